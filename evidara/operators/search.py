"""Lexical and vector retrieval for tables of queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions import text as X
from evidara.functions import vocab as V
from evidara.functions.ordering import top_rows
from evidara.operators import postings
from evidara.session import settle


# -- lexical -------------------------------------------------------------------
def term_frequencies(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, tf)."""
    terms = chunks.select(*keys, F.explode(X.search_tokens(text)).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequencies(chunks: DataFrame, keys: list[str] = (), text: str = "text") -> DataFrame:
    """(keys, term, df): in how many chunks a term occurs.  Combined on the map side."""
    terms = chunks.select(*keys, F.explode(F.array_distinct(X.search_tokens(text))).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("df"))


def idf(frequency: Column, total: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1"""
    return F.log((total + 1) / (frequency + 1)) + 1


def inverse_document_frequencies(chunks: DataFrame, text: str = "text") -> DataFrame:
    total = chunks.agg(F.count("*")).scalar()
    return document_frequencies(chunks, text=text).select("term", "df", idf(F.col("df"), total).alias("idf"))


def lexical_top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    query_key: str = "query_id",
    chunk_key: str = "chunk_id",
    carried: Sequence[str] = (),
) -> DataFrame:
    """The k best chunks per query; ties by document, page, chunk index.

    ``carried`` names further columns of the chunks that come along.

    An index is built for this search; keep one by ``postings.create`` where more searches follow.
    """
    index = settle(postings.build(chunks, [chunk_key, "document", "page", "chunk_index", *carried]))
    return postings.top_k(index, queries, k, query_key)


# -- vectors -------------------------------------------------------------------
def cosine_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = V.TOP_CHUNKS,
    id_column: str = "id",
    query_column: str = "query_id",
    scope: Sequence[str] = (),
    slice_rows: int = 8192,
    query_block: int = 1024,
) -> DataFrame:
    """(scope, query, id, score, rank): exact nearest vectors by cosine, score = max(0, cosine).

    ``scope`` names columns that both sides share (workspace, document type); a query sees only
    vectors of its own scope.  Vectors and queries meet in blocks of counted size, one matrix
    product each; a block gives at most k rows per query, which are ranked again.  The order
    is that of the cosine itself, so vectors that all point away are still told apart.
    Rows without a usable vector (null, zero or wrong length) are left out.
    """
    scope = list(scope)
    vectors = vectors.where(F.col("embedding").isNotNull()).select(*scope, id_column, "embedding")
    queries = queries.where(F.col("embedding").isNotNull()).select(*scope, query_column, "embedding")
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    columns = [*scope, query_column, id_column, "score"]
    schema = T.StructType(
        [*[vectors.schema[c] for c in scope], queries.schema[query_column], vectors.schema[id_column], T.StructField("score", T.DoubleType())]
    )
    blocks = lambda rows: F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).cast("int")
    if scope:
        sizes = vectors.groupBy(*scope).agg(blocks(slice_rows).alias("_slices")).join(
            queries.groupBy(*scope).agg(blocks(query_block).alias("_blocks")), scope
        )
        left, right = vectors.join(sizes, scope), queries.join(sizes, scope)
    else:
        sizes = {"_slices": vectors.agg(blocks(slice_rows)).first()[0], "_blocks": queries.agg(blocks(query_block)).first()[0]}
        left, right = (df.withColumns({name: F.lit(n) for name, n in sizes.items()}) for df in (vectors, queries))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.withColumn("_slice", own(id_column, "_slices")).withColumn("_block", every("_blocks")).drop("_slices", "_blocks")
    right = right.withColumn("_block", own(query_column, "_blocks")).withColumn("_slice", every("_slices")).drop("_slices", "_blocks")

    def match(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if part.empty or wanted.empty:
            return pd.DataFrame(columns=columns)
        names, ids, scores = _best(
            part[id_column].to_numpy(), _unit_rows(part["embedding"], dim), wanted[query_column].to_numpy(), _unit_rows(wanted["embedding"], dim), k
        )
        found = pd.DataFrame({query_column: names, id_column: ids, "score": scores})
        for c in scope:
            found[c] = part[c].iloc[0]
        return found[columns]

    keys = [*scope, "_slice", "_block"]
    candidates = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match, schema)
    ranked = top_rows(candidates, [*scope, query_column], [F.desc("score"), F.col(id_column)], k)
    return ranked.withColumn("score", F.greatest(F.lit(0.0), F.col("score")))


def _unit_rows(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows scaled to length one; unusable rows become NaN."""
    rows = np.full((len(vectors), dim), np.nan)
    fit = np.flatnonzero(vectors.map(len).to_numpy() == dim)
    if len(fit):
        rows[fit] = np.stack(vectors.iloc[fit].to_list())
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.full_like(rows, np.nan), where=norms > 0)


def _best(ids: np.ndarray, rows: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query names, ids and cosines of the k best rows of each query; ties go to the smaller id."""
    usable, asked = ~np.isnan(rows).any(axis=1), ~np.isnan(queries).any(axis=1)
    ids, rows, names, queries = ids[usable], rows[usable], names[asked], queries[asked]
    scores = queries @ rows.T
    if scores.shape[1] > k:
        # Every value that ties with the k-th stays until ids are compared.
        floor = np.partition(scores, -k, axis=1)[:, -k, None]
        at, row = np.nonzero(scores >= floor)
    else:
        at, row = np.nonzero(np.ones_like(scores, dtype=bool))
    order = np.lexsort((ids[row], -scores[at, row], at))
    at, row = at[order], row[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return names[at[keep]], ids[row[keep]], scores[at[keep], row[keep]]


def missing_embeddings(chunks: DataFrame) -> DataFrame:
    """Chunks still to be embedded."""
    return chunks.where(F.col("embedding").isNull())


def update_embeddings(chunks: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed column update: new vectors replace or fill stored ones."""
    fresh = new.select(*keys, F.col("embedding").alias("_new"))
    return chunks.join(fresh, keys, "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")
