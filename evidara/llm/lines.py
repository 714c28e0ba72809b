"""Line dedup by a log-template tree of fixed depth.

A line is parsed to tokens; tokens with digits or an at-sign are variable fields and become
``<*>``.  The tree goes by the number of tokens, then by the leading ``LEAD`` tokens; a leaf
holds the masked lines that arrive there.  A template of a leaf is a masked line with ``FREE`` of its
``BANDS`` equal stretches of tokens left open: lines that agree in all tokens of all other stretches follow
it, so a leaf has as many templates as its lines need, and every token is either compared or in
an open stretch.  (A stretch is compared by 32 bits of a hash.)  A line with fields
that has fewer than ``CONSTANT`` other tokens, or more fields than other tokens, such as a row of
a table, is not masked, follows no template, and recurs only as a whole.

A line recurs if the same masked line is found in at least two documents, a template if
different lines of at least two documents follow it.  The size of a line is its number of tokens, plus half of
its characters in scripts without blanks.  Lines of a size below ``SHORT`` follow no template; alone they need
``SHORT_DOCUMENTS`` documents and ``LEAST`` tokens, but they are also judged in their run: from every line on,
the fewest non-empty lines that make up a size of ``RUN`` are a run if one of them is short, and a run that is found word
for word in at least two documents recurs with all its lines.
Of what recurs the first occurrence (smallest doc_id, then position) stays, all others are
dropped.  A dropped line thus has an earlier equal, or an earlier one of its template; as templates overlap,
that one may itself have gone for a still earlier one, so the first of such a chain is what stays.

All counting is by map-side aggregates over hashes of lines.  A line that a third of all
documents share meets its decision in a join on the line hash, which the adaptive engine splits.

Defined results: a null text stays null, an empty one empty; an empty line is never dropped;
rows with equal doc_id count as one document, and equal rows lose the same lines; rows with a
null doc_id lose no line and count for none; a document that loses all lines stays with an
empty text; very long texts and lines are parsed whole; an empty table stays empty; other columns
are kept whatever their names and types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.base import settle

LEAD, BANDS, FREE = 4, 8, 2
SHORT, SHORT_DOCUMENTS, LEAST = 10, 20, 3
RUN = 30
CONSTANT = 3
FIELD = b"<*>"

_VARIABLE = re.compile(rb"[0-9@]")
# Thai to Khmer, kana, Chinese characters: scripts that are written without blanks.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")


def tokens(words: list[bytes]) -> tuple[list[bytes], bool]:
    """Tokens with variable fields masked, and whether the line is left as it is, like a row of a table."""
    masked = [FIELD if _VARIABLE.search(w) else w for w in words]
    constant = len(words) - masked.count(FIELD)
    bare = constant < CONSTANT or 2 * constant < len(words)
    return (words, True) if bare else (masked, False)


def bands(t: list[bytes]) -> bytes:
    """Hashes of the stretches of a line, four bytes each."""
    cuts = [b * len(t) // BANDS for b in range(BANDS + 1)]
    return b"".join(xxhash.xxh32_digest(b" ".join(t[i:j])) for i, j in zip(cuts, cuts[1:], strict=False))


def entries(text: str) -> Iterator[tuple[int, int, int, int | None, bool, bytes | None]]:
    """Position, number of lines, hash, leaf, whether short, stretches: of each line, then of each run."""
    at: list[tuple[int, int, bytes]] = []
    for pos, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if not words:
            continue
        n = size = len(words)
        if not line.isascii():
            size += len(_UNSPACED.findall(line.decode("utf-8", "surrogatepass"))) // 2
        plain = b" ".join(words)
        at.append((pos, size, plain))
        t, bare = tokens(words) if _VARIABLE.search(line) else (words, False)
        whole = plain if t is words else b" ".join(t)
        short = size < SHORT
        if short and n < LEAST:
            continue
        code = xxhash.xxh3_64_intdigest(whole)
        if short or bare:
            yield pos, 1, code, None, short, None
        else:
            yield pos, 1, code, xxhash.xxh3_64_intdigest(b" ".join(t[:LEAD]), n), short, bands(t)
    total, end, brief = 0, 0, 0
    for start, (pos, size, _) in enumerate(at):
        while total < RUN and end < len(at):
            total += at[end][1]
            brief += at[end][1] < SHORT
            end += 1
        if total < RUN:
            break
        if brief:
            run = b"\n".join(plain for _, _, plain in at[start:end])
            yield pos, at[end - 1][0] - pos + 1, xxhash.xxh3_64_intdigest(run, 1), None, False, None
        total -= size
        brief -= size < SHORT


def parsed(docs: DataFrame) -> DataFrame:
    """One narrow row per non-empty line and per run; ``key`` tells rows of one doc_id apart."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    fields = [("pos", T.IntegerType()), ("span", T.IntegerType()), ("line", T.LongType()), ("leaf", T.LongType()),
              ("short", T.BooleanType()), ("bands", T.BinaryType())]
    schema = T.StructType([*known.schema.fields[:2], *[T.StructField(name, kind) for name, kind in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda code: None if code is None else code - ((code >> 63) << 64)
        for batch in batches:
            owner, found = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                before = len(found)
                found.extend(entries(text))
                owner.extend([row] * (len(found) - before))
            if not found:
                continue
            pos, span, line, leaf, short, stretches = zip(*found, strict=True)
            take = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(span, pa.int32()),
                 pa.array(np.array(line, np.uint64).view(np.int64)), pa.array(map(signed, leaf), pa.int64()),
                 pa.array(short, pa.bool_()), pa.array(stretches, pa.binary())],
                names=schema.names,
            )

    return known.mapInArrow(run, schema)


def templates() -> list:
    """For each choice of open stretches: a hash of the leaf, the choice and all other stretches."""
    made = []
    for choice in combinations(range(BANDS), FREE):
        edges = [-1, *choice, BANDS]
        kept = [F.substring("bands", 4 * a + 5, 4 * (b - a - 1)) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
        made.append(F.xxhash64("leaf", *[F.lit(c) for c in choice], F.concat(*kept)))
    return made


def recurring(rows: DataFrame) -> DataFrame:
    """line -> its first occurrence, for all lines and runs that recur or follow a template that recurs."""
    lines = rows.groupBy("line", "leaf", "short", "bands").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times")
    )
    twice = F.col("first.doc_id") < F.col("last")
    exact = lines.where(twice & ~F.col("short")).select("line", "first")
    # Short lines: documents are counted, first inside each document.
    maybe = lines.where(twice & F.col("short") & (F.col("times") >= SHORT_DOCUMENTS))
    often = rows.where("short").groupBy("line", "doc_id").agg(F.lit(1).alias("one"))
    enough = often.groupBy("line").agg(F.count("*").alias("documents")).where(F.col("documents") >= SHORT_DOCUMENTS)
    brief = maybe.join(enough.select("line"), "line").select("line", "first")
    # Leaves with several lines, from several documents: their templates.
    placed = lines.where(F.col("leaf").isNotNull())
    leaves = placed.groupBy("leaf").agg(F.count("*").alias("members"), F.min("first.doc_id").alias("low"), F.max("last").alias("high"))
    shared = placed.join(leaves.where("members > 1 AND low < high").select("leaf"), "leaf")
    following = shared.select("line", "first", "last", F.explode(F.array(*templates())).alias("template"))
    groups = following.groupBy("template").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.count("*").alias("members"))
    groups = groups.where((F.col("members") > 1) & (F.col("start.doc_id") < F.col("end")))
    general = following.join(groups.select("template", "start"), "template").select("line", F.col("start").alias("first"))
    return exact.unionByName(brief).unionByName(general).groupBy("line").agg(F.min("first").alias("first"))


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, text -> key, doc_id, positions of the lines that go."""
    rows = settle(parsed(docs))
    hit = rows.select("doc_id", "key", "pos", "span", "line").join(recurring(rows), "line")
    gone = hit.where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.pos") != F.col("pos")))
    places = F.explode(F.sequence("pos", F.col("pos") + F.col("span") - 1))
    return gone.select("key", "doc_id", places.alias("pos")).groupBy("key", "doc_id").agg(F.collect_set("pos").alias("gone"))


@F.pandas_udf(T.BinaryType())
def _pressed(text: pd.Series) -> pd.Series:
    """Texts compressed one by one, as they travel to what they lose."""
    press = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([None if x is None else press(x.encode("utf-8", "surrogatepass")) for x in text], dtype=object)


@F.pandas_udf(T.StringType())
def _without(pressed: pd.Series, gone: pd.Series) -> pd.Series:
    """Compressed texts without the non-empty lines at given positions (null: none)."""
    unpress = zstandard.ZstdDecompressor().decompress

    def cut(data: bytes | None, places) -> str | None:
        if data is None:
            return None
        whole = unpress(data)
        if places is not None:
            away = set(places)
            whole = b"\n".join(line for i, line in enumerate(whole.split(b"\n")) if i not in away or not line.strip())
        return whole.decode("utf-8", "surrogatepass")

    return pd.Series([cut(a, b) for a, b in zip(pressed, gone, strict=True)], dtype=object)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that repeat what recurs; all columns are kept."""
    gone = dropped(docs.select("doc_id", "text"))
    others = F.struct(*[F.col(f"`{name}`") for name in docs.columns if name != "text"])
    own = docs.select(
        others.alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", "text").alias("own_key"), _pressed("text").alias("pressed")
    )
    both = own.join(gone, (F.col("own_key") == F.col("key")) & (F.col("own_id") == F.col("doc_id")), "left")
    kept = [_without("pressed", "gone") if name == "text" else F.col("row").getField(name) for name in docs.columns]
    return both.select(*[column.alias(name) for column, name in zip(kept, docs.columns, strict=True)])
