"""Training-corpus pipeline: quality, line dedup, near-duplicates, personal data, packing.

``STAGES`` is the list of (name, function).  A function takes (spark, docs, sf_dir) and returns
a DataFrame; its output is written as Parquet and reread as the next one's ``docs``.  All but the
last return the columns of ``documents``; the last returns packed pieces.

Odd rows: a null text counts as empty in every stage and stays null; rows with a null doc_id are
treated like others, only line dedup leaves them as they are and near-duplicates prefers rows
with an id; repeated rows are near-duplicates of each other (of rows with equal id and text, the one whose other columns come
first as JSON stays); an empty table goes through; other columns may have any name and type.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm import lines, near_copies, packing, personal, quality
from evidara.llm.base import read, session, texts, unused
from evidara.session import shared_folder

# A document goes if its quality score is below this.
LEAST_QUALITY = 0.5
# The stages hash words and shingles; SQL has no expression for most of them.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, does not reject."""
    session(spark)
    forest = quality.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    score = unused("_quality_score", docs)
    kept = quality.scored(docs, forest, score).where(F.col(score) >= LEAST_QUALITY)
    return kept.drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat a recurring template elsewhere."""
    session(spark)
    return lines.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard of 0.8 or more).

    It is the one with the smallest id (of equal ids, the smallest hash).
    """
    session(spark)
    heads = near_copies.heads(texts(docs), "_hash").withColumnRenamed("doc_id", "_id")
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    rest = F.struct(F.lit(0), *[F.col(f"`{name}`") for name in docs.columns if name not in ("doc_id", "text")])
    # Equal ids and texts are told apart by their other columns; as JSON, as maps have no order.
    own = docs.select(
        row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
        F.to_json(rest).alias("rest"),
    )
    kept = own.join(heads, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    equal = Window.partitionBy("id", "hash").orderBy("rest")
    kept = kept.withColumn("nth", F.row_number().over(equal)).where("nth = 1")
    return kept.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    session(spark)
    return personal.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into windows."""
    session(spark)
    return packing.packed(packing.pieces(texts(docs)))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each output is written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
