"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import align, bpe, chat, exact, katz, lines, mixing, nearest, packing, personal, quality, ranked, simhash
from evidara.llm.base import bucket_of, read, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its window and place there."""
    return packing.packed(packing.pieces(texts(read(spark, folder, "documents"))))


@register
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(texts(read(spark, folder, "documents")))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@register
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that repeat a recurring template, and what went."""
    docs = texts(read(spark, folder, "documents"))
    left = lines.deduplicated(docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")))
    return left.select("doc_id", "n_lines", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


@register
def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest found by inner product for every twentieth vector."""
    vectors = nearest.usable(read(spark, folder, "embeddings"))
    return nearest.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


@register
def op5_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents; the rows with remainder 2 are held out of the counts."""
    docs = texts(read(spark, folder, "documents"))
    return katz.scored(docs, bucket_of("doc_id", 7) == 2)


@register
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document; labels of the held-out third are never read for training."""
    docs = texts(read(spark, folder, "documents"))
    forest = quality.fit(docs, read(spark, folder, "labels"), lambda doc_id: ~quality.held_out(doc_id))
    return quality.scored(docs, forest, "score").select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@register
def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests, read back from the formatted text, of all conversations and conversation -1."""
    given = read(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    tricky = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return chat.digests(chat.conversations(given.unionByName(probe)))


ORACLES["op7_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, chr(92), ''), '<', ''), '[', '')) AS body,
         coalesce(lag(role) OVER w, '') AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 15 + length(role)
           + length(role) - length(replace(replace(replace(role, chr(92), ''), '<', ''), '[', '')) END AS marks,
         (before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS fits
  FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + marks) AS BIGINT) AS formatted_chars,
       bool_and(fits) AND arg_max(role, turn) = 'assistant' AS valid
FROM marked GROUP BY conv_id
"""


@register
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them, as digests."""
    return bpe.digests(bpe.encoded(texts(read(spark, folder, "documents"))))


@register
def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best by integer inner product for every fiftieth vector."""
    vectors = exact.quantised(read(spark, folder, "embeddings"))
    return exact.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


@register
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, digest and spans of personal data in every document."""
    return personal.spans_of(texts(read(spark, folder, "documents")))


@register
def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes from every document, by weights of the sources."""
    return mixing.mixed(read(spark, folder, "documents"))


ORACLES["op12_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size, 2 * 2 * sum(size)::HUGEINT AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS weight FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap * 10 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap * 10 / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM sources),
level AS (SELECT rest, others FROM ordered WHERE weight * rest <= cap * others ORDER BY cap * 10 / weight, source LIMIT 1),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN weight * l.rest > cap * l.others THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(weight * l.rest AS DOUBLE) / CAST(l.others * 2 AS DOUBLE) END AS target FROM sources, level l),
goals AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.goal - g.whole * g.source_size AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - earlier)) AS BIGINT) AS taken FROM placed
"""


@register
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that rank highest for every benchmark item."""
    return ranked.top_k(texts(read(spark, folder, "documents")), read(spark, folder, "benchmark"), 10)


ORACLES["op13_ranked_search"] = r"""
WITH words AS (
  SELECT *, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
counts AS (SELECT kind, id, term, count(*) AS tf FROM words GROUP BY kind, id, term),
docs AS (SELECT id, sum(tf)::BIGINT AS n FROM counts WHERE kind = 'd' GROUP BY id),
total AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM docs),
normal AS (SELECT docs.id, 100 - 75 + (75 * docs.n * total.n) // total.l AS m FROM docs, total),
weights AS (
  SELECT term, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts WHERE kind = 'd' GROUP BY term), total),
scored AS (
  SELECT i.id AS item_id, d.id AS doc_id, sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m)))::BIGINT AS score
  FROM counts i JOIN counts d ON i.kind = 'i' AND d.kind = 'd' AND i.term = d.term JOIN weights ON weights.term = d.term JOIN normal ON normal.id = d.id
  GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@register
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens of both tokenizers for every document."""
    return align.scored(texts(read(spark, folder, "documents")))
