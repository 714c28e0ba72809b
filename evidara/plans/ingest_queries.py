"""Files to chunks, retrieval and readings over the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions import vocab as V
from evidara.operators import ingest, search, signals
from evidara.plans import standins as S
from evidara.plans import twin as Q
from evidara.plans.registry import query, spread
from evidara.session import settle
from evidara.sources import files as FS
from evidara.sources import readings

# -- files derived from the tables ------------------------------------------------
EXTENSIONS = [".txt", ".csv", ".pdf", ".docx", ".md", ".xlsx"]


def as_files(df: DataFrame, path, content) -> DataFrame:
    """Rows in the ``binaryFile`` layout."""
    return df.select(
        "*", path.alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
        F.length(content).cast("bigint").alias("length"), content.alias("content"),
    )


def document_files(t) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return as_files(t.documents.select("doc_id", "lang", "source", "text"), path, F.encode("text", "UTF-8"))


def with_tables(files: DataFrame) -> DataFrame:
    """The same files, where those named .csv hold a small table instead of prose."""
    table = F.concat(F.lit("id,lang\n"), F.col("doc_id").cast("string"), F.lit(","), "lang", F.lit("\n"))
    return files.withColumn("content", F.when(F.col("doc_id") % 6 == 1, F.encode(table, "UTF-8")).otherwise(F.col("content")))


REASONS_SQL = """CASE doc_id % 6 WHEN 2 THEN 'PDF signature validation failed.' WHEN 3 THEN '.docx file is not a valid ZIP container.'
  WHEN 4 THEN 'Unsupported file type: .md' WHEN 5 THEN '.xlsx file is not a valid ZIP container.' END"""


@query("upload_gate", "A8 A1", f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 AND doc_id % 6 <> 4 THEN 'Unsupported MIME type for ' || (['.txt', '.csv', '.pdf', '.docx', '.md', '.xlsx'])[doc_id % 6 + 1] || ': image/png' ELSE {REASONS_SQL} END AS reject_reason FROM documents")
def _(t):
    kind = F.when(F.col("doc_id") % 11 == 0, "image/PNG; q=1").otherwise("")
    named = FS.named_files(document_files(t).withColumn("content_type", kind))
    return named.select("doc_id", FS.reject_reason(content_type="content_type").alias("reject_reason"))


STATUS_SQL = f"""WITH u AS (SELECT lang, doc_id, text, {REASONS_SQL} AS reason FROM documents),
 s AS (SELECT *, CASE WHEN reason IS NULL THEN min(doc_id) FILTER (reason IS NULL) OVER (PARTITION BY lang, text) END AS first_id FROM u)
 SELECT lang, doc_id, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN first_id < doc_id THEN 'duplicate' ELSE 'uploaded' END AS status, first_id AS stored_id FROM s"""


def upload_statuses(t) -> DataFrame:
    gate = FS.named_files(document_files(t)).select(
        F.col("lang").alias("workspace_id"), F.col("doc_id").alias("ord"), "filename", FS.reject_reason().alias("reject_reason"),
        ingest.content_hash("content").alias("content_hash"),
    )
    return ingest.classify_uploads(gate)


@query("upload_statuses", "A1 A9", f"SELECT doc_id, status, stored_id FROM ({STATUS_SQL})")
def _(t):
    return upload_statuses(t).select(F.col("ord").alias("doc_id"), "status", "stored_id")


@query("content_hash_dedup", "A9 D15", """
SELECT doc_id, sha256(text) AS content_hash, first_id < doc_id AS duplicate, first_id AS stored_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)""")
def _(t):
    uploads = t.documents.select(
        F.lit("w").alias("workspace_id"), F.col("doc_id").alias("ord"), F.col("source").alias("filename"),
        ingest.content_hash("text").alias("content_hash"), F.lit(None).cast("string").alias("reject_reason"),
    )
    rows = ingest.classify_uploads(uploads)
    return rows.select(F.col("ord").alias("doc_id"), "content_hash", (F.col("status") == "duplicate").alias("duplicate"), "stored_id")


@query("ingest_outcome_summary", "A10", f"SELECT lang AS workspace_id, count(*) AS total_files, count(*) FILTER (status = 'uploaded') AS uploaded_count, count(*) FILTER (status = 'duplicate') AS duplicate_count, count(*) FILTER (status = 'failed') AS failed_count FROM ({STATUS_SQL}) GROUP BY lang")
def _(t):
    return ingest.outcome_summary(upload_statuses(t), ["workspace_id"])


@query("whole_text_scan", "A3", r"SELECT doc_id, length(text)::INTEGER AS characters, md5(text) AS digest, 'plain-text' AS parser FROM documents")
def _(t):
    # Windows line ends and a stray invalid byte in front must not show in the result.
    content = F.concat(F.lit(b"\xff"), F.encode(F.regexp_replace("text", "\n", "\r\n"), "UTF-8"))
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    parsed = FS.parse_files(as_files(t.documents.select("doc_id", "text"), path, content).drop("text"))
    doc = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    return parsed.select(doc.alias("doc_id"), F.length("text").alias("characters"), F.md5("text").alias("digest"), "parser")


@query("csv_page_text", "A4", "SELECT c_custkey, 'id,name,note' || chr(10) || c_custkey || ',' || c_name || ',\"a, b\"' || chr(10) || c_nationkey || ',,x' || chr(10) AS text FROM customer")
def _(t):
    body = F.concat_ws(
        "\n", F.lit("id,name,note"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.lit('"a, b"')),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(',"",x')),
    )
    path = F.concat(F.col("c_custkey").cast("string"), F.lit(".csv"))
    # Files are parsed one by one, so their rows are dealt over the cores first.
    rows = spread(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    parsed = FS.parse_files(as_files(rows, path, F.encode(body, "UTF-8")))
    return parsed.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("c_custkey"), "text")


def _zip(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return buffer.getvalue()


def _escape(text: str) -> str:
    from xml.sax.saxutils import escape

    return escape("".join(c for c in text if c >= " " or c in "\t"))


@F.pandas_udf(T.BinaryType())
def docx_bytes(texts: pd.Series) -> pd.Series:
    """A minimal word container: one paragraph per line, and a table with the first two words."""

    def build(text: str) -> bytes:
        head = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
        cells = "".join(f"<w:tc><w:p><w:r><w:t>{_escape(w)}</w:t></w:r></w:p></w:tc>" for w in text.split()[:2])
        xml = f"<w:document {head}><w:body>{body}<w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>"
        return _zip({"[Content_Types].xml": "<Types/>", "word/document.xml": xml})

    return texts.map(build)


@query("docx_page_text", "A6 A8", """
SELECT conv_id, turn, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) || chr(10)
  || array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:2], ' | ')) AS digest, NULL::VARCHAR AS reject_reason FROM conversations""")
def _(t):
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    files = as_files(t.conversations.select("conv_id", "turn", "text"), F.concat(key, F.lit(".docx")), docx_bytes("text")).drop("text")
    named = FS.named_files(files)
    reasons = named.select("path", FS.reject_reason().alias("reject_reason"))
    parsed = FS.parse_files(named).select("path", F.md5("text").alias("digest"))
    joined = parsed.join(reasons, "path")
    ids = F.split(F.regexp_replace("path", r"\.docx", ""), "-")
    return joined.select(ids[0].cast("bigint").alias("conv_id"), ids[1].cast("bigint").alias("turn"), "digest", "reject_reason")


@F.pandas_udf(T.BinaryType())
def xlsx_bytes(keys: pd.Series, names: pd.Series, amounts: pd.Series) -> pd.Series:
    """A minimal workbook with two sheets: strings, integers, decimals and an empty cell."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def build(key: int, name: str, amount: float) -> bytes:
        text = lambda ref, s: f'<c r="{ref}" t="inlineStr"><is><t>{_escape(s)}</t></is></c>'
        one = (
            f'<row r="1">{text("A1", "key")}{text("B1", "name")}{text("C1", "amount")}</row>'
            f'<row r="2"><c r="A2"><v>{key}</v></c>{text("B2", name)}<c r="C2"><v>{amount!r}</v></c></row>'
            f'<row r="3"><c r="A3"><v>{key + 1}</v></c><c r="C3"><v>0.5</v></c></row>'
        )
        two = f'<row r="1">{text("A1", "only")}</row><row r="2"><c r="A2"><v>{key}.0</v></c></row>'
        sheet = lambda rows: f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>"
        return _zip(
            {
                "[Content_Types].xml": "<Types/>",
                "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="Stock" sheetId="1" r:id="rId1"/><sheet name="Keys" sheetId="2" r:id="rId2"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
                "xl/worksheets/sheet1.xml": sheet(one),
                "xl/worksheets/sheet2.xml": sheet(two),
            }
        )

    return pd.Series([build(int(k), n, float(a)) for k, n, a in zip(keys, names, amounts)])


@query("xlsx_page_text", "A5", """
SELECT s_suppkey, 'Sheet: Stock' || chr(10) || 'key,name,amount' || chr(10) || s_suppkey || ',' || s_name || ',' || s_acctbal || chr(10) || (s_suppkey + 1) || ',,0.5' || chr(10) || chr(10)
  || 'Sheet: Keys' || chr(10) || 'only' || chr(10) || s_suppkey || chr(10) AS text, 2 AS tables FROM supplier""")
def _(t):
    files = as_files(
        t.supplier.select("s_suppkey", "s_name", "s_acctbal"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".xlsx")),
        xlsx_bytes("s_suppkey", "s_name", "s_acctbal"),
    )
    parsed = FS.parse_files(files)
    return parsed.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("s_suppkey"), "text", F.col("extracted_tables_count").alias("tables"))


@query("parser_dispatch", "A7 A1 L12", """
SELECT CASE doc_id % 6 WHEN 0 THEN 'plain-text' WHEN 1 THEN 'pandas-csv' ELSE 'error' END AS parser, count(*) AS files,
 sum(CASE doc_id % 6 WHEN 0 THEN length(text) WHEN 1 THEN length('id,lang' || chr(10) || doc_id || ',' || lang || chr(10)) ELSE 0 END)::BIGINT AS characters FROM documents GROUP BY 1""")
def _(t):
    files = with_tables(document_files(t)).drop("text")
    parsed = FS.parse_files(files).withColumn("parser", F.coalesce("parser", F.lit("error")))
    return parsed.groupBy("parser").agg(F.count("*").alias("files"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters"))


@query("typed_readings", "A2", """
SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 7 = 3 THEN 0.0 ELSE value END AS value, ts FROM events""")
def _(t):
    raw = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.when(F.col("event_id") % 7 == 3, "f").otherwise(" "))).alias("value"),
        F.col("ts").cast("string").alias("ts"),
    )
    return readings.typed(raw, ["value"], ["ts"])


# -- chunking --------------------------------------------------------------------
PAGED = "SELECT source AS document_id, doc_id AS page, text FROM documents"


def paged(t) -> DataFrame:
    return t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), "text")


@query("word_window_chunks", "F1", Q.chunks(PAGED, V.CHUNK_WORDS, V.CHUNK_OVERLAP))
def _(t):
    return ingest.chunk_pages(paged(t), ["document_id"])


@query("retrieval_chunks", "F1", f"SELECT document_id, count(*) AS chunks, max(chunk_index) AS last_index, sum(length(text))::BIGINT AS characters FROM ({Q.chunks(PAGED, 90, 20)}) GROUP BY document_id")
def _(t):
    chunks = ingest.chunk_pages(paged(t), ["document_id"], V.RETRIEVAL_CHUNK_WORDS, V.RETRIEVAL_CHUNK_OVERLAP)
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"), F.sum(F.length("text")).alias("characters")
    )


@query("ingested_documents", "A15 A1 A7 A9 A10", f"""
WITH d AS (SELECT lang AS workspace_id, min(doc_id) AS id, text FROM documents GROUP BY lang, text),
 c AS ({Q.chunks("SELECT id AS document_id, 1 AS page, text FROM d", V.CHUNK_WORDS, V.CHUNK_OVERLAP)})
SELECT d.workspace_id, d.id, length(d.text)::INTEGER AS characters, sha256(d.text) AS content_hash, coalesce(n, 0) AS chunks
FROM d LEFT JOIN (SELECT document_id, count(*) AS n FROM c GROUP BY document_id) k ON k.document_id = d.id""")
def _(t):
    from evidara.plans.analysis import ingest_files

    # Paths repeat inside and across workspaces; an upload is known by workspace and order.
    path = F.concat(F.lit("/in/"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt"))
    files = as_files(t.documents.select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("ord"), "doc_id", "text"), path, F.encode("text", "UTF-8")).drop("text")
    out = ingest_files(files)
    counts = out["chunks"].groupBy("workspace_id", F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"))
    docs = out["documents"].select("workspace_id", "id", F.length("parsed_text").alias("characters"), "content_hash")
    return docs.join(counts, ["workspace_id", "id"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


@query("source_pages", "E12", f"""
SELECT document_id AS filename, page, string_agg(text, ' ' ORDER BY first_index) AS text FROM (
 SELECT document_id, page, text, min(chunk_index) AS first_index FROM ({Q.chunks(PAGED, V.CHUNK_WORDS, V.CHUNK_OVERLAP)}) GROUP BY ALL) GROUP BY ALL""")
def _(t):
    chunks = ingest.chunk_pages(paged(t), ["document_id"])
    doubled = chunks.unionByName(chunks.withColumn("chunk_index", F.col("chunk_index") + 1_000_000_000))
    renamed = doubled.withColumnRenamed("document_id", "filename")
    return ingest.source_pages(renamed, ["filename", "page"], "chunk_index")


PACK_SQL = """
WITH RECURSIVE b AS (SELECT lang AS workspace_id, doc_id AS id, length('Source: ' || source || chr(10) || 'Page: 1' || chr(10) || 'Text:' || chr(10) || text) AS len,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
 g AS (SELECT workspace_id, id, n, len AS filled, 0::BIGINT AS batch FROM b WHERE n = 1
  UNION ALL SELECT b.workspace_id, b.id, b.n, CASE WHEN g.filled + b.len > 12000 THEN b.len ELSE g.filled + b.len END, g.batch + CASE WHEN g.filled + b.len > 12000 THEN 1 ELSE 0 END
  FROM g JOIN b ON b.workspace_id = g.workspace_id AND b.n = g.n + 1)
SELECT workspace_id, id, batch FROM g"""


def packed(t) -> DataFrame:
    chunks = t.documents.select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.lit(1).alias("page"), "text")
    return ingest.evidence_batches(chunks, segment=200)


@query("evidence_batches", "E13", PACK_SQL)
def _(t):
    return packed(t).select("workspace_id", "id", "batch")


@query("evidence_batch_texts", "E13 B38", f"""
SELECT p.workspace_id, batch, count(*) AS blocks, md5(string_agg('Source: ' || source || chr(10) || 'Page: 1' || chr(10) || 'Text:' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS digest
FROM ({PACK_SQL}) p JOIN documents d ON d.doc_id = p.id GROUP BY p.workspace_id, batch""")
def _(t):
    return ingest.batch_texts(packed(t)).select("workspace_id", "batch", "blocks", F.md5("text").alias("digest"))


# -- lexical retrieval -----------------------------------------------------------
CHUNKS_SQL = Q.chunks(PAGED, V.RETRIEVAL_CHUNK_WORDS, V.RETRIEVAL_CHUNK_OVERLAP)


def corpus(t) -> DataFrame:
    """Retrieval chunks of all documents; the file name is the source."""
    chunks = ingest.chunk_pages(paged(t), ["document_id"], V.RETRIEVAL_CHUNK_WORDS, V.RETRIEVAL_CHUNK_OVERLAP, window="window")
    return chunks.select(F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"), F.concat("document_id", F.lit(".txt")).alias("document"), "page", "chunk_index", "window", F.xxhash64("text").alias("text_hash"), "text")


QUESTIONS_SQL = "SELECT item_id AS query_id, text || ' SRC7 what WO-12 42' AS query FROM benchmark"


def questions(t) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" SRC7 what WO-12 42")).alias("query"))


def lexical_sql(questions_sql: str, k: int) -> str:
    return f"""
WITH c AS MATERIALIZED (SELECT document_id || '#' || chunk_index AS chunk_id, document_id || '.txt' AS document, page, chunk_index, {Q.tokens('text')} AS toks FROM ({CHUNKS_SQL})),
 q AS (SELECT query_id, {Q.query_terms('query')} AS terms FROM ({questions_sql})),
 w AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY ALL),
 v AS (SELECT DISTINCT term FROM w),
 tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM c) SEMI JOIN v USING (term) GROUP BY ALL),
 idf AS (SELECT term, ln(((SELECT count(*) FROM c) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
 nm AS (SELECT chunk_id, unnest(list_distinct({Q.tokens('document')})) AS term FROM c),
 parts AS (
  SELECT query_id, chunk_id, weight * ((1 + ln(tf)) * idf + CASE WHEN regexp_full_match(term, '[a-z]{{1,8}}-\\d+[a-z0-9-]*|\\d+(?:\\.\\d+)?') THEN 2.0 ELSE 0.0 END) AS part FROM tf JOIN w USING (term) JOIN idf USING (term)
  UNION ALL SELECT query_id, chunk_id, weight * 0.5 * coalesce(idf, 1.0) FROM nm JOIN w USING (term) LEFT JOIN idf USING (term)
  UNION ALL SELECT query_id, chunk_id, 1.25 * weight FROM
   (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS pair FROM c)
   JOIN (SELECT query_id, pair, count(*) AS weight FROM (SELECT query_id, unnest(list_transform(range(1, len(terms)), lambda i: terms[i] || ' ' || terms[i + 1])) AS pair FROM q) GROUP BY ALL) USING (pair)),
 scored AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL),
 ranked AS (SELECT query_id, chunk_id, document, page, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, page, chunk_index) AS rank FROM scored JOIN c USING (chunk_id) WHERE score > 0)
SELECT query_id, chunk_id, page, round(score, 4) AS score, rank FROM ranked WHERE rank <= {k}"""


def lexical_hits(t, k: int) -> DataFrame:
    return t.once(f"hits{k}", lambda: settle(search.lexical_top_k(corpus(t), questions(t), k, carried=["window", "text_hash"])))


# Chunks up to which hits go to the pages instead of meeting them in a shuffle.
FEW = 20_000


def hit_texts(t, hits: DataFrame) -> DataFrame:
    """chunk_id, text of the chunks that were hit: their windows are cut from their pages, no other chunk is made again.

    Of pages with equal keys the hash tells which one a chunk came from.
    """
    wanted = hits.select("chunk_id", "document", "page", "window", "text_hash").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    pages = paged(t).select(F.concat("document_id", F.lit(".txt")).alias("document"), "page", F.col("text").alias("page_text"))
    text = ingest.window_text("page_text", "window", V.RETRIEVAL_CHUNK_WORDS, V.RETRIEVAL_CHUNK_OVERLAP)
    cut = pages.join(wanted, ["document", "page"]).withColumn("text", text)
    return cut.where(F.xxhash64("text") == F.col("text_hash")).groupBy("chunk_id", "text_hash").agg(F.min("text").alias("text"))


@query("lexical_search", "G2 D17", lexical_sql(QUESTIONS_SQL, 6))
def _(t):
    return lexical_hits(t, 6).select("query_id", "chunk_id", "page", F.round("score", 4).alias("score"), "rank")


@query("inverse_document_frequency", "E17", f"""
SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 9) AS idf FROM (SELECT unnest(list_distinct({Q.tokens('text')})) AS term FROM documents) GROUP BY term""")
def _(t):
    return search.inverse_document_frequencies(t.documents).select("term", "df", F.round("idf", 9).alias("idf"))


@query("term_frequency", "E18", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({Q.tokens('text')}) AS term FROM documents) GROUP BY ALL")
def _(t):
    return search.term_frequencies(t.documents, ["doc_id"])


# -- vectors ---------------------------------------------------------------------
CENTROIDS_SQL = "SELECT label AS query_id, list(v ORDER BY i) AS embedding FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label"


def centroids(t) -> DataFrame:
    flat = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"])
    return means.groupBy(F.col("label").alias("query_id")).agg(vector.alias("embedding"))


def cosine_sql(k: int) -> str:
    return f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
 SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM (
  SELECT q.query_id, e.vec_id, list_cosine_similarity(q.embedding, e.embedding::DOUBLE[]) AS cosine, greatest(0.0, cosine) AS score FROM ({CENTROIDS_SQL}) q, embeddings e)) WHERE rank <= {k}"""


@query("vector_search", "G1 D20", cosine_sql(6))
def _(t):
    top = search.cosine_top_k(t.embeddings, centroids(t), 6, "vec_id")
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("vector_search_scoped", "G1 C1 C2", f"""
SELECT workspace_id, query_id, vec_id, round(greatest(0.0, cosine), 6) AS score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY workspace_id, query_id ORDER BY cosine DESC, vec_id) AS rank FROM (
  SELECT e.vec_id % 4 AS workspace_id, q.query_id, e.vec_id, (CASE WHEN q.query_id % 2 = 1 THEN -1 ELSE 1 END) * list_cosine_similarity(q.embedding, e.embedding::DOUBLE[]) AS cosine
  FROM ({CENTROIDS_SQL}) q, embeddings e WHERE q.query_id % 2 = 0 OR e.label = q.query_id)) WHERE rank <= 6""")
def _(t):
    # Four workspaces and, for odd labels, the label as a type; those queries point away from all they see.
    space = t.embeddings.select((F.col("vec_id") % 4).alias("workspace_id"), "vec_id", "label", "embedding")
    spaces = space.select("workspace_id").distinct()
    odd = F.col("query_id") % 2 == 1
    turned = F.when(odd, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    asked = centroids(t).withColumn("workspace_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])))
    asked = asked.withColumn("embedding", turned).join(spaces, "workspace_id")
    any_type = search.cosine_top_k(space, asked.where(~odd), 6, "vec_id", scope=["workspace_id"])
    typed = search.cosine_top_k(space, asked.where(odd).withColumn("label", F.col("query_id")), 6, "vec_id", scope=["workspace_id", "label"])
    columns = ["workspace_id", "query_id", "vec_id", F.round("score", 6).alias("score"), "rank"]
    return any_type.select(*columns).unionByName(typed.select(*columns))


@query("vector_search_typed", "G1 C2", """
SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, greatest(0.0, list_cosine_similarity(q.v, e.embedding::DOUBLE[])) AS score FROM embeddings e,
 (SELECT list(v ORDER BY i) AS v FROM (SELECT i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY i)) q WHERE label = 3) ORDER BY score DESC, vec_id LIMIT 6""")
def _(t):
    top = search.cosine_top_k(t.embeddings.where(F.col("label") == 3), _mean(t), 6, "vec_id")
    return top.select("vec_id", F.round("score", 6).alias("score"))


def _mean(t) -> DataFrame:
    means = t.embeddings.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"])
    return means.agg(vector.alias("embedding")).withColumn("query_id", F.lit(0))


# -- readings --------------------------------------------------------------------
@query("threshold_breaches", "F8", "SELECT user_id, event_type, count(*) FILTER (value > 20) AS breach_count, max(value) AS peak_value FROM events GROUP BY ALL")
def _(t):
    return signals.threshold_breaches(t.events, ["user_id", "event_type"], "value", 20.0)


@query("rising_trends", "F7", """
SELECT user_id, event_type, count(*) AS points, bool_and(p IS NULL OR p <= value) AS increasing, CASE WHEN count(*) >= 2 THEN round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 4) ELSE 0.0 END AS trend_delta
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) GROUP BY ALL""")
def _(t):
    return signals.rising_trends(t.events, ["user_id", "event_type"], "ts", "value", "event_id")


@query("completion_intervals", "F9", """
SELECT o_custkey, coalesce(max(d) FILTER (r = 1)::DATE - max(d) FILTER (r = 2)::DATE, 0)::INTEGER AS completed_gap_days
FROM (SELECT o_custkey, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 2 GROUP BY o_custkey""")
def _(t):
    return signals.last_interval(t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day")), ["o_custkey"], "day", ["o_orderkey"])


@query("dates_in_text", "F9", """
SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders""")
def _(t):
    line = F.concat(F.lit("Completed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", missing 2024-99-99."))
    found = signals.dates_in_text(t.orders.select("o_custkey", "o_orderkey", line.alias("text")), ["o_custkey", "o_orderkey"])
    return found.select("o_custkey", "o_orderkey", "day")


@query("stock_minimum", "L7", """
SELECT part, asset, available_qty, minimum_qty, status, available_qty < minimum_qty AND status = 'R' AS stockout FROM (
 SELECT l_partkey AS part, l_suppkey AS asset, arg_min(l_quantity, k) AS available_qty, arg_min(l_tax * 1000, k) AS minimum_qty, arg_min(l_returnflag, k) AS status
 FROM (SELECT *, (l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) GROUP BY ALL)""")
def _(t):
    stock = t.lineitem.select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("asset"), F.col("l_quantity").alias("available_qty"), (F.col("l_tax") * 1000).alias("minimum_qty"),
        F.col("l_returnflag").alias("status"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("k"),
    )
    return signals.stock_checks(stock, ["part", "asset"], "k", "R")


@query("latest_events_per_asset", "F2", f"""{S.WITH}
SELECT asset_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, asset_id ORDER BY event_date DESC,
 CASE event_type WHEN 'Incident' THEN 5 WHEN 'Inspection' THEN 3 WHEN 'Service' THEN 2 WHEN 'Work Order' THEN 1 ELSE 0 END DESC, id DESC) AS rank FROM events_t) WHERE rank <= 4""")
def _(t):
    from evidara.operators.graph import limit_events

    return limit_events(S.events(t)).select("asset_id", "id", "rank")


@query("worst_gaps_per_asset", "F3", f"""{S.WITH}
SELECT asset_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, asset_id ORDER BY CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, id DESC) AS rank FROM gaps_t) WHERE rank <= 3""")
def _(t):
    from evidara.operators.graph import limit_gaps

    return limit_gaps(S.gaps(t)).select("asset_id", "id", "rank")


@query("latency_p95", "E21", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(t):
    from evidara.operators.scorecard import exact_percentile

    return exact_percentile(t.events, ["event_type"], "value", 0.95, "p95").withColumn("p95", F.round("p95", 6))
