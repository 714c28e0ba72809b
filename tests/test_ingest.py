"""Files, chunking, page text and packing against plain-Python restatements."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from evidara.functions import ordering as O
from evidara.operators import ingest
from evidara.plans.analysis import ingest_files
from evidara.plans.ingest_queries import _zip
from evidara.sources import files as S
from evidara.sources import readings

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    return _zip({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>"})


def paragraph(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "trend.csv").write_bytes(b"\xef\xbb\xbfTimestamp,Asset,Signal,Value,Unit\n2030-01-01T00:00,P-101,Vibration,6.8,mm/s\n2030-01-02T00:00,P-101,Vibration,bad,mm/s\n")
    (tmp_path / "note.txt").write_bytes(b"Pump P-101\r\nseal \xff leak")
    (tmp_path / "copy.txt").write_bytes(b"Pump P-101\r\nseal \xff leak")
    (tmp_path / "binary.txt").write_bytes(b"a\x00b")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    (tmp_path / "image.png").write_bytes(b"x")
    merged = "<w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>" + paragraph("wide") + "</w:tc>"
    table = f"<w:tbl><w:tr><w:tc>{paragraph('a')}</w:tc><w:tc>{paragraph(' ')}</w:tc><w:tc>{paragraph('b')}</w:tc></w:tr><w:tr>{merged}</w:tr></w:tbl>"
    (tmp_path / "report.docx").write_bytes(docx(paragraph(" First ") + table + paragraph("Second")))
    (tmp_path / "broken.docx").write_bytes(_zip({"other.xml": "<x/>"}))
    return tmp_path


def uploads(spark, folder):
    files = S.read_files(spark, str(folder))
    order = O.position(files.withColumn("workspace_id", F.lit("w")), ["workspace_id"], [F.col("path")], "ord")
    return order


def test_batch_statuses(spark, folder):
    out = ingest_files(uploads(spark, folder))
    rows = {r.filename: (r.status, r.message) for r in out["statuses"].collect()}
    assert rows["copy.txt"][0] == "uploaded" and rows["note.txt"][0] == "duplicate"
    assert rows["trend.csv"][0] == rows["report.docx"][0] == "uploaded"
    assert rows["binary.txt"] == ("failed", ".txt file appears to be binary.")
    assert "empty.txt" not in rows  # Spark's file scan leaves out files without bytes
    assert rows["fake.pdf"] == ("failed", "PDF signature validation failed.")
    assert rows["image.png"] == ("failed", "Unsupported file type: .png")
    assert rows["broken.docx"] == ("failed", ".docx file signature validation failed.")
    summary = ingest.outcome_summary(out["statuses"]).first()
    assert tuple(summary) == (8, 3, 1, 4)
    assert {r.filename for r in out["documents"].collect()} == {"copy.txt", "trend.csv", "report.docx"}
    assert out["chunks"].count() == 3


def test_gate_on_rows(spark):
    rows = [("a.txt", b"", ""), ("", b"x", ""), ("b.csv", b"x", "text/html; charset=utf-8"), ("c.txt", b"\xe9\x81", ""), ("d.txt", b"\xe9", ""), ("e.txt", b"123456", "")]
    df = spark.createDataFrame(rows, "filename string, content binary, kind string").withColumn("extension", F.regexp_extract("filename", r"(\.[a-z]+)$", 1))
    reasons = [r[0] for r in df.select(S.reject_reason(content_type="kind", max_bytes=5)).collect()]
    assert reasons == [
        "File is empty.", "Filename is required.", "Unsupported MIME type for .csv: text/html", "Text is neither UTF-8 nor Windows-1252.", None,
        "File is too large. Maximum upload size is 0 MB.",
    ]


def test_parsed_text(spark, folder):
    texts = {r.path.rsplit("/", 1)[1]: r for r in S.parse_files(S.read_files(spark, str(folder))).collect()}
    assert texts["note.txt"].text == "Pump P-101\nseal  leak"
    assert texts["report.docx"].text == "First\nSecond\na | b\nwide | wide"
    assert texts["trend.csv"].text.splitlines()[0] == "Timestamp,Asset,Signal,Value,Unit" and texts["trend.csv"].extracted_tables_count == 1
    assert texts["broken.docx"].error and texts["image.png"].error == "Unsupported file type: .png"


def test_csv_scan(spark, folder):
    raw = readings.read_csv(spark, str(folder / "trend.csv"), ["Timestamp", "Asset", "Signal", "Value", "Unit"])
    rows = readings.typed(raw, ["Value"], ["Timestamp"]).orderBy("Timestamp").collect()
    assert [r.Value for r in rows] == [6.8, 0.0] and rows[0].Asset == "P-101"


def test_xlsx_dates_and_styles(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = _zip({
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>day</t></si><si><r><t>n</t></r><r><t>o</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" s="1"><v>45306</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })
    from evidara.sources.office import xlsx_sheets

    assert xlsx_sheets(book) == [("S", "day,no\n2024-01-15,True\n")]
    assert zipfile.is_zipfile(io.BytesIO(book))


def python_chunks(pages, size, overlap):
    out, index, step = [], 0, max(size - overlap, 1)
    for page, text in pages:
        words = text.split()
        for start in range(0, len(words), step):
            out.append((page, index, " ".join(words[start:start + size])))
            index += 1
            if start + size >= len(words):
                break
    return out


@pytest.mark.parametrize(("size", "overlap"), [(130, 25), (90, 20), (5, 2), (3, 3)])
def test_chunks_match_restatement(spark, size, overlap):
    rng = random.Random(size)
    docs = {d: [(p, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([0, 1, 4, 5, 6, 90, 91, 200])))) for p in range(1, rng.randint(2, 9))] for d in range(12)}
    df = spark.createDataFrame([("w", d, p, t) for d, ps in docs.items() for p, t in ps], "workspace_id string, document_id int, page int, text string")
    got: dict = {}
    for r in ingest.chunk_pages(df, size=size, overlap=overlap).collect():
        got.setdefault(r.document_id, []).append((r.page, r.chunk_index, r.text))
    for d, ps in docs.items():
        assert sorted(got.get(d, []), key=lambda x: x[1]) == python_chunks(ps, size, overlap)


def test_running_total_over_many_blocks(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    rows = O.running_total(df, ["k"], "o", "v", "before", block=16).orderBy("o").collect()
    total = 0
    for r in rows:
        assert r.before == total
        total += r.v


def test_position_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), ((F.col("id") * 7919) % 3001).alias("o"))
    rows = O.position(df, ["k"], [F.col("o")], partitions=7).collect()
    by_key: dict = {}
    for r in rows:
        by_key.setdefault(r.k, []).append((r.o, r.position))
    assert len(by_key["hot"]) == 2000
    for pairs in by_key.values():
        assert [p for _, p in sorted(pairs)] == list(range(1, len(pairs) + 1))


@pytest.mark.parametrize("segment", [3, 50, 10_000])
def test_greedy_batches_match_restatement(spark, segment):
    rng = random.Random(segment)
    rows = [(w, i, "f.txt", 1, "x" * rng.choice([1, 50, 400, 900, 2500])) for w in ("a", "b") for i in range(150)]
    df = spark.createDataFrame(rows, "workspace_id string, id bigint, filename string, page int, text string")
    got = {(r.workspace_id, r.id): r.batch for r in ingest.evidence_batches(df, limit=2000, segment=segment).select("workspace_id", "id", "batch").collect()}
    for w in ("a", "b"):
        batch, length, want = 0, 0, {}
        for _, i, f, p, t in (r for r in rows if r[0] == w):
            size = len(f"Source: {f}\nPage: {p}\nText:\n{t}")
            if length and length + size > 2000:
                batch, length = batch + 1, 0
            length += size
            want[(w, i)] = batch
        assert {k: v for k, v in got.items() if k[0] == w} == want


def test_source_pages_keep_first_of_copies(spark):
    df = spark.createDataFrame([("w", "f", 1, 3, "b  b"), ("w", "f", 1, 1, "a"), ("w", "f", 1, 2, "b b"), ("w", "f", 1, 4, "a"), ("w", "f", 2, 5, " ")], "workspace_id string, filename string, page int, id int, text string")
    assert [tuple(r) for r in ingest.source_pages(df).collect()] == [("w", "f", 1, "a b b")]


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b"), (4, "a.txt")], "o int, filename string")
    rows = {r.o: r.stored_filename for r in ingest.unique_names(df, [], "o").collect()}
    assert rows == {1: "a.txt", 2: "a-2.txt", 3: "b", 4: "a-3.txt"}
