"""The pipeline stage by stage against brute force, and on odd tables."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from evidara.llm import near_copies, packing, personal, quality, simhash
from tests.llm.test_lines import brute as line_brute
from tests.llm.test_near_copies import groups

FOLDER = "/root/testdata/sf0.01"


def test_every_stage_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    after = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in after.collect()}
        made = stage(spark, after, FOLDER)
        rows = made.collect()
        if name == "packing":
            tokens = defaultdict(int)
            for r in rows:
                tokens[r.doc_id] += r.length
            assert tokens.keys() == before.keys()
            break
        assert made.columns == columns
        text = {r.doc_id: r.text for r in rows}
        assert len(text) == len(rows)
        if name == "quality classifier":
            forest = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            score = {r.doc_id: r._quality_score for r in quality.scored(docs, forest).collect()}
            assert text == {i: r.text for i, r in before.items() if score[i] >= 0.5} and 0 < len(text) < len(before)
        elif name == "line dedup":
            want = line_brute([(i, r.text) for i, r in before.items()])
            assert text == {i: want[i, r.text] for i, r in before.items()}
        elif name == "near duplicates":
            label, best = groups({i: r.text for i, r in before.items()})
            gone = before.keys() - text.keys()
            assert text == {i: before[i].text for i in text} and all(label[i] != i for i in gone)
            copies = {i for i in before if best[i] >= near_copies.SIMILARITY}
            assert len(copies & gone) >= 0.9 * len(copies) > 0
        else:
            assert text == {i: personal.mask(r.text) for i, r in before.items()}
        after = spark.createDataFrame(rows, made.schema)
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, pieces)) and sum(r.length for r in pieces) == sum(r.length for r in rows)
    assert max(r.offset + r.length for r in pieces) <= packing.WINDOW


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _fp long, root string"
    rows = [(1, None, "en", None, 0, 1, "x"), (2, "", None, "s", 0, 1, "x"), (None, "lone text of some words", "en", "s", 5, 1, "x"),
            (None, None, "en", "s", 5, 1, "x"), (3, "same text of some words", "en", "s", 5, 1, "x"), (3, "same text of some words", "en", "s", 5, 1, "x"),
            (4, "w " * 100_000, "en", "s", 5, 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == [(3, rows[4][1]), (4, rows[6][1])]
    made = kept.collect()
    assert sum(r.text in (None, "") for r in made) == 1 and sum(r.text == rows[2][1] for r in made) == 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), FOLDER).collect() == [], name
    assert corpus_pipeline.pack(spark, docs.limit(0), FOLDER).collect() == []
    assert simhash.heads(docs.limit(0).select("doc_id", "text")).collect() == []
    assert near_copies.heads(docs.limit(0).select("doc_id", "text")).collect() == []


def test_clashing_names_and_maps(spark):
    names = ["_quality_score", "_hash", "_id", "_nth", "nth", "row", "rest", "id", "hash", "root", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", notes map<string,string>"
    words = "plain words of a quiet text that tells of rivers and of hills and of the people there"
    rows = [(i, f"{words} {'abc'[i % 3] * 9}", *[f"{n}{i}" for n in names], {"k": str(i)}) for i in range(3)] + [(0, f"{words} {'a' * 9}", *["z"] * len(names), {})]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, FOLDER)
        assert made.schema.names == docs.schema.names
        got = {(r.doc_id, r._id): r for r in made.collect()}
        assert all(r.notes == ({"k": str(i)} if own != "z" else {}) and r["a.b"] == ("z" if own == "z" else f"a.b{i}") for (i, own), r in got.items())
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert [r._nth for r in kept if r.doc_id == 0] == ["_nth0"]
