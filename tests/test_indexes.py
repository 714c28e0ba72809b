"""The stored inverted index and the anchor index against plain loops."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_search_and_signals import python_lexical

from evidara.operators import containment, postings
from evidara.operators import scorecard as C
from evidara.operators import search
from evidara.session import shared_folder

CHUNKS = "chunk_id string, document string, page int, chunk_index int, text string"
WORDS = ["pump", "p-101", "seal", "the", "leak", "7.5", "bearing", "oil", "report", "of"]


def chunks(count, seed):
    rng = random.Random(seed)
    weights = [9, 1, 2, 30, 2, 1, 3, 4, 1, 25]
    return [
        (f"c{seed}-{i}", rng.choice(["pump-log.txt", "oil.txt"]), rng.randint(1, 3), i, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 14))))
        for i in range(count)
    ]


ASKED = {1: "What is the pump p-101 seal leak leak", 2: "the of", 3: "oil 7.5 txt", 4: "unknown", 5: "report of the bearing oil", 6: ""}


def found(hits):
    out: dict = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 5)))
    return out


def brute(rows, k):
    return {q: best for q, text in ASKED.items() if (best := [(c, round(s, 5)) for c, s in python_lexical(rows, text, k)])}


@pytest.mark.parametrize("size", [60, 1_000_000])
def test_adding_equals_rebuilding(spark, monkeypatch, size):
    monkeypatch.setattr(postings, "BLOCK_TOKENS", size)
    monkeypatch.setattr(postings, "QUERY_BLOCK", 2)
    first, second = chunks(90, 1), chunks(70, 2)
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    df = lambda rows: spark.createDataFrame(rows, CHUNKS).repartition(3)
    asked = spark.createDataFrame(list(ASKED.items()), "query_id int, query string")
    postings.create(df(first), path)
    assert found(postings.top_k(spark.read.parquet(path), asked, 4)) == brute(first, 4)
    postings.add(df(second), path)
    stored = spark.read.parquet(path)
    assert found(postings.top_k(stored, asked, 4)) == brute(first + second, 4)
    assert found(search.lexical_top_k(df(first + second), asked, 4)) == brute(first + second, 4)
    assert stored.where("bucket IS NULL").count() > (5 if size == 60 else 1)
    plain = {r.term: (r.df, round(r.idf, 9)) for r in search.inverse_document_frequencies(df(first + second)).collect()}
    asked_for = spark.createDataFrame([(w,) for w in [*WORDS, "unknown"]], "term string")
    assert {r.term: (r.df, round(r.idf, 9)) for r in postings.inverse_document_frequencies(stored, asked_for).collect()} == plain


def test_common_terms_open_no_chunks(spark):
    """With k good chunks at hand, a word of every chunk is looked up for the chunks seen only."""
    rows = [(f"c{i}", "a.txt", 1, i, "the rare rare valve" if i < 5 else "the") for i in range(400)]
    index = postings.build(spark.createDataFrame(rows, CHUNKS).coalesce(1))
    terms = postings.opened(index, spark.createDataFrame([("the",), ("rare",), ("valve",)], "term string"))
    table = terms.unionByName(index.where("bucket IS NULL").select("block", "chunks", "starts"), allowMissingColumns=True).toArrow()
    block = postings.Block(table, postings.CHUNK)
    looked = []
    plain = block.term
    block.term = lambda name: looked.append(name) or plain(name)
    got = block.search({"the": (1.0, 1.0, 0.0), "rare": (1.0, 5.0, 0.0), "valve": (1.0, 5.0, 0.0)}, [("rare", "valve", 1.0)], 3)
    assert [at for at, _ in got] == [0, 1, 2] and looked == ["rare", "valve", "the"]
    assert len({s for _, s in got}) == 1


def test_empty_index(spark):
    none = spark.createDataFrame([], CHUNKS)
    asked = spark.createDataFrame([(1, "pump")], "query_id int, query string")
    assert search.lexical_top_k(none, asked, 3).collect() == []
    some = spark.createDataFrame([("c", None, 1, 0, None), ("d", "pump log.txt", None, 1, ""), ("e", None, 2, 0, "pump")], CHUNKS)
    assert {r.chunk_id for r in search.lexical_top_k(some, asked, 3).collect()} == {"d", "e"}


@pytest.mark.parametrize("gram", [2, 6])
def test_holders_equal_all_pairs(spark, monkeypatch, gram):
    monkeypatch.setattr(containment, "GRAM", gram)
    monkeypatch.setattr(containment, "SLICE", 16)
    rng = random.Random(gram)
    alphabet = "ab cdé日"
    texts = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(150)] + [(900, None), (901, "")]
    texts += [(1000 + i, "a copy of one text, held by many rows") for i in range(40)]
    strings = ["", "a", "é", "日a", "ab", "one text, held", "zzzzzzzz", "by many rows and more", None, "a copy"]
    strings += ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(60)]
    strings += [t[5:25] for _, t in texts[:30]]
    df = spark.createDataFrame(texts, "id int, text string").repartition(5)
    wanted = spark.createDataFrame([(s,) for s in strings], "s string")
    made = [tuple(r) for r in containment.holders(df, ["id"], F.col("text"), wanted, F.col("s")).collect()]
    assert set(made) == {(i, s) for i, t in texts if t is not None for s in strings if s is not None and s in t}
    assert len(made) == len(set(made))


def test_literal_holders_and_odd_terms(spark):
    texts = spark.createDataFrame([(1, "The  Pump-Seal, leaks!"), (2, "pump seal"), (3, None)], "id int, text string")
    items = spark.createDataFrame([(1, "PUMP seal"), (2, "seal leaks"), (3, "..."), (4, "valve")], "item int, text string")
    made = {(r.id, r["item"]) for r in C.literal_holders(texts, items, ["id"], "item").collect()}
    assert made == {(1, 1), (2, 1), (1, 2), (1, 3), (2, 3)}
    terms = spark.createDataFrame([("",), (None,), ("Seal,  leaks",), ("seal leaks",)], "term string")
    assert {r.term for r in C.present_terms(texts, terms).collect()} == {"", "Seal,  leaks"}
    assert C.present_terms(texts.limit(0), terms).collect() == []
