"""Byte-level BPE against the tiktoken library, and the round trip."""

from __future__ import annotations

import hashlib
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evidara.llm import bpe, queries
from evidara.llm.base import texts


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})


def check(spark, library, given_texts):
    df = spark.createDataFrame(list(enumerate(given_texts)), "doc_id long, text string")
    coded = bpe.encoded(texts(df))
    ids = {r.doc_id: list(r.ids) for r in coded.collect()}
    made = {r.doc_id: r for r in bpe.digests(coded).collect()}
    for i, text in enumerate(given_texts):
        want = library.encode_ordinary(text or "")
        assert ids[i] == want, text
        assert made[i].n_tokens == len(want)
        assert made[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert made[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_cases(spark, library):
    check(spark, library, [
        "", None, " ", "  \n\n x", "don't I'LL we've it's'", "<|endoftext|>", "\x00\x01\x7f", "héllo wörld 日本語 😀👍🏽", "a" * 3000,
        "123 4567 ١٢٣", "foo\x85bar baz᠎q\x1cz", "=" * 500 + "-" * 77, "\r\n\t \t", "É" * 300, "the " * 20_000, "x" + " " * 5000,
    ])


def test_every_assigned_code_point(spark, library):
    # Java and the library may know different Unicode versions; old assignments agree.
    points = [c for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    check(spark, library, [f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)}" for c in points[:3000]])
    assert sys.maxunicode


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("etaoin shrdlu'sTHE.,!?\n\t0129éß😀", max_size=200), max_size=40))
def test_random_texts(spark, library, given_texts):
    check(spark, library, given_texts)


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    made = queries.op8_byte_bpe(spark, folder).collect()
    assert len(made) == len(docs)
    for r in made:
        want = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "ab", 2), (1, "ab", 2), (None, None, 2)], "doc_id long, text string, ids int")
    made = bpe.digests(bpe.encoded(texts(df))).collect()
    assert len(made) == 3 and {r.n_tokens for r in made} == {0, 1}
    assert bpe.digests(bpe.encoded(texts(df.limit(0)))).collect() == []


def test_a_task_folds_each_unit_once(monkeypatch):
    def block(*words):
        lists = pa.array([[w.encode() for w in words]], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), lists], ["doc_id", "words"])

    def units(*given_blocks):
        return [b.column(4)[0].as_py() for b in bpe._blocks(bpe.VOCABULARY)(iter(given_blocks))]

    given_blocks = [block(" zxqv", " the"), block(" the", " zxqv", " new"), block(), block(" zxqv")]
    monkeypatch.setattr(bpe, "BLOCK", 1)
    found = units(*given_blocks)
    assert b" the" in found[0] and found[1:] == [[b" new"], [], []]
    # Beyond the bound a task numbers anew.
    monkeypatch.setattr(bpe, "KEPT", 0)
    assert [b" the" in u for u in units(*given_blocks)] == [True, True, False, False]


def test_many_small_blocks_and_few_kept_units(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "BLOCK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    check(spark, library, ["zxqv éß日本 qqzj" * (i % 7) + " again" * (i % 3) + f"xw{i}" for i in range(60)])
