"""Text rules against plain-Python restatements and literal cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import values as W
from evidara.functions import vocab as V
from evidara.functions.evidence import page_features, supported

PIECES = ["P-101", "wo-9998", "2030-03-12", "7.5 mm/s", "12 DAYS", "lubrication", "completed", "the", "of", "seal", "Übung", " ", "\t", "...", "a", "x/y", "10"]


def random_text(rng, n):
    return rng.choice([" ", "  ", "\n"]).join(rng.choice(PIECES) for _ in range(n))


def py_norm(v):
    return " ".join(v.lower().split())


def py_tokens(v):
    return [t for t in re.findall(V.TOKEN, v.lower()) if len(t) >= 2 and t not in set(V.EVIDENCE_STOP_WORDS)]


def py_ids(v):
    return {re.sub(r"[^A-Z0-9]+", "", m.group(0).upper()) for m in re.finditer(V.IDENTIFIER, v)}


def py_supported(value, source):
    squashed = lambda x: " ".join(re.sub(r"[^a-z0-9]+", " ", x.lower()).split())
    if py_norm(value) and (py_norm(value) in py_norm(source) or squashed(value) in squashed(source)):
        return True
    words, held = py_tokens(value), set(py_tokens(source))
    share = sum(w in held for w in words) / len(words) if words else 0
    return bool(words) and not (py_ids(value) - py_ids(source)) and (bool(py_ids(value)) or len(words) >= 4) and share >= 0.6


def test_supported_matches_restatement(spark):
    rng = random.Random(7)
    pairs = [(random_text(rng, rng.randint(0, 7)), random_text(rng, rng.randint(0, 20))) for _ in range(600)]
    df = page_features(spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate(pairs)], "i int, value string, text string"))
    got = {r.i: r.ok for r in df.select("i", supported("value").alias("ok")).collect()}
    assert got == {i: py_supported(v, s) for i, (v, s) in enumerate(pairs)}
    assert 50 < sum(got.values()) < 550


@pytest.mark.parametrize(
    ("value", "page", "expected"),
    [
        ("WO-9998 lubrication completed on 2030-03-12", "2030-03-12 WO-9998 lubrication completed. Supervisor sign-off: present.", True),
        ("Supervisor sign off present", "2030-03-12 WO-9998 lubrication completed. Supervisor sign-off: present.", True),
        ("WO-9997 lubrication completed on 2030-03-12", "2030-03-12 WO-9998 lubrication completed. Supervisor sign-off: present.", False),
        ("...", "abc", True),
        ("", "abc", False),
    ],
)
def test_supported_literal_cases(spark, value, page, expected):
    df = page_features(spark.createDataFrame([(value, page)], "value string, text string"))
    assert df.select(supported("value")).first()[0] is expected


def test_squeeze_is_python_split(spark):
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", " ", " ", " ", " ", " ", "　"]
    rows = [(f"{s}a{s}{s}b{t}",) for s in spaces for t in spaces]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.clean_text("t")).collect()]
    assert got == [" ".join(r[0].split()) for r in rows]


def test_half_even_is_python_round(spark):
    rng = random.Random(3)
    numbers = [i / 1000 for i in range(0, 1001)] + [i / 8 for i in range(0, 80)] + [rng.random() for _ in range(500)] + [rng.random() * 900 for _ in range(200)]
    for digits in (2, 4):
        df = spark.createDataFrame([(float(x),) for x in numbers], "x double")
        got = [r[0] for r in df.select(W.half_even("x", digits)).collect()]
        assert got == [round(x, digits) for x in numbers]


def test_dates(spark):
    cases = {
        "2024-01-15": "2024-01-15", " 2024-01-15T10:00:00 ": "2024-01-15", "2024-01-15 10:00:00": "2024-01-15", "null": None, "": None,
        "2024": None, "2024-01": None, "2024-1-2": None, "2024-13-01": None, "15.01.2024": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", W.iso_date("t").alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


def test_asset_ids_and_choices(spark):
    df = spark.createDataFrame([("p-101",), ("x",), ("a b",), ("P-1\n",), (None,), ("-A1",)], "t string")
    assert [r[0] for r in df.select(W.asset_id("t")).collect()] == ["P-101", "", "", "P-1", "", ""]
    df = spark.createDataFrame([(" in  progress ",), ("OPEN",), ("gone",)], "t string")
    assert [r[0] for r in df.select(W.choice("t", V.STATUSES)).collect()] == ["In Progress", "Open", ""]


def test_confidence(spark):
    df = spark.createDataFrame([("0.5",), ("7",), ("-1",), ("nan",), ("high",), (None,)], "t string")
    assert [r[0] for r in df.select(W.confidence("t")).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_file_names(spark):
    df = spark.createDataFrame([("../<na me>.TXT",), ("/a/b/.hidden",), ("c.tar.gz",), ("end.",)], "t string")
    named = df.select(X.safe_filename("t").alias("n")).select("n", X.file_suffix("n"), X.file_stem("n"))
    assert [tuple(r) for r in named.collect()] == [("na me.TXT", ".txt", "na me"), (".hidden", "", ".hidden"), ("c.tar.gz", ".gz", "c.tar"), ("end.", "", "end.")]


def test_snippets_and_excerpts(spark):
    text = "word " * 100 + "Needle here " + "tail " * 100
    df = spark.createDataFrame([(text,)], "t string")
    clean = " ".join(text.split())
    at = clean.lower().find("needle")
    row = df.select(X.source_excerpt(F.lit("NEEDLE"), "t"), X.term_snippet("t", F.array(F.lit("zz"), F.lit("needle"))), X.title_from_description("t"), X.citation_snippet("t")).first()
    assert row[0] == clean[max(0, at - 140): at + 6 + 140].strip()
    assert row[1] == clean[at - 80: at - 80 + 260].strip()
    assert row[2] == clean[:69].rstrip() + "..."
    assert row[3] == clean[:280].rstrip() + "..."


def test_display_labels(spark):
    cases = {"p-101a": "P-101A", "3 / 4": "3/4", "pump_and-seal": "Pump and Seal", "oem manual": "OEM Manual", "": "Not available", "deepseek": "DeepSeek"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.display_label("t").alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases


def test_model_text(spark):
    df = spark.createDataFrame([("ﬁne—“x”… ½",)], "t string")
    assert df.select(X.model_text("t")).first()[0] == 'fine-"x"... 1⁄2'
