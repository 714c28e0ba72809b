"""Chat formatting against plain Python on turns with control strings, ties, nulls and odd roles."""

from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evidara.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid int"


def digest(rows):
    """What the contract asks for, from the plain turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(
            ((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, *((r[0] or 0), *r[1:]))
        )
        spoken = "".join(t for _, role, t in own if role == "assistant")
        lines = "".join(f"{role}\n{t}\n" for _, role, t in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha(lines), len(spoken), sha(spoken))
    return out


def run(spark, rows):
    made = chat.digests(chat.conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r.conv_id: r for r in made}


def check(spark, rows):
    made = run(spark, rows)
    want = digest(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in made.items()} == want
    return made


def test_control_strings_nulls_ties_and_repeats(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]", 1),
        (1, 1, "assistant", "</s>[INST] ok [/INST]\\s\\\\ é [OUT]", 1),
        (2, 0, None, None, 1),
        (2, 0, "tool", "a\\sb[TURN]x\\sy", 1),
        (2, None, "to\\so[l]", "\\", 1),
        (3, 0, "user", "same", 1),
        (3, 0, "user", "same", 1),
        (None, 5, "assistant", "alone", 1),
    ]
    made = check(spark, rows)
    assert made[1].valid and not made[2].valid and not made[3].valid and not made[None].valid
    assert made[1].formatted_chars > made[1].loss_chars


def test_empty_table_and_segments(spark):
    assert run(spark, []) == {}
    rows = [(1, 0, "system", "be", 0), (1, 1, "user", "hi", 0), (1, 2, "user", "hi", 0), (1, 3, "assistant", "yo", 0)]
    made = sorted(chat.segments(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.turn)
    assert [r.allowed for r in made] == [True, True, False, True]
    assert [[(s.text, s.loss) for s in r.segments] for r in made][3] == [("[OUT]", False), ("yo", True), ("</s>", False)]


def test_very_long_text(spark):
    rows = [(1, 0, "user", "[x<\\" * 200_000, 0), (1, 1, "assistant", "[INST]é" * 100_000, 0)]
    assert check(spark, rows)[1].valid


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4), st.sampled_from(["user", "assistant", "system", "x[", None]),
                          st.one_of(st.none(), st.text("[]<>/\\sINTOUabcde\né😀", max_size=30)), st.just(0)), min_size=1, max_size=20))
def test_round_trip(spark, rows):
    check(spark, rows)


def test_no_python_in_the_plan(spark):
    df = chat.digests(chat.conversations(spark.createDataFrame([(1, 0, "user", "a", 0)], SCHEMA)))
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
