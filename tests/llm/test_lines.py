"""Line dedup against a plain-Python template tree that compares the tokens themselves."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

from evidara.llm import lines

FOLDER = "/root/testdata/sf0.01"
UNSPACED = ("฀", "໿"), ("က", "႟"), ("ក", "៿"), ("぀", "ヿ"), ("㐀", "鿿"), ("豈", "﫿")


def brute(rows):
    """text by (doc_id, text), by the rules in the module's docstring."""
    found, runs = [], defaultdict(list)
    for doc_id, text in rows:
        if doc_id is None or text is None:
            continue
        own = []
        for pos, line in enumerate(text.split("\n")):
            words = tuple(x for x in re.split(r"[ \t\n\x0b\f\r]+", line) if x)
            if not words:
                continue
            t = tuple("<*>" if re.search("[0-9@]", w) else w for w in words)
            fixed = sum(w != "<*>" for w in t)
            bare = re.search("[0-9@]", line) is not None and (fixed < lines.CONSTANT or 2 * fixed < len(t))
            size = len(words) + sum(any(a <= c <= b for a, b in UNSPACED) for c in line) // 2
            found.append((doc_id, text, pos, words if bare else t, bare, size))
            own.append((pos, size, words))
        for i in range(len(own)):
            for j in range(i, len(own)):
                run = own[i : j + 1]
                if sum(size for _, size, _ in run) >= lines.RUN:
                    if any(size < lines.SHORT for _, size, _ in run):
                        runs[tuple(words for _, _, words in run)].append((doc_id, text, [pos for pos, _, _ in run]))
                    break
    own = defaultdict(list)
    for doc_id, _, pos, t, bare, size in found:
        own[t, bare, size].append((doc_id, pos))
    first = defaultdict(list)
    for (t, bare, size), at in own.items():
        n = len({d for d, _ in at})
        if n > 1 and (size >= lines.SHORT or (n >= lines.SHORT_DOCUMENTS and len(t) >= lines.LEAST)):
            first[t, bare, size].append(min(at))
    templates = defaultdict(list)
    for t, bare, size in own:
        if size >= lines.SHORT and not bare:
            cuts = [b * len(t) // lines.BANDS for b in range(lines.BANDS + 1)]
            for free in combinations(range(lines.BANDS), lines.FREE):
                kept = tuple(w for b in range(lines.BANDS) if b not in free for w in t[cuts[b] : cuts[b + 1]])
                templates[len(t), t[: lines.LEAD], free, kept].append((t, bare, size))
    for near in templates.values():
        at = [x for t in near for x in own[t]]
        if len(near) > 1 and len({d for d, _ in at}) > 1:
            for t in near:
                first[t].append(min(at))
    gone = defaultdict(set)
    for doc_id, text, pos, t, bare, size in found:
        if first.get((t, bare, size)) and min(first[t, bare, size]) != (doc_id, pos):
            gone[doc_id, text].add(pos)
    for at in runs.values():
        if len({d for d, _, _ in at}) > 1:
            start = min((d, places[0]) for d, _, places in at)
            for doc_id, text, places in at:
                if (doc_id, places[0]) != start:
                    gone[doc_id, text].update(places)
    return {(d, text): text and "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[d, text]) for d, text in rows}


def same(spark, rows):
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "gone long, doc_id long, text string")
    made = lines.deduplicated(df)
    assert made.columns == ["gone", "doc_id", "text"]
    got, want = {r.gone: r.text for r in made.collect()}, brute(rows)
    assert got == {i: want[d, t] for i, (d, t) in enumerate(rows)}
    return got


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = same(spark, rows)
    assert 0 < sum(got[i] != t for i, (_, t) in enumerate(rows)) < len(rows)


def test_variable_fields_and_short_lines(spark):
    long = "the quick brown fox jumps over the lazy dog near river number {} on {} today"
    names = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, "own " + " ".join(chr(97 + i) * k for k in range(1, 12)) + "\n" + long.format(i, names[i % 4])) for i in range(8)]
    rows += [(100 + i, f"short one here\nas.\nline of {chr(97 + i)} {chr(98 + i)} {chr(99 + i)}") for i in range(25)]
    got = same(spark, rows)
    assert "number 0" in got[0] and all("number" not in got[i] and "own" in got[i] for i in range(1, 8))
    assert [i for i in range(25) if "short one here" in got[8 + i]] == [0]
    assert all("as." in got[8 + i] for i in range(25))


def test_odd_inputs(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, long), (4, long), (5, long + "\n" + long), (None, long), (6, long + "\n" + "w " * 200_000), (7, "\t" + long + " ")]
    got = same(spark, rows)
    assert got[3] == got[4] == long and got[5] == "" and got[6] == long and got[8] == ""
    assert lines.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_of_numbers_stay(spark):
    wide = [(i, "\n".join(" ".join(str(i * 1000 + r * 20 + c) for c in range(12)) for r in range(4))) for i in range(5)]
    near = [(10 + i, "0 0 0 0 0 0 0 0 0 0 0 " + str(i)) for i in range(3)]
    narrow = [(20 + i, f"t{i} {i}.5 {i}.7 C") for i in range(25)]
    copies = [(50, "1 2 3 4 5 6 7 8 9 10 11"), (51, "1 2 3 4 5 6 7 8 9 10 11")]
    rows = wide + near + narrow + copies
    made = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made == dict(rows) | {51: ""}
    assert list(made.values()) and same(spark, rows)


def test_every_token_counts(spark):
    one = [f"a{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(64)]
    # Equal at sixteen evenly spaced places and around them, different in 45 tokens.
    other = [w if i % 4 == 0 or i < 4 else "z" + w for i, w in enumerate(one)]
    assert sum(a != b for a, b in zip(one, other, strict=True)) == 45
    got = same(spark, [(1, " ".join(one)), (2, " ".join(other))])
    assert got[1] == " ".join(other)


def test_several_templates_in_a_leaf(spark):
    start = "request failed at node"
    kinds = [start + " {} because the disk of the host was full again", start + " {} while an upstream peer did close its socket"]
    rows = [(i, kinds[0].format("abcdef"[i])) for i in range(6)] + [(10 + i, kinds[1].format("ghij"[i])) for i in range(4)]
    got = same(spark, rows)
    assert [i for i in got if got[i]] == [0, 6]


def test_runs_of_short_lines(spark):
    passage = "\n".join(" ".join(f"w{chr(97 + r)}{chr(97 + c)}" for c in range(8)) for r in range(12))
    rows = [(i, f"opening {'abcdefghij'[i]}\n{passage}\nend {'klmnopqrst'[i]}") for i in range(10)]
    # Six shared words are no passage; a blank line inside one stays.
    rows += [(20, "just two lines\nof three words"), (21, "just two lines\nof three words"), (22, passage.replace("\n", "\n\n", 1))]
    got = same(spark, rows)
    assert got[0] == rows[0][1] and all(got[i] == f"opening {'abcdefghij'[i]}\nend {'klmnopqrst'[i]}" for i in range(1, 10))
    assert got[11] == rows[11][1] and got[12] == ""
    unspaced = "一二三四五六七八九十百千万上下左右大小中天地人"
    got = same(spark, [(1, "own text\n" + unspaced), (2, unspaced + "\nelse")])
    assert got == {0: "own text\n" + unspaced, 1: "else"}


def test_clashing_columns(spark):
    names = ["row", "own_id", "own_key", "key", "gone", "pos", "_own", "_key", "_doc", "_gone", "first", "line", "a.b", "notes"]
    line = "one two three four five six seven eight nine ten eleven twelve"
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names[:-1]) + ", notes map<string,string>"
    rows = [(i, f"{line}\nof {i}", *[f"{n}{i}" for n in names[:-1]], {"k": str(i)}) for i in (1, 2)]
    made = lines.deduplicated(spark.createDataFrame(rows, schema))
    assert made.columns == ["doc_id", "text", *names]
    assert sorted(tuple(r) for r in made.select("doc_id", "text", "row", "own_key", "`a.b`").collect()) == [
        (1, f"{line}\nof 1", "row1", "own_key1", "a.b1"), (2, "of 2", "row2", "own_key2", "a.b2")]
    assert sorted((r.doc_id, r.notes["k"], r._gone) for r in made.collect()) == [(1, "1", "_gone1"), (2, "2", "_gone2")]
