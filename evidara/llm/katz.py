"""Language-model scoring with a Katz backoff bigram model.

    P(w | v) = d(c) c(v w) / (c(v) + 1)    if the bigram v w is kept (count of at least ``KEEP``)
             = alpha(v) P(w)               otherwise

with Good-Turing discounts d(c) for counts up to ``CUT``, alpha(v) such that the probabilities
after v sum to one exactly (the 1 leaves some mass where no count is discounted), and a Good-Turing unigram P(w) that leaves the mass of new words to
as many unseen words as the counts suggest (n1^2 / 2 n2), evenly.  Every text ends with an end
token, which is also the context of its first word.  All texts are scored; counts come from the
training texts only.  Discounts of bigrams come from the counts of counts of all bigrams, so a
score does not depend on the number of partitions.

How it runs.  Words are told apart by 64-bit hashes.  A chunk is a set of documents (by a hash)
small enough for a task; what a chunk asks for travels as packed sorted arrays:

1. words: map tasks send their distinct words, training counts, and the chunks that hold them to
   the word partitions, which answer each chunk with numbers and total counts for its words;
2. bigrams: each chunk sends its distinct bigrams with counts and places to the partition of the
   context (a context of over ``HOT`` tokens is spread by the whole bigram), where the table of
   the partition is formed.  Back go, by document, the sums of log probabilities without discounts,
   how many bigrams have each discounted count, and which contexts it backs off from, with what
   their weights are made of; counts of counts go along;
3. counts of counts are added up over all partitions, which gives the discounts, and sums,
   discounts and backoff weights are added up by chunk.  Only counts of counts and the parts of
   spread contexts, of which there are at most ``SHARES``, come to the driver in between.

Defined results: a null text is empty (its only token is the end); repeated rows are scored and
counted each; a null id counts as the empty text in the choice of training rows; an empty table
gives an empty result; with no training text every token is unknown; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.base import settle, sized

KEEP, CUT = 1, 5
CHUNK_CHARS, PART_TOKENS = 8_000_000, 2_000_000
HOT, SHARES = 1_000_000, 200_000
END = xxhash.xxh64_intdigest(b"\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------------- packed arrays


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; sorted arrays should be given as differences."""
    data = np.ascontiguousarray(values, np.int64)
    return zstandard.ZstdCompressor(level=1).compress(data.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).ravel()


def rising(values: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers."""
    return pack(np.diff(values, prepend=np.uint64(0)).view(np.int64))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for a bigram; it only deals bigrams out and tells none apart."""
    with np.errstate(over="ignore"):
        return ((left * _MIX) ^ right) * _MIX >> np.uint64(20)


def starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys]))))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    first = starts(keys[order])
    return keys[order][first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


# ------------------------------------------------------------------------------- a chunk


class Words:
    """Hashes of words; each distinct word of a task is hashed once."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        """Hashes of the tokens of a text, the end included."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(self.known) > 200_000:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return np.append(out, np.uint64(END))


@dataclass
class Tokens:
    """Tokens of several documents in a row, each with the token before it."""

    token: np.ndarray
    before: np.ndarray
    document: np.ndarray
    train: np.ndarray  # by document

    @staticmethod
    def of(rows: list[tuple[str, bool]], words: Words) -> Tokens:
        lists = [words.of(text) for text, _ in rows]
        token = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        before = np.concatenate(([np.uint64(END)], token[:-1])) if len(token) else token
        document = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return Tokens(token, before, document, np.array([t for _, t in rows], bool))


def _table(rows: list[tuple], schema: str) -> dict[str, pa.Array]:
    """Rows as Arrow columns by a schema of simple Spark types."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    out = {}
    for place, field in enumerate(schema.split(", ")):
        name, kind = field.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        arrow = pa.list_(kinds[inner]) if kind != inner else kinds[kind]
        out[name] = pa.array([r[place] for r in rows], arrow)
    return out


# ------------------------------------------------------------- pass 1: counts of words

ASK_WORDS = "part int, keys binary, counts binary, times binary, chunks binary"
ANSWER_WORDS = "chunk int, part int, index binary, counts binary, facts array<long>, hot array<long>"


def _ask_words(docs: DataFrame, parts: int) -> DataFrame:
    """Distinct words of a map task's documents with training counts and the chunks they are in."""

    def ask(rows: list[tuple[str, bool, int]], words: Words) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[2])
        t = Tokens.of([(text, train) for text, train, _ in rows], words)
        chunk = np.array([c for _, _, c in rows], np.int64)[t.document]
        train = t.train[t.document].astype(np.int64)
        # By part, then word; stable, so that the chunks of a word stay in order.
        order = np.argsort(t.token, kind="stable")
        order = order[np.argsort((t.token[order] % np.uint64(parts)).astype(np.uint32), kind="stable")]
        token, chunk, train = t.token[order], chunk[order], train[order]
        pair = starts(token, chunk)
        word = starts(token)
        counts = np.add.reduceat(train, word)
        times = np.diff(np.append(np.searchsorted(pair, word), len(pair)))
        part, keys, chunks = (token[word] % np.uint64(parts)).astype(np.int64), token[word], chunk[pair]
        ends = np.cumsum(times)
        cut = starts(part)
        made = []
        for low, high in zip(cut, [*cut[1:], len(part)], strict=True):
            own = chunks[ends[low] - times[low] : ends[high - 1]]
            made.append((int(part[low]), rising(keys[low:high]), pack(counts[low:high]), pack(times[low:high]), pack(own)))
        columns = _table(made, ASK_WORDS)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows, size = Words(), [], 0
        limit = CHUNK_CHARS
        for batch in batches:
            for text, out, chunk in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                rows.append((text, not out, chunk))
                size += len(text) + 64
            if size > limit:
                yield ask(rows, words)
                rows, size = [], 0
        if rows:
            yield ask(rows, words)

    return docs.mapInArrow(run, ASK_WORDS)


def _answer_words(parts: int, limit: int):
    """Totals of a word partition: an answer to each chunk, and one row (chunk -1) of statistics.

    A word's number is its place in the partition times ``parts`` plus the partition; an answer
    lists places in the order of the hashes, which the chunk knows.
    """

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys = [risen(k) for k in table.column("keys").to_pylist()]
        counts, times, chunks = ([unpack(v) for v in table.column(n).to_pylist()] for n in ("counts", "times", "chunks"))
        total, count = summed(joined(keys, np.uint64), joined(counts, np.int64))
        place = joined([np.repeat(np.searchsorted(total, k), t) for k, t in zip(keys, times, strict=True)], np.int64)
        chunk = joined(chunks, np.int64)
        order = np.lexsort((place, chunk))
        place, chunk = place[order], chunk[order]
        once = starts(chunk, place)
        place, chunk = place[once], chunk[once]
        cut = starts(chunk)
        rows = [
            (int(chunk[low]), part, pack(np.diff(place[low:high], prepend=0)), pack(count[place[low:high]]), None, None)
            for low, high in zip(cut, [*cut[1:], len(chunk)], strict=True)
        ]
        ones = np.bincount(np.minimum(count, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()
        facts = [int(count.sum()), int((count > 0).sum()), *ones]
        rows.append((-1, part, None, None, facts, (np.flatnonzero(count > limit) * parts + part).tolist()))
        return pa.table(_table(rows, ANSWER_WORDS))

    return run


# -------------------------------------------------------------------------------- the model


def discounts(ones: list[int]) -> np.ndarray:
    """d(1..CUT) by Good-Turing, scaled so that counts above CUT are not discounted.

    Where counts of counts are too thin for the formula (a discount outside 0..1), the count
    is not discounted.
    """
    out = np.ones(CUT + 1)
    if ones[0] <= 0:
        return out
    rest = (CUT + 1) * ones[CUT] / ones[0]
    for r in range(1, CUT + 1):
        if ones[r - 1] > 0 and rest != 1:
            d = ((r + 1) * ones[r] / (r * ones[r - 1]) - rest) / (1 - rest)
            out[r] = d if 0 < d < 1 else 1.0
    return out


@dataclass(frozen=True)
class Model:
    """Everything but the counts themselves."""

    tokens: int
    words: int
    unigram: np.ndarray  # discounts of words
    unseen: float  # log10 probability of one unknown word
    scale: float  # of the words' own mass, so that all sums to one
    spread: np.ndarray  # sorted numbers of contexts that are spread over partitions

    @staticmethod
    def of(tokens: int, words: int, ones: list[int], spread: np.ndarray) -> Model:
        d = discounts(ones)
        seen = sum(r * ones[r - 1] for r in range(1, CUT + 1))
        kept = sum(d[r] * r * ones[r - 1] for r in range(1, CUT + 1)) + tokens - seen
        # New words have at least the mass of half a token.
        free = max(1 - kept / tokens, 0.5 / tokens) if tokens else 1.0
        many = max(1.0, ones[0] ** 2 / (2 * max(1, ones[1])))
        scale = (1 - free) * tokens / kept if tokens else 1.0
        return Model(tokens, words, d, float(np.log10(free / many)), scale, np.sort(spread))

    def log_word(self, count: np.ndarray) -> np.ndarray:
        """log10 P(w) from the counts of words."""
        d = np.where(count > CUT, 1.0, self.unigram[np.minimum(count, CUT)])
        with np.errstate(divide="ignore"):
            known = np.log10(self.scale * d * count / max(1, self.tokens))
        return np.where(count > 0, known, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.words + 1))

    def is_spread(self, context: np.ndarray) -> np.ndarray:
        if not len(self.spread):
            return np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(self.spread, context), len(self.spread) - 1)
        return self.spread[at] == context



def kept_mass(d: np.ndarray, tally: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of P(w | v) over the kept bigrams of contexts with ``size`` tokens.

    ``tally`` has for each context its bigrams by count up to ``CUT``, and the tokens of all others.
    """
    return (tally[:, :CUT] @ (d[1:] * np.arange(1, CUT + 1)) + tally[:, CUT]) / (size + 1)


def log_alpha(katz: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """log10 of the backoff weight from the sums of P(w | v) and of P(w) over the kept bigrams."""
    return np.log10(np.maximum(1 - katz, 1e-15) / np.maximum(1 - plain, 1e-15))


# --------------------------------------------------------------------- pass 2: bigrams

ASK_BIGRAMS = (
    "part int, chunk int, x binary, run binary, before binary, y binary, train binary, count binary, times binary, place binary, "
    "ids array<long>, held array<boolean>, totals array<long>, known array<long>, base array<double>"
)
ANSWER_BIGRAMS = (
    "chunk int, ids array<long>, held array<boolean>, totals array<long>, known array<long>, base array<double>, "
    "docs binary, sums binary, levels binary, owing binary, owed binary, tally binary, size binary, rest binary, "
    "ones array<long>, context array<long>, tallies array<long>, sizes array<long>, plain array<double>"
)


def _ask_bigrams(model: Model, parts: int):
    """Documents of a chunk and the counts of its words -> blocks of bigrams by part, and the documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            ids, texts, out = (left.column(n).to_pylist() for n in ("doc_id", "text", "held_out"))
            chunk, n = left.column("chunk")[0].as_py(), left.num_rows
            t = Tokens.of([(text, not o) for text, o in zip(texts, out, strict=True)], Words())
            keys, token = np.unique(t.token, return_inverse=True)
            number, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            home = keys % np.uint64(parts)
            for p, index, total in zip(*(right.column(c).to_pylist() for c in ("part", "index", "counts")), strict=True):
                own = np.flatnonzero(home == np.uint64(p))
                number[own], counts[own] = np.cumsum(unpack(index)) * parts + p, unpack(total)
            before = np.concatenate(([np.searchsorted(keys, np.uint64(END))], token[:-1]))
            count = counts[token]
            known = np.bincount(t.document, count > 0, n).astype(np.int64)
            base = np.bincount(t.document, model.base(count), n)
            facts = (ids, out, np.bincount(t.document, minlength=n).tolist(), known.tolist(), base.tolist())
            rows.append((chunk % parts, chunk, *[None] * 8, *facts))
            # By part, context number and word number; stable, so that documents stay in order.
            x, y = number[before], number[token]
            deal = mixed(x.view(np.uint64), np.where(model.is_spread(x), y, x).view(np.uint64))
            part = (deal % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((y, x, part))
            part, x, y, document = part[order], x[order], y[order], t.document[order]
            single, context, train = counts[token[order]], counts[before[order]], t.train[document].astype(np.int64)
            cut = starts(part)
            for low, high in zip(cut, [*cut[1:], len(part)], strict=True):
                first = low + starts(x[low:high], y[low:high])
                new = starts(x[first])
                block = (
                    pack(np.diff(x[first][new], prepend=0)), pack(np.diff(np.append(new, len(first)))), pack(context[first][new]),
                    pack(y[first]), pack(np.add.reduceat(train[low:high], first - low)), pack(single[first]),
                    pack(np.diff(np.append(first, high))), pack(document[low:high]),
                )
                rows.append((int(part[low]), chunk, *block, *[None] * 5))
        return pa.table(_table(rows, ASK_BIGRAMS))

    return run


def _answer_bigrams(model: Model):
    """Sums of log probabilities by chunk and document, all but discounts and backoff weights.

    ``levels`` has the bigrams of each document by count up to ``CUT``.  What bigrams that are not
    kept still lack, the weight of their context, is listed by document (owing) and context (owed):
    the place of a spread context, or -1 - the place among the contexts of the block, whose
    tallies go along.  One row (chunk -1) has counts of counts and the tallies of spread contexts.
    """

    def run(table: pa.Table) -> pa.Table:
        given = {n: table.column(n).to_pylist() for n in table.column_names}
        rows: list[tuple] = []
        for i, ids in enumerate(given["ids"]):
            if ids is not None:
                facts = [given[n][i] for n in ("ids", "held", "totals", "known", "base")]
                rows.append((given["chunk"][i], *facts, *[None] * 13))
        blocks = [i for i, x in enumerate(given["x"]) if x is not None]
        if not blocks:
            return pa.table(_table(rows, ANSWER_BIGRAMS))
        of = lambda name: [unpack(given[name][i]) for i in blocks]
        runs = of("run")
        x = joined([np.repeat(np.cumsum(v), r) for v, r in zip(of("x"), runs, strict=True)], np.int64)
        context = joined([np.repeat(v, r) for v, r in zip(of("before"), runs, strict=True)], np.int64)
        y = joined(of("y"), np.int64)
        train, single = joined(of("train"), np.int64), joined(of("count"), np.int64)
        order = np.lexsort((y, x))
        first = starts(x[order], y[order])
        group = np.empty(len(x), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        head = order[first]
        count = np.bincount(group, train, len(head)).astype(np.int64)
        # The table of this partition: one entry for each bigram.
        ones = np.bincount(np.minimum(count, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()
        plain, keep = model.log_word(single[head]), count >= KEEP
        opens = starts(x[head])
        opened = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(head))))
        level = np.where(keep & (count <= CUT), count, 0)
        tally = np.stack(
            [np.add.reduceat((level == r).astype(np.int64), opens) for r in range(1, CUT + 1)]
            + [np.add.reduceat(np.where(keep & (count > CUT), count, 0), opens)], axis=1
        )
        size = context[head][opens]
        sum_plain = np.add.reduceat(np.where(keep, 10.0**plain, 0.0), opens)
        spread = model.is_spread(x[head][opens])
        with np.errstate(divide="ignore"):
            log = np.where(keep, np.log10(count / (context[head] + 1)), plain)
        far = (x[head][opens][spread].tolist(), tally[spread].ravel().tolist(), size[spread].tolist(), sum_plain[spread].tolist())
        rows.append((-1, *[None] * 13, ones, *far))
        low = 0
        for i, times in zip(blocks, of("times"), strict=True):
            own = group[low : low + len(times)]
            each, place = np.repeat(own, times), unpack(given["place"][i])
            docs, sums = summed(place, log[each])
            few = level[each] > 0
            cells = np.searchsorted(docs, place[few]) * CUT + level[each][few] - 1
            levels = np.bincount(cells, minlength=len(docs) * CUT)
            owing = ~keep[each]
            lacks = opened[each][owing]
            near, owed = np.unique(lacks[~spread[lacks]]), np.zeros(len(lacks), np.int64)
            owed[~spread[lacks]] = -1 - np.searchsorted(near, lacks[~spread[lacks]])
            owed[spread[lacks]] = np.searchsorted(model.spread, x[head][opens][lacks[spread[lacks]]])
            parts = (pack(docs), sums.tobytes(), pack(levels), pack(place[owing]), pack(owed), pack(tally[near].ravel()), pack(size[near]), sum_plain[near].tobytes())
            rows.append((given["chunk"][i], *[None] * 5, *parts, *[None] * 5))
            low += len(times)
        return pa.table(_table(rows, ANSWER_BIGRAMS))

    return run


# ---------------------------------------------------------------------- pass 3: documents

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _add_up(model: Model, d: np.ndarray, weights: np.ndarray):
    """Sums of a chunk's documents; ``d`` are the discounts, ``weights`` those of the spread contexts."""

    def run(table: pa.Table) -> pa.Table:
        given = {n: table.column(n).to_pylist() for n in table.column_names}
        facts = next(i for i, ids in enumerate(given["ids"]) if ids is not None)
        n = len(given["ids"][facts])
        score = np.zeros(n)
        names = ("docs", "sums", "levels", "owing", "owed", "tally", "size", "rest")
        for docs, sums, levels, owing, owed, tally, size, rest in zip(*(given[n] for n in names), strict=True):
            if docs is not None:
                own = np.frombuffer(sums, np.float64) + unpack(levels).reshape(-1, CUT) @ np.log10(d[1:])
                np.add.at(score, unpack(docs), own)
                near = log_alpha(kept_mass(d, unpack(tally).reshape(-1, CUT + 1), unpack(size)), np.frombuffer(rest, np.float64))
                # Spread contexts from the front, those of the block from the back.
                np.add.at(score, unpack(owing), np.concatenate([weights, near[::-1]])[unpack(owed)])
        ids, held, totals, known, base = (given[k][facts] for k in ("ids", "held", "totals", "known", "base"))
        rows = list(zip(ids, held, totals, known, [model.tokens] * n, base, score.tolist(), strict=True))
        return pa.table(_table(rows, SCORES))

    return run


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, text -> scores of all rows by the model of the rows that are not held out."""
    total = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    chunks, parts = sized(total, CHUNK_CHARS), sized(total // 6, PART_TOKENS)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    hot = max(HOT, total // SHARES)
    docs = docs.select("doc_id", "text", held_out.alias("held_out"), chunk.alias("chunk"))
    answers = settle(_ask_words(docs, parts).groupBy("part").applyInArrow(_answer_words(parts, hot), ANSWER_WORDS))
    facts = answers.where("chunk = -1").agg(*[F.sum(F.get("facts", F.lit(i))).alias(f"f{i}") for i in range(CUT + 3)]).first()
    tokens, words, *ones = [int(v or 0) for v in facts]
    # Each has over a share of 1 / SHARES of all characters, so there are few.
    spread = [r[0] for r in answers.where("chunk = -1").select(F.explode("hot")).collect()]
    model = Model.of(tokens, words, ones, np.array(spread, np.int64))
    counts = answers.where("chunk >= 0").select("chunk", "part", "index", "counts")
    asked = docs.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_ask_bigrams(model, parts), ASK_BIGRAMS)
    sums = settle(asked.groupBy("part").applyInArrow(_answer_bigrams(model), ANSWER_BIGRAMS))
    tables = sums.where("chunk = -1")
    ones = tables.agg(*[F.sum(F.get("ones", F.lit(i))).alias(f"n{i}") for i in range(CUT + 1)]).first()
    d = discounts([int(v or 0) for v in ones])
    each = tables.select(F.posexplode("context").alias("i", "context"), "tallies", "sizes", "plain")
    tally = [F.sum(F.get("tallies", F.col("i") * (CUT + 1) + r)).alias(f"t{r}") for r in range(CUT + 1)]
    whole = (F.max(F.get("sizes", "i")).alias("size"), F.sum(F.get("plain", "i")).alias("plain"))
    rows = each.groupBy("context").agg(*tally, *whole).collect()
    weights = np.zeros(len(model.spread))
    if rows:
        place = np.searchsorted(model.spread, np.array([r["context"] for r in rows], np.int64))
        tally = np.array([[r[f"t{i}"] for i in range(CUT + 1)] for r in rows], np.int64)
        katz = kept_mass(d, tally, np.array([r["size"] for r in rows], np.int64))
        weights[place] = log_alpha(katz, np.array([r["plain"] for r in rows]))
    return sums.where("chunk >= 0").groupBy("chunk").applyInArrow(_add_up(model, d, weights), SCORES)
