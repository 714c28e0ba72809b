"""Text normalisation, tokens, excerpts and labels as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions import vocab as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and deep inside other lambdas it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(c: Column | str) -> Column:
    """Collapse Unicode white space to single spaces and trim."""
    return F.trim(F.regexp_replace(col(c), V.WHITESPACE, " "))


def clean_text(c: Column | str) -> Column:
    """Null to '', NUL dropped, white space collapsed."""
    return squeeze(F.translate(F.coalesce(col(c), F.lit("")), "\0", ""))


def normalise(c: Column | str) -> Column:
    """Lower case with collapsed white space."""
    return squeeze(F.lower(col(c)))


def compact(c: Column | str) -> Column:
    """Lower case, every run of other characters becomes one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def identifier_keys(c: Column | str) -> Column:
    """Distinct equipment tags, ISO dates and measurements, squeezed to [A-Z0-9]."""
    found = F.regexp_extract_all(col(c), F.lit(V.IDENTIFIER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.upper(m), "[^A-Z0-9]+", "")))


def search_tokens(c: Column | str) -> Column:
    """Lower-cased tokens in text order, duplicates kept."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(V.TOKEN), F.lit(0))


def evidence_tokens(c: Column | str) -> Column:
    """Tokens that carry evidence: stop words and single characters dropped, duplicates kept."""
    return F.filter(search_tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(V.EVIDENCE_STOP_WORDS))


def query_terms(c: Column | str) -> Column:
    """Query tokens without stop words; all tokens when nothing else is left."""
    tokens = search_tokens(c)
    kept = F.filter(tokens, lambda t: ~t.isin(V.RETRIEVAL_STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def is_identifier_term(c: Column | str) -> Column:
    return col(c).rlike(V.IDENTIFIER_TERM)


def bigrams(tokens: Column | str) -> Column:
    """Adjacent pairs ``"a b"``; tokens never hold a blank, so the key is unambiguous."""
    tokens = col(tokens)
    ahead = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    behind = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(behind, ahead, lambda a, b: F.concat(a, F.lit(" "), b))


def matched_terms(text: Column | str, terms: Column | str) -> Column:
    """Terms whose normal form occurs in the normal form of the text."""
    return _terms_in(text, terms, lambda haystack, t: F.contains(haystack, normalise(t)))


def missing_terms(text: Column | str, terms: Column | str) -> Column:
    return _terms_in(text, terms, lambda haystack, t: ~F.contains(haystack, normalise(t)))


def _terms_in(text: Column | str, terms: Column | str, kept: Callable[[Column, Column], Column]) -> Column:
    """The text is brought to its normal form once for all terms, and not at all without a term."""
    haystack, terms = normalise(F.coalesce(col(text), F.lit(""))), col(terms)
    return F.when(F.size(terms) == 0, terms).otherwise(bound(haystack, lambda h: F.filter(terms, lambda t: kept(h, t))))


def unique_terms(terms: Column | str) -> Column:
    """First term of every normal form, in order."""
    terms = col(terms)
    keys = F.transform(terms, lambda t: normalise(t))
    return F.filter(terms, lambda t, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def clean_list(items: Column | str) -> Column:
    """Clean every string, drop empty ones, keep the first of equals; null becomes []."""
    cleaned = F.filter(F.transform(col(items), lambda x: clean_text(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def required_list(items: Column | str) -> Column:
    """The report variant: white space collapsed, blanks dropped, duplicates kept, null when empty."""
    kept = F.filter(F.transform(col(items), lambda x: squeeze(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def title_from_description(c: Column | str, limit: int = 72) -> Column:
    text = clean_text(c)
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def citation_snippet(c: Column | str, length: int = 280) -> Column:
    text = squeeze(c)
    cut = F.concat(F.rtrim(F.substring(text, 1, length)), F.lit("..."))
    return F.when(F.length(text) <= length, text).otherwise(cut)


def source_excerpt(value: Column | str, text: Column | str, radius: int = 140) -> Column:
    """The text around the first hit of ``value``, else the head of the text."""

    def excerpt(source: Column, needle: Column, at: Column) -> Column:
        start = F.greatest(at - radius, F.lit(1))
        stop = at + F.length(needle) + radius
        around = F.trim(F.substring(source, start, stop - start))
        head = F.trim(F.substring(source, 1, radius * 2))
        return F.when((source == "") | (needle == ""), "").when(at > 0, around).otherwise(head)

    def place(found: Column) -> Column:
        source, needle = found["source"], found["needle"]
        return bound(F.instr(F.lower(source), F.lower(needle)), lambda at: excerpt(source, needle, at))

    return bound(F.struct(clean_text(text).alias("source"), clean_text(value).alias("needle")), place)


def term_snippet(text: Column | str, terms: Column | str | None = None, length: int = 260) -> Column:
    """A window that starts 80 characters before the first listed term that occurs."""
    source = squeeze(F.coalesce(col(text), F.lit("")))
    if terms is None:
        return F.trim(F.substring(source, 1, length))
    lower = F.lower(source)
    hits = F.filter(F.transform(col(terms), lambda t: F.instr(lower, F.lower(t))), lambda p: p > 0)
    at = F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(1))
    return F.trim(F.substring(source, F.greatest(at - 80, F.lit(1)), F.lit(length)))


def filename_keys(c: Column | str) -> Column:
    """Normalised full path, file name and stem by which a cited file may be named."""
    text = F.regexp_replace(clean_text(c), "\\A[\"'` ]+|[\"'` ]+\\z", "")
    text = F.regexp_replace(text, r"(?i)\Asource:\s*", "")
    text = F.regexp_replace(text, r"(?i)\s+(?:page|p\.)\s+\d+\s*\z", "")
    text = F.replace(text, F.lit("\\"), F.lit("/"))
    name = base_name(text)
    keys = F.array(text, name, file_stem(name))
    return F.array_distinct(F.transform(F.filter(keys, lambda k: k != ""), lambda k: normalise(k)))


def base_name(c: Column | str) -> Column:
    """Last path component; '.' and trailing slashes do not count, '..' does."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"(?:/\.?)+\z", ""), r"\A\.\z", "")
    return F.regexp_extract(bare, r"([^/]*)\z", 1)


def file_stem(name: Column | str) -> Column:
    """File name without its last extension; a leading dot or a final dot is no extension."""
    return F.regexp_replace(col(name), r"(?s)\A(.+)\.[^.]+\z", "$1")


def file_suffix(name: Column | str) -> Column:
    """Lower-cased extension with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(col(name), r"(?s)\A.+(\.[^.]+)\z", 1))


def document_type(name: Column | str) -> Column:
    return F.upper(F.regexp_replace(file_suffix(name), r"\A\.", ""))


def safe_filename(c: Column | str) -> Column:
    """Base name restricted to letters, digits and `` ._-()``, at most 160 characters."""
    kept = F.regexp_replace(base_name(c), r"[^\p{L}\p{N} ._()\-]", "")
    return F.substring(F.trim(kept), 1, 160)


def fold_model_text(c: Column | str) -> Column:
    """Dashes, quotes and special blanks folded to ASCII (without Unicode composition)."""
    folded = F.translate(col(c), V.FOLD_FROM, V.FOLD_TO)
    return F.trim(F.replace(folded, F.lit(V.ELLIPSIS), F.lit("...")))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def model_text(c: Column | str) -> Column:
    """Compatibility composition, for which Spark has no built-in, then folding."""
    return fold_model_text(_nfkc(col(c)))


TAG = r"(?i)\A[a-z]+-\d+[a-z0-9-]*\z"


def display_label(c: Column | str) -> Column:
    """A readable label: acronyms, minor words, equipment tags and capitals."""
    raw = F.trim(col(c).cast("string"))
    spaced = F.regexp_replace(F.replace(raw, F.lit("_"), F.lit(" ")), r"\s+", " ")
    words = F.flatten(
        F.transform(
            F.split(spaced, " "),
            lambda w: F.when(w.rlike(r"\A\d+/\d+\z"), F.array(w))
            .when(w.rlike(TAG), F.array(F.upper(w)))
            .otherwise(F.filter(F.split(w, "[/-]+"), lambda p: p != "")),
        )
    )
    shown = F.transform(words, lambda w, i: _label_word(w, i, F.size(words)))
    return (
        F.when(raw.isNull() | (raw == ""), "Not available")
        .when(raw.rlike(r"\A\d+\s*/\s*\d+\z"), F.regexp_replace(raw, r"\s+", ""))
        .when(raw.rlike(TAG), F.upper(raw))
        .otherwise(F.array_join(shown, " "))
    )


def _label_word(word: Column, index: Column, total: Column) -> Column:
    lower = F.lower(word)
    special = F.create_map(*[F.lit(x) for pair in V.SPECIAL_WORDS.items() for x in pair])
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))
    return (
        F.when(lower.isin(list(V.SPECIAL_WORDS)), F.try_element_at(special, lower))
        .when(lower.isin(V.ACRONYMS), F.upper(lower))
        .when((index > 0) & (index < total - 1) & lower.isin(V.MINOR_WORDS), lower)
        .when(word.rlike(TAG), F.upper(word))
        .when(word == lower, capital)
        .otherwise(word)
    )


def any_contains(columns: Iterable[Column | str], query: str) -> Column:
    """Case-insensitive free-text filter over several columns; a blank query keeps all rows."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(wanted))
    return hit
