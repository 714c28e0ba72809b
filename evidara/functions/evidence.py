"""The provenance predicate: is a value supported by the text of a page?

Page-side features are computed once per page; record-side features once per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import vocab as V
from evidara.functions.text import bound, col, compact, evidence_tokens, identifier_keys, normalise

FEATURES = ("compact", "ids", "tokens")


def page_features(pages: DataFrame, text: str = "text", prefix: str = "page_") -> DataFrame:
    """Add the three columns the predicate reads."""
    source = F.coalesce(F.col(text), F.lit(""))
    return pages.withColumns(
        {
            f"{prefix}compact": compact(source),
            f"{prefix}ids": identifier_keys(source),
            f"{prefix}tokens": F.array_distinct(evidence_tokens(source)),
        }
    )


def supported(value: Column | str, prefix: str = "page_") -> Column:
    """True when the page holds the value literally, or holds its identifiers and most of its tokens.

    Where a normal form is held the compact form is held too, so the compact one decides.
    """
    v = F.coalesce(col(value), F.lit(""))
    squashed, ids, tokens = (F.col(f"{prefix}{name}") for name in FEATURES)
    literal = (normalise(v) != "") & F.contains(squashed, compact(v))
    return F.coalesce(F.when(literal, True).otherwise(_by_tokens(v, ids, tokens)), F.lit(False))


def overlap(value: Column | str, prefix: str = "page_") -> Column:
    """Share of the value's tokens found on the page, 0.0 without tokens."""
    words = evidence_tokens(F.coalesce(col(value), F.lit("")))
    held = F.filter(words, lambda t: F.array_contains(F.col(f"{prefix}tokens"), t))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(held) / F.nullif(F.size(words), F.lit(0)))


def _by_tokens(value: Column, ids: Column, tokens: Column) -> Column:
    """All that reads the page or the value is bound to lambda variables, so it is computed once per value.

    The optimizer may put the whole making of the page's columns in the place of their names; inside
    the lambda over the words that would be done again for every word.
    """

    def judge(v: Column) -> Column:
        wanted, words = v["ids"], v["words"]
        return (
            (F.size(words) > 0)
            & (F.size(F.array_except(wanted, ids)) == 0)
            & ((F.size(wanted) > 0) | (F.size(words) >= V.MIN_TOKENS_WITHOUT_IDENTIFIER))
            & bound(F.array_intersect(words, tokens), lambda held: F.size(F.filter(words, lambda t: F.array_contains(held, t))) / F.size(words) >= V.MIN_TOKEN_OVERLAP)
        )

    return bound(F.struct(identifier_keys(value).alias("ids"), evidence_tokens(value).alias("words")), judge)
