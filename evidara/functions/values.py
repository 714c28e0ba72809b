"""Scalar value rules: choices, dates, confidences, ratios, vectors, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions import vocab as V
from evidara.functions.text import clean_text, col


def lookup(c: Column | str, table: Mapping[str, object], default: object = None) -> Column:
    """Constant-map lookup; a missing or null key gives ``default``."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(col(c), F.lit("\0"))), F.lit(default))


def or_default(c: Column | str, default: str) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def first_filled(*cs: Column | str) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def asset_id(c: Column | str) -> Column:
    """Upper-cased tag when it has the shape of one, else ''."""
    text = F.upper(clean_text(c))
    return F.when(text.rlike(V.ASSET_ID), text).otherwise("")


def choice(c: Column | str, allowed: Sequence[str]) -> Column:
    """Canonical spelling of an allowed label, case-insensitively, else ''."""
    return lookup(F.lower(clean_text(c)), {a.lower(): a for a in allowed}, "")


def iso_date(c: Column | str) -> Column:
    """The date part of an ISO date or date-time as text, null when it is none.

    The date is the one written, whatever the zone; week dates and basic forms count.
    """
    text = clean_text(c)
    part = F.when(text.rlike(V.ISO_DATE), F.regexp_extract(text, V.ISO_DATE, 1))
    plain = F.regexp_replace(part, "-", "")
    week = F.when(F.contains(plain, F.lit("W")), plain)
    number = lambda start, size: F.substring(week, start, size).try_cast("int")
    # The fourth of January lies in week 1, which starts on the Monday before.
    fourth = F.try_to_date(F.concat(F.substring(week, 1, 4), F.lit("0104")), "yyyyMMdd")
    weekday = F.coalesce(number(8, 1), F.lit(1))
    day = F.date_add(F.date_trunc("week", fourth).cast("date"), (number(6, 2) - 1) * 7 + weekday - 1)
    day = F.when(F.weekofyear(day) == number(6, 2), day)
    return F.date_format(F.coalesce(F.try_to_date(F.when(week.isNull(), plain), "yyyyMMdd"), day), "yyyy-MM-dd")


def entity_value(entity_type: Column | str, value: Column | str) -> Column:
    return F.when(col(entity_type).isin("Equipment", "Work Order"), F.upper(col(value))).otherwise(col(value))


def entity_type(raw: Column | str, value: Column | str) -> Column:
    """Unknown types whose value is a valid tag become Equipment."""
    raw = col(raw)
    return F.when(~raw.isin(V.ENTITY_TYPES) & (asset_id(value) != ""), "Equipment").otherwise(raw)


def confidence(c: Column | str) -> Column:
    """Clamp to [0, 1]; text that is no number, and NaN, give 0."""
    number = as_number(c)
    return F.when(F.isnan(number), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def as_number(c: Column | str) -> Column:
    """Text to double, 0.0 when it is no number."""
    text = col(c).cast("string")
    plain = F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("_"), F.lit(""))
    return F.coalesce(F.when(text.rlike(V.NUMBER), plain.try_cast("double")), F.lit(0.0))


def compare(actual: Column | str, operator: Column | str, expected: Column | str) -> Column:
    """Comparison chosen by name; ``==`` tolerates 0.001.  Unknown names give null."""
    a, e = col(actual), col(expected)
    op = F.lit(operator) if isinstance(operator, str) else operator
    return (
        F.when(op == ">", a > e)
        .when(op == ">=", a >= e)
        .when(op == "<", a < e)
        .when(op == "<=", a <= e)
        .when(op == "==", F.abs(a - e) <= 0.001)
    )


def half_even(c: Column | str, digits: int) -> Column:
    """Round the exact binary value half to even, for 0 <= x < 1024.

    ``round`` in SQL works on the shortest decimal spelling, so 0.695 becomes 0.70
    although the double lies below the tie.  Scaling by a power of two is exact, and
    decimal(38,0) arithmetic on the scaled integer is exact too, so the decision is
    made on the true value and stays inside the JVM.
    """
    x = col(c).cast("double")
    shifted = x * float(10**digits)
    # Only values next to a tie need the exact decision.
    clear = F.abs(shifted - F.floor(shifted) - 0.5) > 1e-6
    exact = F.element_at(F.transform(F.array(x), lambda v: _half_even_scaled(v, digits)), 1)
    return F.when(clear, F.floor(shifted + 0.5) / float(10**digits)).otherwise(exact)


def _half_even_scaled(x: Column, digits: int) -> Column:
    """Bound to a lambda variable, so the argument is computed once and the generated code stays small."""
    unit = F.when(x < 1, F.lit(2**62)).otherwise(F.lit(2**52))
    one = unit.cast("decimal(20,0)")
    scaled = (x * unit.cast("double")).try_cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(6,0)")
    parts = F.transform(
        F.array(F.struct(scaled.alias("scaled"), (scaled % one).alias("rest"))),
        lambda p: F.struct(((p["scaled"] - p["rest"]) / one).cast("decimal(20,0)").alias("whole"), (p["rest"] * 2).alias("twice")),
    )
    rounded = F.transform(
        parts,
        lambda p: p["whole"] + F.when((p["twice"] > one) | ((p["twice"] == one) & (p["whole"] % 2 == 1)), 1).otherwise(0),
    )
    return F.element_at(rounded, 1).cast("double") / float(10**digits)


def ratio(numerator: Column | str, denominator: Column | str, digits: int | None = 4) -> Column:
    """Guarded ratio, rounded last; ``digits=None`` leaves it unrounded."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    value = F.when(F.coalesce(d, F.lit(0.0)) == 0, 0.0).otherwise(n / F.nullif(d, F.lit(0.0)))
    return value if digits is None else half_even(value, digits)


def f1(precision: Column | str, recall: Column | str) -> Column:
    p, r = col(precision), col(recall)
    return F.when(p + r == 0, 0.0).otherwise(half_even((2 * p * r) / F.nullif(p + r, F.lit(0.0)), 4))


def asset_name(asset: Column | str, name: Column | str, kind: Column | str) -> Column:
    """Label = name, type or id; the id is put in front unless the label holds it."""
    a = col(asset)
    label = F.coalesce(F.nullif(col(name), F.lit("")), F.nullif(col(kind), F.lit("")), a)
    return F.when(F.contains(label, a), label).otherwise(F.concat_ws(" ", a, label))


def gap_evidence(source_document: Column | str, evidence: Column | str) -> tuple[Column, Column]:
    """(evidence_status, confidence) of a stored gap."""
    present = (F.coalesce(col(source_document), F.lit("")) != "") & (F.coalesce(col(evidence), F.lit("")) != "")
    status = F.when(present, "accepted").otherwise("rejected")
    return status.alias("evidence_status"), F.when(present, V.GAP_CONFIDENCE).otherwise(0.0).alias("confidence")


def json_list(c: Column | str) -> Column:
    """Stored list column read tolerantly: JSON text, plain text, or null."""
    text = col(c).cast("string")
    parsed = F.from_json(text, "array<string>")
    fallback = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.coalesce(F.when(text.rlike(r"\A\s*\["), parsed), fallback)


def is_sensitive_key(c: Column | str) -> Column:
    key = F.replace(F.lower(F.trim(col(c))), F.lit("_"), F.lit("-"))
    return key.isin(V.SENSITIVE_KEYS) | key.endswith("-api-key")


def redact(entries: Column | str) -> Column:
    """Replace the values of sensitive keys in a map<string,string>."""
    return F.transform_values(col(entries), lambda k, v: F.when(is_sensitive_key(k), V.REDACTED).otherwise(v))


def redact_record(value: Column | str, kind: T.DataType) -> Column:
    """Replace the values of sensitive keys at any depth of a record of type ``kind``.

    Maps with text keys, structs and arrays are walked; a sensitive key hides whatever is below
    it if that is text or can be cast to text, and is null otherwise.
    """
    c = col(value)

    def hidden(to: T.DataType) -> Column:
        return F.lit(V.REDACTED) if isinstance(to, T.StringType) else F.lit(None).cast(to)

    if isinstance(kind, T.StructType):
        fields = [
            F.when(is_sensitive_key(F.lit(f.name)), hidden(f.dataType)).otherwise(redact_record(c[f.name], f.dataType)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        under = kind.valueType
        return F.transform_values(
            c, lambda k, v: F.when(is_sensitive_key(k.cast("string")), hidden(under)).otherwise(redact_record(v, under))
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_record(x, kind.elementType))
    return c


def vector_reject_reason(vector: Column | str, dim: int) -> Column:
    """Null for a usable vector."""
    v = col(vector)
    return F.when(v.isNull(), "Embedding vector is invalid.").when(
        F.size(v) != dim,
        F.concat(
            F.lit(f"Embedding dimensions mismatch. Expected {dim}, got "), F.size(v).cast("string"), F.lit(".")
        ),
    )


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def severity_order(c: Column | str) -> Column:
    """High, Medium, Low, anything else."""
    return lookup(c, V.SEVERITY_ORDER, 4)
