"""SQL fragments from which the DuckDB twins of the queries are put together."""

from __future__ import annotations

from evidara.functions import vocab as V

SPACE = r"'[\s\x0b\x1c-\x1f\x85\p{Z}]+'"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {SPACE}, ' ', 'g'))"


def norm(x: str) -> str:
    return squeeze(f"lower({x})")


def compact(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{V.TOKEN}')"


def evidence_tokens(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: length(t) >= 2 AND t NOT IN ({quoted(V.EVIDENCE_STOP_WORDS)}))"


def query_terms(x: str) -> str:
    kept = f"list_filter({tokens(x)}, lambda t: t NOT IN ({quoted(V.RETRIEVAL_STOP_WORDS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens(x)} END"


def ids(x: str) -> str:
    return (
        f"list_distinct(list_transform(regexp_extract_all({x}, '{V.IDENTIFIER}'), "
        "lambda m: regexp_replace(upper(m), '[^A-Z0-9]+', '', 'g')))"
    )


def supported(v: str, page: str = "p") -> str:
    """Evidence predicate against columns {page}.norm, .compact, .ids, .tokens."""
    words, wanted = evidence_tokens(v), ids(v)
    return (
        f"CASE WHEN {norm(v)} <> '' AND (contains({page}.norm, {norm(v)}) OR contains({page}.compact, {compact(v)})) THEN true "
        f"WHEN len({words}) = 0 THEN false "
        f"ELSE len(list_filter({wanted}, lambda i: NOT list_contains({page}.ids, i))) = 0 "
        f"AND (len({wanted}) > 0 OR len({words}) >= 4) "
        f"AND len(list_filter({words}, lambda w: list_contains({page}.tokens, w))) / len({words}) >= 0.6 END"
    )


def page_columns(text: str) -> str:
    return (
        f"{norm(text)} AS norm, {compact(text)} AS compact, {ids(text)} AS ids, "
        f"list_distinct({evidence_tokens(text)}) AS tokens"
    )


def half_even(x: str, digits: int) -> str:
    """Exact half-even rounding of a double in [0, 1)."""
    scaled = f"(({x}) * 4611686018427387904.0)::HUGEINT * {10**digits}"
    whole, rest = f"({scaled}) // 4611686018427387904", f"({scaled}) % 4611686018427387904"
    up = f"({rest} > 2305843009213693952 OR ({rest} = 2305843009213693952 AND ({whole}) % 2 = 1))"
    return f"((({whole}) + CASE WHEN {up} THEN 1 ELSE 0 END)::DOUBLE / {10**digits}.0)"


def chunks(source: str, size: int, overlap: int, keys: str = "document_id") -> str:
    """Word windows of ``source``(keys, page, text) with a running chunk index."""
    step = size - overlap
    return f"""
      SELECT {keys}, page, (first_index + i)::BIGINT AS chunk_index,
             array_to_string(words[(i * {step} + 1):(i * {step} + {size})], ' ') AS text
      FROM (
        SELECT *, unnest(range(n)) AS i FROM (
          SELECT *, coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_index
          FROM (
            SELECT {keys}, page, words,
                   CASE WHEN len(words) = 0 THEN 0 ELSE greatest(1, ceil((len(words) - {size}) / {step})::BIGINT + 1) END AS n
            FROM (SELECT {keys}, page, list_filter(string_split({squeeze('text')}, ' '), lambda w: w <> '') AS words FROM ({source}))
          )
        )
      )"""
