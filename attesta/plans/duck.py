"""DuckDB spellings of the scalar functions, for oracle SQL only."""

from __future__ import annotations

from attesta.functions import fixed_values as fv


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


WS = r"[\s\x{00A0}\x0B]+"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WS)}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q('^' + WS + '|' + WS + '$')}, '', 'g')"


def norm_quote(x: str) -> str:
    out = f"translate({x}, {q(fv.QUOTE_CHARS_FROM)}, {q(fv.QUOTE_CHARS_TO)})"
    for a, b in fv.QUOTE_EXPANSIONS:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"lower({collapse(out)})"


def norm_statement(x: str) -> str:
    return collapse(f"regexp_replace(lower(replace({x}, 'ß', 'ss')), '[^a-z0-9\\s]+', ' ', 'g')")


def compact(x: str) -> str:
    return f"regexp_replace({norm_quote(x)}, {q(fv.COMPACT_PATTERN)}, '', 'g')"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({norm_quote(x)}, '[a-z0-9]+'), lambda t: length(t) > 2))"


def content_terms(x: str) -> str:
    found = f"regexp_extract_all({x}, {q(fv.TERM_PATTERN)})"
    lowered = f"list_transform(list_filter({found}, lambda t: length(t) > 2), lambda t: lower(t))"
    return f"list_distinct(list_filter({lowered}, lambda t: NOT list_contains({listing(fv.TERM_STOPWORDS)}, t)))"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
            f"CAST({inter} AS DOUBLE) / (len({a}) + len({b}) - {inter}) END)")


def rank(x: str) -> str:
    return f"(CASE {x} WHEN 'central' THEN 0 WHEN 'minor' THEN 2 ELSE 1 END)"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def stable(prefix: str, *parts: str) -> str:
    joined = " || '||' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"'{prefix}_' || left(sha256({joined}), 16)"


def is_non_claim(x: str) -> str:
    s = strip(x)
    return (f"(length({s}) < 25 OR regexp_matches({s}, {q('(?i)' + fv.PLACEHOLDER_PATTERN)}) "
            f"OR regexp_matches({s}, {q('(?i)' + fv.NON_CLAIM_PATTERN)}))")


def evidence_kind(x: str, hint: str) -> str:
    low = f"lower({x})"
    return f"""CASE WHEN regexp_matches({low}, {q(fv.TABLE_WORD_PATTERN)}) THEN 'table_result'
        WHEN regexp_matches({low}, {q(fv.FIGURE_WORD_PATTERN)}) THEN 'figure_result'
        WHEN regexp_matches({low}, {q(fv.STATISTIC_WORD_PATTERN)}) THEN 'statistic'
        WHEN contains({low}, 'replicat') THEN 'replication'
        WHEN contains({low}, 'robust') OR contains({low}, 'sensitivity') THEN 'robustness'
        WHEN {hint} = 'method_result' THEN 'method_context'
        WHEN {hint} IN ('claim', 'mixed') THEN 'mixed' ELSE 'observation' END"""


def case_map(x: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {x} = {q(k)} THEN {v if isinstance(v, int) else q(v)}" for k, v in table.items())
    return f"(CASE {arms} ELSE {default} END)"


# RE2 has no look-around: guards are consumed, so separators are doubled first to serve two neighbours.
NUMBER = r"(?:^|[^A-Za-z0-9\-/_.])([-+]?\d+(?:[.,]\d+)*(?:\s*[×x]\s*10\s*[\^]?\s*[-−]?\d+)?)(?:$|[^A-Za-z0-9/_])"
MEASURE = r"(?:^|[^A-Za-z0-9])([-+]?\d+(?:[.,]\d+)*)\s*(" + "|".join(fv.MEASUREMENT_UNITS) + r")(?:$|[^A-Za-z0-9])"


def _doubled(x: str, kept: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q('([^A-Za-z0-9' + kept + '])')}, {q(chr(92) + '1' + chr(92) + '1')}, 'g')"


def numbers(x: str) -> str:
    """Number tokens in order, cleaned."""
    found = f"regexp_extract_all({_doubled(x, '.,×^−/_-')}, {q(NUMBER)}, 1)"
    clean = f"replace(replace(replace(regexp_replace(n, {q(WS)}, '', 'g'), ',', ''), '−', '-'), '×', 'x')"
    return f"list_filter(list_transform({found}, lambda n: regexp_replace(regexp_replace({clean}, '^[+]+', ''), '^-+', '')), lambda n: n <> '')"


def missing_numbers(x: str, quotes: str) -> str:
    """Sorted distinct numbers of a text that no quote of a list states."""
    stated = f"flatten(list_transform({quotes}, lambda s: {numbers('s')}))"
    hay = f"replace({norm_quote(f'array_to_string({quotes}, ' + q(' ') + ')')}, ',', '')"
    a, b = "TRY_CAST(m AS DOUBLE)", "TRY_CAST(o AS DOUBLE)"
    close = f"coalesce(abs({a} - {b}) <= 1e-9 * greatest(1.0, abs({a}), abs({b})), false)"
    return (f"list_sort(list_distinct(list_filter({numbers(x)}, lambda m: NOT (contains({hay}, m) "
            f"OR len(list_filter({stated}, lambda o: o = m OR {close})) > 0))))")


def measurements(x: str) -> str:
    """``value unit`` strings of a text."""
    twice = _doubled(x, ".,µμ°/+-")
    return (f"list_transform(list_zip(regexp_extract_all({twice}, {q(MEASURE)}, 1), regexp_extract_all({twice}, {q(MEASURE)}, 2)), "
            f"lambda z: z[1] || ' ' || z[2])")


def identifiers(x: str) -> str:
    return (f"list_filter(regexp_extract_all({x}, {q(fv.IDENTIFIER_PATTERN)}), "
            f"lambda t: length(t) >= 4 AND NOT list_contains({listing(fv.IDENTIFIER_EXCLUSIONS)}, lower(t)))")


def ratio_units(num: str, den: str, places: int = 4) -> str:
    """Ties-to-even units of 10^-places of an integer ratio."""
    n, d = f"(CAST({num} AS BIGINT) * {10**places})", f"CAST({den} AS BIGINT)"
    rest = f"({n} - ({n} // {d}) * {d})"
    return f"({n} // {d} + CASE WHEN {rest} * 2 > {d} OR ({rest} * 2 = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END)"


def ratio(num: str, den: str, places: int = 4) -> str:
    return f"({ratio_units(num, den, places)} / {float(10**places)})"
