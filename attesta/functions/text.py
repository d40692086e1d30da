"""Scalar text functions as Column expressions (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def collapse_ws(value: Column | str) -> Column:
    """Runs of any Unicode white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"(?U)\s+", " "))


def strip(value: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"(?U)^\s+|\s+$", "")


def is_blank(value: Column | str) -> Column:
    return strip(value) == ""


def fold_quote_chars(value: Column | str) -> Column:
    out = F.translate(_col(value), fv.QUOTE_CHARS_FROM, fv.QUOTE_CHARS_TO)
    for source, target in fv.QUOTE_EXPANSIONS:
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def normalize_quote(value: Column | str) -> Column:
    """Form in which quotes and spans are compared: folded characters, single spaces, lower case."""
    return F.lower(collapse_ws(fold_quote_chars(value)))


def normalize_statement(value: Column | str) -> Column:
    lowered = F.lower(F.replace(_col(value), F.lit("ß"), F.lit("ss")))
    return collapse_ws(F.regexp_replace(lowered, r"[^a-z0-9\s]+", " "))


def compact(value: Column | str) -> Column:
    return F.regexp_replace(normalize_quote(value), fv.COMPACT_PATTERN, "")


def tokens(value: Column | str) -> Column:
    """Distinct lower-case alphanumeric tokens longer than two characters."""
    found = F.regexp_extract_all(normalize_quote(value), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 2))


def content_terms(value: Column | str) -> Column:
    found = F.regexp_extract_all(_col(value), F.lit("(" + fv.TERM_PATTERN + ")"), F.lit(1))
    lowered = F.transform(F.filter(found, lambda t: F.length(t) > 2), F.lower)
    stop = F.array(*[F.lit(w) for w in fv.TERM_STOPWORDS])
    return F.array_distinct(F.filter(lowered, lambda t: ~F.array_contains(stop, t)))


def required_claim_terms(value: Column | str) -> Column:
    generic = F.array(*[F.lit(w) for w in fv.GENERIC_CLAIM_TERMS])
    return F.array_except(content_terms(value), generic)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two token arrays; zero when either is empty."""
    common = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        common / (F.size(left) + F.size(right) - common)
    )


def containment(claim_terms: Column, candidate_terms: Column) -> Column:
    """Share of the claim's terms that the candidate contains."""
    common = F.size(F.array_intersect(claim_terms, candidate_terms))
    return F.when((F.size(claim_terms) == 0) | (F.size(candidate_terms) == 0), F.lit(0.0)).otherwise(
        common / F.size(claim_terms)
    )


def word_count(value: Column | str) -> Column:
    words = F.split(_col(value), r"(?U)\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def numeric_terms(value: Column | str) -> Column:
    return F.regexp_extract_all(_col(value), F.lit("(" + fv.NUMERIC_TERM_PATTERN + ")"), F.lit(1))


def identifiers(value: Column | str) -> Column:
    found = F.regexp_extract_all(_col(value), F.lit("(" + fv.IDENTIFIER_PATTERN + ")"), F.lit(1))
    excluded = F.array(*[F.lit(w) for w in fv.IDENTIFIER_EXCLUSIONS])
    kept = F.filter(found, lambda t: (F.length(t) >= 4) & ~F.array_contains(excluded, F.lower(t)))
    return F.array_sort(F.array_distinct(kept))


def ungrounded_identifiers(statement: Column, paper_compact: Column) -> Column:
    return F.filter(identifiers(statement), lambda t: F.instr(paper_compact, compact(t)) == 0)


def entity_codes(value: Column | str) -> Column:
    found = F.regexp_extract_all(_col(value), F.lit("(" + fv.ENTITY_CODE_PATTERN + ")"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def is_boilerplate_wording(value: Column | str) -> Column:
    return _col(value).rlike("(?i)" + fv.BOILERPLATE_STATEMENT_PATTERN)


def is_non_claim(value: Column | str) -> Column:
    text = strip(value)
    return (
        (F.length(text) < 25)
        | text.rlike("(?i)" + fv.PLACEHOLDER_PATTERN)
        | text.rlike("(?i)" + fv.NON_CLAIM_PATTERN)
    )


def is_reference_list(value: Column | str) -> Column:
    """Eight or more non-blank lines of which over 60 % look like references."""
    lines = F.filter(F.split(F.lower(_col(value)), "\n"), lambda line: ~is_blank(line))
    hits = F.filter(
        lines,
        lambda line: line.rlike(fv.REFERENCE_LINE_START_PATTERN) | line.rlike(fv.REFERENCE_LINE_YEAR_PATTERN),
    )
    return (F.size(lines) >= 8) & (F.size(hits) / F.greatest(F.size(lines), F.lit(1)) > 0.6)


def pick(value: Column | str, allowed, default: Column | str) -> Column:
    """Lower-case, spaces to underscores, default when not an allowed value."""
    fallback = F.lit(default) if isinstance(default, str) else default
    cleaned = F.replace(F.lower(strip(value)), F.lit(" "), F.lit("_"))
    return F.when(cleaned.isin(*allowed), cleaned).otherwise(fallback)


def importance_rank(value: Column | str) -> Column:
    """central 0, supporting 1, minor 2; anything else counts as supporting."""
    col = _col(value)
    return F.when(col == "central", 0).when(col == "minor", 2).otherwise(1)


ROLE_ALIASES = {
    "result": ("figure", "table", "chart", "result_figure", "result_table", "evidence", "observation"),
    "method": ("methodology", "procedure", "protocol", "algorithm", "setup"),
    "input": ("definition", "question", "background", "context", "source"),
    "interpretation": ("limitation", "rationale", "discussion", "conclusion", "analysis", "inference"),
}


def coerce_source_role(value: Column | str) -> Column:
    cleaned = F.lower(strip(value))
    out = F.when(cleaned.isin(*fv.ROLE_VALUES), cleaned)
    for target, aliases in ROLE_ALIASES.items():
        out = out.when(cleaned.isin(*aliases), F.lit(target))
    return out.otherwise(F.lit("metadata"))


def coerce_mapping_status(value: Column | str) -> Column:
    cleaned = F.lower(strip(value))
    out = F.lit(None).cast("string")
    for target, aliases in fv.MAPPING_ALIASES.items():
        out = F.when(cleaned.isin(*aliases), F.lit(target)).otherwise(out)
    return F.coalesce(out, F.lit("unresolved"))


def run_label(value: Column | str) -> Column:
    cleaned = F.regexp_replace(strip(value), r"[^A-Za-z0-9._-]+", "-")
    trimmed = F.regexp_replace(cleaned, r"^[-._]+|[-._]+$", "")
    return F.when(trimmed == "", F.lit("default")).otherwise(trimmed)


def versioned_name(base: Column, label: Column) -> Column:
    clean = run_label(label)
    return F.when(clean == "default", base).otherwise(F.concat(base, F.lit("__run_"), clean))


def parse_versioned_name(name: Column) -> Column:
    """Struct (base_name, run_label) of ``base__run_label``; split at the last marker."""
    suffix = F.substring_index(name, "__run_", -1)
    base = F.left(name, F.length(name) - F.length(suffix) - F.lit(len("__run_")))
    has = name.contains("__run_") & (suffix != "") & (base != "")
    return F.struct(
        F.when(has, base).otherwise(name).alias("base_name"),
        F.when(has, run_label(suffix)).otherwise(F.lit("default")).alias("run_label"),
    )


def safe_task_id(value: Column | str) -> Column:
    cleaned = F.regexp_replace(strip(value), r"(?U)[^\p{L}\p{N}_.-]", "_")
    return F.when(cleaned == "", F.lit("claims_task")).otherwise(cleaned)


def slug(value: Column | str) -> Column:
    cleaned = F.regexp_replace(strip(value), r"[^A-Za-z0-9_.-]+", "_")
    trimmed = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(trimmed == "", F.lit("record")).otherwise(trimmed)


def short_concept(value: Column | str) -> Column:
    """A phrase of at most ten words without operators or bare numbers, else ''."""
    text = F.regexp_replace(collapse_ws(value), r"^[ .;:]+|[ .;:]+$", "")
    return (
        F.when(word_count(text) > 10, F.lit(""))
        .when(text.rlike("[=<>%]"), F.lit(""))
        .when(text.rlike(r"^\d*\.?\d*$") & text.rlike(r"\d"), F.lit(""))
        .otherwise(text)
    )


def has_statistical_payload(value: Column | str) -> Column:
    text = F.lower(strip(value))
    phrase = F.lit(False)
    for words in fv.STATISTICAL_PAYLOAD_PHRASES:
        phrase = phrase | text.contains(words)
    return (text != "") & (phrase | text.rlike(fv.STATISTICAL_PAYLOAD_PATTERN))


def infer_evidence_kind(text: Column, role_hint: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(lowered.rlike(fv.TABLE_WORD_PATTERN), "table_result")
        .when(lowered.rlike(fv.FIGURE_WORD_PATTERN), "figure_result")
        .when(lowered.rlike(fv.STATISTIC_WORD_PATTERN), "statistic")
        .when(lowered.contains("replicat"), "replication")
        .when(lowered.contains("robust") | lowered.contains("sensitivity"), "robustness")
        .when(role_hint == "method_result", "method_context")
        .when(role_hint.isin("claim", "mixed"), "mixed")
        .otherwise("observation")
    )


def normalize_evidence_kind(value: Column, text: Column, role_hint: Column) -> Column:
    cleaned = F.lower(strip(value))
    return F.when(cleaned.isin(*fv.EVIDENCE_KINDS), cleaned).otherwise(infer_evidence_kind(text, role_hint))


def coerce_bool(value: Column, default: bool) -> Column:
    cleaned = F.lower(strip(value))
    return F.when(cleaned.isin("true", "yes", "1"), True).when(cleaned.isin("false", "no", "0"), False).otherwise(default)


def infer_claim_profile(text: Column, context_keys: Column, detail_keys: Column, default: str = "generic_claim") -> Column:
    """First keyword rule that hits decides; detail keys decide only after all of them."""
    lowered = F.lower(text)

    def any_word(words) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        return hit

    out = None
    for profile, words in fv.PROFILE_KEYWORDS:
        hit = any_word(words)
        if profile == "mechanistic_claim":
            hit = hit | F.array_contains(context_keys, "mechanism")
        out = F.when(hit, profile) if out is None else out.when(hit, profile)
    stats = F.arrays_overlap(detail_keys, F.array(*[F.lit(k) for k in fv.STATISTIC_DETAIL_KEYS]))
    return out.when(stats, "regression_association_result").otherwise(default)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 16 hex digits of sha256 over the parts joined by ``||``."""
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(joined, 256), F.lit(16)))


def sequence_id(prefix: str, number: Column, width: int = 2) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def url_ok(value: Column | str) -> Column:
    return strip(value).rlike(r"^(?i:https?)://[^/?#]+")


def outcome_type(claim_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fv.OUTCOME_TYPE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, claim_type), F.lit("qualitative_result"))


def evidence_title(topic: Column, pages: Column, statement: Column) -> Column:
    return F.concat(topic, F.lit(" (p. "), F.when(pages == "", "n/a").otherwise(pages), F.lit("): "), F.left(statement, F.lit(80)))


def default_falsification(statement: Column, conditions: Column) -> Column:
    scope = F.when((conditions != "") & (conditions != fv.NOT_AVAILABLE), conditions).otherwise(F.lit("the same study design"))
    return F.concat(
        F.lit("Under "), scope,
        F.lit(", observing the opposite direction or no difference for the relationship stated ('"),
        F.left(statement, F.lit(120)), F.lit("') would refute this claim."),
    )


def quality_band(value: Column) -> Column:
    return (
        F.when(value.isNull(), "muted").when(value >= 0.9, "ok").when(value >= 0.7, "warn").otherwise("bad")
    )
