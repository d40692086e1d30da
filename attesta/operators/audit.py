"""Integrity, grounding and rigor audits over flat artifact tables.

Every audit returns the findings schema
``paper_id, pass_name, target_type, target_id, code, severity, detail``.
Claims, evidence, experiments and references are flat tables keyed by
``paper_id``; a nested artifact is exploded once (see ``assemble``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions import numbers as N
from attesta.functions import text as X
from attesta.operators.frames import ordinal, stack_checks

FINDING = ["paper_id", "pass_name", "target_type", "target_id", "code", "severity", "detail"]


def _finding(df: DataFrame, pass_name: str, target_type, target_id, code, severity, detail="") -> DataFrame:
    def col(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return df.select(
        "paper_id", col(pass_name).alias("pass_name"), col(target_type).alias("target_type"),
        col(target_id).cast("string").alias("target_id"), col(code).alias("code"),
        col(severity).alias("severity"), col(detail).cast("string").alias("detail"),
    )


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- raw artifact text
def invalid_json(raw: DataFrame) -> DataFrame:
    """Text that is not JSON, or not a JSON object.  ``raw`` has paper_id, body."""
    shape = F.schema_of_variant(F.try_parse_json("body"))
    bad = raw.where(shape.isNull() | ~shape.startswith("OBJECT"))
    return _finding(bad, "structural", "artifact", F.lit(None), "invalid_json", "blocker")


def missing_layers(raw: DataFrame) -> DataFrame:
    keys = F.json_object_keys("body")
    layers = F.array(*[F.lit(layer) for layer in fv.ARTIFACT_LAYERS])
    gone = raw.where(keys.isNotNull()).select("paper_id", F.explode(F.array_except(layers, keys)).alias("layer"))
    return _finding(gone, "structural", "layer", F.col("layer"), "missing_layer", "blocker")


def schema_failures(raw: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Objects that do not fit the schema or lack a required field; blocker when a layer is missing."""
    parsed = F.from_json("body", schema + ", _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    checked = raw.where(F.json_object_keys("body").isNotNull()).withColumn("_a", parsed)
    lacking = reduce(lambda a, b: a | b, [F.col(f"_a.{path}").isNull() for path in required])
    layers = F.array(*[F.lit(layer) for layer in fv.ARTIFACT_LAYERS])
    no_layer = F.size(F.array_except(layers, F.json_object_keys("body"))) > 0
    bad = checked.where(F.col("_a").isNull() | F.col("_a._broken").isNotNull() | lacking)
    return _finding(bad, "structural", "artifact", F.lit(None), "schema_validation_failed",
                    F.when(no_layer, "blocker").otherwise("critical"))


# ---------------------------------------------------------------- integrity
def duplicate_ids(ids: DataFrame) -> DataFrame:
    """``ids`` has paper_id, target_type, target_id over all id spaces; blanks are ignored."""
    many = ids.where(F.col("target_id") != "").groupBy("paper_id", "target_type", "target_id").count().where("count > 1")
    return _finding(many, "structural", F.col("target_type"), F.col("target_id"), "duplicate_id", "critical", F.col("count"))


def empty_layer(papers: DataFrame, rows: DataFrame, target_type: str, code: str) -> DataFrame:
    gone = papers.select("paper_id").join(rows.select("paper_id").distinct(), "paper_id", "left_anti")
    return _finding(gone, "structural", target_type, F.lit(None), code, "critical")


def missing_fields(rows: DataFrame, target_type: str, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Blank required fields; ``fields`` maps field name to severity."""
    items = F.array(*[
        F.struct(F.lit(name).alias("field"), F.lit(severity).alias("severity"), X.is_blank(name).alias("blank"))
        for name, severity in fields.items()
    ])
    blank = rows.select("paper_id", F.col(id_col).alias("target_id"), F.explode(F.filter(items, lambda i: i["blank"])).alias("_f"))
    return _finding(blank, "structural", target_type, F.col("target_id"), "missing_required_field",
                    F.col("_f.severity"), F.col("_f.field"))


def unresolved(refs: DataFrame, known: DataFrame, target_type: str, field: str, severity: str) -> DataFrame:
    """References (paper_id, target_id, ref_id) whose id is not in ``known`` (paper_id, ref_id)."""
    gone = refs.join(known.select("paper_id", "ref_id").distinct(), ["paper_id", "ref_id"], "left_anti")
    return _finding(gone, "structural", target_type, F.col("target_id"), "unresolved_reference", severity,
                    F.concat_ws(":", F.lit(field), "ref_id"))


def number_findings(findings: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Sequence ids per paper in emission order, with what the pass of that prefix suggests for the code."""
    numbered = ordinal(findings, ["paper_id"], order, "_no")
    suggestion = F.lit(fv.OTHER_SUGGESTION.get(prefix))
    for code, text in fv.SUGGESTIONS.get(prefix, {}).items():
        suggestion = F.when(F.col("code") == code, text).otherwise(suggestion)
    return numbered.withColumn("finding_id", X.sequence_id(prefix, F.col("_no"), 3)).withColumn(
        "suggestion", suggestion.cast("string")).drop("_no")


# ---------------------------------------------------------------- source references
def missing_source_payload(papers: DataFrame, spans: DataFrame) -> DataFrame:
    gone = papers.select("paper_id").join(spans.select("paper_id").distinct(), "paper_id", "left_anti")
    return _finding(gone, "grounding", "source_payload", F.lit(None), "missing_source_payload", "critical")


def no_source_refs(rows: DataFrame, target_type: str, id_col: str, *supports: DataFrame) -> DataFrame:
    """Targets that appear in none of the support tables (paper_id, id)."""
    keys = ["paper_id", id_col]
    left = rows.select(*keys)
    for support in supports:
        left = left.join(support.select(*keys).distinct(), keys, "left_anti")
    return _finding(left, "grounding", target_type, F.col(id_col), "no_source_refs", "critical")


def source_ref_checks(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Role, empty and unknown span checks.

    ``refs`` has paper_id, target_type, target_id, source_type, role, span_ids.
    """
    role = _finding(refs.where(~F.col("role").isin(*fv.ROLE_VALUES)), "grounding", F.col("target_type"),
                    F.col("target_id"), "invalid_source_role", "major", F.col("role"))
    empty = _finding(refs.where((F.size("span_ids") == 0) & (F.col("source_type") == "span")), "grounding",
                     F.col("target_type"), F.col("target_id"), "missing_source_span", "major")
    cited = refs.select("paper_id", "target_type", "target_id", F.explode("span_ids").alias("span_id"))
    unknown = cited.join(spans.select("paper_id", "span_id").distinct(), ["paper_id", "span_id"], "left_anti")
    gone = _finding(unknown, "grounding", F.col("target_type"), F.col("target_id"), "missing_source_span", "critical", F.col("span_id"))
    return union_findings(role, empty, gone)


def quote_checks(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Multi-span, not-in-source and short-quote findings in one join with the cited spans.

    ``refs`` has paper_id, target_type, target_id, ref_id, quote, span_ids and
    may mix claims, evidence, experiments, concepts and trace nodes.
    """
    quoted = refs.where(~X.is_blank("quote"))
    keys = ["paper_id", "target_type", "target_id", "ref_id", "quote", "n_spans"]
    cited = quoted.withColumn("n_spans", F.size("span_ids")).select(*keys, F.explode_outer("span_ids").alias("span_id"))
    texts = spans.select("paper_id", "span_id", F.col("text").alias("_text"))
    hit = F.coalesce(
        F.contains("_text", "quote") | F.contains(X.normalize_quote("_text"), X.normalize_quote("quote")), F.lit(False)
    )
    per_ref = cited.join(texts, ["paper_id", "span_id"], "left").groupBy(*keys).agg(F.bool_or(hit).alias("found"))
    checks = [
        ("quote_multi_span", "minor", F.col("n_spans") != 1),
        ("quote_not_in_source", "critical", ~F.col("found")),
        ("short_quote", "warning", F.col("found") & (F.length(X.strip("quote")) < 25)),
    ]
    hits = stack_checks(per_ref, ["paper_id", "target_type", "target_id", "ref_id"], checks)
    return _finding(hits, "rigor", F.col("target_type"), F.col("target_id"), F.col("code"), F.col("severity"), F.col("ref_id"))


def connected_quotes(claims: DataFrame, claim_refs: DataFrame, claim_evidence: DataFrame, evidence_refs: DataFrame) -> DataFrame:
    """Quotes of a claim's own references and of its linked evidence, as one array per claim."""
    keys = ["paper_id", "claim_id"]
    own = claim_refs.where(~X.is_blank("quote")).select(*keys, "quote")
    linked = claim_evidence.select(*keys, "evidence_id").join(
        evidence_refs.where(~X.is_blank("quote")).select("paper_id", "evidence_id", "quote"), ["paper_id", "evidence_id"]
    ).select(*keys, "quote")
    lists = own.unionByName(linked).groupBy(*keys).agg(F.collect_set("quote").alias("quotes"))
    return claims.join(lists, keys, "left").withColumn(
        "quotes", F.coalesce("quotes", F.array().cast("array<string>"))
    )


def claim_rigor(claims: DataFrame) -> DataFrame:
    """Per-claim checks that need no other row; ``claims`` carries its connected ``quotes``."""
    missing = N.ungrounded_numbers(F.concat_ws(" ", "statement", "conditions"), F.col("quotes"))
    conditions = X.strip("conditions")
    falsification = X.strip("falsification")
    checks = [
        ("number_not_grounded", "major", F.size(missing) > 0),
        ("no_quote", "major", F.size("quotes") == 0),
        ("vague_conditions", "warning", (F.length(conditions) < 30) | F.lower(conditions).startswith("not available")),
        ("weak_falsification", "warning",
         (F.length(falsification) < 40) | falsification.rlike("(?i)" + fv.GENERIC_FALSIFICATION_PATTERN)),
        ("long_statement", "minor", X.word_count("statement") > 60),
        ("no_importance", "suggestion", F.col("importance").isNull() | ~F.col("importance").isin(*fv.IMPORTANCE_VALUES)),
    ]
    hits = stack_checks(claims, ["paper_id", "claim_id"], checks)
    return _finding(hits, "rigor", "claim", F.col("claim_id"), F.col("code"), F.col("severity"))


def near_duplicates(matches: DataFrame) -> DataFrame:
    """One finding per claim with an earlier similar claim: ``matches`` has paper_id, left_id (earliest), right_id."""
    return _finding(matches, "rigor", "claim", F.col("right_id"), "near_duplicate", "major", F.col("left_id"))


def evidence_rigor(evidence: DataFrame, evidence_refs: DataFrame, links: DataFrame) -> DataFrame:
    """Ungrounded summary numbers and records that link no claim."""
    keys = ["paper_id", "evidence_id"]
    quotes = evidence_refs.where(~X.is_blank("quote")).groupBy(*keys).agg(F.collect_set("quote").alias("quotes"))
    linked = links.select(*keys).distinct().withColumn("_linked", F.lit(True))
    joined = evidence.join(quotes, keys, "left").join(linked, keys, "left")
    summary_quotes = F.coalesce("quotes", F.array().cast("array<string>"))
    checks = [
        ("evidence_number_not_grounded", "minor", F.size(N.ungrounded_numbers(F.col("summary"), summary_quotes)) > 0),
        ("orphan_evidence", "minor", F.col("_linked").isNull()),
    ]
    hits = stack_checks(joined, keys, checks)
    return _finding(hits, "rigor", "evidence", F.col("evidence_id"), F.col("code"), F.col("severity"))


def experiment_rigor(experiments: DataFrame, refs: DataFrame) -> DataFrame:
    """Exact numbers in the expected outcome; method constants no quote states."""
    keys = ["paper_id", "experiment_id"]
    quotes = refs.where(~X.is_blank("quote")).groupBy(*keys).agg(F.collect_set("quote").alias("quotes"))
    joined = experiments.join(quotes, keys, "left")
    own = F.coalesce("quotes", F.array().cast("array<string>"))
    constants = N.ungrounded_numbers(F.concat_ws(" ", "setup", "procedure"), own)
    checks = [
        ("experiment_numbers", "minor", F.size(N.numbers_in(F.coalesce("expected_outcome", F.lit("")))) > 0),
        ("experiment_constants_ungrounded", "warning", F.size(constants) > 0),
    ]
    hits = stack_checks(joined, keys, checks)
    return _finding(hits, "rigor", "experiment", F.col("experiment_id"), F.col("code"), F.col("severity"))


# ---------------------------------------------------------------- lighter artifact check
def artifact_issues(papers: DataFrame, claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """Empty fields, unresolved evidence and coverage shortfalls as (paper_id, path, code).

    ``papers`` has paper_id, title, n_summary (non-blank summary statements).
    """
    def issue(df: DataFrame, path, code: str) -> DataFrame:
        return df.select("paper_id", (path if isinstance(path, Column) else F.lit(path)).alias("path"), F.lit(code).alias("code"))

    n_claims = claims.groupBy("paper_id").agg(F.count("*").alias("n_claims"))
    n_evidence = evidence.groupBy("paper_id").agg(F.count("*").alias("n_evidence"))
    per_claim = claims.select("paper_id", "claim_id").join(
        claim_evidence.groupBy("paper_id", "claim_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("_set")),
        ["paper_id", "claim_id"], "left",
    ).select("paper_id", F.coalesce(F.array_join("_set", "\u0001"), F.lit("")).alias("_set"))
    sets = per_claim.groupBy("paper_id").agg(F.min("_set").alias("_low"), F.max("_set").alias("_high"))
    wide = papers.join(n_claims, "paper_id", "left").join(n_evidence, "paper_id", "left").join(sets, "paper_id", "left").na.fill(
        0, ["n_claims", "n_evidence"]
    )
    expected = F.least(F.lit(3), F.col("n_summary"))
    paper_issues = [
        issue(wide.where(X.is_blank("paper_id")), "paper.paper_id", "missing"),
        issue(wide.where(F.coalesce("title", F.lit("")) == ""), "paper.title", "missing"),
        issue(wide.where("n_claims = 0"), "logic.claims", "missing"),
        issue(wide.where((expected > 0) & (F.col("n_claims") < expected)), "logic.claims", "insufficient_coverage"),
        issue(wide.where("n_claims >= 3 AND n_evidence < n_claims"), "evidence.records", "insufficient_evidence_coverage"),
        issue(wide.where("n_claims > 1 AND _low = _high"), "logic.claims", "collapsed_evidence_coverage"),
    ]
    path = lambda field: F.concat(F.lit("logic.claims."), F.col("claim_id"), F.lit("." + field))
    claim_issues = [
        issue(claims.where(F.coalesce(name, F.lit("")) == ""), path(label), "missing")
        for name, label in (("statement", "statement"), ("conditions", "conditions"), ("falsification", "falsification_criteria"))
    ]
    gone = claim_evidence.join(evidence.select("paper_id", "evidence_id").distinct(), ["paper_id", "evidence_id"], "left_anti")
    return reduce(lambda a, b: a.unionByName(b), [*paper_issues, *claim_issues, issue(gone, path("evidence_ids"), "unresolved_ref")])


# ---------------------------------------------------------------- statistics and report
def artifact_statistics(claims: DataFrame, refs: DataFrame, evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per paper: counts, span coverage, mean quotes, quote length and words.

    ``refs`` has paper_id, claim_id, span_id, quote: one row per quote and cited span.
    """
    per_claim = refs.groupBy("paper_id", "claim_id").agg(F.count(F.when(F.col("quote") != "", 1)).alias("_nq"))
    claim_stats = claims.join(per_claim, ["paper_id", "claim_id"], "left").groupBy("paper_id").agg(
        F.count("*").alias("claims"),
        F.sum(F.coalesce("_nq", F.lit(0))).alias("_quotes"),
        F.sum(X.word_count("statement")).alias("_words"),
        F.count(F.when(F.size(N.numbers_in(F.col("statement"))) > 0, 1)).alias("claims_with_numbers"),
        *[F.count(F.when(F.col("importance") == level, 1)).alias(f"n_{level}") for level in fv.IMPORTANCE_VALUES],
    )
    lengths = refs.where(F.col("quote") != "").groupBy("paper_id").agg(F.sum(F.length("quote")).alias("_chars"), F.count("*").alias("_nquote"))
    known = spans.select("paper_id", "span_id").distinct()
    cited = refs.select("paper_id", "span_id").distinct().join(known, ["paper_id", "span_id"]).groupBy("paper_id").agg(
        F.count("*").alias("spans_cited"))
    totals = known.groupBy("paper_id").agg(F.count("*").alias("spans_total"))
    n_evidence = evidence.groupBy("paper_id").agg(F.count("*").alias("evidence_records"))
    wide = totals
    for part in (claim_stats, lengths, cited, n_evidence):
        wide = wide.join(part, "paper_id", "left")
    wide = wide.na.fill(0)
    ratio = lambda a, b, places: F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b), places)).otherwise(0.0)
    return wide.select(
        "paper_id", "claims", "evidence_records", "spans_total", "spans_cited",
        ratio("spans_cited", "spans_total", 4).alias("span_coverage"),
        "claims_with_numbers",
        ratio("_quotes", "claims", 2).alias("avg_quotes_per_claim"),
        ratio("_chars", "_nquote", 1).alias("avg_quote_chars"),
        ratio("_words", "claims", 1).alias("avg_statement_words"),
        *[f"n_{level}" for level in fv.IMPORTANCE_VALUES],
    )


def report_rollup(papers: DataFrame, findings: DataFrame, scores: DataFrame) -> DataFrame:
    """Findings per pass beside the score; papers without an artifact keep a zero row."""
    passes = ["structural", "grounding", "rigor"]
    counts = findings.groupBy("paper_id").agg(
        *[F.count(F.when(F.col("pass_name") == p, 1)).alias(f"{p}_count") for p in passes]
    )
    joined = papers.join(counts, "paper_id", "left").join(scores, "paper_id", "left")
    return joined.select(
        "paper_id", *[F.coalesce(f"{p}_count", F.lit(0)).alias(f"{p}_count") for p in passes],
        F.when(F.col("has_artifact"), F.coalesce("score", F.lit(1.0))).otherwise(0.0).alias("score"),
        F.when(F.col("has_artifact"), F.coalesce("passed", F.lit(True))).otherwise(False).alias("passed"),
    )


def report_details(papers: DataFrame, findings: DataFrame) -> DataFrame:
    """What ``report_rollup`` counts, in full: severity_summary (map, every severity) and findings (list of structs).

    ``papers``: paper_id (unique), has_artifact; ``findings``: paper_id,
    pass_name, finding_no, target_id, code, severity.  The list runs by pass
    (structural, grounding, rigor, then others by name), then by finding_no; it
    holds the findings of one artifact.  A paper without an artifact has none
    and says so in ``error``.  Unknown severities count in the list only.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in ("structural", "grounding", "rigor")]), F.col("pass_name")),
                                F.lit(0)), F.lit(4))
    listed = F.struct(place.alias("_place"), "pass_name", "finding_no", "target_id", "code", "severity")
    grouped = findings.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(listed)).alias("_all"),
        *[F.count(F.when(F.col("severity") == level, 1)).alias(f"_{level}") for level in fv.SEVERITY_PENALTY_HUNDREDTHS])
    both = papers.join(grouped, "paper_id", "left")
    there = F.coalesce("has_artifact", F.lit(False))
    fields = ("pass_name", "finding_no", "target_id", "code", "severity")
    found = F.transform("_all", lambda f: F.struct(*[f[name].alias(name) for name in fields]))
    summary = F.create_map(*[c for level in fv.SEVERITY_PENALTY_HUNDREDTHS for c in (
        F.lit(level), F.when(there, F.coalesce(f"_{level}", F.lit(0))).otherwise(0))])
    return both.select(
        "paper_id", F.when(~there, "artifact missing").alias("error"), summary.alias("severity_summary"),
        F.when(there & F.col("_all").isNotNull(), found).otherwise(
            F.array().cast("array<struct<pass_name:string,finding_no:long,target_id:string,code:string,severity:string>>")).alias("findings"))
