"""Quotes and candidates over the claim-shaped views (GRD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import grounding as G
from attesta.plans import duck as D
from attesta.plans.registry import query

LOCATED = f"""
  SELECT q.paper_id, q.pos, q.span_id, CASE WHEN length({D.strip('q.quote')}) < 25 THEN 'failed' WHEN contains(s.text, {D.strip('q.quote')}) THEN 'exact'
    WHEN contains({D.norm_quote('s.text')}, {D.norm_quote('q.quote')}) THEN 'normalized' ELSE 'failed' END AS method
  FROM f_quote q JOIN f_span s ON s.paper_id = q.paper_id AND s.span_id = q.span_id"""


@query("grd_01_locate_exact_normalized", "SELECT paper_id, pos, method FROM f_located", {"f_located": LOCATED})
def _locate(t):
    return G.locate_quotes(t.quote, t.span, fuzzy=False).select("paper_id", "pos", "method")


@query("grd_01b_locate_fuzzy")
def _fuzzy(t):
    return G.locate_quotes(t.quote, t.span).select("paper_id", "pos", "method", "similarity", "located")


@query("grd_01c_located_source_text", f"""
SELECT q.paper_id, q.pos, {D.norm_quote('q.quote')} AS located
FROM f_quote q JOIN f_located l ON l.paper_id = q.paper_id AND l.pos = q.pos WHERE l.method IN ('exact', 'normalized')""", {"f_located": LOCATED})
def _source_text(t):
    """The source text of a located quote is the quote itself, but for white space and case."""
    from attesta.functions import text as X

    found = G.locate_quotes(t.quote, t.span, fuzzy=False).where("method <> 'failed'")
    return found.select("paper_id", "pos", X.normalize_quote("located").alias("located"))


@query("grd_02_quote_in_span", f"""
SELECT q.paper_id, q.pos, contains(s.text, q.quote) OR contains({D.norm_quote('s.text')}, {D.norm_quote('q.quote')}) AS found
FROM f_quote q JOIN f_span s ON s.paper_id = q.paper_id AND s.span_id = q.span_id""")
def _in_span(t):
    joined = t.quote.join(t.span.select("paper_id", "span_id", "text"), ["paper_id", "span_id"])
    return joined.select("paper_id", "pos", G.quote_in_span(F.col("text"), F.col("quote")).alias("found"))


def proposals(t):
    """Claims as proposals: each with its quote."""
    rows = t.claim.select("paper_id", F.col("claim_id").alias("candidate_id"), "span_id", "statement",
                          F.lit("").alias("conditions"), "claim_type", "status", "importance")
    quotes = t.quote.select("paper_id", F.col("claim_id").alias("candidate_id"), "span_id", F.lit(0).alias("quote_pos"), "quote", "role")
    return rows, quotes


VERIFIED = f"""
  SELECT c.paper_id, c.pos, c.span_id, CASE WHEN length(st) < 20 THEN 'empty_statement'
    WHEN regexp_matches(st, {D.q('(?i)' + D.fv.BOILERPLATE_STATEMENT_PATTERN)}) AND len({D.numbers('st')}) = 0 THEN 'boilerplate_statement'
    WHEN length({D.collapse('q.quote')}) < 25 OR NOT (contains(s.text, {D.collapse('q.quote')}) OR contains({D.norm_quote('s.text')}, {D.norm_quote('q.quote')}))
      THEN 'no_grounded_quote'
    WHEN len({D.missing_numbers('st', f"[left(CASE WHEN contains(s.text, {D.strip('q.quote')}) THEN {D.strip('q.quote')} ELSE {D.strip('s.text')} END, 420)]")}) > 0
      THEN 'ungrounded_numbers' END AS reason
  FROM (SELECT *, {D.collapse("statement")} AS st FROM f_claim) c
  JOIN f_quote q ON q.paper_id = c.paper_id AND q.pos = c.pos JOIN f_span s ON s.paper_id = c.paper_id AND s.pos = c.pos"""


@query("grd_03_verify_candidates", """
SELECT paper_id, span_id, reason, CASE WHEN reason IS NULL THEN 'kept' WHEN reason = 'ungrounded_numbers' THEN 'repair' ELSE 'dropped' END AS route
FROM f_verified""", {"f_verified": VERIFIED})
def _verify(t):
    rows, quotes = proposals(t)
    return G.verify_candidates(rows, quotes, t.span, fuzzy=False).select("paper_id", "span_id", "reason", "route")


@query("grd_03b_verify_with_numbers")
def _verify_numbers(t):
    """Full statements, fuzzy quotes included: numbers no quote states go to repair."""
    _, quotes = proposals(t)
    rows = t.claim.select("paper_id", F.col("claim_id").alias("candidate_id"), "span_id", "statement", "conditions", "claim_type", "status", "importance")
    return G.verify_candidates(rows, quotes, t.span).select(
        "paper_id", "candidate_id", "route", "reason", F.array_join("missing_numbers", ",").alias("missing_numbers"))


# With the fuzzy stage, a quote with one edited character is found.
ONE_EDIT = "(q.doc_no + q.pos) % 4 = 3"
LOCATED_FUZZY = f"""
  SELECT q.paper_id, q.pos, q.span_id, CASE WHEN length({D.strip('q.quote')}) < 25 THEN 'failed' WHEN contains(s.text, {D.strip('q.quote')}) THEN 'exact'
    WHEN contains({D.norm_quote('s.text')}, {D.norm_quote('q.quote')}) THEN 'normalized' WHEN {ONE_EDIT} THEN 'fuzzy' ELSE 'failed' END AS method
  FROM f_quote q JOIN f_span s ON s.paper_id = q.paper_id AND s.span_id = q.span_id"""
VERIFIED_FUZZY = f"""
  SELECT c.paper_id, c.pos, c.span_id, CASE WHEN length(st) < 20 THEN 'empty_statement'
    WHEN regexp_matches(st, {D.q('(?i)' + D.fv.BOILERPLATE_STATEMENT_PATTERN)}) AND len({D.numbers('st')}) = 0 THEN 'boilerplate_statement'
    WHEN length({D.collapse('q.quote')}) < 25 OR NOT ({ONE_EDIT} OR contains(s.text, {D.collapse('q.quote')}) OR contains({D.norm_quote('s.text')}, {D.norm_quote('q.quote')}))
      THEN 'no_grounded_quote'
    WHEN len({D.missing_numbers('st', f"[left(CASE WHEN contains(s.text, {D.strip('q.quote')}) THEN {D.strip('q.quote')} ELSE {D.strip('s.text')} END, 420)]")}) > 0
      THEN 'ungrounded_numbers' END AS reason
  FROM (SELECT *, {D.collapse("statement")} AS st FROM f_claim) c
  JOIN f_quote q ON q.paper_id = c.paper_id AND q.pos = c.pos JOIN f_span s ON s.paper_id = c.paper_id AND s.pos = c.pos"""


@query("grd_03c_verify_with_fuzzy", """
SELECT paper_id, span_id, reason, CASE WHEN reason IS NULL THEN 'kept' WHEN reason = 'ungrounded_numbers' THEN 'repair' ELSE 'dropped' END AS route
FROM f_verified""", {"f_verified": VERIFIED_FUZZY})
def _verify_with_fuzzy(t):
    rows, quotes = proposals(t)
    return G.verify_candidates(rows, quotes, t.span).select("paper_id", "span_id", "reason", "route")


@query("grd_04_repair_pass")
def _repair(t):
    """Rows sent to repair come back with the numbers struck out."""
    _, quotes = proposals(t)
    rows = t.claim.select("paper_id", F.col("claim_id").alias("candidate_id"), "span_id", "statement", "conditions", "claim_type", "status", "importance")
    again = G.verify_candidates(rows, quotes, t.span, fuzzy=False).where("route = 'repair'").withColumn(
        "statement", F.regexp_replace("statement", "[0-9]+", "some"))
    fixed = again.select("paper_id", "candidate_id", "span_id", "statement", F.lit("").alias("conditions"), "claim_type", "status", "importance")
    return G.repair_pass(fixed, quotes, t.span, fuzzy=False).select("paper_id", "candidate_id", "repaired")


@query("grd_05_grounding_report", """
SELECT v.paper_id, v.span_id, 1 AS raw, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS kept,
  CASE WHEN reason = 'ungrounded_numbers' THEN 1 ELSE 0 END AS repair, CASE WHEN reason <> 'ungrounded_numbers' THEN 1 ELSE 0 END AS dropped,
  CASE WHEN method = 'exact' THEN 1 ELSE 0 END AS n_exact, CASE WHEN method = 'normalized' THEN 1 ELSE 0 END AS n_normalized, 0 AS n_fuzzy,
  CASE WHEN method = 'failed' THEN 1 ELSE 0 END AS n_failed
FROM f_verified v JOIN f_located l ON l.paper_id = v.paper_id AND l.pos = v.pos""", {"f_verified": VERIFIED, "f_located": LOCATED})
def _report(t):
    rows, quotes = proposals(t)
    return G.grounding_report(G.verify_candidates(rows, quotes, t.span, fuzzy=False), G.locate_quotes(t.quote, t.span, fuzzy=False))


@query("grd_05b_report_with_fuzzy", """
SELECT v.paper_id, v.span_id, 1 AS raw, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS kept,
  CASE WHEN reason = 'ungrounded_numbers' THEN 1 ELSE 0 END AS repair, CASE WHEN reason <> 'ungrounded_numbers' THEN 1 ELSE 0 END AS dropped,
  CASE WHEN method = 'exact' THEN 1 ELSE 0 END AS n_exact, CASE WHEN method = 'normalized' THEN 1 ELSE 0 END AS n_normalized,
  CASE WHEN method = 'fuzzy' THEN 1 ELSE 0 END AS n_fuzzy, CASE WHEN method = 'failed' THEN 1 ELSE 0 END AS n_failed
FROM f_verified v JOIN f_located l ON l.paper_id = v.paper_id AND l.pos = v.pos""", {"f_verified": VERIFIED_FUZZY, "f_located": LOCATED_FUZZY})
def _report_with_fuzzy(t):
    rows, quotes = proposals(t)
    return G.grounding_report(G.verify_candidates(rows, quotes, t.span), G.locate_quotes(t.quote, t.span))


@query("grd_06_final_quote_guard", f"""
SELECT paper_id, claim_id, pos, span_id, role, kind <> 'none' AS verified,
  CASE kind WHEN 'exact' THEN plain WHEN 'normalized' THEN {D.strip('line')} ELSE quote END AS quote FROM (
  SELECT q.*, s.text AS line, {D.strip('q.quote')} AS plain, CASE WHEN {D.strip('q.quote')} = '' THEN 'none' WHEN contains(s.text, {D.strip('q.quote')}) THEN 'exact'
    WHEN contains({D.norm_quote('s.text')}, {D.norm_quote('q.quote')}) THEN 'normalized'
    -- one edited character of so many leaves a similarity that rounds to 0.999 or more
    WHEN (q.doc_no + q.pos) % 4 = 3 AND round(1 - 1.0 / length({D.norm_quote('q.quote')}), 4) >= 0.999 THEN 'normalized' ELSE 'none' END AS kind
  FROM f_quote q JOIN f_span s ON s.paper_id = q.paper_id AND s.span_id = q.span_id)""")
def _guard(t):
    sources = t.quote.select("paper_id", "claim_id", "pos", "span_id", "quote", "role")
    return G.guard_quotes(sources, t.span)


@query("grd_07_verified_source_ref", f"""
SELECT q.paper_id, q.pos AS ref_key, q.span_id, CASE l.method WHEN 'exact' THEN left(q.quote, 420) WHEN 'normalized' THEN left({D.strip('s.text')}, 420) END AS quote
FROM f_quote q JOIN f_located l ON l.paper_id = q.paper_id AND l.pos = q.pos JOIN f_span s ON s.paper_id = q.paper_id AND s.span_id = q.span_id""", {"f_located": LOCATED})
def _refs(t):
    base = t.quote.select(
        "paper_id", F.col("pos").alias("ref_key"), "quote",
        F.posexplode(F.array(F.concat(F.col("paper_id"), F.lit("-span-9999")), F.col("span_id"))).alias("span_pos", "span_id"))
    from attesta.functions import text as X

    found = G.verified_refs(base.withColumn("quote", X.strip("quote")), t.span, fuzzy=False)
    return found.select("paper_id", "ref_key", "span_id", "quote")


@query("grd_07b_verified_ref_with_fuzzy")
def _refs_with_fuzzy(t):
    """No SQL: where the edited character was `ß`, the located text ends a character early."""
    base = t.quote.select(
        "paper_id", F.col("pos").alias("ref_key"), "quote",
        F.posexplode(F.array(F.concat(F.col("paper_id"), F.lit("-span-9999")), F.col("span_id"))).alias("span_pos", "span_id"))
    from attesta.functions import text as X

    found = G.verified_refs(base.withColumn("quote", X.strip("quote")), t.span)
    return found.select("paper_id", "ref_key", "span_id", "quote")


SPANS_OF_WORDS = f"""
  SELECT paper_id, span_id, norm, w FROM (
    SELECT paper_id, span_id, lower({D.collapse('text')}) AS norm, unnest(list_distinct(list_filter(
      string_split(lower({D.collapse('text')}), ' '), lambda x: length(x) >= 8))) AS w FROM f_span)"""
INTERVALS = """
  SELECT DISTINCT paper_id, span_id, CAST(start AS BIGINT) AS start, CAST(start + length(w) AS BIGINT) AS stop FROM (
    SELECT paper_id, span_id, w, pieces, unnest(range(1, len(pieces))) AS k,
      list_sum(list_transform(pieces[1:k], lambda p: length(p))) + (k - 1) * length(w) AS start
    FROM (SELECT *, string_split(norm, w) AS pieces FROM f_word))"""


@query("grd_08_quote_occurrences", """
SELECT paper_id, span_id, min(start) AS start, max(stop) AS stop FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, span_id ORDER BY start, stop) AS island FROM (
    SELECT *, max(stop) OVER (PARTITION BY paper_id, span_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f_interval))
GROUP BY paper_id, span_id, island""", {"f_word": SPANS_OF_WORDS, "f_interval": INTERVALS})
def _occurrences(t):
    """Long words of a span as quotes; their highlighted stretches."""
    from attesta.functions import text as X

    words = F.filter(F.split(F.lower(X.collapse_ws("text")), " "), lambda w: F.length(w) >= 8)
    quotes = t.span.select("paper_id", "span_id", F.explode(F.array_distinct(words)).alias("quote"))
    return G.merge_intervals(G.occurrences(t.span, quotes))


@query("grd_09_passage_lookup", f"""
SELECT CAST(doc_id AS VARCHAR) AS paper_id, item_id AS passage_id FROM documents d, benchmark b
WHERE {D.norm_quote('b.text')} <> '' AND contains({D.norm_quote('d.text')}, {D.norm_quote('b.text')})""")
def _passages(t):
    spans = t.read("documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("doc_id").cast("string").alias("span_id"), "text")
    passages = t.read("benchmark").select(F.col("item_id").alias("passage_id"), "text")
    return G.find_passages(spans, passages).select("paper_id", "passage_id")
