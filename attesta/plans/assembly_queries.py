"""Artifact layers (ASM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.operators import assemble as A
from attesta.plans import duck as D
from attesta.plans.registry import query


@query("asm_01_domain_coercion", f"""
SELECT paper_id, claim_id, importance, CASE WHEN status = 'supported' THEN status ELSE 'supported' END AS status, claim_type,
  CASE WHEN trim(conditions) = '' THEN {D.q(fv.NOT_AVAILABLE)} ELSE conditions END AS conditions FROM f_claim""")
def _coerce(t):
    return A.coerce_domains(t.claim.withColumn("importance", F.upper("importance"))).select(
        "paper_id", "claim_id", "importance", "status", "claim_type", "conditions")


@query("asm_02_evidence_records", f"""
SELECT paper_id, claim_id, printf('EV%02d', row_number() OVER (PARTITION BY paper_id ORDER BY pos)) AS evidence_id, 'support' AS role,
  topic || ' (p. ' || CAST(page AS VARCHAR) || '): ' || left(statement, 80) AS title,
  CASE WHEN len({D.missing_numbers('given', 'qs')}) > 0 THEN statement ELSE given END AS summary,
  {D.case_map('claim_type', D.fv.OUTCOME_TYPE, "'qualitative_result'")} AS outcome_type, len(qs) AS n_refs
FROM (SELECT c.*, CASE WHEN c.pos % 3 = 0 THEN c.statement ELSE c.statement || ' 42' END AS given,
        CASE WHEN {D.strip('q.quote')} <> '' THEN [q.quote] ELSE CAST([] AS VARCHAR[]) END AS qs
      FROM f_claim c LEFT JOIN f_quote q ON q.paper_id = c.paper_id AND q.claim_id = c.claim_id)""")
def _evidence(t):
    claims = t.claim.withColumn("summary", F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat("statement", F.lit(" 42"))))
    return A.evidence_records(claims.withColumn("pages", F.col("page").cast("string")), t.quote.select("paper_id", "claim_id", "quote"))


@query("asm_03_supplied_experiments")
def _experiments(t):
    quotes = t.quote.join(t.claim.select("paper_id", "claim_id", "page"), ["paper_id", "claim_id"]).select(
        "paper_id", F.format_string("E%02d", "page").alias("experiment_id"), "quote")
    rows = t.experiment.withColumn("setup", F.concat("setup", F.lit(" of 120 patients at 2.5 mg")))
    return A.supplied_experiments(rows, t.experiment_claim, t.claim, quotes)


@query("asm_04_leftover_by_topic", """
SELECT paper_id, topic, first_pos, n_claims, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY first_pos) AS INTEGER) AS topic_no, 'Analysis of ' || topic AS title FROM (
  SELECT paper_id, topic, min(pos) AS first_pos, count(*) AS n_claims FROM f_claim c
  WHERE NOT EXISTS (SELECT 1 FROM f_experiment_claim e WHERE e.paper_id = c.paper_id AND e.claim_id = c.claim_id) GROUP BY paper_id, topic)""")
def _leftover(t):
    return A.leftover_by_topic(t.claim, t.experiment_claim).drop("setup")


@query("asm_05_inverse_index", """
SELECT paper_id, claim_id, string_agg(experiment_id, ',' ORDER BY experiment_id) AS experiment_ids FROM f_experiment_claim GROUP BY paper_id, claim_id""")
def _inverse(t):
    return A.inverse_index(t.experiment_claim).withColumn("experiment_ids", F.array_join("experiment_ids", ","))


NODE = """
  SELECT paper_id, 'R' || CAST(pos AS VARCHAR) AS node_id, pos % 6 AS depth, pos % 3 = 0 AS spans, pos % 2 = 0 AS explicit,
    CASE WHEN pos % 5 = 0 THEN 'C7777' ELSE claim_id END AS ref FROM f_claim"""


def nodes(t):
    base = t.claim.select("paper_id", "pos", "claim_id", F.concat(F.lit("R"), F.col("pos").cast("string")).alias("node_id"))
    tree = base.select("paper_id", "node_id", (F.col("pos") % 6).alias("depth"), F.lit("result").alias("node_type"),
                       F.when(F.col("pos") % 2 == 0, "explicit").otherwise("inferred").alias("support_level"), F.when(F.col("pos") % 3 == 0, 1).otherwise(0).alias("n_spans"))
    refs = base.select("paper_id", "node_id", F.when(F.col("pos") % 5 == 0, "C7777").otherwise(F.col("claim_id")).alias("claim_id"))
    return A.trace_nodes(tree, refs, t.claim)


@query("asm_06_trace_nodes", """
SELECT paper_id, node_id, depth, CASE WHEN explicit AND (spans OR ref <> 'C7777') THEN 'explicit' ELSE 'inferred' END AS support_level,
  CASE WHEN ref = 'C7777' THEN 0 ELSE 1 END AS n_claims FROM f_node WHERE depth <= 4""", {"f_node": NODE})
def _trace(t):
    return nodes(t)[0].select("paper_id", "node_id", "depth", "support_level", "n_claims")


@query("asm_06b_trace_leftovers", """
SELECT paper_id, topic, min(pos) AS first_pos, count(*) AS n_claims FROM f_claim c
WHERE NOT EXISTS (SELECT 1 FROM f_node n WHERE n.paper_id = c.paper_id AND n.ref = c.claim_id AND n.depth <= 4) GROUP BY paper_id, topic""", {"f_node": NODE})
def _trace_left(t):
    return nodes(t)[1].select("paper_id", "topic", "first_pos", "n_claims")


TRACE = """{"summary": "  What  holds ", "children": [
  {"node_type": "question", "support_level": "explicit", "summary": "a", "claim_ids": ["C01"], "children": [
    "skip",
    {"node_type": "result", "support_level": "explicit", "summary": "b", "claim_ids": [], "evidence": ["C02", "C7777"], "children": [
      {"summary": "c", "children": [
        {"node_type": null, "support_level": "explicit", "span_ids": ["s1"], "children": [{"summary": "too deep", "claim_ids": ["C03"]}]}]}]}]},
  {"node_type": "result", "support_level": "explicit", "summary": "e", "evidence": ["C7777"]}]}"""


@query("asm_06c_nested_trace", """
WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id % 3 <> 0 AS traced, source FROM documents),
n AS (SELECT * FROM (VALUES ('Q1', 'Q0', 1, 1, 'question', 'explicit', 'a', 'C01'), ('R2', 'Q1', 2, 2, 'result', 'explicit', 'b', 'C02'), ('Q3', 'R2', 3, 3, 'question', 'inferred', 'c', NULL),
  ('R4', 'Q3', 4, 4, 'question', 'spans', 'Not available from provided input', NULL), ('R5', 'Q0', 5, 1, 'result', 'inferred', 'e', NULL)) v(node_id, parent_id, place, depth, node_type, support, summary, ref)),
tree AS (SELECT p.paper_id, n.*, c.claim_id FROM p CROSS JOIN n LEFT JOIN f_claim c ON c.paper_id = p.paper_id AND c.claim_id = n.ref WHERE traced),
rest AS (SELECT paper_id, traced, topic, min(pos) AS first, string_agg(claim_id, ',' ORDER BY pos) AS claim_ids FROM f_claim c JOIN p USING (paper_id)
  WHERE NOT (traced AND claim_id IN ('C01', 'C02')) GROUP BY ALL)
SELECT paper_id, 'Q0' AS node_id, NULL AS parent_id, 0 AS place, 0 AS depth, 'question' AS node_type, 'explicit' AS support_level,
  CASE WHEN traced THEN 'What holds' ELSE 'What does the paper ''' || source || ''' establish?' END AS summary, '' AS claim_ids FROM p
UNION ALL SELECT paper_id, node_id, parent_id, place, depth, node_type, CASE WHEN support = 'spans' OR claim_id IS NOT NULL THEN 'explicit' ELSE 'inferred' END, summary, coalesce(claim_id, '') FROM tree
UNION ALL SELECT paper_id, 'R' || k, 'Q0', k, 1, 'result', 'explicit', 'Results on ' || topic, claim_ids
FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY first) + CASE WHEN traced THEN 5 ELSE 0 END AS k FROM rest)""")
def _nested_trace(t):
    """A trace five levels deep for two thirds of the papers, none for the others."""
    docs = t.read("documents")
    replies = docs.select(F.col("doc_id").cast("string").alias("paper_id"), F.when(F.col("doc_id") % 3 != 0, TRACE).alias("body"),
                          F.col("source").alias("title"), F.lit(1).alias("n_spans"))
    return A.nested_trace(replies, t.claim).withColumn("claim_ids", F.array_join("claim_ids", ","))


@query("asm_07_metadata_overlay", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'T ' || lang ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE coalesce(c.s, '') END AS claims_summary
FROM documents LEFT JOIN (SELECT paper_id, string_agg(statement, '|' ORDER BY pos) AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS k FROM f_claim WHERE importance = 'central') WHERE k <= 8 GROUP BY paper_id) c ON c.paper_id = CAST(doc_id AS VARCHAR)""")
def _metadata(t):
    docs = t.read("documents").withColumn("paper_id", F.col("doc_id").cast("string"))
    papers = docs.select("paper_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("title"))
    supplied = docs.select("paper_id", F.concat(F.lit(" T  "), "lang").alias("title"),
                           F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("given"), F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("claims_summary"))
    return A.overlay_metadata(papers, supplied, t.claim, ["title"]).withColumn("claims_summary", F.array_join("claims_summary", "|"))


@query("asm_08_value_counts", """
SELECT paper_id, string_agg(importance || '=' || CAST(n AS VARCHAR), ',' ORDER BY importance) AS counts FROM (
  SELECT paper_id, importance, count(*) AS n FROM f_claim GROUP BY paper_id, importance) GROUP BY paper_id""")
def _counts(t):
    folded = A.as_map(A.value_counts(t.claim, "importance"))
    entries = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return folded.select("paper_id", F.array_join(entries, ",").alias("counts"))


@query("asm_09_layer_round_trip", "SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS INTEGER) AS pos, claim_id, statement FROM f_claim")
def _round_trip(t):
    nested = A.fold_layer(t.claim.select("paper_id", "pos", "claim_id", "statement"), "claims", ["claim_id", "statement"])
    return A.explode_layer(nested, "claims", ["claim_id", "statement"])
