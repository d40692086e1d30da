"""Rollups and reports (RPT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import grounding
from attesta.operators import reports as R
from attesta.plans import duck as D
from attesta.plans.grounding_queries import LOCATED, LOCATED_FUZZY
from attesta.plans.registry import query
from attesta.plans.scoring_queries import VIEWS, paper_scores
from attesta.plans.tables import CONTESTANTS
from attesta.session import cut_lineage

RUN = """
  SELECT CAST(o_custkey AS VARCHAR) AS run_name, o_orderkey AS paper_pos, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'missing' END AS status,
    o_orderkey % 150 AS claims, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 10001 END AS q, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS runtime, o_orderdate AS updated_at FROM orders"""


def runs(t):
    key = F.col("o_orderkey")
    return t.read("orders").select(
        F.col("o_custkey").cast("string").alias("run_name"), key.alias("paper_pos"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("missing").alias("status"),
        (key % 150).alias("claims"), F.when(key % 4 != 0, (key % 10001) / 10000).alias("quality"),
        F.when(key % 3 != 0, F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cost_cents"),
        F.when(key % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("runtime"), F.col("o_orderdate").alias("updated_at"))


DONE = "status = 'completed'"


@query("rpt_01_run_rollup", f"""
SELECT run_name, count(*) AS paper_count, count(*) FILTER ({DONE}) AS completed, count(*) FILTER (status = 'failed') AS failed,
  CASE WHEN count(*) FILTER ({DONE}) > 0 THEN {D.ratio(f'sum(claims) FILTER ({DONE})', f'count(*) FILTER ({DONE})', 1)} END AS avg_claims,
  CASE WHEN count(q) FILTER ({DONE}) > 0 THEN {D.ratio(f'sum(q) FILTER ({DONE})', f'count(q) FILTER ({DONE}) * 10000')} END AS avg_quality,
  sum(cents) FILTER ({DONE}) / 100.0 AS total_cost_usd, arg_min(runtime, paper_pos) FILTER (runtime <> '') AS runtime, max(updated_at) AS updated_at
FROM f_run GROUP BY run_name""", {"f_run": RUN})
def _runs(t):
    return R.run_rollup(runs(t))


@query("rpt_02_usage_merge", """
SELECT run_id, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(cost_micro) / 1000000.0 AS cost_usd,
  CASE WHEN count(cost_micro) = 0 THEN 'unavailable' WHEN bool_and(cost_kind = 'actual') FILTER (cost_micro IS NOT NULL) THEN 'actual' ELSE 'estimated' END AS cost_kind,
  (SELECT string_agg(stage, ',' ORDER BY a) FROM (SELECT stage, min(call_no) AS a FROM f_call c2 WHERE c2.run_id = c.run_id GROUP BY stage)) AS source
FROM f_call c GROUP BY run_id""")
def _usage(t):
    calls = t.call.withColumn("cost_units", F.col("cost_micro") * 100).withColumn("source", F.col("stage"))
    return R.merge_usage(calls, ["run_id"])


@query("rpt_03_severity_histogram", """
SELECT code, severity, count(*) AS n, list_position(['blocker', 'critical', 'major', 'minor', 'warning', 'suggestion'], severity) AS severity_order FROM f_finding GROUP BY code, severity""")
def _histogram(t):
    return R.severity_histogram(t.finding, ["code"])


@query("rpt_04_usage_normalization", """
SELECT event_id AS record_id, k AS prompt_tokens, CASE WHEN s = 3 THEN NULL ELSE k * 2 END AS completion_tokens, CASE WHEN s = 1 THEN 7 END AS reasoning_tokens,
  CASE WHEN s = 1 THEN 3 WHEN s = 2 THEN 4 END AS cache_read_tokens, CAST(NULL AS BIGINT) AS cache_write_tokens, CASE s WHEN 0 THEN k * 5 WHEN 1 THEN k * 3 + 7 WHEN 2 THEN k * 3 END AS total_tokens,
  CASE s WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN NULL ELSE value END AS cost_usd,
  CASE s WHEN 0 THEN 'actual' WHEN 1 THEN 'estimated' WHEN 2 THEN 'unavailable' ELSE 'actual' END AS cost_kind
FROM (SELECT event_id, event_id % 4 AS s, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def _normalize(t):
    """Four record shapes with different aliases, made from each event."""
    k = F.get_json_object("props", "$.k")
    twice = (k.cast("bigint") * 2).cast("string")
    value = F.col("value").cast("string")
    shape = F.col("event_id") % 4
    body = (
        F.when(shape == 0, F.concat(F.lit('{"prompt_tokens": '), k, F.lit(', "completion_tokens": '), twice, F.lit(', "total_tokens": '), (k.cast("bigint") * 5).cast("string"), F.lit(', "cost_usd": '), value, F.lit("}")))
        .when(shape == 1, F.concat(F.lit('{"input_tokens": '), k, F.lit(', "output_tokens": '), twice, F.lit(', "prompt_tokens_details": {"cached_tokens": 3}, "completion_tokens_details": {"reasoning_tokens": 7}, "response_cost": '), value, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"prompt_tokens": '), k, F.lit(', "output_tokens": '), twice, F.lit(', "cached_tokens": 4}')))
        .otherwise(F.concat(F.lit('{"input_tokens": '), k, F.lit(', "actual_cost_usd": '), value, F.lit(', "response_cost": 1}'))))
    return R.normalize_usage(t.read("events").select(F.col("event_id").alias("record_id"), body.alias("body")))


@query("rpt_04b_usage_of_records", """
SELECT event_id AS record_id, CASE WHEN s IN (0, 1, 3) THEN k END AS prompt_tokens, CASE WHEN s IN (0, 1) THEN 2 * k END AS completion_tokens,
  CASE s WHEN 0 THEN 999999 + 2 * k WHEN 1 THEN 3 * k WHEN 2 THEN k END AS total_tokens,
  CASE WHEN s IN (1, 3) THEN value WHEN s = 4 THEN 2 END AS cost_usd,
  CASE s WHEN 3 THEN 'estimated' WHEN 4 THEN 'actual' ELSE 'unavailable' END AS cost_kind
FROM (SELECT event_id, event_id % 6 AS s, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE s < 5""")
def _records(t):
    """Records with usage in the record, in its response or in hidden parameters; a sixth has none."""
    fill = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("<k>"), F.col("k").cast("string")), F.lit("<2k>"), (F.col("k") * 2).cast("string")),
                                  F.lit("<v>"), F.col("value").cast("string"))
    shape = F.col("event_id") % 6
    body = (
        F.when(shape == 0, fill('{"usage": {"prompt_tokens": <k>}, "response": {"usage": {"prompt_tokens": 999999, "completion_tokens": <2k>}}}'))
        .when(shape == 1, fill('{"response": {"usage_metadata": {"input_tokens": <k>, "output_tokens": <2k>}, "_hidden_params": {"response_cost": <v>}}}'))
        .when(shape == 2, fill('{"usage": "none", "token_usage": {"prompt_tokens": "12", "total_tokens": <k>.9}}'))
        .when(shape == 3, fill('{"usage": {"prompt_tokens": <k>, "response_cost": 1}, "cost": <v>}'))
        .when(shape == 4, fill('{"_hidden_params": {"cost_usd": <v>}, "actual_cost_usd": 2}'))
        .otherwise(F.lit('{"response": {"usage": [1]}}')))
    rows = t.read("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return R.record_usage(rows.select(F.col("event_id").alias("record_id"), body.alias("body"))).select(
        "record_id", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "cost_kind")


@query("rpt_05_cost_estimation", """
SELECT call_no, round_even(CASE WHEN cost_micro IS NOT NULL THEN cost_micro / 1000000.0 WHEN (prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL) AND model <> 'vendor/m2'
    THEN (coalesce(prompt_tokens, 0) * CASE model WHEN 'vendor/m0' THEN 2.0 ELSE 0.5 END + coalesce(completion_tokens, 0) * CASE model WHEN 'vendor/m0' THEN 8.0 ELSE 1.5 END) / 1000000 END, 8) AS cost_usd
FROM f_call""")
def _cost(t):
    prices = t.spark.createDataFrame([("vendor/m0", 2.0, 8.0, None, None), ("m1", 0.5, 1.5, 0.1, None)], "model string, input double, output double, cache_read double, cache_write double")
    usage = t.call.withColumn("cost_usd", F.col("cost_micro") / 1e6).withColumns({c: F.lit(None).cast("bigint") for c in ("cache_read_tokens", "cache_write_tokens", "total_tokens")})
    return R.estimate_cost(usage, prices).select("call_no", F.bround("cost_usd", 8).alias("cost_usd"))


@query("rpt_06_stage_breakdown", """
SELECT model, stage, count(*) AS requests, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(cost_micro) AS cost_units
FROM f_call GROUP BY ROLLUP (model, stage)""")
def _stages(t):
    return R.stage_breakdown(t.call.withColumnRenamed("cost_micro", "cost_units"))


@query("rpt_07_span_funnel", """
SELECT s.paper_id, s.span_id, 1 AS raw, CASE WHEN l.method <> 'failed' THEN 1 ELSE 0 END AS grounded, CASE WHEN s.pos % 3 = 0 THEN 1 ELSE 0 END AS citing
FROM f_span s JOIN f_located l ON l.paper_id = s.paper_id AND l.pos = s.pos""", {"f_located": LOCATED})
def _funnel(t):
    located = grounding.locate_quotes(t.quote, t.span, fuzzy=False).select("paper_id", "span_id", (F.col("method") != "failed").alias("kept"))
    return R.span_funnel(t.span, located, t.claim.where("pos % 3 = 0").select("paper_id", "span_id", "claim_id"))


@query("rpt_07b_span_funnel_with_fuzzy", """
SELECT s.paper_id, s.span_id, 1 AS raw, CASE WHEN l.method <> 'failed' THEN 1 ELSE 0 END AS grounded, CASE WHEN s.pos % 3 = 0 THEN 1 ELSE 0 END AS citing
FROM f_span s JOIN f_located l ON l.paper_id = s.paper_id AND l.pos = s.pos""", {"f_located": LOCATED_FUZZY})
def _funnel_with_fuzzy(t):
    located = grounding.locate_quotes(t.quote, t.span).select("paper_id", "span_id", (F.col("method") != "failed").alias("kept"))
    return R.span_funnel(t.span, located, t.claim.where("pos % 3 = 0").select("paper_id", "span_id", "claim_id"))


@query("rpt_08_claim_export", f"""
WITH l AS (SELECT paper_id, claim_id, evidence_id, min(ref_pos) AS p FROM f_claim_evidence GROUP BY paper_id, claim_id, evidence_id),
g AS (SELECT l.paper_id, l.claim_id, string_agg(l.evidence_id, '; ' ORDER BY p, l.evidence_id) AS ids, count(e.evidence_id) AS n,
  string_agg({D.strip('e.summary')}, ' | ' ORDER BY p, l.evidence_id) FILTER ({D.strip('e.summary')} <> '') AS s,
  '[' || string_agg('"' || l.evidence_id || '"', ',' ORDER BY p, l.evidence_id) || ']' AS j
  FROM l LEFT JOIN f_evidence e ON e.paper_id = l.paper_id AND e.evidence_id = l.evidence_id GROUP BY l.paper_id, l.claim_id)
SELECT c.paper_id, c.claim_id, c.statement, t.section_name, coalesce(ids, '') AS linked_evidence_ids, coalesce(n, 0) AS linked_evidence_count,
  coalesce(s, '') AS linked_evidence_summary, coalesce(j, '[]') AS evidence_json
FROM f_claim c JOIN f_section_span t ON t.paper_id = c.paper_id AND t.pos = c.pos LEFT JOIN g ON g.paper_id = c.paper_id AND g.claim_id = c.claim_id""")
def _export(t):
    sections = t.claim.select("paper_id", "pos", "claim_id").join(t.section_span.select("paper_id", "pos", "section_name"), ["paper_id", "pos"]).drop("pos")
    return R.claim_export(t.claim, sections, t.claim_evidence.withColumnRenamed("ref_pos", "link_pos"), t.evidence)


NAMES = [f"k{i}" for i in range(CONTESTANTS)]


@query("rpt_09_contestant_matrix", "SELECT paper_id, " + ", ".join(f"max(score) FILTER (contestant = '{n}') AS {n}" for n in NAMES) + " FROM f_paper_score GROUP BY paper_id", VIEWS)
def _matrix(t):
    return R.contestant_matrix(paper_scores(t), NAMES)


@query("rpt_09b_paper_leaders", f"""
SELECT paper_id, max(score) AS best_score, arg_min(contestant, (-score, contestant)) AS best, max(score) FILTER (contestant = 'k3') AS mine,
  {D.ratio('sum(CAST(round(score * 10000) AS BIGINT))', 'count(*) * 10000')} AS average, count(*) AS n FROM f_paper_score GROUP BY paper_id""", VIEWS)
def _leaders(t):
    return R.paper_leaders(paper_scores(t), "k3")


@query("rpt_10_claim_filter", """
SELECT c.paper_id, c.claim_id FROM f_claim c JOIN f_verdict v ON v.paper_id = c.paper_id
WHERE importance = 'central' AND verdict = 'accept' AND contains(lower(claim_id || ' ' || statement || ' ' || conditions), 'the')""")
def _filter(t):
    joined = t.claim.join(t.verdict.select("paper_id", "verdict"), "paper_id", "left")
    return R.filter_claims(joined, "central", "accept", "The").select("paper_id", "claim_id")


@query("rpt_11_lost_candidates", """
SELECT paper_id, claim_id AS candidate_id FROM f_claim c WHERE pos % 4 <> 0
AND NOT EXISTS (SELECT 1 FROM f_experiment_claim e WHERE e.paper_id = c.paper_id AND e.claim_id = c.claim_id)""")
def _lost(t):
    name = lambda df: df.select("paper_id", F.col("claim_id").alias("candidate_id"))
    return R.lost_candidates(name(t.claim), name(t.experiment_claim), name(t.claim.where("pos % 4 = 0")))


@query("rpt_11b_merge_rows", """
SELECT e.paper_id, experiment_id AS claim_key, count(*) AS members FROM f_experiment_claim e JOIN f_claim c ON c.paper_id = e.paper_id AND c.claim_id = e.claim_id
GROUP BY e.paper_id, experiment_id HAVING count(*) > 1""")
def _merges(t):
    members = t.experiment_claim.select("paper_id", F.col("experiment_id").alias("claim_key"), F.col("claim_id").alias("candidate_id"))
    return R.merge_rows(members, t.claim.select("paper_id", F.col("claim_id").alias("candidate_id")))


@query("rpt_12_claim_inspector", """
SELECT c.paper_id, c.claim_id,
  coalesce((SELECT string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) FROM f_claim_evidence x WHERE x.paper_id = c.paper_id AND x.claim_id = c.claim_id), '') AS evidence_ids,
  coalesce((SELECT string_agg(DISTINCT experiment_id, ',' ORDER BY experiment_id) FROM f_experiment_claim x WHERE x.paper_id = c.paper_id AND x.claim_id = c.claim_id), '') AS experiment_ids,
  1 AS quoted_spans, 1 AS quotes, coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM f_finding x WHERE x.paper_id = c.paper_id AND x.target_id = c.claim_id), '') AS finding_codes
FROM f_claim c""")
def _inspector(t):
    findings = t.finding.select("paper_id", F.col("target_id").alias("claim_id"), "code")
    return R.claim_inspector(t.claim.select("paper_id", "claim_id"), t.claim_evidence, t.experiment_claim, t.quote, findings)


@query("rpt_13_throughput", """
SELECT count(*) AS rows, count(*) FILTER (status = 'completed') AS completed, sum(claims) FILTER (status = 'completed') / count(*) FILTER (status = 'completed') AS avg_seconds,
  max(claims) FILTER (status = 'completed') AS slowest_seconds, sum(claims) FILTER (status = 'completed') / count(*) FILTER (status = 'completed') * 50 / 8 / 60 AS projected_minutes
FROM f_run""", {"f_run": RUN})
def _throughput(t):
    return R.throughput(runs(t).withColumn("seconds", F.col("claims")))


@query("rpt_14_quality_bands", """
SELECT paper_pos, CASE WHEN q IS NULL THEN 'muted' WHEN q >= 9000 THEN 'ok' WHEN q >= 7000 THEN 'warn' ELSE 'bad' END AS band FROM f_run""", {"f_run": RUN})
def _bands(t):
    return R.quality_bands(runs(t), "quality").select("paper_pos", "band")


@query("rpt_15_latest_runs", """
SELECT run_name, max(updated_at) AS updated_at FROM f_run GROUP BY run_name ORDER BY updated_at DESC, run_name LIMIT 20""", {"f_run": RUN})
def _latest(t):
    return R.latest_open(R.run_rollup(runs(t)).select("run_name", "updated_at"), t.verdict.withColumn("status", F.col("verdict")), 20)[0]


@query("rpt_16_task_results", f"""
WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS task_id, conv_id || '-' || turn AS paper_id, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'b' || conv_id END AS batch_id, 'run' || conv_id AS run_id, text AS payload,
  CASE WHEN turn % 3 = 2 THEN 'x' END AS error FROM conversations)
SELECT task_id, paper_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, strlen(payload) AS artifact_bytes, sha256(payload) AS artifact_sha256,
  {D.stable('artifact', "coalesce(nullif(batch_id, ''), run_id)", 'paper_id')} AS artifact_id,
  count(*) FILTER (error IS NULL) OVER (PARTITION BY task_id) AS completed, count(error) OVER (PARTITION BY task_id) AS failed FROM p""")
def _tasks(t):
    rows = t.read("conversations").select(
        F.col("conv_id").cast("string").alias("task_id"), F.concat_ws("-", "conv_id", "turn").alias("paper_id"),
        F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.concat(F.lit("b"), F.col("conv_id").cast("string"))).alias("batch_id"),
        F.concat(F.lit("run"), F.col("conv_id").cast("string")).alias("run_id"), F.col("text").alias("payload"), F.when(F.col("turn") % 3 == 2, "x").alias("error"))
    return R.task_results(rows)
