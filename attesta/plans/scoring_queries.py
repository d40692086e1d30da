"""Scores, ranks and payouts (SCO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.operators import scoring
from attesta.plans import duck as D
from attesta.plans.audit_queries import SCORE_SQL
from attesta.plans.registry import query
from attesta.session import cut_lineage
from attesta.settings import PayoutSettings

W100 = D.case_map("importance", fv.IMPORTANCE_WEIGHT_HUNDREDTHS, "0")

COVERAGE = f"""
  SELECT paper_id, contestant, CASE WHEN tm > 0 THEN
      {D.ratio('(gm * 19 + least(gn * 19, tm))', '(tm * 19 + least(tn * 19, tm))')}
    WHEN tn > 0 THEN {D.ratio('gn', 'tn')} ELSE 1.0 END AS coverage
  FROM (SELECT s.paper_id, s.contestant,
      coalesce(sum(CASE WHEN ok AND importance <> 'minor' THEN {W100} END), 0) AS tm, coalesce(sum(CASE WHEN ok AND importance = 'minor' THEN {W100} END), 0) AS tn,
      coalesce(sum(CASE WHEN ok AND m.unit_id IS NOT NULL AND importance <> 'minor' THEN {W100} END), 0) AS gm,
      coalesce(sum(CASE WHEN ok AND m.unit_id IS NOT NULL AND importance = 'minor' THEN {W100} END), 0) AS gn
    FROM f_submission s JOIN (SELECT *, required OR scoring_mode = 'accepted_improvement' AS ok FROM f_unit) u ON u.paper_id = s.paper_id
    LEFT JOIN f_unit_member m ON m.paper_id = u.paper_id AND m.unit_id = u.unit_id AND m.contestant = s.contestant
    GROUP BY s.paper_id, s.contestant)"""
DIAGNOSTIC = """
  SELECT paper_id, contestant, (100 - (CAST(paper_id AS BIGINT) + length(contestant)) % 7) / 100.0 AS diagnostic_quality FROM f_submission"""
PAPER_SCORE = f"""
  SELECT paper_id, contestant, coverage, diagnostic_quality, adj / 100.0 AS adjudication_quality, n_invalid, quality / 10000.0 AS quality,
         {D.ratio('CAST(round(coverage * 10000) AS BIGINT) * quality', '100000000')} AS score
  FROM (SELECT *, {D.ratio_units('CAST(round(diagnostic_quality * 10000) AS BIGINT) * adj', '1000000')} AS quality FROM (
    SELECT c.paper_id, c.contestant, coverage, diagnostic_quality, greatest(0, 100 - coalesce(x.lost, 0)) AS adj, coalesce(x.n, 0) AS n_invalid
    FROM f_coverage c JOIN f_diagnostic d USING (paper_id, contestant)
    LEFT JOIN (SELECT paper_id, contestant, sum({D.case_map('severity', fv.SEVERITY_PENALTY_HUNDREDTHS, '0')}) AS lost, count(*) AS n
               FROM f_invalid GROUP BY paper_id, contestant) x USING (paper_id, contestant)))"""
BATCH_ROWS = """
  SELECT paper_id, contestant, CASE contestant WHEN 'k11' THEN 0.0 WHEN 'k1' THEN 0.5 WHEN 'k0' THEN 0.5 ELSE score END AS score,
         CAST(paper_id AS BIGINT) % 17 = 0 AS missing FROM f_paper_score"""
BATCH = f"""
  SELECT *, rank() OVER (ORDER BY mean_score DESC) AS rank FROM (
    SELECT contestant, count(*) AS papers, count(DISTINCT CASE WHEN missing THEN paper_id END) AS missing_papers,
      {D.ratio('sum(CAST(round(score * 10000) AS BIGINT))', 'count(*) * 10000')} AS mean_score,
      {D.ratio('2 * median(CAST(round(score * 10000) AS BIGINT))', '20000')} AS median_score, round_even(min(score), 4) AS min_score
    FROM f_batch_row GROUP BY contestant)"""
VIEWS = {"f_coverage": COVERAGE, "f_diagnostic": DIAGNOSTIC, "f_paper_score": PAPER_SCORE, "f_batch_row": BATCH_ROWS, "f_batch": BATCH,
         "f_score": SCORE_SQL}


@query("sco_01_finding_score", "SELECT * EXCLUDE (severe), score >= 0.7 AND NOT severe AS passed FROM f_score", VIEWS)
def _finding_score(t):
    return scoring.score_findings(t.finding, ["paper_id"])


@query("sco_01b_clean_papers", """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, coalesce(score, 1.0) AS score, coalesce(score >= 0.7 AND NOT severe, true) AS passed
FROM documents LEFT JOIN f_score ON f_score.paper_id = CAST(doc_id AS VARCHAR)""", VIEWS)
def _clean(t):
    head = t.read("documents").select(F.col("doc_id").cast("string").alias("paper_id"))
    return scoring.with_clean_papers(head, scoring.score_findings(t.finding, ["paper_id"])).select("paper_id", "score", "passed")


@query("sco_02_quality_estimate", """
SELECT s.paper_id, score, greatest(0, 100 - 25 * coalesce(r, 0)) / 100.0 AS adjudication_quality,
       round_even(score * (greatest(0, 100 - 25 * coalesce(r, 0)) / 100.0), 4) AS quality_estimate
FROM f_score s LEFT JOIN (SELECT paper_id, count(*) FILTER (verdict = 'reject') AS r FROM f_verdict GROUP BY paper_id) v USING (paper_id)""", VIEWS)
def _quality(t):
    return scoring.quality_estimate(scoring.score_findings(t.finding, ["paper_id"]), t.verdict)


@query("sco_03_coverage", "SELECT * FROM f_coverage", VIEWS)
def _coverage(t):
    return scoring.coverage(t.unit, t.unit_member, t.submission)


@query("sco_04_unit_status", """
SELECT u.paper_id, s.contestant, u.unit_id, u.importance, u.scoring_mode, m.unit_id IS NOT NULL AS improvement,
  CASE WHEN m.unit_id IS NULL THEN CASE importance WHEN 'central' THEN 'critical' WHEN 'supporting' THEN 'major' ELSE 'minor' END END AS missing_severity
FROM f_submission s JOIN f_unit u ON u.paper_id = s.paper_id
LEFT JOIN f_unit_member m ON m.paper_id = u.paper_id AND m.unit_id = u.unit_id AND m.contestant = s.contestant
WHERE CASE WHEN m.unit_id IS NULL THEN required OR scoring_mode = 'accepted_improvement' ELSE scoring_mode = 'accepted_improvement' END""", VIEWS)
def _status(t):
    return scoring.unit_status(t.unit, t.unit_member, t.submission)


@query("sco_05_invalid_extras", """
SELECT i.paper_id, i.contestant, candidate_id AS target_id, severity FROM f_invalid i JOIN f_submission USING (paper_id, contestant)""", VIEWS)
def _invalid(t):
    return scoring.invalid_extras(t.invalid, t.submission).select("paper_id", "contestant", "target_id", "severity")


def diagnostics(t):
    lost = (F.col("paper_id").cast("bigint") + F.length("contestant")) % 7
    return t.submission.select("paper_id", "contestant", ((100 - lost) / 100).alias("diagnostic_quality"))


def paper_scores(t):
    return scoring.paper_scores(t.unit, t.unit_member, t.submission, t.invalid, diagnostics(t))


@query("sco_06_paper_score", "SELECT * FROM f_paper_score", VIEWS)
def _paper(t):
    return paper_scores(t)


@query("sco_07_project_claims", f"""
SELECT paper_id, pos, record_id, 'reference:' || record_id AS candidate_id, statement, {D.norm_statement('statement')} AS normalized_statement,
       nullif({D.strip('conditions')}, '') AS qualifier, span_id AS span_ids FROM (
  SELECT *, count(*) OVER (PARTITION BY paper_id, record_id) AS n FROM (
    SELECT paper_id, pos, conditions, span_id, {D.strip('statement')} AS statement,
      CASE WHEN pos % 7 = 0 THEN 'claim_' || CAST(pos AS VARCHAR) WHEN pos % 5 = 0 THEN 'C05' ELSE claim_id END AS record_id FROM f_claim))
WHERE n = 1 AND statement <> ''""")
def _project(t):
    ids = F.when(F.col("pos") % 7 == 0, " ").when(F.col("pos") % 5 == 0, "C05").otherwise(F.col("claim_id"))
    refs = t.quote.select("paper_id", F.col("pos").alias("claim_pos"), F.lit(0).alias("ref_pos"), "span_id", "quote")
    return scoring.project_claims(t.claim.withColumn("claim_id", ids), refs, "reference").select(
        "paper_id", "pos", "record_id", "candidate_id", "statement", "normalized_statement", "qualifier",
        F.array_join("span_ids", ",").alias("span_ids"))


def batch_rows(t):
    score = F.when(F.col("contestant") == "k11", 0.0).when(F.col("contestant").isin("k0", "k1"), 0.5).otherwise(F.col("score"))
    rows = paper_scores(t).select(
        "paper_id", "contestant", score.alias("score"), (F.col("paper_id").cast("bigint") % 17 == 0).alias("missing"))
    return cut_lineage(rows)  # read by several aggregates


@query("sco_08_batch_score", """
SELECT contestant, papers, missing_papers, (SELECT count(DISTINCT paper_id) FROM f_batch_row) - missing_papers AS submitted_papers,
       mean_score, median_score, min_score FROM f_batch""", VIEWS)
def _batch(t):
    return scoring.batch_scores(batch_rows(t)).select(
        "contestant", "papers", "missing_papers", "submitted_papers", "mean_score", "median_score", "min_score")


@query("sco_09_competition_rank", "SELECT contestant, rank, rank = 1 AND mean_score > 0 AS winner FROM f_batch", VIEWS)
def _rank(t):
    return scoring.batch_scores(batch_rows(t)).select("contestant", "rank", "winner")


PAYOUT = """
  SELECT contestant, mean_score AS batch_score, round_even(coalesce(share / sum(share) OVER (), 0), 8) AS payout_weight FROM (
    SELECT b.contestant, b.mean_score, w.share FROM f_batch b LEFT JOIN (
      SELECT contestant, sum(w) OVER (PARTITION BY mean_score) / count(*) OVER (PARTITION BY mean_score) AS share FROM (
        SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN slot = 0 THEN 0.7 WHEN slot <= least(4, n - 1)
          THEN 0.3 * pow(0.5, slot - 1) / list_sum(list_transform(range(CAST(least(4, n - 1) AS BIGINT)), lambda i: pow(0.5, i))) ELSE 0.0 END AS w
        FROM (SELECT *, row_number() OVER (ORDER BY mean_score DESC, contestant) - 1 AS slot, count(*) OVER () AS n FROM f_batch WHERE mean_score > 0))) w
    USING (contestant))"""


@query("sco_10_winner_takes_most", "SELECT contestant, payout_weight FROM f_payout", {**VIEWS, "f_payout": PAYOUT})
def _winner(t):
    scores = scoring.batch_scores(batch_rows(t)).select("contestant", "batch_score")
    return scoring.winner_takes_most(scores).select("contestant", "payout_weight")


@query("sco_11_proportional_payout", """
SELECT contestant, round_even(mean_score / sum(mean_score) OVER (), 8) AS payout_weight FROM (SELECT * FROM f_batch ORDER BY contestant)""", VIEWS)
def _proportional(t):
    scores = scoring.batch_scores(batch_rows(t)).select("contestant", "batch_score")
    return scoring.proportional_payout(scores).select("contestant", "payout_weight")


@query("sco_12_bucket_payout", """
SELECT contestant, round_even(payout_weight * 0.8, 8) AS overall_weight,
  round_even(CASE WHEN best THEN 0.2 / sum(CAST(best AS INTEGER)) OVER () ELSE 0 END, 8) AS newcomer_bonus FROM (
  SELECT *, coalesce(newcomer AND batch_score > 0.1 AND batch_score = max(CASE WHEN newcomer AND batch_score > 0.1 THEN batch_score END) OVER (), false) AS best
  FROM (SELECT *, contestant IN ('k2', 'k5', 'k7', 'k11') AS newcomer FROM f_payout))""", {**VIEWS, "f_payout": PAYOUT})
def _bucket(t):
    scores = scoring.batch_scores(batch_rows(t)).select(
        "contestant", "batch_score", "submitted_papers", F.col("contestant").isin("k2", "k5", "k7", "k11").alias("newcomer"))
    overall = scoring.winner_takes_most(scores.select("contestant", "batch_score"))
    settings = PayoutSettings(newcomer_share=0.2, newcomer_min_score=0.1)
    return scoring.bucket_payout(scores, overall, settings).select("contestant", "overall_weight", "newcomer_bonus")


@query("sco_13_batch_outcome", """
SELECT CASE WHEN f > 0 THEN 'degraded' ELSE 'completed' END AS outcome, f AS failed_papers, w AS winners FROM (
  SELECT (SELECT count(DISTINCT paper_id) FROM f_batch_row WHERE missing) AS f,
         (SELECT string_agg(contestant, ',' ORDER BY contestant) FROM f_batch WHERE rank = 1 AND mean_score > 0) AS w)""", VIEWS)
def _outcome(t):
    rows = batch_rows(t)
    return scoring.batch_outcome(scoring.batch_scores(rows), rows.where("missing")).select("outcome", "failed_papers", "winners")
