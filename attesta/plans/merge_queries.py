"""Merging, guarding, ranking and capping of claims (MRG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import merge as M
from attesta.operators.similarity import similar_pairs
from attesta.plans import duck as D
from attesta.plans.registry import query
from attesta.settings import CLAIMS

TOK = f"SELECT *, {D.tokens('statement')} AS tok FROM f_claim"


def tokens_only(t):
    """Claims with their token sets; numbers are left out so that SQL can follow."""
    return t.claim.withColumn("tokens", X.tokens("statement")).withColumn("numbers", F.array().cast("array<string>"))


def _edges(limit):
    return f"""SELECT b.paper_id, a.pos AS i, b.pos AS j FROM f_tok a JOIN f_tok b ON a.paper_id = b.paper_id AND a.pos < b.pos
      WHERE {D.jaccard('a.tok', 'b.tok')} >= {limit}"""


LEADERS = """/*rec*/
  WITH RECURSIVE r AS (SELECT c.paper_id, c.pos, row_number() OVER (PARTITION BY c.paper_id ORDER BY c.pos) AS n, coalesce(e.near, CAST([] AS INTEGER[])) AS near
    FROM f_claim c LEFT JOIN (SELECT paper_id, j, list(i) AS near FROM f_edge GROUP BY paper_id, j) e ON e.paper_id = c.paper_id AND e.j = c.pos),
  fold AS (
    SELECT paper_id, pos, n, [pos] AS leaders, pos AS leader_pos FROM r WHERE n = 1
    UNION ALL
    SELECT paper_id, pos, n, CASE WHEN hit IS NULL THEN list_append(leaders, pos) ELSE leaders END, coalesce(hit, pos) FROM (
      SELECT r.paper_id, r.pos, r.n, f.leaders, list_min(list_intersect(r.near, f.leaders)) AS hit
      FROM fold f JOIN r ON r.paper_id = f.paper_id AND r.n = f.n + 1))
  SELECT paper_id, pos, leader_pos FROM fold"""
VIEWS = {"f_tok": TOK, "f_edge": _edges(0.5), "f_leader": LEADERS}


@query("mrg_01_similar_pairs", f"""
WITH s AS (SELECT paper_id, list_sort(tok) AS tok, min(pos) AS pos FROM f_tok WHERE len(tok) > 0 GROUP BY paper_id, list_sort(tok))
SELECT a.paper_id, a.pos AS left_pos, b.pos AS right_pos, round_even({D.jaccard('a.tok', 'b.tok')}, 4) AS score
FROM s a JOIN s b ON a.paper_id = b.paper_id AND a.pos < b.pos WHERE {D.jaccard('a.tok', 'b.tok')} >= 0.3""", VIEWS)
def _pairs(t):
    return similar_pairs(tokens_only(t), 0.3).withColumn("score", F.bround("score", 4))


@query("mrg_02_leader_clusters", "SELECT * FROM f_leader", VIEWS)
def _leaders(t):
    return M.premerge(tokens_only(t), number_rule=False)


@query("mrg_02b_leader_clusters_with_numbers", "SELECT * FROM f_leader", {
    "f_tok": f"SELECT *, {D.tokens('statement')} AS tok, {D.numbers('statement')} AS nums FROM f_claim",
    "f_edge": f"""SELECT b.paper_id, a.pos AS i, b.pos AS j FROM f_tok a JOIN f_tok b ON a.paper_id = b.paper_id AND a.pos < b.pos
      WHERE {D.jaccard('a.tok', 'b.tok')} >= 0.5 OR ({D.jaccard('a.tok', 'b.tok')} >= 0.375 AND len(list_intersect(a.nums, b.nums)) > 0)""",
    "f_leader": LEADERS})
def _leaders_numbers(t):
    return M.premerge(M.with_signature(t.claim))


@query("mrg_02c_survivors", f"""
SELECT l.paper_id, l.leader_pos AS pos, count(*) - 1 AS absorbed, ['central', 'supporting', 'minor'][min({D.rank('importance')}) + 1] AS importance
FROM f_leader l JOIN f_claim c ON c.paper_id = l.paper_id AND c.pos = l.pos GROUP BY l.paper_id, l.leader_pos""", VIEWS)
def _survivors(t):
    rows = tokens_only(t)
    return M.survivors(rows, M.premerge(rows, number_rule=False)).select("paper_id", "pos", "absorbed", "importance")


@query("mrg_02d_pooled_quotes", """
SELECT l.paper_id, l.leader_pos, q.quote, arg_min(q.span_id, q.pos) AS span_id
FROM f_leader l JOIN f_quote q ON q.paper_id = l.paper_id AND q.pos = l.pos GROUP BY l.paper_id, l.leader_pos, q.quote""", VIEWS)
def _pooled(t):
    quotes = t.quote.select("paper_id", "pos", F.lit(0).alias("quote_pos"), "span_id", "quote", "role")
    return M.pooled_quotes(quotes, M.premerge(tokens_only(t), number_rule=False)).select("paper_id", "leader_pos", "quote", "span_id")


NUMBER_VIEWS = {
    "f_tok": f"SELECT *, {D.tokens('statement')} AS tok, {D.numbers('statement')} AS nums FROM f_claim",
    "f_edge": f"""SELECT b.paper_id, a.pos AS i, b.pos AS j FROM f_tok a JOIN f_tok b ON a.paper_id = b.paper_id AND a.pos < b.pos
      WHERE {D.jaccard('a.tok', 'b.tok')} >= 0.5 OR ({D.jaccard('a.tok', 'b.tok')} >= 0.375 AND len(list_intersect(a.nums, b.nums)) > 0)""",
    "f_leader": LEADERS}


@query("mrg_02e_survivors_with_numbers", f"""
SELECT l.paper_id, l.leader_pos AS pos, count(*) - 1 AS absorbed, ['central', 'supporting', 'minor'][min({D.rank('importance')}) + 1] AS importance
FROM f_leader l JOIN f_claim c ON c.paper_id = l.paper_id AND c.pos = l.pos GROUP BY l.paper_id, l.leader_pos""", NUMBER_VIEWS)
def _survivors_numbers(t):
    rows = M.with_signature(t.claim)
    return M.survivors(rows, M.premerge(rows)).select("paper_id", "pos", "absorbed", "importance")


@query("mrg_02f_pooled_quotes_with_numbers", """
SELECT l.paper_id, l.leader_pos, q.quote, arg_min(q.span_id, q.pos) AS span_id
FROM f_leader l JOIN f_quote q ON q.paper_id = l.paper_id AND q.pos = l.pos GROUP BY l.paper_id, l.leader_pos, q.quote""", NUMBER_VIEWS)
def _pooled_numbers(t):
    quotes = t.quote.select("paper_id", "pos", F.lit(0).alias("quote_pos"), "span_id", "quote", "role")
    return M.pooled_quotes(quotes, M.premerge(M.with_signature(t.claim))).select("paper_id", "leader_pos", "quote", "span_id")


GROUPS = """
  SELECT paper_id, CAST(pos // 70 AS INTEGER) AS chunk, claim_id AS candidate_id, CAST(pos // 3 AS INTEGER) AS group_pos FROM f_claim WHERE pos % 5 <> 0
  UNION ALL SELECT paper_id, CAST(pos // 70 AS INTEGER), claim_id, CAST(pos // 3 + 1 AS INTEGER) FROM f_claim WHERE pos % 6 = 0
  UNION ALL SELECT paper_id, CAST(pos // 70 AS INTEGER), claim_id || 'x', CAST(pos // 3 AS INTEGER) FROM f_claim WHERE pos % 9 = 0"""
OWNER = "SELECT paper_id, chunk, candidate_id, min(group_pos) AS group_pos FROM f_group WHERE NOT ends_with(candidate_id, 'x') GROUP BY paper_id, chunk, candidate_id"
APPLIED = """
  SELECT paper_id, chunk, candidate_id, group_pos, 'member' AS kind FROM f_owner
  UNION ALL SELECT paper_id, CAST(pos // 70 AS INTEGER), claim_id, NULL, 'dropped' FROM f_claim c WHERE pos % 10 = 0
    AND NOT EXISTS (SELECT 1 FROM f_owner o WHERE o.paper_id = c.paper_id AND o.candidate_id = c.claim_id)
  UNION ALL SELECT paper_id, CAST(pos // 70 AS INTEGER), claim_id, NULL, 'singleton' FROM f_claim c WHERE pos % 10 <> 0
    AND NOT EXISTS (SELECT 1 FROM f_owner o WHERE o.paper_id = c.paper_id AND o.candidate_id = c.claim_id)"""
GROUP_VIEWS = {**VIEWS, "f_group": GROUPS, "f_owner": OWNER, "f_applied": APPLIED}


def model_groups(t):
    """Merge groups and drops as a model would supply them, with repeats and unknown ids."""
    base = t.claim.select("paper_id", "pos", F.col("claim_id").alias("candidate_id"), F.floor(F.col("pos") / 70).cast("int").alias("chunk"))
    slot = F.floor(F.col("pos") / 3).cast("int")
    groups = base.where("pos % 5 <> 0").withColumn("group_pos", slot).unionByName(
        base.where("pos % 6 = 0").withColumn("group_pos", slot + 1)).unionByName(
        base.where("pos % 9 = 0").withColumn("group_pos", slot).withColumn("candidate_id", F.concat("candidate_id", F.lit("x"))))
    return base, groups.withColumn("member_pos", F.col("pos")), base.where("pos % 10 = 0")


@query("mrg_03_apply_groups", "SELECT * FROM f_applied", GROUP_VIEWS)
def _apply(t):
    return M.apply_groups(*model_groups(t))


GUARD = f"""
  SELECT *, rank_near <= 6 AND near AS stays FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id, claim_key, near ORDER BY rk, page, pos) AS rank_near FROM (
      SELECT m.*, m.first OR {D.jaccard('m.tok', 'm.ptok')} >= 0.3 AS near FROM (
        SELECT *, first_value(tok) OVER w AS ptok, row_number() OVER w = 1 AS first FROM (
          SELECT paper_id, pos, claim_id, page, tok, {D.rank('importance')} AS rk, CAST(pos // 10 AS INTEGER) AS claim_key FROM f_tok)
        WINDOW w AS (PARTITION BY paper_id, claim_key ORDER BY rk, page, pos)) m))"""


@query("mrg_04_merge_guard", """
SELECT paper_id, claim_key, claim_id AS candidate_id, stays, count(*) FILTER (NOT stays) OVER (PARTITION BY paper_id, claim_key) AS splits, first AS is_primary
FROM f_guard""", {**VIEWS, "f_guard": GUARD})
def _guard(t):
    members = tokens_only(t).select(
        "paper_id", F.floor(F.col("pos") / 10).cast("int").alias("claim_key"), F.col("pos").alias("member_pos"),
        F.col("claim_id").alias("candidate_id"), "importance", "page", "tokens", "numbers")
    return M.guard_merges(members).drop("member_pos")


NUMBER_GUARD = f"""
  SELECT *, rank_near <= 6 AND near AS stays FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id, claim_key, near ORDER BY rk, page, pos) AS rank_near FROM (
      SELECT m.*, m.first OR {D.jaccard('m.tok', 'm.ptok')} >= 0.3
          OR ({D.jaccard('m.tok', 'm.ptok')} >= 0.15 AND len(list_intersect(m.nums, m.pnums)) > 0) AS near FROM (
        SELECT *, first_value(tok) OVER w AS ptok, first_value(nums) OVER w AS pnums, row_number() OVER w = 1 AS first FROM (
          SELECT paper_id, pos, claim_id, page, tok, nums, {D.rank('importance')} AS rk, CAST(pos // 10 AS INTEGER) AS claim_key FROM f_tok)
        WINDOW w AS (PARTITION BY paper_id, claim_key ORDER BY rk, page, pos)) m))"""


@query("mrg_04b_merge_guard_with_numbers", """
SELECT paper_id, claim_key, claim_id AS candidate_id, stays, count(*) FILTER (NOT stays) OVER (PARTITION BY paper_id, claim_key) AS splits, first AS is_primary
FROM f_guard""", {**NUMBER_VIEWS, "f_guard": NUMBER_GUARD})
def _guard_numbers(t):
    members = M.with_signature(t.claim).select(
        "paper_id", F.floor(F.col("pos") / 10).cast("int").alias("claim_key"), F.col("pos").alias("member_pos"),
        F.col("claim_id").alias("candidate_id"), "importance", "page", "tokens", "numbers")
    return M.guard_merges(members).drop("member_pos")


@query("mrg_05_retention_floor", """
WITH c AS (SELECT paper_id, count(*) AS n, count(DISTINCT pos // 3) FILTER (pos % 5 <> 0) AS k FROM f_claim GROUP BY paper_id)
SELECT f.paper_id, claim_id AS candidate_id, CASE WHEN k * 1.0 / n < 0.55 THEN claim_id ELSE CAST(pos // 3 AS VARCHAR) END AS claim_key, k * 1.0 / n < 0.55 AS rebuilt
FROM f_claim f JOIN c USING (paper_id) WHERE pos % 5 <> 0""")
def _retention(t):
    candidates = t.claim.select("paper_id", F.col("claim_id").alias("candidate_id"))
    members = t.claim.where("pos % 5 <> 0").select(
        "paper_id", F.floor(F.col("pos") / 3).cast("string").alias("claim_key"), F.col("claim_id").alias("candidate_id"))
    return M.enforce_retention(members.select("paper_id", "claim_key").distinct(), members, candidates)


@query("mrg_06_finalize_claims")
def _finalize(t):
    members = t.claim.select("paper_id", F.floor(F.col("pos") / 4).cast("int").alias("claim_key"), F.col("pos").alias("member_pos"),
                             "pos", "statement", "conditions", "importance", "page")
    claims = members.groupBy("paper_id", "claim_key").agg(F.max_by("statement", "pos").alias("statement"), F.lit("").alias("conditions"))
    quotes = t.quote.select("paper_id", "pos", F.lit(0).alias("quote_pos"), "span_id", "quote", "role")
    return M.finalize_claims(claims, members, quotes).select(
        "paper_id", "claim_key", "statement", "n_quotes", F.array_join("span_ids", ",").alias("span_ids"), "fallback")


@query("mrg_07_merge_restatements", f"""
WITH g AS (SELECT *, CAST(pos // 6 AS INTEGER) AS grp, pos % 3 AS nq FROM f_claim WHERE pos % 2 = 0),
h AS (SELECT paper_id, grp, arg_min(pos, (-nq, -length(statement), pos)) AS keeper, min({D.rank('importance')}) AS rk FROM g GROUP BY paper_id, grp)
SELECT c.paper_id, c.pos, coalesce(h.keeper, c.pos) AS keeper_pos,
  CASE WHEN h.keeper = c.pos THEN ['central', 'supporting', 'minor'][h.rk + 1] ELSE c.importance END AS importance
FROM f_claim c LEFT JOIN h ON h.paper_id = c.paper_id AND c.pos % 2 = 0 AND h.grp = c.pos // 6
WHERE c.pos % 11 NOT IN (3, 7)""")
def _restatements(t):
    claims = t.claim.withColumn("n_quotes", F.col("pos") % 3)
    groups = t.claim.where("pos % 2 = 0").select("paper_id", "pos", F.floor(F.col("pos") / 6).cast("int").alias("group_pos"))
    verdicts = t.claim.select("paper_id", "pos", F.when(F.col("pos") % 11 == 3, "contradicted").when(F.col("pos") % 11 == 7, "unsupported").otherwise("ok").alias("verdict"))
    return M.drop_unsupported(M.merge_restatements(claims, groups), verdicts)


@query("mrg_08_claim_hygiene", f"""
WITH paper AS (SELECT paper_id, string_agg({D.compact('text')}, '' ORDER BY pos) AS whole FROM f_span GROUP BY paper_id),
c AS (SELECT paper_id, pos, statement || CASE WHEN pos % 3 = 0 THEN ' at 25 mg and 3 nM' ELSE '' END AS st FROM f_claim),
m AS (SELECT c.*, list_sort(list_distinct(list_filter({D.measurements('st')}, lambda v: NOT contains(whole, {D.compact('v')})))) AS gone
      FROM c JOIN paper USING (paper_id))
SELECT paper_id, pos, CASE WHEN {D.is_non_claim('st')} THEN 'not_a_scientific_claim' WHEN len(gone) > 0 THEN 'measurement_not_in_paper' END AS reason,
  CASE WHEN NOT {D.is_non_claim('st')} AND len(gone) > 0 THEN array_to_string(gone, ';') END AS detail FROM m""")
def _hygiene(t):
    odd = F.when(F.col("pos") % 3 == 0, F.concat("statement", F.lit(" at 25 mg and 3 nM"))).otherwise(F.col("statement"))
    return M.hygiene(t.claim.withColumn("statement", odd), t.span).select("paper_id", "pos", "reason", F.array_join("detail", ";").alias("detail"))


@query("mrg_09_near_duplicates", "SELECT * FROM f_leader", {**VIEWS, "f_edge": _edges(0.55)})
def _near(t):
    return M.premerge(tokens_only(t), number_rule=False, threshold=CLAIMS.cross_group_duplicate_threshold)


@query("mrg_10_rank_and_cap", f"""
SELECT paper_id, pos, printf('C%02d', n) AS claim_id FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY {D.rank('importance')}, page, pos) AS n FROM f_claim) WHERE n <= 40""")
def _cap(t):
    return M.rank_and_cap(t.claim.drop("claim_id"), 40).select("paper_id", "pos", "claim_id")


@query("mrg_11_signature_groups", f"""
SELECT paper_id, min(pos) AS first_pos, count(*) AS n, ids, nums FROM (
  SELECT paper_id, pos, array_to_string(list_sort(list_distinct(list_transform({D.identifiers('statement')}, lambda t: {D.compact('t')}))), ',') AS ids,
    array_to_string(list_sort(list_distinct({D.numbers('statement')})), ',') AS nums FROM f_claim) GROUP BY paper_id, ids, nums""")
def _signatures(t):
    return M.signature_groups(t.claim).select(
        "paper_id", "first_pos", "n", F.array_join("ids", ",").alias("ids"), F.array_join("nums", ",").alias("nums"))


@query("mrg_12_fixed_batches", """
SELECT paper_id, pos, CAST((row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1) // 12 AS INTEGER) AS batch FROM f_claim""")
def _batches(t):
    return M.fixed_batches(t.claim, ["paper_id"], ["pos"], 12).select("paper_id", "pos", "batch")


@query("mrg_13_canonical_units", f"""
WITH k AS (SELECT source AS paper_id, doc_no * 1000 + pos AS pos, doc_no || '-' || pos AS candidate_id, text, lower({D.collapse('text')}) AS norm FROM f_span
           WHERE (doc_no + pos) % 29 <> 0)
SELECT paper_id, candidate_id, min(pos) OVER w AS unit_pos, first_value(text) OVER (PARTITION BY paper_id, norm ORDER BY pos) AS unit_statement, count(*) OVER w AS members
FROM k WINDOW w AS (PARTITION BY paper_id, norm)""")
def _units(t):
    base = t.span.select(F.col("source").alias("paper_id"), (F.col("doc_no") * 1000 + F.col("pos")).alias("pos"),
                         F.concat_ws("-", "doc_no", "pos").alias("candidate_id"), F.col("text").alias("statement"), ((F.col("doc_no") + F.col("pos")) % 29 == 0).alias("out"))
    return M.canonical_units(base.drop("out"), base.where("out"))
