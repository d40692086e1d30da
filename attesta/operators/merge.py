"""Dedupe, merge, guard, rank and cap of candidate claims.

Candidates: paper_id, pos (order in the paper), candidate_id, statement,
conditions, importance, page, tokens, numbers.  Quotes are flat:
paper_id, pos, quote_pos, span_id, quote, role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import numbers as N
from attesta.functions import text as X
from attesta.functions import fixed_values as fv
from attesta.operators.frames import ordinal, top_rows
from attesta.operators.similarity import leader_clusters
from attesta.session import cut_lineage
from attesta.settings import CLAIMS, ClaimSettings


def with_signature(rows: DataFrame) -> DataFrame:
    """Add the token set and the number set that similarity compares."""
    return rows.withColumn("tokens", X.tokens("statement")).withColumn("numbers", N.numbers_in(F.col("statement")))


def best_importance(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in fv.IMPORTANCE_VALUES]), rank + 1)


def premerge(candidates: DataFrame, settings: ClaimSettings = CLAIMS, number_rule: bool = True, threshold: float | None = None) -> DataFrame:
    """Fold restatements into the first kept candidate: (paper_id, pos, leader_pos)."""
    limit = settings.premerge_overlap if threshold is None else threshold
    return leader_clusters(candidates.select("paper_id", "pos", "tokens", "numbers"), limit, number_rule=number_rule)


def survivors(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """Kept candidates with the best importance of their cluster and the number absorbed."""
    joined = candidates.select("paper_id", "pos", X.importance_rank("importance").alias("_rank")).join(clusters, ["paper_id", "pos"])
    merged = joined.groupBy("paper_id", F.col("leader_pos").alias("pos")).agg(
        F.min("_rank").alias("_rank"), (F.count("*") - 1).alias("absorbed"))
    return candidates.drop("importance").join(merged, ["paper_id", "pos"]).withColumn(
        "importance", best_importance(F.col("_rank"))).drop("_rank")


def pooled_quotes(quotes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct quotes of a cluster, the first occurrence (member order, then quote order) winning."""
    joined = quotes.join(clusters, ["paper_id", "pos"])
    first = F.min_by(F.struct("pos", "quote_pos", "span_id", "role"), F.struct("pos", "quote_pos"))
    return joined.groupBy("paper_id", "leader_pos", "quote").agg(first.alias("_q")).select(
        "paper_id", "leader_pos", "quote", "_q.*")


def apply_groups(candidates: DataFrame, groups: DataFrame, drops: DataFrame) -> DataFrame:
    """Members of merged claims; no candidate is lost.

    ``candidates``: paper_id, candidate_id, chunk; ``groups``: paper_id, chunk,
    group_pos, member_pos, candidate_id; ``drops``: paper_id, chunk, candidate_id.
    Inside a chunk an id belongs to the first group naming it; a dropped id
    counts only if no group used it; candidates of the chunk named by neither
    become claims of their own (group_pos NULL).  Output has kind = member,
    dropped or singleton.
    """
    known = groups.join(candidates.select("paper_id", "candidate_id").distinct(), ["paper_id", "candidate_id"], "left_semi")
    owner = known.groupBy("paper_id", "chunk", "candidate_id").agg(F.min("group_pos").alias("_first"))
    members = known.join(owner, ["paper_id", "chunk", "candidate_id"]).where(F.col("group_pos") == F.col("_first")).select(
        "paper_id", "chunk", "candidate_id", "group_pos", F.lit("member").alias("kind"))
    keys = ["paper_id", "chunk", "candidate_id"]
    dropped = (
        drops.join(candidates.select("paper_id", "candidate_id").distinct(), ["paper_id", "candidate_id"], "left_semi")
        .select(*keys).distinct().join(owner, keys, "left_anti")
        .withColumn("group_pos", F.lit(None).cast("int")).withColumn("kind", F.lit("dropped"))
    )
    left = candidates.select(*keys).join(owner, keys, "left_anti").join(dropped, keys, "left_anti")
    singles = left.withColumn("group_pos", F.lit(None).cast("int")).withColumn("kind", F.lit("singleton"))
    return members.unionByName(dropped).unionByName(singles)


def guard_merges(members: DataFrame, settings: ClaimSettings = CLAIMS) -> DataFrame:
    """Split members that do not restate their group's primary.

    ``members``: paper_id, claim_key, member_pos, candidate_id, importance,
    page, tokens, numbers.  The primary is found by a partial aggregate and the
    cap of ``merge_max_members`` by a group limit, so a huge group is never sorted
    whole.  Output: stays (bool) and splits (number of members leaving).
    """
    keys = ["paper_id", "claim_key"]
    order = F.struct(X.importance_rank("importance").alias("rank"), F.coalesce("page", F.lit(0)).alias("page"), "member_pos")
    ordered = members.withColumn("_order", order)
    primary = ordered.groupBy(*keys).agg(F.min("_order").alias("_first"), F.min_by(F.struct("tokens", "numbers"), "_order").alias("_p"))
    joined = ordered.join(primary, keys)
    overlap = X.jaccard(F.col("tokens"), F.col("_p.tokens"))
    low = settings.merge_min_overlap
    similar = (overlap >= low) | (N.shares_number(F.col("numbers"), F.col("_p.numbers")) & (overlap >= low / 2))
    judged = joined.withColumn("_near", (F.col("_order") == F.col("_first")) | similar)
    kept = top_rows(judged.where("_near"), keys, [F.col("_order")], settings.merge_max_members)
    stays = kept.select(*keys, "member_pos").withColumn("stays", F.lit(True))
    flagged = judged.join(stays, [*keys, "member_pos"], "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    counts = flagged.groupBy(*keys).agg(F.count(F.when(~F.col("stays"), 1)).alias("splits"))
    return flagged.join(counts, keys).select(
        *keys, "member_pos", "candidate_id", "stays", "splits", (F.col("_order") == F.col("_first")).alias("is_primary"))


def enforce_retention(claims: DataFrame, members: DataFrame, candidates: DataFrame, settings: ClaimSettings = CLAIMS) -> DataFrame:
    """Papers where claims / candidates falls below the floor go back to one claim per used candidate.

    ``claims``: paper_id, claim_key; ``members``: paper_id, claim_key,
    candidate_id; ``candidates``: paper_id, candidate_id.
    """
    n_claims = claims.groupBy("paper_id").agg(F.count("*").alias("n_claims"))
    n_all = candidates.groupBy("paper_id").agg(F.count("*").alias("n_all"))
    low = n_all.join(n_claims, "paper_id", "left").where(
        F.coalesce("n_claims", F.lit(0)) / F.col("n_all") < settings.retention_floor)
    used = candidates.join(members.select("paper_id", "candidate_id").distinct(), ["paper_id", "candidate_id"], "left_semi")
    rebuilt = used.join(low, "paper_id", "left_semi").select("paper_id", F.col("candidate_id").alias("claim_key"), "candidate_id")
    can_rebuild = rebuilt.select("paper_id").distinct()
    kept = members.join(can_rebuild, "paper_id", "left_anti").select("paper_id", "claim_key", "candidate_id")
    return kept.withColumn("rebuilt", F.lit(False)).unionByName(rebuilt.withColumn("rebuilt", F.lit(True)))


def finalize_claims(claims: DataFrame, members: DataFrame, quotes: DataFrame) -> DataFrame:
    """Claims with pooled quotes and a wording whose numbers the quotes state.

    ``claims``: paper_id, claim_key, statement, conditions; ``members``:
    paper_id, claim_key, member_pos, pos, statement, conditions, importance,
    page; ``quotes``: paper_id, pos, quote_pos, span_id, quote, role.  Falls back
    to the primary's wording; drops the claim if that is ungrounded too.
    """
    keys = ["paper_id", "claim_key"]
    order = F.struct(X.importance_rank("importance").alias("rank"), F.coalesce("page", F.lit(0)).alias("page"), "member_pos")
    primary = members.groupBy(*keys).agg(
        F.min_by(F.struct(F.col("statement").alias("p_statement"), F.col("conditions").alias("p_conditions")), order).alias("_p"))
    pooled = members.select(*keys, "pos", "page", order.alias("_order")).join(quotes, ["paper_id", "pos"])
    first = pooled.groupBy(*keys, "span_id", "quote").agg(
        F.min(F.struct("_order", "quote_pos")).alias("_at"), F.min_by("page", F.struct("_order", "quote_pos")).alias("page"))
    lists = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_at", "quote"))).alias("_q"),
        F.array_sort(F.collect_set("span_id")).alias("span_ids"), F.array_sort(F.collect_set("page")).alias("pages"))
    texts = F.transform(F.coalesce("_q", F.lit(None)), lambda q: q["quote"])
    joined = claims.join(primary, keys).join(lists, keys, "left").withColumn(
        "_texts", F.coalesce(texts, F.array().cast("array<string>")))
    chosen = F.when(F.coalesce("statement", F.lit("")) != "", F.col("statement")).otherwise(F.col("_p.p_statement"))
    scope = F.when(F.coalesce("conditions", F.lit("")) != "", F.col("conditions")).otherwise(F.col("_p.p_conditions"))
    worded = joined.withColumn("_s", chosen).withColumn("_c", scope).withColumn(
        "fallback", F.size(N.ungrounded_numbers(F.concat_ws(" ", "_s", "_c"), F.col("_texts"))) > 0)
    final = worded.withColumn("_s", F.when(F.col("fallback"), F.col("_p.p_statement")).otherwise(F.col("_s"))).withColumn(
        "_c", F.when(F.col("fallback"), F.col("_p.p_conditions")).otherwise(F.col("_c")))
    grounded = ~F.col("fallback") | (F.size(N.ungrounded_numbers(F.concat_ws(" ", "_s", "_c"), F.col("_texts"))) == 0)
    return final.where(grounded).select(
        *keys, F.col("_s").alias("statement"),
        F.when(F.col("_c") == "", fv.NOT_AVAILABLE).otherwise(F.col("_c")).alias("conditions"),
        F.size("_texts").alias("n_quotes"), "span_ids", "pages", "fallback")


def merge_restatements(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """Apply supplied groups of restating claims: (paper_id, pos, keeper_pos, importance).

    ``claims``: paper_id, pos, statement, importance, n_quotes; ``groups``:
    paper_id, group_pos, pos.  A claim belongs to the first group naming it; the
    keeper has most quotes, then the longest statement, then comes first.
    """
    first = groups.groupBy("paper_id", "pos").agg(F.min("group_pos").alias("group_pos"))
    grouped = claims.join(first, ["paper_id", "pos"])
    order = F.struct((-F.col("n_quotes")).alias("q"), (-F.length("statement")).alias("l"), "pos")
    heads = grouped.groupBy("paper_id", "group_pos").agg(
        F.min_by("pos", order).alias("keeper_pos"), F.min(X.importance_rank("importance")).alias("_rank"))
    joined = claims.join(first, ["paper_id", "pos"], "left").join(heads, ["paper_id", "group_pos"], "left")
    return joined.select(
        "paper_id", "pos", F.coalesce("keeper_pos", "pos").alias("keeper_pos"),
        F.when(F.col("keeper_pos") == F.col("pos"), best_importance(F.col("_rank"))).otherwise(F.col("importance")).alias("importance"))


def drop_unsupported(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims without a rejecting support verdict; ``verdicts``: paper_id, pos, verdict."""
    bad = verdicts.where(F.col("verdict").isin(*fv.REJECTING_VERDICTS)).select("paper_id", "pos").distinct()
    return claims.join(bad, ["paper_id", "pos"], "left_anti")


def hygiene(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """Claims with a drop reason: not a claim, or a measurement the paper never states.

    A measurement may straddle any number of spans.  Every span is searched
    together with the characters before it, one less than the longest
    measurement has, gathered over as many spans as that takes; the paper's
    text is never put in one cell.
    """
    asked = claims.select("paper_id", "pos", F.explode(F.array_distinct(N.measurements(F.col("statement")))).alias("measurement"))
    needles = cut_lineage(asked.select("paper_id", "measurement").distinct().withColumn("_needle", X.compact("measurement")))
    longest = needles.agg(F.max(F.length("_needle")).alias("n")).first()["n"] or 1
    packed = spans.join(needles.select("paper_id").distinct(), "paper_id", "left_semi").select(
        "paper_id", "pos", X.compact("text").alias("_packed")).where("_packed <> ''")
    numbered = cut_lineage(ordinal(packed, ["paper_id"], ["pos"], "_no").drop("pos"))
    tails = _tails(numbered, longest - 1)
    before = tails.select("paper_id", (F.col("_no") + 1).alias("_no"), F.col("_tail").alias("_before"))
    text = F.concat(F.coalesce("_before", F.lit("")), F.col("_packed"))
    stated = numbered.join(before, ["paper_id", "_no"], "left").select("paper_id", text.alias("_text")).join(needles, "paper_id").where(
        F.contains("_text", "_needle")).select("paper_id", "measurement").distinct()
    missing = asked.join(stated, ["paper_id", "measurement"], "left_anti").groupBy("paper_id", "pos").agg(
        F.array_sort(F.collect_set("measurement")).alias("detail"))
    joined = claims.join(missing, ["paper_id", "pos"], "left")
    reason = F.when(X.is_non_claim("statement"), "not_a_scientific_claim").when(F.col("detail").isNotNull(), "measurement_not_in_paper")
    return joined.withColumn("reason", reason).withColumn(
        "detail", F.when(F.col("reason") == "measurement_not_in_paper", F.col("detail")))


def _tails(numbered: DataFrame, size: int) -> DataFrame:
    """The last ``size`` characters of a paper up to and with each span (paper_id, _no, _tail).

    No span is empty, so ``size`` spans suffice; each round doubles how many of
    them a tail covers, by a join on the span's number.
    """
    tails = numbered.select("paper_id", "_no", F.right("_packed", F.lit(size)).alias("_tail"))
    step = 1
    while step < size:
        earlier = tails.select("paper_id", (F.col("_no") + step).alias("_no"), F.col("_tail").alias("_more"))
        tails = tails.join(earlier, ["paper_id", "_no"], "left").select(
            "paper_id", "_no", F.right(F.concat(F.coalesce("_more", F.lit("")), F.col("_tail")), F.lit(size)).alias("_tail"))
        step *= 2
    return tails


def rank_and_cap(claims: DataFrame, limit: int = CLAIMS.max_claims) -> DataFrame:
    """The first ``limit`` claims per paper by importance, first page and order, with their ids.

    The group limit runs before the shuffle, so numbering sees at most ``limit`` rows per paper.
    """
    order = [X.importance_rank("importance"), F.coalesce(F.col("page"), F.lit(999)), F.col("pos")]
    kept = top_rows(claims, ["paper_id"], order, limit)
    number = F.row_number().over(W.partitionBy("paper_id").orderBy(*order))
    return kept.withColumn("claim_no", number).withColumn("claim_id", X.sequence_id("C", F.col("claim_no")))


def signature_groups(claims: DataFrame) -> DataFrame:
    """Claims that share both identifiers and numbers, reported as group sizes."""
    ids = F.array_sort(F.array_distinct(F.transform(X.identifiers("statement"), X.compact)))
    nums = F.array_sort(F.array_distinct(N.numbers_in(F.col("statement"))))
    return claims.select("paper_id", "pos", ids.alias("ids"), nums.alias("nums")).groupBy("paper_id", "ids", "nums").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def fixed_batches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Number ordered rows into batches of ``size`` (0-based)."""
    return ordinal(rows, keys, order, "_no").withColumn(
        "batch", F.floor((F.col("_no") - 1) / size).cast("int")).drop("_no")


def canonical_units(statements: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Accepted statements grouped by exact normal form, mandatory exclusions left out.

    ``statements``: paper_id, pos, candidate_id, statement.  One row per member,
    with the unit's first position and statement.
    """
    kept = statements.join(exclusions.select("paper_id", "candidate_id").distinct(), ["paper_id", "candidate_id"], "left_anti").withColumn(
        "_norm", F.lower(X.collapse_ws("statement")))
    units = kept.groupBy("paper_id", "_norm").agg(
        F.min("pos").alias("unit_pos"), F.min_by("statement", "pos").alias("unit_statement"), F.count("*").alias("members"))
    return kept.join(units, ["paper_id", "_norm"]).select("paper_id", "candidate_id", "unit_pos", "unit_statement", "members")
