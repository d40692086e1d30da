"""Finding scores, coverage, batch scores, ranks and payouts.

Penalties, floors and weights are kept in integer hundredths, so sums are exact
and do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions import numbers as N
from attesta.settings import PAYOUT, PayoutSettings


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*[x for key, value in values.items() for x in (F.lit(key), F.lit(value))])


def penalty(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(fv.SEVERITY_PENALTY_HUNDREDTHS), severity), F.lit(0))


def floor_of(severity: Column, code: Column) -> Column:
    by_code = F.coalesce(F.try_element_at(_table(fv.CODE_FLOOR_HUNDREDTHS), code), F.lit(100))
    return F.when(severity == "blocker", F.least(F.lit(fv.BLOCKER_FLOOR_HUNDREDTHS), by_code)).otherwise(by_code)


def score_findings(findings: DataFrame, keys: list[str], threshold: float = 0.7) -> DataFrame:
    """Score, pass flag and severity histogram per key; partial sums only, no group is collected."""
    severity, code = F.col("severity"), F.col("code")
    summed = findings.groupBy(*keys).agg(
        F.sum(penalty(severity)).alias("_lost"),
        F.min(floor_of(severity, code)).alias("_cap"),
        F.bool_or(severity.isin("blocker", "critical")).alias("_severe"),
        *[F.count(F.when(severity == level, 1)).alias(f"n_{level}") for level in fv.SEVERITY_PENALTY_HUNDREDTHS],
    )
    score = F.least(F.greatest(F.lit(0), 100 - F.col("_lost")), F.col("_cap")) / 100
    return summed.select(
        *keys, score.alias("score"), ((score >= threshold) & ~F.col("_severe")).alias("passed"),
        *[f"n_{level}" for level in fv.SEVERITY_PENALTY_HUNDREDTHS],
    )


def with_clean_papers(papers: DataFrame, scores: DataFrame) -> DataFrame:
    """Papers without findings score 1.0 and pass."""
    joined = papers.join(scores, "paper_id", "left")
    counts = [f"n_{level}" for level in fv.SEVERITY_PENALTY_HUNDREDTHS]
    return joined.select(
        *papers.columns, F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("passed", F.lit(True)).alias("passed"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def quality_estimate(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Diagnostic score times (1 - 0.25 per rejected claim)."""
    rejects = verdicts.groupBy("paper_id").agg(F.count(F.when(F.col("verdict") == "reject", 1)).alias("rejected"))
    joined = scores.join(rejects, "paper_id", "left")
    rejected = F.coalesce("rejected", F.lit(0))
    adjudication = F.greatest(F.lit(0), 100 - fv.SEVERITY_PENALTY_HUNDREDTHS["critical"] * rejected) / 100
    return joined.select(
        "paper_id", "score", adjudication.alias("adjudication_quality"),
        F.bround(F.col("score") * adjudication, 4).alias("quality_estimate"),
    )


def is_scored() -> Column:
    return F.col("required") | (F.col("scoring_mode") == "accepted_improvement")


def scored_units(units: DataFrame) -> DataFrame:
    return units.where(is_scored())


def unit_status(units: DataFrame, members: DataFrame, submissions: DataFrame) -> DataFrame:
    """What a contestant's submission lacks or adds: scored units it misses, and improvements it covers.

    ``submissions`` has paper_id, contestant.  A covered unit that is no
    improvement gives no row.
    """
    better = F.col("scoring_mode") == "accepted_improvement"
    asked = units.where(F.col("required") | better)
    # Units meet their contestants before they are multiplied by the submissions.
    joined = asked.join(holders(members), ["paper_id", "unit_id"], "left").join(submissions, "paper_id")
    covered = F.coalesce(F.array_contains("_held", F.col("contestant")), F.lit(False))
    severity = F.when(F.col("importance") == "central", "critical").when(F.col("importance") == "supporting", "major").otherwise("minor")
    return joined.where(~covered | better).select(
        "paper_id", "contestant", "unit_id", "importance", "scoring_mode", covered.alias("improvement"),
        F.when(~covered, severity).alias("missing_severity"))


def holders(members: DataFrame) -> DataFrame:
    """(paper_id, unit_id, _held): the contestants that cover a unit; their number bounds the list."""
    return members.groupBy("paper_id", "unit_id").agg(F.collect_set("contestant").alias("_held"))


def covered_units(units: DataFrame, members: DataFrame) -> DataFrame:
    """Only the (unit, contestant) pairs that are covered: grows with the members, not with units x contestants."""
    held = holders(members).join(units, ["paper_id", "unit_id"])
    return held.select("*", F.explode("_held").alias("contestant")).drop("_held")


def _weight() -> Column:
    return F.try_element_at(_table(fv.IMPORTANCE_WEIGHT_HUNDREDTHS), F.col("importance"))


def coverage(units: DataFrame, members: DataFrame, submissions: DataFrame) -> DataFrame:
    """Weighted unit coverage per paper and contestant with the minor tier capped.

    Totals come once per paper and covered weights once per (paper, contestant),
    so units are never multiplied by contestants.
    """
    minor = F.col("importance") == "minor"
    weight = _weight()

    def sums(prefix: str, counts: Column = F.lit(True)) -> list[Column]:
        return [
            F.sum(F.when(counts & ~minor, weight).otherwise(0)).alias(f"{prefix}_main"),
            F.sum(F.when(counts & minor, weight).otherwise(0)).alias(f"{prefix}_minor"),
        ]

    totals = units.groupBy("paper_id").agg(*sums("total", is_scored())).na.fill(0)
    got = covered_units(scored_units(units), members).groupBy("paper_id", "contestant").agg(*sums("got"))
    joined = submissions.join(totals, "paper_id").join(got, ["paper_id", "contestant"], "left").na.fill(0, ["got_main", "got_minor"])
    # The minor tier counts for at most cap/(1-cap) of the main total; with cap 1/20 that is total_main / 19.
    part = round(1 / fv.MINOR_TIER_CAP) - 1
    main = N.ratio(
        F.col("got_main") * part + F.least(F.col("got_minor") * part, F.col("total_main")),
        F.col("total_main") * part + F.least(F.col("total_minor") * part, F.col("total_main")),
    )
    only_minor = N.ratio(F.col("got_minor"), F.col("total_minor"))
    value = (
        F.when(F.col("total_main") > 0, main).when(F.col("total_minor") > 0, only_minor).otherwise(F.lit(1.0))
    )
    return joined.select("paper_id", "contestant", value.alias("coverage"))


def invalid_extras(invalid: DataFrame, submissions: DataFrame) -> DataFrame:
    """A contestant's own rejected candidates, as accuracy findings."""
    return invalid.join(submissions, ["paper_id", "contestant"], "left_semi").select(
        "paper_id", "contestant", F.col("candidate_id").alias("target_id"), F.lit("claim_accuracy").alias("dimension"),
        "severity", F.lit("invalid_extra_candidate").alias("code"),
    )


def paper_scores(
    units: DataFrame, members: DataFrame, submissions: DataFrame, invalid: DataFrame, diagnostics: DataFrame
) -> DataFrame:
    """coverage x diagnostic quality x adjudication quality; an empty reference record scores 0.

    ``diagnostics`` has paper_id, contestant, diagnostic_quality (absent means 1.0).
    """
    covered = coverage(units, members, submissions)
    extras = invalid_extras(invalid, submissions).groupBy("paper_id", "contestant").agg(
        F.sum(penalty(F.col("severity"))).alias("_lost"), F.count("*").alias("n_invalid"))
    alive = scored_units(units).select("paper_id").union(invalid.select("paper_id")).distinct().withColumn("_alive", F.lit(True))
    joined = (
        covered.join(extras, ["paper_id", "contestant"], "left")
        .join(diagnostics, ["paper_id", "contestant"], "left")
        .join(alive, "paper_id", "left")
    )
    adjudication = F.greatest(F.lit(0), 100 - F.coalesce("_lost", F.lit(0)))
    diagnostic = F.round(F.coalesce("diagnostic_quality", F.lit(1.0)) * 10000).cast("bigint")
    # All factors are whole hundredths or ten-thousandths, so the products are exact integers.
    quality = N.ratio_units(diagnostic * adjudication, F.lit(100 * 10000))
    score = F.when(F.col("_alive").isNull(), F.lit(0.0)).otherwise(
        N.ratio(score_units(F.col("coverage")) * quality, F.lit(10000 * 10000)))
    return joined.select(
        "paper_id", "contestant", "coverage", (diagnostic / 10000).alias("diagnostic_quality"),
        (adjudication / 100).alias("adjudication_quality"), (quality / 10000).alias("quality"), score.alias("score"),
        F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"),
    )


def project_claims(claims: DataFrame, refs: DataFrame, origin: str) -> DataFrame:
    """Comparable candidates of an artifact.

    Ids default to ``claim_{n}``; every row of a repeated id is left out (blank
    statements count as repeats), then blank statements go.  ``claims`` has
    paper_id, pos, claim_id, statement, conditions; ``refs`` has paper_id,
    claim_pos, ref_pos, span_id, quote.
    """
    from attesta.functions import text as X

    record = F.when(~X.is_blank("claim_id"), X.strip("claim_id")).otherwise(F.concat(F.lit("claim_"), F.col("pos").cast("string")))
    named = claims.withColumn("record_id", record)
    unique = named.groupBy("paper_id", "record_id").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    kept = named.join(unique, ["paper_id", "record_id"], "left_semi").where(~X.is_blank("statement"))
    lists = refs.groupBy("paper_id", F.col("claim_pos").alias("pos")).agg(
        F.array_sort(F.collect_set(F.when(~X.is_blank("span_id"), X.strip("span_id")))).alias("span_ids"),
        F.array_sort(F.collect_list(F.when(~X.is_blank("quote"), F.struct("ref_pos", X.strip("quote").alias("q"))))).alias("_q"),
    )
    return kept.join(lists, ["paper_id", "pos"], "left").select(
        "paper_id", "pos", "record_id", F.concat(F.lit(origin + ":"), "record_id").alias("candidate_id"),
        X.strip("statement").alias("statement"), X.normalize_statement(X.strip("statement")).alias("normalized_statement"),
        F.nullif(X.strip("conditions"), F.lit("")).alias("qualifier"),
        F.coalesce("span_ids", F.array().cast("array<string>")).alias("span_ids"),
        F.coalesce(F.transform("_q", lambda s: s["q"]), F.array().cast("array<string>")).alias("quotes"),
        F.lit("supporting").alias("importance"),
    )


def score_units(value: Column) -> Column:
    """A four-place score as an integer number of ten-thousandths."""
    return F.round(value * 10000).cast("bigint")


def batch_scores(paper_rows: DataFrame, expected: int | None = None) -> DataFrame:
    """Mean, exact median, minimum and counts per contestant, with competition rank.

    ``paper_rows`` has contestant, paper_id, score, missing (no submission).
    """
    # Sums of ten-thousandths are exact whatever the order of partitions.
    median = _exact_median(paper_rows)
    eligible = paper_rows.agg(F.count_distinct("paper_id")).scalar()
    stats = paper_rows.groupBy("contestant").agg(
        F.count("*").alias("papers"),
        F.count_distinct(F.when(F.col("missing"), F.col("paper_id"))).alias("missing_papers"),
        N.ratio(F.sum(score_units(F.col("score"))), F.count("*") * 10000).alias("mean_score"),
        F.bround(F.min("score"), 4).alias("min_score"),
    )
    joined = stats.join(median, "contestant").withColumn("eligible_papers", eligible)
    ranked = joined.withColumn("rank", F.rank().over(W.orderBy(F.col("mean_score").desc())))
    return ranked.select(
        "contestant", "papers", F.lit(expected).cast("int").alias("expected_papers") if expected else F.col("eligible_papers").alias("expected_papers"),
        "eligible_papers", F.greatest(F.lit(0), F.col("eligible_papers") - F.col("missing_papers")).alias("submitted_papers"),
        "missing_papers", "mean_score", "median_score", "min_score", F.col("mean_score").alias("batch_score"), "rank",
        ((F.col("rank") == 1) & (F.col("mean_score") > 0)).alias("winner"),
    )


def _exact_median(paper_rows: DataFrame) -> DataFrame:
    """Exact median from the distribution of distinct scores.

    Scores have at most 10,001 distinct values, so (contestant, value) counts are
    small however many papers there are; no group of raw rows is ever sorted.
    """
    counts = paper_rows.groupBy("contestant", score_units(F.col("score")).alias("v")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("contestant").orderBy("v")
    ranked = counts.select(
        "contestant", "v", F.sum("n").over(upto).alias("_hi"),
        (F.sum("n").over(upto) - F.col("n")).alias("_lo"), F.sum("n").over(W.partitionBy("contestant")).alias("_all"),
    )
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = ranked.groupBy("contestant").agg(
        F.max(F.when((F.col("_lo") <= low) & (low < F.col("_hi")), F.col("v"))).alias("_a"),
        F.max(F.when((F.col("_lo") <= high) & (high < F.col("_hi")), F.col("v"))).alias("_b"),
    )
    return middle.select("contestant", N.ratio(F.col("_a") + F.col("_b"), F.lit(20000)).alias("median_score"))


def winner_takes_most(scores: DataFrame, settings: PayoutSettings = PAYOUT) -> DataFrame:
    """Rank payout; tied contestants split the slots they occupy.  ``scores``: contestant, batch_score.

    One row per contestant: a ranking of runs, small by nature.
    """
    if not 0.0 <= settings.winner_share <= 1.0 or settings.runner_up_slots < 0 or settings.runner_up_decay <= 0:
        raise ValueError("payout settings out of range")
    positive = scores.where("batch_score > 0")
    by_score = W.orderBy(F.col("batch_score").desc(), F.col("contestant"))
    everyone = W.partitionBy()
    slotted = positive.withColumn("_slot", F.row_number().over(by_score) - 1).withColumn("_n", F.count("*").over(everyone))
    paid = F.least(F.lit(settings.runner_up_slots), F.col("_n") - 1)
    factors = F.transform(F.sequence(F.lit(0), F.lit(max(settings.runner_up_slots - 1, 0))), lambda i: F.pow(F.lit(settings.runner_up_decay), i))
    total = F.aggregate(F.slice(factors, F.lit(1), paid), F.lit(0.0), lambda acc, x: acc + x)
    runner = F.lit(max(0.0, 1.0 - settings.winner_share)) * F.pow(F.lit(settings.runner_up_decay), F.col("_slot") - 1) / total
    weight = (
        F.when(F.col("_n") == 1, 1.0).when(F.col("_slot") == 0, settings.winner_share)
        .when(F.col("_slot") <= paid, runner).otherwise(0.0)
    )
    tie = W.partitionBy("batch_score")
    shared = slotted.withColumn("_w", weight).withColumn("_share", F.sum("_w").over(tie) / F.count("*").over(tie))
    final = shared.withColumn("_total", F.sum("_share").over(everyone)).select(
        "contestant", F.when(F.col("_total") > 0, F.col("_share") / F.col("_total")).otherwise(F.col("_share")).alias("_payout"))
    return scores.join(final, "contestant", "left").select(
        *scores.columns, F.bround(F.coalesce("_payout", F.lit(0.0)), 8).alias("payout_weight"))


def proportional_payout(scores: DataFrame) -> DataFrame:
    share = F.greatest(F.col("batch_score"), F.lit(0.0))
    total = F.sum(share).over(W.partitionBy())
    return scores.select(*scores.columns, F.bround(F.when(total > 0, share / total).otherwise(0.0), 8).alias("payout_weight"))


def bucket_payout(scores: DataFrame, overall: DataFrame, settings: PayoutSettings) -> DataFrame:
    """Reserve a share for the best newcomers; ``scores`` has newcomer and submitted_papers."""
    share = max(0.0, min(0.40, settings.newcomer_share))
    low = max(0.0, min(1.0, settings.newcomer_min_score))
    eligible = F.col("newcomer") & (F.col("submitted_papers") > 0) & (F.col("batch_score") > low)
    everyone = W.partitionBy()
    best = F.max(F.when(eligible, F.col("batch_score"))).over(everyone)
    marked = scores.join(overall.select("contestant", F.col("payout_weight").alias("_overall")), "contestant", "left").withColumn(
        "_best", eligible & (F.col("batch_score") == best))
    winners = marked.withColumn("_winners", F.sum(F.coalesce("_best", F.lit(False)).cast("int")).over(everyone))
    applied = F.when(F.col("_winners") > 0, share).otherwise(0.0)
    main = F.bround(F.coalesce("_overall", F.lit(0.0)) * (1.0 - applied), 8)
    bonus = F.bround(F.when(F.coalesce("_best", F.lit(False)), applied / F.col("_winners")).otherwise(0.0), 8)
    return winners.select(
        "contestant", "batch_score", main.alias("overall_weight"), bonus.alias("newcomer_bonus"),
        F.bround(main + bonus, 8).alias("payout_weight"), applied.alias("applied_newcomer_share"))


def batch_outcome(scores: DataFrame, failed_papers: DataFrame, settings: PayoutSettings = PAYOUT) -> DataFrame:
    """One policy row: outcome, winners and the settings in force."""
    winners = F.array_join(F.array_sort(F.collect_set(F.when(F.col("winner"), F.col("contestant")))), ",")
    failed = failed_papers.agg(F.count_distinct("paper_id")).scalar()
    return scores.agg(winners.alias("winners")).withColumn("failed_papers", failed).select(
        F.when(F.col("failed_papers") > 0, "degraded").otherwise("completed").alias("outcome"), "failed_papers", "winners",
        F.lit(settings.winner_share).alias("winner_share"), F.lit(settings.runner_up_slots).alias("runner_up_slots"),
        F.lit(settings.runner_up_decay).alias("runner_up_decay"),
    )


def rank_by_score(rows: DataFrame, score: str) -> DataFrame:
    """Competition rank per distinct score value: 1 + number of rows with a higher score.

    The ordered pass sees one row per distinct score (at most 10,001), not one per row.
    """
    counts = rows.groupBy(score).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(W.orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(score, (F.coalesce(above, F.lit(0)) + 1).alias("rank"))
