"""The best partners of each row by shared terms, with score bounds in place of a full term join.

Terms that few rows of the other side hold are joined outright; they give every
row a lower bound of its kth best score.  The terms held by many matter in two
ways only.  A partner already seen can gain at most one for each of them, so it
is counted exactly only if that can still lift it to the bound.  A partner not
seen shares frequent terms alone; rows that such a partner could still serve are
collapsed to their distinct sets of frequent terms, and each set is searched
once.  Of the most frequent term of a set no list is read beyond its first k
rows, since what shares nothing but this term is ranked by that list's own
order.  So a term that every row holds costs k rows.

Papers with at most ``FEW`` rows on either side need none of this: ``split_papers``
sets them apart, and ``all_scores`` compares their rows one by one, so that terms
travel once and a row meets no more than ``FEW`` others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.frames import top_rows
from attesta.session import cut_lineage

FEW = 1024  # rows of a paper, each side, up to which its rows are compared one by one; results do not depend on it
OFTEN = 64  # rows a list may have to be joined outright; results do not depend on it

Score = Callable[[Column, Column, Column], Column]


def containment(shared: Column, asked: Column, offered: Column) -> Column:
    """Share of the asking row's terms."""
    return shared / asked


def jaccard(shared: Column, asked: Column, offered: Column) -> Column:
    return shared / (asked + offered - shared)


def split_papers(asked: DataFrame, offered: DataFrame, few: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Both sides' rows of small papers, and both sides' rows of larger ones, if there are any."""
    counts = [side.groupBy("paper_id").agg(F.count("*").alias("_n")).where(F.col("_n") > few).select("paper_id") for side in (asked, offered)]
    large = cut_lineage(counts[0].union(counts[1]).distinct())
    if large.isEmpty():
        return asked, offered, None
    kept = lambda how: [side.join(large, "paper_id", how) for side in (asked, offered)]
    return *kept("left_anti"), tuple(kept("left_semi"))


def all_scores(asked: DataFrame, offered: DataFrame, score: Score) -> DataFrame:
    """Every asked with every offered row of its paper, and their score: 0 where either has no terms.

    ``asked``: paper_id, terms and more; ``offered``: paper_id, its own terms as ``o_terms`` and more.
    """
    a, o = F.size("terms"), F.size("o_terms")
    both = asked.join(offered, "paper_id").withColumn("_shared", F.size(F.array_intersect("terms", "o_terms")))
    return both.withColumn("score", F.when((a > 0) & (o > 0), score(F.col("_shared"), a, o)).otherwise(F.lit(0.0))).drop(
        "terms", "o_terms", "_shared")


def best_partners(asked: DataFrame, offered: DataFrame, k: int, score: Score, tie: Column, often: int = OFTEN) -> DataFrame:
    """(paper_id, a, o, score): the ``k`` best offered rows that share a term with an asked one, ``tie`` ascending among equals.

    ``asked``: paper_id, a, terms; ``offered``: paper_id, o, terms (distinct
    64-bit hashes).  ``score`` must grow with the shared terms and stay at or
    below shared / asked.
    """
    group, ids = "paper_id", ["paper_id", "a"]
    asked = asked.select(group, "a", "terms", F.size("terms").alias("na"))
    offered = cut_lineage(offered.select(group, "o", "terms", F.size("terms").alias("no")))
    listed = offered.select(group, "o", "no", F.explode("terms").alias("term"))
    frequent = cut_lineage(listed.groupBy(group, "term").agg(F.count("*").alias("f")).where(F.col("f") > often))
    told = asked.select(group, "a", "na", F.explode("terms").alias("term"))
    few = told.join(listed.join(frequent, [group, "term"], "left_anti"), [group, "term"])
    seen = cut_lineage(few.groupBy(*ids, "na", "o", "no").agg(F.count("*").alias("p")))
    order = [F.col("score").desc(), tie]
    many = cut_lineage(told.join(frequent, [group, "term"]).groupBy(*ids, "na").agg(F.array_sort(F.collect_list(F.struct("f", "term"))).alias("_m")).select(
        *ids, "na", F.transform("_m", lambda m: m["term"]).alias("rest")))
    low = seen.withColumn("score", score(F.col("p"), F.col("na"), F.col("no")))
    if many.isEmpty():
        return top_rows(low.select(*ids, "o", "no", "score"), ids, order, k).select(*ids, "o", "score")
    kth = top_rows(low.select(*ids, "o", "no", "score"), ids, order, k).groupBy(*ids).agg(
        F.min("score").alias("kth"), F.count("*").alias("_c")).where(F.col("_c") == k).drop("_c")
    bounded = cut_lineage(many.join(kth, ids, "left").withColumn("kth", F.coalesce("kth", F.lit(0.0))))
    r = F.size("rest")

    # partners seen through rare terms, counted exactly where the frequent ones can still matter
    rest = low.join(bounded.drop("na"), ids, "left")
    alone = rest.where(F.col("rest").isNull()).select(*ids, "o", "no", "score")
    reach = rest.where(F.col("rest").isNotNull() & (score(F.least(F.col("p") + r, F.col("no"), F.col("na")), F.col("na"), F.col("no")) >= F.col("kth")))
    exact = reach.join(offered.select(group, "o", "terms"), [group, "o"]).withColumn(
        "n", F.col("p") + F.size(F.array_intersect("terms", "rest"))).select(
        *ids, "o", "no", score(F.col("n"), F.col("na"), F.col("no")).alias("score"))

    # partners not seen: the best of each distinct set of frequent terms
    still_open = bounded.where(r / F.col("na") >= F.col("kth"))
    keys = [group, "rest", "na"]
    sets = cut_lineage(still_open.select(*keys).distinct())
    inner = sets.select(*keys, F.explode(F.slice("rest", F.lit(1), r - 1)).alias("term")).join(
        listed.select(group, "term", "o"), [group, "term"]).select(*keys, "o")
    heads = top_rows(listed.withColumn("score", score(F.lit(1), F.lit(1), F.col("no"))), [group, "term"], order, k).select(group, "term", "o")
    last = sets.withColumn("term", F.element_at("rest", -1)).join(heads, [group, "term"]).select(*keys, "o")
    found = inner.union(last).distinct().join(offered, [group, "o"]).withColumn(
        "score", score(F.size(F.array_intersect("terms", "rest")), F.col("na"), F.col("no")))
    unseen = still_open.select(*ids, "na", "rest").join(top_rows(found.select(*keys, "o", "no", "score"), keys, order, k), keys).select(
        *ids, "o", "no", "score").join(seen.select(*ids, "o"), [*ids, "o"], "left_anti")
    return top_rows(alone.unionByName(exact).unionByName(unseen), ids, order, k).select(*ids, "o", "score")
