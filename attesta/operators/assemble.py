"""Artifact layers from ranked claims: evidence, experiments, trace, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions import numbers as N
from attesta.functions import text as X
from attesta.operators.frames import ordinal, top_rows
from attesta.session import cut_lineage


def coerce_domains(claims: DataFrame) -> DataFrame:
    """Closed fields brought to allowed values, blanks to their defaults."""
    return claims.withColumns({
        "importance": X.pick("importance", fv.IMPORTANCE_VALUES, "supporting"),
        "status": X.pick("status", fv.STATUS_VALUES, "supported"),
        "claim_type": X.pick("claim_type", fv.CLAIM_TYPE_VALUES, "comparative_finding"),
        "conditions": F.when(X.is_blank("conditions"), fv.NOT_AVAILABLE).otherwise(X.collapse_ws("conditions")),
    })


def evidence_records(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """One record per claim, numbered in claim order; the summary falls back to the statement if ungrounded.

    ``claims``: paper_id, pos, claim_id, statement, summary, topic, claim_type,
    pages (text); ``quotes``: paper_id, claim_id, quote.
    """
    keys = ["paper_id", "claim_id"]
    lists = quotes.where(~X.is_blank("quote")).groupBy(*keys).agg(F.collect_set("quote").alias("_quotes"))
    numbered = ordinal(claims, ["paper_id"], ["pos"], "_no").join(lists, keys, "left")
    own = F.coalesce("_quotes", F.array().cast("array<string>"))
    given = F.when(X.is_blank("summary"), F.col("statement")).otherwise(F.col("summary"))
    summary = F.when(F.size(N.ungrounded_numbers(given, own)) > 0, F.col("statement")).otherwise(given)
    return numbered.select(
        *keys, X.sequence_id("EV", F.col("_no")).alias("evidence_id"), F.lit("support").alias("role"),
        X.evidence_title(F.col("topic"), F.col("pages"), F.col("statement")).alias("title"),
        summary.alias("summary"), X.outcome_type(F.col("claim_type")).alias("outcome_type"), F.size(own).alias("n_refs"))


def supplied_experiments(experiments: DataFrame, verifies: DataFrame, claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """Supplied experiments that verify at least one known claim, numbers no quote states struck out.

    ``experiments``: paper_id, experiment_id, setup, procedure, expected_outcome;
    ``verifies``: paper_id, experiment_id, claim_id; ``quotes``: paper_id, experiment_id, quote.
    """
    keys = ["paper_id", "experiment_id"]
    valid = verifies.join(claims.select("paper_id", "claim_id").distinct(), ["paper_id", "claim_id"], "left_semi")
    counts = valid.groupBy(*keys).agg(F.count_distinct("claim_id").alias("n_claims"))
    lists = quotes.where(~X.is_blank("quote")).groupBy(*keys).agg(F.collect_set("quote").alias("_quotes"))
    joined = experiments.join(counts, keys).join(lists, keys, "left")
    own = F.coalesce("_quotes", F.array().cast("array<string>"))
    bounded = lambda c: N.strip_numbers_if_ungrounded(X.collapse_ws(c), own)
    or_default = lambda value, text: F.when(value == "", text).otherwise(value)
    return joined.select(
        *keys, "n_claims", or_default(bounded("setup"), fv.NOT_AVAILABLE).alias("setup"),
        or_default(bounded("procedure"), fv.NOT_AVAILABLE).alias("procedure"),
        or_default(N.strip_numbers(X.collapse_ws("expected_outcome")), "Directional outcome consistent with the verified claims.").alias("expected_outcome"))


def leftover_by_topic(claims: DataFrame, verifies: DataFrame) -> DataFrame:
    """Topics of claims in no experiment, in first-seen order, with their number of claims."""
    left = claims.join(verifies.select("paper_id", "claim_id").distinct(), ["paper_id", "claim_id"], "left_anti")
    topics = left.groupBy("paper_id", "topic").agg(
        F.min("pos").alias("first_pos"), F.count("*").alias("n_claims"), F.min_by("conditions", "pos").alias("conditions"))
    placed = ordinal(topics, ["paper_id"], ["first_pos"], "topic_no")
    return placed.withColumn("title", F.concat(F.lit("Analysis of "), "topic")).withColumn(
        "setup", N.strip_numbers(F.col("conditions"))).drop("conditions")


def inverse_index(verifies: DataFrame) -> DataFrame:
    """Experiments of each claim in experiment order; bounded by one claim's references."""
    return verifies.groupBy("paper_id", "claim_id").agg(
        F.array_sort(F.collect_list("experiment_id")).alias("experiment_ids"))


def trace_nodes(nodes: DataFrame, refs: DataFrame, claims: DataFrame, max_depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Trace nodes (flat) with valid claim references, and result nodes for uncovered claims by topic.

    ``nodes``: paper_id, node_id, depth, node_type, support_level, n_spans;
    ``refs``: paper_id, node_id, claim_id; ``claims``: paper_id, pos, claim_id, topic.
    """
    live = nodes.where(F.col("depth") <= max_depth)
    valid = refs.join(claims.select("paper_id", "claim_id").distinct(), ["paper_id", "claim_id"], "left_semi").join(
        live.select("paper_id", "node_id"), ["paper_id", "node_id"], "left_semi")
    counts = valid.groupBy("paper_id", "node_id").agg(F.count_distinct("claim_id").alias("n_claims"))
    joined = live.join(counts, ["paper_id", "node_id"], "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))
    explicit = (F.col("support_level") == "explicit") & ((F.col("n_spans") > 0) | (F.col("n_claims") > 0))
    built = joined.withColumn("support_level", F.when(explicit, "explicit").otherwise("inferred"))
    uncovered = claims.join(valid.select("paper_id", "claim_id").distinct(), ["paper_id", "claim_id"], "left_anti")
    extra = uncovered.groupBy("paper_id", "topic").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_claims")).withColumn(
        "summary", F.concat(F.lit("Results on "), "topic"))
    return built, extra


def _trace_levels(replies: DataFrame, max_depth: int) -> DataFrame:
    """Nodes of nested replies with their path, the positions taken from the root down; children that are no objects are left out."""
    def children(parents: DataFrame, node: Column) -> DataFrame:
        listed = parents.select("paper_id", "_path", F.posexplode(F.try_variant_get(node, "$.children", "array<variant>")).alias("_at", "_node"))
        return listed.where(F.startswith(F.schema_of_variant("_node"), F.lit("OBJECT"))).select(
            "paper_id", F.concat("_path", F.array("_at")).alias("_path"), "_node")

    level = replies.select("paper_id", F.array().cast("array<int>").alias("_path"), F.try_parse_json("body").alias("_node"))
    found = None
    for _ in range(max_depth):
        level = children(level, F.col("_node"))
        found = level if found is None else found.unionByName(level)
    return found


def nested_trace(replies: DataFrame, claims: DataFrame, max_depth: int = 4) -> DataFrame:
    """The whole trace of each paper as rows: root Q0, the nested nodes in preorder, a result node for each topic left over.

    ``replies``: paper_id (unique), body (JSON of the root), title, n_spans;
    ``claims``: paper_id, pos, claim_id, topic.  Ids count on through all nodes of
    a paper, Q for questions (also where no type is given) and R for the rest.
    Nodes below ``max_depth`` are left out, their claims stay uncovered.  Without
    JSON there is the root only, and every claim is left over.
    """
    text = lambda node, key: X.collapse_ws(F.coalesce(F.try_variant_get(node, f"$.{key}", "string"), F.lit("")))
    node = F.col("_node")
    kind = F.try_variant_get(node, "$.node_type", "variant")
    listed = lambda key: F.coalesce(F.try_variant_get(node, f"$.{key}", "array<string>"), F.array().cast("array<string>"))
    named = F.when(F.size(listed("claim_ids")) > 0, listed("claim_ids")).otherwise(listed("evidence"))
    order = W.partitionBy("paper_id").orderBy("_path")  # the nodes of one reply
    tree = cut_lineage(_trace_levels(replies, max_depth).select(
        "paper_id", "_path", F.row_number().over(order).alias("_no"),
        (kind.isNull() | F.coalesce(F.try_variant_get(node, "$.node_type", "string") == "question", F.lit(False))).alias("_asks"),
        F.coalesce(F.nullif(F.try_variant_get(node, "$.node_type", "string"), F.lit("")), F.lit("question")).alias("node_type"),
        F.coalesce(F.try_variant_get(node, "$.support_level", "string") == "explicit", F.lit(False)).alias("_explicit"),
        (F.size(listed("span_ids")) > 0).alias("_spans"), F.coalesce(F.nullif(text(node, "summary"), F.lit("")), F.lit(fv.NOT_AVAILABLE)).alias("summary"),
        named.alias("_refs")).withColumn("node_id", F.concat(F.when(F.col("_asks"), "Q").otherwise("R"), F.col("_no").cast("string"))))
    refs = tree.select("paper_id", "_no", F.posexplode("_refs").alias("_at", "claim_id"))
    valid = refs.join(claims.select("paper_id", "claim_id").distinct(), ["paper_id", "claim_id"], "left_semi")
    kept = valid.groupBy("paper_id", "_no").agg(F.array_sort(F.collect_list(F.struct("_at", "claim_id"))).alias("_kept"))
    parents = tree.select("paper_id", F.col("_path").alias("_up"), F.col("node_id").alias("_parent"))
    supported = F.col("_explicit") & (F.col("_spans") | F.col("_kept").isNotNull())
    depth = F.size("_path")
    built = tree.join(kept, ["paper_id", "_no"], "left").withColumn("_up", F.slice("_path", F.lit(1), depth - 1)).join(
        parents, ["paper_id", "_up"], "left").select(
        "paper_id", "node_id", F.coalesce("_parent", F.lit("Q0")).alias("parent_id"), F.col("_no").alias("place"), depth.alias("depth"), "node_type",
        F.when(supported, "explicit").otherwise("inferred").alias("support_level"), "summary",
        F.coalesce(F.transform("_kept", lambda k: k["claim_id"]), F.array().cast("array<string>")).alias("claim_ids"))
    sizes = tree.groupBy("paper_id").agg(F.max("_no").alias("_nodes"))
    uncovered = claims.join(replies.select("paper_id"), "paper_id", "left_semi").join(
        valid.select("paper_id", "claim_id").distinct(), ["paper_id", "claim_id"], "left_anti")
    topics = uncovered.groupBy("paper_id", "topic").agg(F.min("pos").alias("_first"), F.array_sort(F.collect_list(F.struct("pos", "claim_id"))).alias("_kept"))
    placed = topics.join(sizes, "paper_id", "left").withColumn(
        "place", F.coalesce("_nodes", F.lit(0)) + F.row_number().over(W.partitionBy("paper_id").orderBy("_first")))
    extra = placed.select(
        "paper_id", F.concat(F.lit("R"), F.col("place").cast("string")).alias("node_id"), F.lit("Q0").alias("parent_id"), "place", F.lit(1).alias("depth"),
        F.lit("result").alias("node_type"), F.lit("explicit").alias("support_level"), F.concat(F.lit("Results on "), "topic").alias("summary"),
        F.transform("_kept", lambda k: k["claim_id"]).alias("claim_ids"))
    asked = F.concat(F.lit("What does the paper '"), F.coalesce("title", F.lit("None")), F.lit("' establish?"))
    root = replies.select(
        "paper_id", F.lit("Q0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("place"), F.lit(0).alias("depth"),
        F.lit("question").alias("node_type"), F.when(F.col("n_spans") > 0, "explicit").otherwise("inferred").alias("support_level"),
        F.coalesce(F.nullif(text(F.try_parse_json("body"), "summary"), F.lit("")), asked).alias("summary"), F.array().cast("array<string>").alias("claim_ids"))
    return root.unionByName(built).unionByName(extra)


def overlay_metadata(papers: DataFrame, supplied: DataFrame, claims: DataFrame, fields: list[str], top: int = 8) -> DataFrame:
    """Fill only empty fields; claims_summary falls back to the first central statements."""
    renamed = supplied.select("paper_id", "claims_summary", *[X.collapse_ws(f).alias(f"_s_{f}") for f in fields])
    first = top_rows(claims.where("importance = 'central'"), ["paper_id"], [F.col("pos")], top)
    central = first.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", "statement"))).alias("_c"))
    joined = papers.join(renamed, "paper_id", "left").join(central, "paper_id", "left")
    filled = [F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_s_{f}"), F.lit("")).alias(f) for f in fields]
    given = F.filter("claims_summary", lambda s: ~X.is_blank(s))
    fallback = F.coalesce(F.transform("_c", lambda s: s["statement"]), F.array().cast("array<string>"))
    return joined.select("paper_id", *filled, F.when(F.size(given) > 0, given).otherwise(fallback).alias("claims_summary"))


def value_counts(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """Counts per value as flat rows; ``as_map`` folds them."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))
    return rows.groupBy("paper_id", value.alias("value")).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame) -> DataFrame:
    return counts.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def explode_layer(artifacts: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """One row per element of a nested layer with its position."""
    items = artifacts.select("paper_id", F.posexplode(path).alias("_i", "_e"))
    return items.select("paper_id", (F.col("_i") + 1).alias("pos"), *[F.col(f"_e.{c}").alias(c) for c in columns])


def fold_layer(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Inverse of ``explode_layer``: elements back in position order."""
    listed = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*columns).alias("e")))).alias("_l"))
    return listed.select("paper_id", F.transform("_l", lambda x: x["e"]).alias(name))
