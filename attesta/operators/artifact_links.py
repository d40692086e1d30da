"""Ids and references of whole artifacts (JSON), trace nodes at any depth, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.audit import _finding, duplicate_ids
from attesta.session import cut_lineage

# Where each id space lives in an artifact, and its id field (the trace is walked apart).
SPACES = {
    "claim": ("$.logic.claims", "claim_id"), "concept": ("$.logic.concepts", "concept_id"),
    "experiment": ("$.logic.experiments", "experiment_id"), "evidence": ("$.evidence.records", "evidence_id"),
}
# Which lists of ids point from one space into another: (from, list, name in a finding, into, severity).
REFERENCES = (
    ("claim", "evidence_ids", "evidence_id", "evidence", "critical"), ("claim", "proof", "proof", "experiment", "critical"),
    ("claim", "dependencies", "dependency", "claim", "major"), ("experiment", "verifies", "verifies", "claim", "critical"),
    ("experiment", "evidence_ids", "evidence_id", "evidence", "major"),
    ("evidence", "linked_claim_ids", "linked_claim_id", "claim", "critical"), ("trace_node", "evidence", "evidence", "any", "major"),
)


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _trace_rows(parsed: DataFrame) -> DataFrame:
    """(paper_id, target_type, node) of every trace node: levels go down until one is empty, each written to a table."""
    level = parsed.select("paper_id", F.try_variant_get("_body", "$.trace", "variant").alias("node")).where(_is_object(F.col("node")))
    out = None
    while True:
        level = cut_lineage(level)
        out = level if out is None else out.unionByName(level)
        level = level.select("paper_id", F.explode(F.try_variant_get("node", "$.children", "array<variant>")).alias("node")).where(
            _is_object(F.col("node")))
        if level.isEmpty():
            return out.select("paper_id", F.lit("trace_node").alias("target_type"), "node")


def artifact_targets(raw: DataFrame) -> DataFrame:
    """(paper_id, target_type, target_id, refs): every object with an id, and what it points to.

    ``raw``: paper_id, body.  ``refs`` holds (field, ref_id, space, severity) in
    the order of the lists, repeats kept; a null id or reference is left out, a
    blank one stays.  Bodies that are no JSON objects give no rows.
    """
    parsed = raw.select("paper_id", F.try_parse_json("body").alias("_body")).where(_is_object(F.col("_body")))
    listed = [F.struct(F.lit(kind).alias("target_type"), F.try_variant_get("_body", path, "array<variant>").alias("nodes"))
              for kind, (path, _) in SPACES.items()]
    layers = parsed.select("paper_id", F.inline(F.array(*listed))).select("paper_id", "target_type", F.explode("nodes").alias("node"))
    rows = layers.where(_is_object(F.col("node"))).unionByName(_trace_rows(parsed))
    kind = F.col("target_type")
    ids = F.try_variant_get("node", "$.node_id", "string")
    for name, (_, field) in SPACES.items():
        ids = F.when(kind == name, F.try_variant_get("node", f"$.{field}", "string")).otherwise(ids)
    refs = [F.when(kind == source, F.transform(
        F.filter(F.coalesce(F.try_variant_get("node", f"$.{field}", "array<string>"), F.array().cast("array<string>")), lambda r: r.isNotNull()),
        lambda r: F.struct(F.lit(name).alias("field"), r.alias("ref_id"), F.lit(into).alias("space"), F.lit(severity).alias("severity"))))
        for source, field, name, into, severity in REFERENCES]
    none = F.array().cast("array<struct<field:string,ref_id:string,space:string,severity:string>>")
    return rows.select("paper_id", "target_type", ids.alias("target_id"), F.flatten(F.array(*[F.coalesce(r, none) for r in refs])).alias("refs"))


def artifact_duplicates(targets: DataFrame) -> DataFrame:
    """Ids given twice within one of the five spaces of a paper; blank ids are passed over."""
    return duplicate_ids(targets.select("paper_id", "target_type", "target_id"))


def artifact_unresolved(targets: DataFrame) -> DataFrame:
    """References of all seven kinds whose id is not in the space they point into, one row each, repeats kept.

    One join serves all kinds: an id stands under its own space and, unless it
    is a trace node's, under ``any``, which trace nodes point into.
    """
    spaces = F.when(F.col("target_type") == "trace_node", F.array("target_type")).otherwise(F.array("target_type", F.lit("any")))
    known = targets.where(F.col("target_id").isNotNull()).select(
        "paper_id", F.explode(spaces).alias("space"), F.col("target_id").alias("ref_id")).distinct()
    refs = targets.select("paper_id", "target_type", "target_id", F.inline("refs"))
    gone = refs.join(known, ["paper_id", "space", "ref_id"], "left_anti")
    return _finding(gone, "structural", F.col("target_type"), F.col("target_id"), "unresolved_reference", F.col("severity"),
                    F.concat_ws(":", "field", "ref_id"))
