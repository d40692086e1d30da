"""Samples inside intervals, and run rollups kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators.reports import run_rollup
from attesta.session import cut_lineage
from attesta.sources.folders import entries, remove


def _nodes(first: str, past: str, top: str) -> Column:
    """The slots ``first`` .. ``past`` - 1 as at most two blocks a level; a block of level k holds 2^k slots."""
    return F.expr(f"""
      flatten(transform(sequence(0, {top}), k -> filter(array(
        CASE WHEN -shiftright(-{first}, k) < shiftright({past}, k) AND -shiftright(-{first}, k) % 2 != 0
          THEN named_struct('level', k, 'node', -shiftright(-{first}, k)) END,
        CASE WHEN -shiftright(-{first}, k) < shiftright({past}, k) AND shiftright({past}, k) % 2 != 0
          THEN named_struct('level', k, 'node', shiftright({past}, k) - 1) END), n -> n IS NOT NULL)))""")


def covering_blocks(intervals: DataFrame) -> DataFrame:
    """``intervals`` (with _from, _to: slots of start and end) listed under the blocks that fill the slots between.

    A list grows with the logarithm of the interval's length.
    """
    wide = F.greatest(F.col("_to") - F.col("_from"), F.lit(1))
    return intervals.withColumn("_top", F.floor(F.log2(wide)).cast("int")).withColumn("_past", F.col("_from") + 1).select(
        "*", F.inline(_nodes("_past", "_to", "_top")))


def _placed(intervals: DataFrame, samples: DataFrame, slot_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Samples numbered from 0 per host in order of time, and intervals with the numbers from ``_lo`` to below ``_hi`` inside them.

    One pass sorts samples and interval ends slot by slot; only the slots' totals are ordered per host.
    """
    nothing = F.lit(None)
    rows = samples.where("host IS NOT NULL AND ts IS NOT NULL").select(
        "host", F.unix_micros("ts").alias("_at"), F.lit(0).alias("_kind"), F.col("sample_no").alias("_no"), "value",
        nothing.alias("interval_id"), nothing.alias("started"), nothing.alias("ended"))
    edges = intervals.where("host IS NOT NULL AND ended >= started").select(
        "host", F.inline(F.array(F.struct(F.unix_micros("started").alias("_at"), F.lit(1).alias("_kind")),
                                 F.struct(F.unix_micros("ended").alias("_at"), F.lit(2).alias("_kind")))),
        nothing.alias("_no"), nothing.alias("value"), "interval_id", "started", "ended")
    marks = rows.unionByName(edges).withColumn("_slot", F.floor(F.col("_at") / (slot_seconds * 1_000_000))).withColumn(
        "_one", F.when(F.col("_kind") == 0, 1).otherwise(0))
    earlier = W.partitionBy("host").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    before = marks.groupBy("host", "_slot").agg(F.sum("_one").alias("_sum")).select(
        "host", "_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    slot = W.partitionBy("host", "_slot")
    count = lambda window: F.col("_base") + F.coalesce(F.sum("_one").over(window), F.lit(0))
    numbered = cut_lineage(marks.join(before, ["host", "_slot"]).select(
        "*", count(slot.orderBy("_at", "_kind", "_no").rowsBetween(W.unboundedPreceding, -1)).alias("pos"),
        F.first("value").over(W.partitionBy("host", "_slot", "_at").orderBy("_kind", "_no")).alias("_first"),
        F.when(F.col("_kind") == 1, count(slot.orderBy("_at").rangeBetween(W.unboundedPreceding, -1))).when(
            F.col("_kind") == 2, count(slot.orderBy("_at").rangeBetween(W.unboundedPreceding, 0))).alias("_edge")))
    ranges = numbered.where("_kind > 0").groupBy("host", "interval_id", "started", "ended").agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_edge"))).alias("_lo"), F.max(F.when(F.col("_kind") == 2, F.col("_edge"))).alias("_hi"),
        F.count(F.when(F.col("_kind") == 1, 1)).alias("_copies"))
    return numbered.where("_kind = 0").select("host", "pos", "_at", "value", "_first"), ranges


FINE = 6    # levels of blocks that are built from single samples; the others from blocks of 2^FINE


def _blocks(placed: DataFrame) -> DataFrame:
    """Peak and low of the aligned blocks of 1, 2, 4, ... samples."""
    def of(rows: DataFrame, first: int, past: int) -> DataFrame:
        each = rows.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(past - 1))))
        return each.withColumn("node", F.expr(f"shiftright(pos, level - {first})")).groupBy("host", "level", "node").agg(
            F.max("peak").alias("peak"), F.min("low").alias("low"))

    single = placed.select("host", "pos", F.col("value").alias("peak"), F.col("value").alias("low"))
    wide = single.withColumn("pos", F.expr(f"shiftright(pos, {FINE})")).groupBy("host", "pos").agg(
        F.max("peak").alias("peak"), F.min("low").alias("low"))
    return of(single, 0, FINE).unionByName(of(wide, FINE, 63))


def interval_summary(intervals: DataFrame, samples: DataFrame, step_seconds: float, slot_seconds: int) -> DataFrame:
    """First, last, peak and minimum sample per interval; the nearest sample if none lies inside.

    ``intervals``: host, interval_id, started, ended; ``samples``: host, ts,
    sample_no, value.  Samples are numbered per host in order of time, and an
    interval is the numbers from its first to its last sample.  It is listed
    under the blocks of 1, 2, 4, ... numbers that fill it, so the cost grows with
    the logarithm of its samples, however densely samples and intervals lie.
    The nearest sample is the one before or after, at most two steps from the middle.
    """
    placed, ranges = _placed(intervals, samples, slot_seconds)
    full = ranges.where("_hi > _lo")
    listed = covering_blocks(full.withColumn("_from", F.col("_lo") - 1).withColumn("_to", F.col("_hi")))
    keys = ["host", "interval_id", "started", "ended"]
    ends = full.select(*keys, F.lit(0).alias("level"), F.inline(F.array(
        F.struct(F.col("_lo").alias("node"), F.lit("first").alias("_end")), F.struct((F.col("_hi") - 1).alias("node"), F.lit("last").alias("_end")))))
    rows = listed.select(*keys, "level", "node", F.lit("").alias("_end")).unionByName(ends)
    found = rows.join(_blocks(placed), ["host", "level", "node"]).groupBy(*keys).agg(
        F.max(F.when(F.col("_end") == "first", F.col("peak"))).alias("first_value"),
        F.max(F.when(F.col("_end") == "last", F.col("peak"))).alias("last_value"), F.max("peak").alias("peak"), F.min("low").alias("low"))
    counted = found.join(full, keys).groupBy("host", "interval_id").agg(
        F.sum((F.col("_hi") - F.col("_lo")) * F.col("_copies")).alias("samples"), F.min_by("first_value", "_lo").alias("first_value"),
        F.max_by("last_value", "_hi").alias("last_value"), F.max("peak").alias("peak"), F.min("low").alias("low"))
    lonely = ranges.groupBy("host", "interval_id").agg(
        F.max(F.col("_hi") > F.col("_lo")).alias("_any"), F.collect_set(F.struct("started", "ended", "_lo")).alias("_r")).where("NOT _any")
    middle = (F.unix_micros("started") + F.unix_micros("ended")) / 2
    near = lonely.select("host", "interval_id", F.inline("_r")).select(
        "host", "interval_id", middle.alias("_mid"), F.explode(F.array(F.col("_lo") - 1, F.col("_lo"))).alias("pos"))
    close = near.join(placed, ["host", "pos"]).withColumn("_gap", F.abs(F.col("_at") - F.col("_mid"))).where(
        F.col("_gap") <= step_seconds * 2 * 1_000_000)
    nearest = close.groupBy("host", "interval_id").agg(F.min_by("_first", F.struct("_gap", "_at")).alias("first_value")).select(
        "host", "interval_id", F.lit(1).cast("bigint").alias("samples"), "first_value",
        F.col("first_value").alias("last_value"), F.col("first_value").alias("peak"), F.col("first_value").alias("low"))
    return counted.unionByName(nearest)


def monitored_runs(results: DataFrame, path: str, checkpoint: str, lateness: str = "1 day", key: list[str] | None = None) -> StreamingQuery:
    """Keep the run rollup current as result files land: each trigger upserts the runs it changed, and only those.

    ``results`` as for ``run_rollup``.  With ``key`` (say run_name, paper_pos) a
    result that comes again within ``lateness`` of ``updated_at`` is taken once.
    Each trigger owns one folder of changed rows, so a repeated trigger rewrites
    its own; ``current_runs`` reads the newest row of each run.
    """
    def publish(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")

    if key:
        timed = results.withColumn("_seen", F.col("updated_at").cast("timestamp")).withWatermark("_seen", lateness)
        results = timed.dropDuplicatesWithinWatermark(key).drop("_seen")
    return run_rollup(results).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(
        availableNow=True).start()


def _held(spark: SparkSession, path: str) -> list[str]:
    return [entry for part in ("base", "changes") for entry in entries(spark, f"{path}/{part}")]


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each run: the folded base and the changes after it."""
    rows = spark.read.parquet(*_held(spark, path))
    kept = [c for c in rows.columns if c != "version"]
    newest = rows.groupBy("run_name").agg(F.max_by(F.struct(*kept), "version").alias("_row"), F.max("version").alias("version"))
    return newest.select("_row.*", "version")


def fold_changes(spark: SparkSession, path: str) -> None:
    """Write the newest rows as the base, then delete what it replaces; run it while no trigger does.

    A crash in between leaves rows twice with equal versions, which ``current_runs`` reads as one.
    """
    base = f"{path}/base/{uuid.uuid4().hex}"
    old = _held(spark, path)
    current_runs(spark, path).write.parquet(base)
    for entry in old:
        remove(spark, entry)
