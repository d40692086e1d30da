"""Event logs delivered exactly once, their progress and their prefix check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from attesta.operators.frames import ordinal
from attesta.session import cut_lineage, discard
from attesta.sources.folders import entries, exists


BUCKETS = 64


def _bucket(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(BUCKETS)).cast("int")


def _held(spark: SparkSession, target: str, ids: StructField, step: str) -> DataFrame:
    """Ids of a target with their bucket and the step that wrote them; an empty target has none."""
    held = StructType([ids, StructField("id_bucket", IntegerType()), StructField(step, LongType())])
    return spark.read.schema(held).parquet(target)


def _absent(rows: DataFrame, target: str, id_col: str, step: str, number: int) -> DataFrame:
    """Rows, one an id, whose id no earlier step wrote; of ``target`` only the buckets of these rows are read."""
    fresh = rows.dropDuplicates([id_col]).withColumn("id_bucket", _bucket(id_col))
    if not exists(rows.sparkSession, target):
        return fresh
    asked = [row.id_bucket for row in fresh.select("id_bucket").distinct().collect()]  # at most BUCKETS numbers
    earlier = _held(rows.sparkSession, target, rows.schema[id_col], step).where(
        F.col("id_bucket").isin(asked) & (F.col(step) < number)).select("id_bucket", id_col)
    return fresh.join(earlier, ["id_bucket", id_col], "left_anti")


def insert_absent(batch: DataFrame, target: str, id_col: str, epoch: int) -> None:
    """Append the rows of a micro-batch whose id the target does not hold yet.

    The target is partitioned by a hash of the id, so a batch reads only the
    buckets its ids fall into.  Each epoch owns one folder, so a repeated epoch
    overwrites its own output and never another's: replays after a lost
    executor add nothing twice.
    """
    fresh = _absent(batch, target, id_col, "epoch", epoch)
    fresh.write.mode("overwrite").partitionBy("id_bucket").parquet(f"{target}/epoch={epoch}")


def idempotent_sink(events: DataFrame, target: str, checkpoint: str, id_col: str = "usage_event_id", once: bool = True) -> StreamingQuery:
    """Stream events into ``target``; the checkpoint resumes after a failure, the id check absorbs repeats."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: insert_absent(batch, target, id_col, epoch))
    return (writer.trigger(availableNow=True) if once else writer).start()


@dataclass(frozen=True)
class Delivery:
    """Where events go: ``events`` by hash bucket of the id, ``ledger`` with a row a run and round."""

    folder: str
    chunk_size: int = 1000

    @property
    def events(self) -> str:
        return f"{self.folder}/events"

    @property
    def ledger(self) -> str:
        return f"{self.folder}/ledger"


def ledger_state(spark: SparkSession, to: Delivery) -> DataFrame:
    """The last ledger row of each run."""
    rows = spark.read.parquet(to.ledger)
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), "round").alias("_row")).select(
        "run_id", "_row.*")


def _next_round(spark: SparkSession, to: Delivery) -> int:
    return max((int(name.rsplit("=", 1)[1]) for name in entries(spark, to.ledger) if "round=" in name), default=-1) + 1


def send_chunks(events: DataFrame, to: Delivery, chunks: int | None = None) -> None:
    """Send each run's events from its ``next_offset`` on, in chunks, and enter the progress in the ledger.

    ``events``: run_id, pos (from 0, gapless in a run), usage_event_id, and any
    others.  ``chunks`` bounds the chunks a run sends in this round; a run with
    events left is then ``uploading``.  A chunk with an event that cannot be
    stored (no id) is refused whole: the run is ``failed`` and keeps its offset
    at that chunk, and the chunks before it stand.  Events are written before the
    ledger, under the number of the round: a round that broke off in between is
    repeated under its own number, and ids it stored are not inserted again.
    """
    spark = events.sparkSession
    number = _next_round(spark, to)
    sizes = events.groupBy("run_id").agg(F.count("*").alias("expected"))
    known = ledger_state(spark, to) if number else spark.createDataFrame(
        [], "run_id string, next_offset bigint, inserted bigint, status string")
    state = sizes.join(known.select("run_id", "next_offset", "inserted", "status"), "run_id", "left").where(
        F.coalesce("status", F.lit("")) != "complete").select(
        "run_id", "expected", F.least(F.coalesce("next_offset", F.lit(0)), "expected").alias("start"),
        F.coalesce("inserted", F.lit(0)).alias("inserted"))
    open_rows = events.join(state.select("run_id", "start"), "run_id").where(F.col("pos") >= F.col("start")).withColumn(
        "_chunk", F.floor((F.col("pos") - F.col("start")) / to.chunk_size))
    if chunks is not None:
        open_rows = open_rows.where(F.col("_chunk") < chunks)
    offered = open_rows.groupBy("run_id").agg(
        F.min(F.when(F.col("usage_event_id").isNull(), F.col("_chunk"))).alias("_bad"), (F.max("pos") + 1).alias("_end"))
    planned = cut_lineage(state.join(offered, "run_id", "left").select(
        "run_id", "expected", "inserted", "start", F.col("_bad").isNotNull().alias("refused"),
        F.coalesce(F.col("start") + F.col("_bad") * to.chunk_size, "_end", "start").alias("next_offset")))
    sent = open_rows.join(planned.select("run_id", "next_offset"), "run_id").where(F.col("pos") < F.col("next_offset")).drop(
        "start", "next_offset", "_chunk")
    one = sent.groupBy("usage_event_id").agg(F.min(F.struct("run_id", "pos")).alias("_at"))  # the first run to send an id stores it
    first = sent.join(one.select("usage_event_id", F.col("_at.run_id").alias("run_id"), F.col("_at.pos").alias("pos")),
                      ["usage_event_id", "run_id", "pos"])
    fresh = _absent(first, to.events, "usage_event_id", "round", number)
    fresh.write.mode("overwrite").partitionBy("id_bucket").parquet(f"{to.events}/round={number}")
    stored = spark.read.schema(fresh.schema).parquet(f"{to.events}/round={number}")
    added = stored.groupBy("run_id").agg(F.count("*").alias("_new"))
    status = F.when(F.col("refused"), "failed").when(F.col("next_offset") < F.col("expected"), "uploading").otherwise("uploaded_unverified")
    planned.join(added, "run_id", "left").select(
        "run_id", "expected", "next_offset", (F.col("inserted") + F.coalesce("_new", F.lit(0))).alias("inserted"),
        F.lit(None).cast("bigint").alias("stored"), status.alias("status")).write.mode("overwrite").parquet(f"{to.ledger}/round={number}")
    discard(planned)


def verify_deliveries(events: DataFrame, to: Delivery) -> None:
    """Count what is stored of each run of ``events`` that has sent everything: ``complete``, or ``pending`` from offset 0 again."""
    spark = events.sparkSession
    number = _next_round(spark, to)
    sent = ledger_state(spark, to).where("status = 'uploaded_unverified'").drop("round", "stored", "status").join(
        events.select("run_id").distinct(), "run_id", "left_semi")
    asked = events.join(sent.select("run_id"), "run_id", "left_semi").select("run_id", "usage_event_id").distinct().withColumn(
        "id_bucket", _bucket("usage_event_id"))
    held = _held(spark, to.events, events.schema["usage_event_id"], "round").select("id_bucket", "usage_event_id")
    counts = asked.join(held, ["id_bucket", "usage_event_id"], "left_semi").groupBy("run_id").agg(F.count("*").alias("stored"))
    checked = sent.join(counts, "run_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    whole = F.col("stored") >= F.col("expected")
    checked.select(
        "run_id", "expected", F.when(whole, F.col("next_offset")).otherwise(0).alias("next_offset"), "inserted", "stored",
        F.when(whole, "complete").otherwise("pending").alias("status")).write.mode("overwrite").parquet(f"{to.ledger}/round={number}")


def upload_status(expected: DataFrame, stored: DataFrame, verified: bool = True) -> DataFrame:
    """Delivery status per run from counts: complete, uploaded_unverified or pending.

    ``expected`` and ``stored``: run_id, usage_event_id.
    """
    want = expected.groupBy("run_id").agg(F.count_distinct("usage_event_id").alias("expected"))
    have = stored.groupBy("run_id").agg(F.count_distinct("usage_event_id").alias("stored"))
    joined = want.join(have, "run_id", "left").na.fill(0, ["stored"])
    done = F.col("stored") >= F.col("expected")
    return joined.withColumn("status", F.when(done, "complete" if verified else "uploaded_unverified").otherwise("pending"))


def prefix_check(old: DataFrame, new: DataFrame) -> DataFrame:
    """Does each run's new id list extend its old one, an empty one included?  If not, offsets restart at zero.

    ``old`` / ``new``: run_id, pos, usage_event_id.
    """
    compared = old.join(new.select("run_id", "pos", F.col("usage_event_id").alias("_new")), ["run_id", "pos"], "left")
    per_run = compared.groupBy("run_id").agg(
        F.bool_and(F.coalesce(F.col("_new") == F.col("usage_event_id"), F.lit(False))).alias("append_only"), F.count("*").alias("old_count"))
    totals = new.groupBy("run_id").agg(F.count("*").alias("new_count"))
    joined = totals.join(per_run, "run_id", "left")
    append = F.coalesce("append_only", F.lit(True))
    return joined.select("run_id", append.alias("append_only"), "new_count",
                         F.when(append, F.coalesce("old_count", F.lit(0))).otherwise(0).alias("next_offset"))


def chunked_sections(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Chunk number per row of each section with its own chunk size, and rows per chunk.

    ``rows``: section, pos.
    """
    size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("section")), F.lit(1))
    numbered = ordinal(rows, ["section"], ["pos"], "_no").withColumn("chunk", F.floor((F.col("_no") - 1) / size).cast("int"))
    return numbered.groupBy("section", "chunk").agg(F.count("*").alias("rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def pending_backlog(backups: DataFrame) -> DataFrame:
    return backups.where(F.coalesce("status", F.lit("")) != "complete").orderBy("path")
