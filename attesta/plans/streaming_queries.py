"""Stateful and streaming operators over the events (STR)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.registry import query
from attesta.plans.report_queries import RUN, runs
from attesta.session import ensure_checkpoint_dir
from attesta.streaming import monitor, requests, uploads

DAY = 86400
LIMIT_FOLD = """
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold AS (
  SELECT user_id, event_id, n, [t] AS recent, true AS accepted FROM r WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END, len(kept) < 3 FROM (
    SELECT r.user_id, r.event_id, r.n, r.t, list_filter(f.recent, lambda x: r.t - x < 86400000000) AS kept FROM fold f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))
SELECT event_id AS request_id, accepted FROM fold"""


def asked(t) -> DataFrame:
    return t.read("events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request_id"))


def scratch(t, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(t) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(t.folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_01_rate_limit", LIMIT_FOLD)
def _limit(t):
    return requests.rate_limited(asked(t), 3, DAY).select("request_id", "accepted")


@query("str_01b_rate_limit_stream", LIMIT_FOLD)
def _limit_stream(t):
    """The same answer from keyed state over an event stream."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = event_stream(t).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request_id"))
    out = scratch(t, "limited")
    requests.rate_limited_stream(stream, 3, DAY).writeStream.option("checkpointLocation", scratch(t, "state")).trigger(
        availableNow=True).format("parquet").start(out).awaitTermination()
    return t.spark.read.parquet(out).select("request_id", "accepted")


@query("str_02_coalesced_requests", """
SELECT sha256(CAST(user_id AS VARCHAR) || event_type) AS cache_key, min(event_id) AS leader, count(*) AS callers FROM events GROUP BY user_id, event_type""")
def _coalesce(t):
    key = F.sha2(F.concat(F.col("user_id").cast("string"), "event_type"), 256)
    return requests.coalesced(t.read("events").select(key.alias("cache_key"), F.col("event_id").alias("request_id")))


@query("str_02b_coalesced_stream", "SELECT count(*) AS leaders FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _coalesce_stream(t):
    stream = event_stream(t).withColumn("cache_key", F.concat_ws("/", "user_id", "event_type"))
    out = scratch(t, "coalesced")
    requests.coalesced_stream(stream, "3650 days").select("cache_key", "event_id").writeStream.option("checkpointLocation", scratch(t, "state")).trigger(
        availableNow=True).format("parquet").start(out).awaitTermination()
    return t.spark.read.parquet(out).agg(F.count("*").alias("leaders"))


@query("str_03_cache_read_through", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS cache_key, CASE WHEN c_custkey IS NULL THEN 'compute' ELSE 'cached' END AS source
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def _cache(t):
    wanted = t.read("orders").select(F.col("o_custkey").cast("string").alias("cache_key"))
    cache = t.read("customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("cache_key"))
    cached, todo = requests.read_through(wanted, cache)
    return cached.withColumn("source", F.lit("cached")).unionByName(todo.withColumn("source", F.lit("compute")))


@query("str_04_idempotent_sink", "SELECT event_id AS usage_event_id, event_type FROM events")
def _sink(t):
    """The event file is delivered twice, through two checkpoints; the target holds each event once."""
    target = scratch(t, "events")
    for _ in range(2):
        stream = event_stream(t).select(F.col("event_id").alias("usage_event_id"), "event_type")
        uploads.idempotent_sink(stream, target, scratch(t, "offsets")).awaitTermination()
    return t.spark.read.parquet(target).select("usage_event_id", "event_type")


CHUNK = 4
USAGE = f"""
  SELECT *, count(*) OVER (PARTITION BY run_id) AS expected,
    min(CASE WHEN id IS NULL THEN pos // {CHUNK} * {CHUNK} END) OVER (PARTITION BY run_id) AS refused FROM (
    SELECT CAST(user_id AS VARCHAR) AS run_id, user_id, pos, CASE WHEN user_id % 5 = 1 AND pos = 6 THEN NULL WHEN user_id % 7 = 2 AND pos = 1 THEN first ELSE event_id END AS id
    FROM (SELECT user_id, event_id, row_number() OVER w - 1 AS pos, first_value(event_id) OVER w AS first
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


@query("str_04c_chunk_ledger", f"""
WITH sent AS (SELECT *, least(coalesce(refused, expected), CASE WHEN user_id % 3 = 0 THEN {CHUNK} ELSE expected END) AS upto FROM f_usage),
r AS (SELECT run_id, user_id, expected, refused, upto, count(DISTINCT id) FILTER (pos < upto) AS inserted, count(DISTINCT id) AS ids FROM sent GROUP BY ALL)
SELECT run_id, expected, inserted, CASE WHEN upto < expected OR user_id % 4 = 3 THEN NULL ELSE ids END AS stored,
  CASE WHEN upto < expected OR user_id % 4 = 3 OR ids = expected THEN upto ELSE 0 END AS next_offset,
  CASE WHEN upto < expected THEN CASE WHEN refused IS NOT NULL AND upto = refused AND (user_id % 3 <> 0 OR refused < {CHUNK}) THEN 'failed' ELSE 'uploading' END
    WHEN user_id % 4 = 3 THEN 'uploaded_unverified' WHEN ids = expected THEN 'complete' ELSE 'pending' END AS status FROM r""", {"f_usage": USAGE})
def _ledger(t):
    """Every run sends one chunk and stops; two thirds resume; a quarter is never verified.

    Some runs hold an event without id, some an id twice.
    """
    from pyspark.sql import Window as W

    run = W.partitionBy("user_id").orderBy("ts", "event_id")
    pos, user = F.col("pos"), F.col("user_id")
    listed = t.read("events").select("user_id", "event_id", "event_type", (F.row_number().over(run) - 1).alias("pos"), F.first("event_id").over(run).alias("first"))
    rows = listed.select(
        user.cast("string").alias("run_id"), "user_id", "pos", "event_type",
        F.when((user % 5 == 1) & (pos == 6), None).when((user % 7 == 2) & (pos == 1), F.col("first")).otherwise(F.col("event_id")).alias("usage_event_id"))
    to = uploads.Delivery(scratch(t, "delivery"), CHUNK)
    uploads.send_chunks(rows, to, chunks=1)
    uploads.send_chunks(rows.where(user % 3 != 0), to)
    uploads.verify_deliveries(rows.where(user % 4 != 3), to)
    return uploads.ledger_state(t.spark, to).select("run_id", "expected", "inserted", "stored", "next_offset", "status")


@query("str_04b_upload_status", """
SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS expected, count(*) FILTER (event_type <> 'error' OR user_id % 2 = 0) AS stored,
  CASE WHEN count(*) FILTER (event_type <> 'error' OR user_id % 2 = 0) >= count(*) THEN 'complete' ELSE 'pending' END AS status FROM events GROUP BY user_id""")
def _status(t):
    rows = t.read("events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("usage_event_id"), ((F.col("event_type") != "error") | (F.col("user_id") % 2 == 0)).alias("here"))
    return uploads.upload_status(rows, rows.where("here"))


@query("str_05_append_only_prefix", """
SELECT CAST(l_orderkey AS VARCHAR) AS run_id, ok AS append_only, new_count, CASE WHEN ok THEN new_count - 1 ELSE 0 END AS next_offset
FROM (SELECT l_orderkey, count(*) AS new_count, l_orderkey % 3 <> 0 OR count(*) FILTER (pos % 2 = 0 AND pos < n) = 0 AS ok
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
          count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey)""")
def _prefix(t):
    """Old lists lack the last id; in every third run the even ids were replaced."""
    from pyspark.sql import Window as W

    run = W.partitionBy("l_orderkey")
    lines = t.read("lineitem").select(
        "l_orderkey", F.row_number().over(run.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("pos"), F.count("*").over(run).alias("n"))
    new = lines.select(F.col("l_orderkey").cast("string").alias("run_id"), "pos", F.concat_ws("-", "l_orderkey", "pos").alias("usage_event_id"))
    changed = (F.col("l_orderkey") % 3 == 0) & (F.col("pos") % 2 == 0)
    old = lines.where("pos < n").select(F.col("l_orderkey").cast("string").alias("run_id"), "pos",
                                        F.when(changed, "other").otherwise(F.concat_ws("-", "l_orderkey", "pos")).alias("usage_event_id"))
    return uploads.prefix_check(old, new)


@query("str_06_chunked_sections", """
SELECT section, chunk, count(*) AS rows, min(event_id) AS first_pos, max(event_id) AS last_pos FROM (
  SELECT event_type AS section, event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // CASE event_type WHEN 'view' THEN 150 WHEN 'signup' THEN 20 ELSE 50 END AS INTEGER) AS chunk FROM events)
GROUP BY section, chunk""")
def _chunks(t):
    sizes = {"view": 150, "signup": 20, "click": 50, "purchase": 50, "error": 50}
    return uploads.chunked_sections(t.read("events").select(F.col("event_type").alias("section"), F.col("event_id").alias("pos")), sizes)


INTERVALS = """
  SELECT * FROM (SELECT user_id % 5 AS host, event_id AS interval_id, ts AS started, lead(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS ended
    FROM events WHERE event_type = 'purchase') WHERE ended IS NOT NULL"""


@query("str_07_interval_summary", """
WITH s AS (SELECT user_id % 5 AS host, ts, event_id, value FROM events WHERE event_type = 'view'),
i AS (SELECT i.host, i.interval_id, count(*) AS samples, arg_min(value, (s.ts, event_id)) AS first_value, arg_max(value, (s.ts, event_id)) AS last_value, max(value) AS peak, min(value) AS low
  FROM f_interval_of i JOIN s ON s.host = i.host AND s.ts BETWEEN started AND ended GROUP BY i.host, i.interval_id),
n AS (SELECT x.host, x.interval_id, arg_min(value, (abs(epoch_us(s.ts) - (epoch_us(started) + epoch_us(ended)) / 2), s.ts, event_id)) AS v
  FROM f_interval_of x JOIN s ON s.host = x.host AND abs(epoch_us(s.ts) - (epoch_us(started) + epoch_us(ended)) / 2) <= 3600000000
  WHERE (x.host, x.interval_id) NOT IN (SELECT (host, interval_id) FROM i) GROUP BY x.host, x.interval_id)
SELECT * FROM i UNION ALL SELECT host, interval_id, 1, v, v, v, v FROM n""", {"f_interval_of": INTERVALS})
def _intervals(t):
    from pyspark.sql import Window as W

    host = (F.col("user_id") % 5).alias("host")
    nxt = F.lead("ts").over(W.partitionBy(F.col("user_id") % 5).orderBy("ts", "event_id"))
    intervals = t.read("events").where("event_type = 'purchase'").select(host, F.col("event_id").alias("interval_id"), F.col("ts").alias("started"), nxt.alias("ended")).where("ended IS NOT NULL")
    samples = t.read("events").where("event_type = 'view'").select(host, "ts", F.col("event_id").alias("sample_no"), "value")
    return monitor.interval_summary(intervals, samples, 1800, 3600)


@query("str_08_pending_backlog", "SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'")
def _backlog(t):
    backups = t.read("orders").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise(F.col("o_orderstatus")).alias("status"))
    return uploads.pending_backlog(backups)


@query("str_09_incremental_runs", """
SELECT run_name, count(*) AS paper_count, count(*) FILTER (status = 'completed') AS completed, max(updated_at) AS updated_at FROM f_run GROUP BY run_name""", {"f_run": RUN})
def _monitor(t):
    """Orders land as files in two triggers; the runs kept up to date end where the batch rollup does."""
    landing, out, state = scratch(t, "landing"), scratch(t, "rollup"), scratch(t, "state")
    early = F.col("paper_pos") % 2 == 0
    for part in (runs(t).where(early), runs(t).where(~early)):
        part.write.mode("append").parquet(landing)
        stream = t.spark.readStream.schema(part.schema).parquet(landing)
        monitor.monitored_runs(stream, out, state).awaitTermination()
    return monitor.current_runs(t.spark, out).select("run_name", "paper_count", "completed", "updated_at")
