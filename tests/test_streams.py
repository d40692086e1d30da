"""Streams and deliveries: what survives an interruption, what a batch reads, how lists grow."""

from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.sources.folders import entries
from attesta.streaming import monitor, requests, uploads

DAY = datetime(2024, 1, 1)


def plain_limit(rows, limit, width):
    """Accepted flags by the definition, one key after another."""
    flags = {}
    for key in {r[0] for r in rows}:
        recent = []
        for moment, number in sorted((r[1], r[2]) for r in rows if r[0] == key):
            recent = [t for t in recent if (moment - t).total_seconds() < width]
            flags[number] = len(recent) < limit
            if flags[number]:
                recent.append(moment)
    return flags


def test_rate_limit_of_a_hot_key(spark):
    draw = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", DAY + timedelta(seconds=draw.randrange(4000)), i, f"x{i}") for i in range(6000)]
    table = spark.createDataFrame(rows, "key string, ts timestamp, request_id bigint, _t string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        flagged = requests.rate_limited(table, 4, 60).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.request_id: r.accepted for r in flagged} == plain_limit(rows, 4, 60)
    assert all(r["_t"] == f"x{r.request_id}" for r in flagged)


def test_rate_limit_without_key_time_or_rows(spark):
    rows = [(None, DAY, 1), ("", DAY, 1), ("a", None, 2), ("a", DAY, 3), ("a", DAY, 3), ("a", DAY, 4)]
    table = spark.createDataFrame(rows, "key string, ts timestamp, request_id bigint")
    flagged = sorted((r.key or "", r.request_id, r.accepted) for r in requests.rate_limited(table, 2, 60).collect())
    assert flagged == [("", 1, True), ("", 1, True), ("a", 2, True), ("a", 3, True), ("a", 3, True), ("a", 4, False)]
    assert requests.rate_limited(table.limit(0), 2, 60).count() == 0
    assert requests.rate_limited(table, 0, 60).where("accepted").count() == 6


def test_interval_lists_grow_with_the_logarithm(spark):
    slots = spark.createDataFrame([(1, 5, 5 + 8784), (2, -9, 40), (3, 7, 7), (4, 7, 8), (5, 7, 9)], "id int, _from bigint, _to bigint")
    listed = monitor.covering_blocks(slots).collect()
    for row in slots.collect():
        covered = sorted(s for b in listed if b.id == row.id for s in range(b.node << b.level, (b.node + 1) << b.level))
        assert covered == list(range(row["_from"] + 1, row["_to"]))
    assert sum(b.id == 1 for b in listed) < 30


def test_interval_summary_equals_a_plain_scan(spark):
    draw = random.Random(5)
    at = lambda s: DAY + timedelta(seconds=s)
    samples = [(i % 2, at(draw.randrange(400_000)), i, float(draw.randrange(100))) for i in range(1500)]
    spans = [(i % 2, i, at(a := draw.randrange(380_000)), at(a + draw.choice([0, 40, 900, 3600, 90_000]))) for i in range(150)]
    out = monitor.interval_summary(
        spark.createDataFrame(spans, "host int, interval_id int, started timestamp, ended timestamp"),
        spark.createDataFrame(samples, "host int, ts timestamp, sample_no int, value double"), 300, 600).collect()
    expected = {}
    for host, number, start, end in spans:
        inside = sorted((t, n, v) for h, t, n, v in samples if h == host and start <= t <= end)
        middle = start + (end - start) / 2
        near = sorted((abs(t - middle), t, n, v) for h, t, n, v in samples if h == host and abs(t - middle) <= timedelta(seconds=600))
        values = [v for *_, v in inside] or [v for *_, v in near[:1]]
        if values:
            expected[number] = (len(values), values[0], values[-1], max(values), min(values))
    assert {r.interval_id: (r.samples, r.first_value, r.last_value, r.peak, r.low) for r in out} == expected


def test_dense_intervals_meet_few_rows(spark):
    """Many intervals and samples of one slot: an interval is listed under the samples inside it only."""
    at = lambda s: DAY + timedelta(seconds=s)
    samples = [(1, at(i // 3), 9000 - i, float(i % 7)) for i in range(1200)]
    spans = [(1, i, at(i), at(i + 2)) for i in range(0, 400, 2)] + [(1, 1000, at(500), at(520)), (1, 1001, at(-9), at(-8)), (None, 7, at(0), at(9))]
    intervals = spark.createDataFrame(spans, "host int, interval_id int, started timestamp, ended timestamp")
    table = spark.createDataFrame(samples, "host int, ts timestamp, sample_no int, value double")
    _, ranges = monitor._placed(intervals, table, 3600)
    assert ranges.agg({"_hi": "max"}).first()[0] == 1200 and ranges.where("_hi - _lo > 9").count() == 0
    found = {r.interval_id: (r.samples, r.first_value, r.last_value) for r in monitor.interval_summary(intervals, table, 300, 3600).collect()}
    value = lambda number: next(v for _, _, n, v in samples if n == number)
    for _, number, start, end in spans[:200]:
        inside = sorted((t, n) for _, t, n, _ in samples if start <= t <= end)
        assert found[number] == (len(inside), value(inside[0][1]), value(inside[-1][1]))
    # of equally near samples the one of the smallest number counts
    assert found[1000] == (1, value(9000 - 1199), value(9000 - 1199)) and found[1001] == (1, value(9000 - 2), value(9000 - 2)) and 7 not in found


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def usage(spark, runs):
    rows = [(run, pos, number) for run, ids in runs.items() for pos, number in enumerate(ids)]
    return spark.createDataFrame(rows, "run_id string, pos bigint, usage_event_id string")


def states(spark, to):
    return {r.run_id: (r.status, r.next_offset, r.inserted, r.stored) for r in uploads.ledger_state(spark, to).collect()}


def test_delivery_states_and_resume(spark, folder):
    to = uploads.Delivery(folder, 3)
    ids = [f"e{i}" for i in range(8)]
    events = usage(spark, {"whole": ids, "twice": ["t1", "t2", "t1"], "broken": ["b0", "b1", "b2", "b3", None, "b5"]})
    uploads.send_chunks(events, to, chunks=1)
    assert states(spark, to) == {"whole": ("uploading", 3, 3, None), "twice": ("uploaded_unverified", 3, 2, None), "broken": ("uploading", 3, 3, None)}
    uploads.send_chunks(events, to)
    assert states(spark, to)["whole"] == ("uploaded_unverified", 8, 8, None)
    assert states(spark, to)["broken"] == ("failed", 3, 3, None)
    uploads.verify_deliveries(events, to)
    assert states(spark, to) == {"whole": ("complete", 8, 8, 8), "twice": ("pending", 0, 2, 2), "broken": ("failed", 3, 3, None)}
    mended = usage(spark, {"broken": ["b0", "b1", "b2", "b3", "b4", "b5"], "whole": ids})
    uploads.send_chunks(mended, to)
    uploads.verify_deliveries(mended, to)
    assert states(spark, to)["broken"] == ("complete", 6, 6, 6)
    stored = [r[0] for r in spark.read.parquet(to.events).select("usage_event_id").collect()]
    assert sorted(stored) == sorted(ids + ["t1", "t2"] + [f"b{i}" for i in range(6)])


def test_killed_between_events_and_ledger(spark, folder, monkeypatch):
    to = uploads.Delivery(folder, 3)
    events = usage(spark, {"a": [f"e{i}" for i in range(7)], "b": ["e1", "e9"]})
    uploads.send_chunks(events, to, chunks=1)
    monkeypatch.setattr(uploads, "F", _Killing(uploads.F))
    with pytest.raises(RuntimeError, match="killed"):
        uploads.send_chunks(events, to)
    monkeypatch.undo()
    assert entries(spark, to.events)[-1].endswith("round=1")  # events are there, their ledger row is not
    assert states(spark, to)["a"] == ("uploading", 3, 3, None)
    uploads.send_chunks(events, to)
    uploads.verify_deliveries(events, to)
    assert states(spark, to) == {"a": ("complete", 7, 7, 7), "b": ("complete", 2, 1, 2)}
    assert spark.read.parquet(to.events).groupBy("usage_event_id").count().where("count > 1").isEmpty()


class _Killing:
    """Functions of Spark, but the one that states the status fails."""

    def __init__(self, functions):
        self.functions = functions

    def __getattr__(self, name):
        return getattr(self.functions, name)

    def when(self, condition, value):
        if isinstance(value, str) and value == "failed":
            raise RuntimeError("killed")
        return self.functions.when(condition, value)


def test_batch_reads_only_its_buckets(spark, folder):
    first = spark.range(2000).select(F.col("id").cast("string").alias("usage_event_id"))
    uploads.insert_absent(first, folder, "usage_event_id", 0)
    batch = spark.createDataFrame([("7",), ("new",), ("new",)], "usage_event_id string")
    fresh = uploads._absent(batch, folder, "usage_event_id", "epoch", 1)
    assert [r.usage_event_id for r in fresh.collect()] == ["new"]
    plan = fresh._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "id_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for _ in range(2):  # a repeated epoch
        uploads.insert_absent(batch, folder, "usage_event_id", 1)
    assert spark.read.parquet(folder).count() == 2001


def test_triggers_write_changed_runs_only(spark, folder):
    schema = "run_name string, paper_pos bigint, status string, claims bigint, quality double, cost_cents bigint, runtime string, updated_at date"
    rows = lambda *names: spark.createDataFrame(
        [(n, p, "completed", 4, 0.5, 10, "r", DAY.date()) for n, p in names], schema)
    landing, out, state = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    rows(("a", 1), ("b", 1)).write.parquet(landing)
    stream = spark.readStream.schema(schema).parquet(landing)
    run = lambda: monitor.monitored_runs(stream, out, state, key=["run_name", "paper_pos"]).awaitTermination()
    run()
    rows(("b", 2), ("b", 1), ("c", 1)).write.mode("append").parquet(landing)
    run()
    epochs = [{r.run_name for r in spark.read.parquet(e).collect()} for e in entries(spark, f"{out}/changes")]
    assert [e for e in epochs if e] == [{"a", "b"}, {"b", "c"}]
    counts = lambda: {r.run_name: r.paper_count for r in monitor.current_runs(spark, out).collect()}
    assert counts() == {"a": 1, "b": 2, "c": 1}
    monitor.fold_changes(spark, out)
    assert counts() == {"a": 1, "b": 2, "c": 1} and not entries(spark, f"{out}/changes")
    rows(("a", 2)).write.mode("append").parquet(landing)
    run()
    assert counts() == {"a": 2, "b": 2, "c": 1}
