"""Request limiting, coalescing and caching, as streams and as batch twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from attesta.operators.frames import previous, running_total


def _scan(limit: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Flags rows that arrive by stretch and time; between batches it holds the last ``limit`` accepted times only.

    With fewer accepted requests than ``limit``, or the oldest of the last
    ``limit`` a whole window back, the next request is accepted.
    """
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, recent = None, deque(maxlen=limit)
        for batch in batches:
            keys, numbers = batch.column("_key").to_pylist(), batch.column("_stretch").to_pylist()
            flags = []
            for row, moment in zip(zip(keys, numbers), batch.column("_t").to_pylist()):
                if row != stretch:
                    stretch = row
                    recent.clear()
                accepted = len(recent) < limit or moment - recent[0] >= width
                if accepted:
                    recent.append(moment)
                flags.append(accepted)
            kept = [name for name in batch.schema.names if name not in ("_key", "_stretch", "_t")]
            yield batch.select(kept).append_column("accepted", pa.array(flags, pa.bool_()))

    return flag


def rate_limited(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Batch twin: accepted flag per request; only accepted requests count against the limit.

    ``requests``: key, ts, request_id, and any other columns but ``accepted``.
    A gap of a whole window between two requests empties the window, so each key
    is cut into independent stretches; Spark deals rows by stretch, sorts them by
    time, and one scan flags them batch by batch.  Requests with a blank key or
    without a time are accepted and never count.
    """
    if limit <= 0:
        return requests.withColumn("accepted", F.lit(True))
    width = window_seconds * 1_000_000
    bucket = max(width, 3_600_000_000)
    name = F.col("key").cast("string")
    free = (F.coalesce(name, F.lit("")) == "") | F.col("ts").isNull()
    packed = requests.where(~free).select(
        F.struct(*requests.columns).alias("_row"), name.alias("_key"), F.unix_micros("ts").alias("_t"), F.col("request_id").alias("_id"))
    before = previous(packed, ["_key"], "_t", "_t", "_before", bucket)  # equal times share a stretch
    opened = before.withColumn("_new", F.when(F.col("_t") - F.col("_before") < width, 0).otherwise(1))
    numbered = running_total(opened, ["_key"], ["_t"], "_new", "_open", bucket).withColumn("_stretch", F.col("_open") + F.col("_new"))
    dealt = numbered.repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_t", "_id")
    schema = StructType([*requests.schema.fields, StructField("accepted", BooleanType())])
    inner = StructType([StructField("_row", requests.schema), StructField("accepted", BooleanType())])
    flagged = dealt.select("_key", "_stretch", "_t", "_row").mapInArrow(_scan(limit, width), inner)
    return flagged.select("_row.*", "accepted").unionByName(requests.where(free).withColumn("accepted", F.lit(True))).to(schema)


class RateLimiter(StatefulProcessor):
    """Keeps the accepted times of one key inside the window; requests in a batch are taken in time order.

    A timer one window after the last accepted request clears the key's state.
    """

    def __init__(self, limit: int, window_seconds: int):
        self.limit = limit
        self.width = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("accepted", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "request_id"])
        recent = [row[0] for row in self.times.get()] if self.times.exists() else []
        flags = []
        for moment in batch["t"]:
            recent = [t for t in recent if moment - t < self.width]
            accepted = len(recent) < self.limit
            if accepted:
                recent.append(int(moment))
            flags.append(accepted)
        self.times.put([(int(t),) for t in recent])
        if recent:
            self.handle.registerTimer((max(recent) + self.width) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "request_id": batch["request_id"].to_numpy(), "accepted": flags})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.times.exists() and all(now - row[0] >= self.width for row in self.times.get()):
            self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limited_stream(requests: DataFrame, limit: int, window_seconds: int, lateness: str = "1 minute") -> DataFrame:
    """Stream form of ``rate_limited``; requests later than the watermark are dropped."""
    rows = requests.withWatermark("ts", lateness).select(F.col("key"), F.unix_micros("ts").alias("t"), "request_id")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RateLimiter(limit, window_seconds),
        outputStructType="key bigint, request_id bigint, accepted boolean", outputMode="Append", timeMode="EventTime")


def coalesced(requests: DataFrame) -> DataFrame:
    """First request per fingerprint does the work: a partial aggregate, no sort.  ``requests``: cache_key, request_id."""
    return requests.groupBy("cache_key").agg(F.min("request_id").alias("leader"), F.count("*").alias("callers"))


def coalesced_stream(requests: DataFrame, lateness: str) -> DataFrame:
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["cache_key"])


def read_through(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached results, work still to do), one row per distinct cache key."""
    asked = requests.select("cache_key").distinct()
    return asked.join(cache, "cache_key"), asked.join(cache.select("cache_key"), "cache_key", "left_anti")
