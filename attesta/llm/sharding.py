"""Sampled-splitter sharding: near-equal byte shards over a range-partitioned key space.

Records are ordered by (hash of the text, hash of the id), so equal texts lie
side by side.  A size-weighted key sample gives quantile splitters for many
fine ranges; their true sizes are counted, ranges that turn out overfull are
sampled again and subdivided, and running byte totals cut the ordered ranges
into shards.  Only splitters and per-range totals, whose number is a
parameter, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.common import numbered, text_hash
from attesta.session import cut_lineage

LOWEST = -(2**63)


@dataclass(frozen=True)
class ShardSettings:
    shards: int = 8
    ranges: int = 1024          # fine ranges: raise with the rows, about one per million
    samples_per_range: int = 16
    whole_group: float = 0.005  # groups up to this share of a shard are never cut


def _range_of(splitters: list[tuple[int, int]]):
    """Vectorised search of the range a (key, tie) pair falls into."""
    keys = np.array([s[0] for s in splitters], dtype=np.int64)
    ties = np.array([s[1] for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def find(k: pd.Series, t: pd.Series) -> pd.Series:
        key, tie = k.to_numpy(np.int64), t.to_numpy(np.int64)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        place = low.copy()
        shared = np.flatnonzero(high > low)
        for value in np.unique(key[shared]):
            at = shared[key[shared] == value]
            i, j = low[at[0]], high[at[0]]
            place[at] = i + np.searchsorted(ties[i:j], tie[at], "right")
        return pd.Series(place.astype(np.int32))

    return find


def _quantiles(sample: list[tuple[int, int, float]], pieces: int) -> list[tuple[int, int]]:
    """Boundaries that cut the weighted sample into ``pieces`` of equal weight."""
    if not sample or pieces < 2:
        return []
    sample = sorted(sample)
    reach = np.cumsum([w for _, _, w in sample])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, pieces) / pieces)
    return sorted({sample[i][:2] for i in np.minimum(at, len(sample) - 1)})


def _snap(splitters: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Move a boundary to the start of its group, unless the group holds several boundaries."""
    seen, out = set(), []
    for key, tie in sorted(set(splitters)):
        out.append((key, tie if key in seen else LOWEST))
        seen.add(key)
    return out


def _draw(slim: DataFrame, rate: Column, salt: int) -> list[tuple[int, int, float]]:
    """Keep each record with probability size x rate (one draw per key); weight what one kept record stands for."""
    chance = F.pmod(F.xxhash64(F.lit(salt), "_k", "_t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = slim.withColumn("_rate", rate).where(chance < F.col("_size") * F.col("_rate"))
    return [(r["_k"], r["_t"], float(r["w"])) for r in picked.groupBy("_k", "_t").agg(
        F.sum(F.greatest(F.col("_size").cast("double"), 1 / F.col("_rate"))).alias("w")).collect()]


def splitters_for(slim: DataFrame, settings: ShardSettings, total: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Splitters of the fine ranges, and (range, bytes, rows) of every range that has rows."""
    room = total / settings.ranges
    rate = settings.samples_per_range / room
    splitters = _snap(_quantiles(_draw(slim, F.lit(rate), 0), settings.ranges))
    for attempt in range(1, 4):
        ranged = slim.withColumn("_range", _range_of(splitters)("_k", "_t"))
        held = [tuple(r) for r in ranged.groupBy("_range").agg(
            F.sum("_size").alias("b"), F.count("*").alias("n"),
            F.min(F.struct("_k", "_t")).alias("lo"), F.max(F.struct("_k", "_t")).alias("hi")).collect()]
        over = {r: b for r, b, _, lo, hi in held if b > 2 * room and tuple(lo) != tuple(hi)}
        if not over or attempt == 3:
            break
        finer = _draw(ranged.where(F.col("_range").isin(list(over))), F.lit(rate * 4), attempt)
        bounds = np.array([s[0] for s in splitters], dtype=np.int64)
        extra: dict[int, list] = {}
        for k, t, w in finer:
            at = int(np.searchsorted(bounds, k, "left"))
            while at < len(splitters) and splitters[at] <= (k, t):
                at += 1
            extra.setdefault(at, []).append((k, t, w))
        for at, sample in extra.items():
            splitters += _quantiles(sample, int(np.ceil(over.get(at, 0) / room)))
        splitters = _snap(splitters)
    return splitters, sorted((r, int(b), int(n)) for r, b, n, _, _ in held)


def shard_documents(docs: DataFrame, settings: ShardSettings = ShardSettings()) -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard.

    Size is the UTF-8 bytes of the text plus 1; shards are near equal in bytes
    (law ``bytes``), so grown_shard is null.  A null text has size 1 and crc 0.
    A null id or text is an ordinary key; repeated rows are neighbours that
    take slots in any order, which no column shows.  Input columns named like
    an output are replaced, any other name is kept with its values.  An empty
    table gives no rows.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    base, named = numbered(docs.drop(*made))
    text, doc_id = named["text"], named["doc_id"]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    keyed = base.withColumns({
        "_size": size, "_k": text_hash(text), "_t": F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id)),
        "_crc": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")})
    slim = cut_lineage(keyed.select("_k", "_t", "_size"))
    whole = slim.agg(F.sum("_size").alias("b")).first()["b"] or 1
    splitters, held = splitters_for(slim, settings, whole)
    find = _range_of(splitters)
    bytes_before = [0] * (len(splitters) + 2)
    rows_before = [0] * (len(splitters) + 2)
    sums = {r: (b, n) for r, b, n in held}
    for r in range(len(splitters) + 1):
        b, n = sums.get(r, (0, 0))
        bytes_before[r + 1], rows_before[r + 1] = bytes_before[r] + b, rows_before[r] + n
    bases = docs.sparkSession.createDataFrame(
        [(r, bytes_before[r], rows_before[r]) for r in range(len(splitters) + 1)], "_range int, _b long, _r long")

    def placed(rows: DataFrame) -> DataFrame:
        order = W.partitionBy("_range").orderBy("_k", "_t")
        group = W.partitionBy("_range", "_k")
        rows = rows.withColumn("_range", find("_k", "_t")).join(F.broadcast(bases), "_range")
        rows = rows.withColumns({
            "_cum": F.col("_b") + F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"),
            "_rank": F.col("_r") + F.row_number().over(order) - 1})
        rows = rows.withColumns({"_start": F.min("_cum").over(group), "_group": F.sum("_size").over(group)})
        small = F.col("_group") <= F.lit(int(whole / settings.shards * settings.whole_group))
        at = F.when(small, F.col("_start") + F.floor(F.col("_group") / 2)).otherwise(
            F.col("_cum") + F.floor(F.col("_size") / 2))
        shard = F.floor(at.cast("decimal(38,0)") * settings.shards / F.lit(whole).cast("decimal(38,0)"))
        return rows.withColumn("_shard", F.least(shard.cast("int"), F.lit(settings.shards - 1)))

    first = {r["_shard"]: r["f"] for r in placed(slim).groupBy("_shard").agg(F.min("_rank").alias("f")).collect()}
    starts = F.array(*[F.lit(int(first.get(s, 0))).cast("long") for s in range(settings.shards)])
    out = placed(keyed)
    return out.select(
        *[F.col(c).alias(name) for name, c in named.items()], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_rank") - F.get(starts, F.col("_shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
