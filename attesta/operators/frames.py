"""Building blocks that stay distributed when one group holds much of the table.

A plain window over a hot group runs in one task.  ``ordinal`` and
``running_total`` cut the group into position buckets, work inside the buckets
in parallel and only order the small per-bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 4096


def _bucketed(df: DataFrame, order: Sequence[str], bucket: int) -> tuple[DataFrame, list[str]]:
    """Order prefix plus a position bucket; the last order column is an integer position."""
    out = df.withColumn("_slot", F.floor(F.col(order[-1]) / bucket))
    return out, [*order[:-1], "_slot"]


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, bucket: int = BUCKET
) -> DataFrame:
    """Sum of ``value`` over earlier rows of the group (the row itself excluded)."""
    slotted, slots = _bucketed(df, order, bucket)
    totals = slotted.groupBy(*keys, *slots).agg(F.sum(value).alias("_slot_sum"))
    before = W.partitionBy(*keys).orderBy(*slots).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_slot_sum").over(before), F.lit(0))).drop("_slot_sum")
    inside = W.partitionBy(*keys, *slots).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = _null_safe_join(slotted, bases, [*keys, *slots])
    return joined.withColumn(
        out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    ).drop("_base", "_slot")


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, bucket: int = BUCKET) -> DataFrame:
    """1-based rank of each row in its group; ``order`` ends in an integer position."""
    return running_total(df.withColumn("_one", F.lit(1)), keys, order, "_one", out, bucket).withColumn(
        out, (F.col(out) + 1).cast("int")
    ).drop("_one")


def previous(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """Value of the previous row of the group by integer position (a distributed ``lag``)."""
    slotted = df.withColumn("_slot", F.floor(F.col(pos) / bucket))
    lasts = slotted.groupBy(*keys, "_slot").agg(F.max_by(value, pos).alias("_last"))
    over_slots = W.partitionBy(*keys).orderBy("_slot")
    carried = lasts.select(*keys, "_slot", F.lag("_last").over(over_slots).alias("_carried"))
    inside = W.partitionBy(*keys, "_slot").orderBy(pos)
    joined = slotted.join(carried, [*keys, "_slot"])
    return joined.withColumn(
        out, F.when(F.row_number().over(inside) > 1, F.lag(value).over(inside)).otherwise(F.col("_carried"))
    ).drop("_carried", "_slot")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group.

    Written as ``row_number() <= n`` so that Spark's window group limit keeps
    only ``n`` rows per group and task before the shuffle, hot groups included.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def stack_checks(df: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One output row per check that holds: (keys, code, severity) in a single pass."""
    hits = F.array(
        *[F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.coalesce(cond, F.lit(False)).alias("hit"))
          for code, severity, cond in checks]
    )
    return (
        df.withColumn("_hit", F.explode(F.filter(hits, lambda h: h["hit"])))
        .select(*keys, F.col("_hit.code").alias("code"), F.col("_hit.severity").alias("severity"))
    )
