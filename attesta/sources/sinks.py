"""Writers of claims, evaluations and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partitions: list[str] | None = None) -> None:
    """Write one table partitioned by run; refuses to write over an existing one."""
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partitions) if partitions else writer).save(path)


def write_artifacts(papers: DataFrame, path: str) -> None:
    """One JSON object per paper, in one folder per run."""
    papers.write.mode("errorifexists").partitionBy("run_id").json(path)


def evaluation_rows(claims: DataFrame, verdicts: DataFrame, shape: str = "intrinsic") -> DataFrame:
    """Rows for human evaluation with the judge's columns appended.

    ``gold`` rows carry empty columns for the reference answer, ``intrinsic`` rows the claim's own fields.
    """
    judge = verdicts.select("paper_id", "claim_id", F.col("verdict").alias("llm_judge_verdict"), F.col("importance").alias("llm_judge_importance"))
    joined = claims.join(judge, ["paper_id", "claim_id"], "left")
    blank = F.lit("")
    own = ["statement", "conditions", "importance"]
    extra = [blank.alias("gold_statement"), blank.alias("gold_match")] if shape == "gold" else [F.col("status")]
    return joined.select("paper_id", "claim_id", *own, *extra, *[F.coalesce(c, blank).alias(c) for c in ("llm_judge_verdict", "llm_judge_importance")])


def conflicting_targets(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Targets that hold another paper's results: ``planned`` and ``existing`` have target, paper_id."""
    held = existing.select("target", F.col("paper_id").alias("held_by")).distinct()
    return planned.join(held, "target").where(F.col("paper_id") != F.col("held_by"))


def guard_targets(spark: SparkSession, planned: DataFrame, existing: DataFrame) -> None:
    """Fail before writing when a target belongs to another paper."""
    clash = conflicting_targets(planned, existing).take(1)
    if clash:
        raise ValueError(f"{clash[0]['target']} holds results of {clash[0]['held_by']}")
