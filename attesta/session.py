"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "attesta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    AQE coalesces and splits skewed shuffle partitions at run time, so the
    shuffle width is an upper bound and not a tuning constant.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared folder; make a scratch folder only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The plan starts afresh at the table, a lost executor only re-reads it, and
    its true size lets later joins be planned well.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote, once nothing that is still to run reads it.

    Shuffle files go when the driver's garbage is collected, which a large heap
    may put off until long after the query; so it is collected here.
    """
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    jvm.java.lang.System.gc()
