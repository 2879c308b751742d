"""Session-level helpers: scratch space, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BROADCAST_ROWS_CONF = "spark.sigtrail.maxBroadcastRows"
DEFAULT_BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only in a local session, whose
    executors share the driver's disk, a private temporary folder stands in.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    fallback = spark.conf.get("spark.sigtrail.localScratch", None)
    if not fallback:
        fallback = tempfile.mkdtemp(prefix="sigtrail-")
        spark.conf.set("spark.sigtrail.localScratch", fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_stage_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _stage_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sigtrail/{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete what this application has materialised.

    Stages outlive the call that wrote them, as the frame it returned still reads
    them; call this when the results are taken.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once on shared storage, so that several branches read
    the same rows and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of one ``cut_lineage`` that no later result reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a frame has few enough rows to be broadcast.

    Where it has not, callers join without a hint, as an ordinary shuffled join, so a
    result does not depend on the bound.
    """
    limit = max_rows or int(df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))
    return df.limit(limit + 1).count() <= limit
