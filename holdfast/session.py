"""Session-level helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Rows of a task in sorts by ranges and in iterative fits, whatever the session's number of shuffle partitions.
ROWS_PER_TASK = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    Read from the session.  Only a local-mode session may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="holdfast-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's own part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/holdfast-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application wrote for itself; results that read them must have been saved."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(rows: int) -> int:
    """So many tasks that none gets more than about `ROWS_PER_TASK` rows: their number grows with the table, a task does not."""
    return max(1, -(-rows // ROWS_PER_TASK))


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
