"""Session helpers: where to cut lineage, and how to size partitions."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. A session on one machine without one, as in tests, gets a temporary folder; on a cluster that would be machine-local, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named and context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))


_tidied = 0.0


def tidy(spark: SparkSession, every: float = 10.0) -> None:
    """Let Spark delete what nothing refers to any more. Shuffle files, broadcasts and, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, checkpoints of former steps go only when the
    driver's garbage is collected, which a driver with memory to spare doesn't do: loops over joins fill the disk, and the heap grows. Not more often than ``every`` seconds."""
    global _tidied
    if time.monotonic() - _tidied >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that later plans start from files that outlive executors."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a :func:`cut` that no later plan reads: those of the round before in a loop."""
    spark = df.sparkSession
    at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
