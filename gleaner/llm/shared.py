"""Helpers that several corpus operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts documents without an id after all others.
LAST_ID = 9223372036854775807


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only where neither
    that setting nor the context has one (tests in one process) is a temporary
    folder made, which goes away with the process.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gleaner-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_missing(error: Exception) -> bool:
    """Whether a table couldn't be read because nothing has been written there."""
    return "PATH_NOT_FOUND" in str(error)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sort_id(column: str = "doc_id"):
    """The id as a long that is never null; null ids come last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def uniform(column) -> F.Column:
    """A number in [0, 1) that depends on the value only.

    From the first 8 hex digits of the MD5 of the decimal form, so that any SQL
    engine can compute the same number.
    """
    digits = F.substring(F.md5(column.cast("string").cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
