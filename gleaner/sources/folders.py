"""Where tables lie, those that a query writes for itself among them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that all executors reach.

    It is in the folder that the cluster names in ``spark.checkpoint.dir``. Only a
    session in one process may leave that unset; there it is in the warehouse folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table lies in a folder of files, not in one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
