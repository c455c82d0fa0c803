"""The package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def is_there(spark: SparkSession) -> bool:
    """Whether Python workers find the package without help: on their path, or where the driver runs."""
    named = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    return any(p and Path(p).resolve() == ROOT for p in named) or (spark.sparkContext.master.startswith("local[") and Path.cwd() == ROOT)


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, once for a context; does nothing if it ``is_there``.

    The file is read by the driver, which serves it; a lost executor's successor
    gets it too.
    """
    sc = spark.sparkContext
    if is_there(spark) or getattr(sc, "_gleaner_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="gleaner-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = f"{folder}/gleaner.zip"
    with zipfile.PyZipFile(at, "w") as z:
        z.writepy(str(ROOT / "gleaner"))
        for sub in sorted(p.parent for p in (ROOT / "gleaner").glob("*/__init__.py")):
            z.writepy(str(sub), "gleaner")
    sc.addPyFile(at)
    sc._gleaner_shipped = True
