"""Sends this package to the Python workers, which need not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per Spark context, before Python workers run."""
    sc = spark.sparkContext
    if getattr(sc, "_keyloom_sent", False):
        return
    top, folder = Path(__file__).resolve().parents[1], tempfile.mkdtemp()  # the driver serves the archive as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(archive := Path(folder, "keyloom_package.zip"), "w") as z:
        for p in sorted((top / "keyloom").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(archive))
    sc._keyloom_sent = True
