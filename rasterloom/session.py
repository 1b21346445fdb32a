"""Spark session settings, and the package's own code for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_rasterloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="rasterloom-"), "rasterloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(out)
    sc._rasterloom_shipped = True
    return spark


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("rasterloom")
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }.items():
        b = b.config(k, conf.pop(k, v))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
