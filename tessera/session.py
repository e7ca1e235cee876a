"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return spark
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    sc.addPyFile(path)
    sc._tessera_shipped = True
    return spark


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches that Python workers get; texts may be very long. Spark reads these settings when a result is
    computed, after the operator has returned, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, spark-submit's own session is used."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
