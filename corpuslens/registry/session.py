"""A local session for tests, the bench and the check tool."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, name: str = "corpuslens") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", 8)
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="corpuslens-wh-"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
