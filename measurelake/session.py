"""Session defaults of the engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with the defaults; keyword names use double underscores for dots."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # local workers take the driver's environment
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    given = {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("measurelake")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"} | given
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
