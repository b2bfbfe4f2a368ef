"""Session and table access shared by queries, bench and tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "scriptorium", **conf: str) -> SparkSession:
    """A single-node session; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "8g"),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
