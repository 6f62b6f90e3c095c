"""Session settings and table loading shared by every query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "ledgerline", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the star schema; Parquet, so pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
