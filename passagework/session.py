"""Session defaults for running on one machine; on a cluster pass your own session instead."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "passagework") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.maxMetadataStringLength", "1000")  # plans say whole paths
            .getOrCreate())
