"""Session construction with the settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "usagemill", master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A UTC session with adaptive execution; cluster deployments pass their own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
