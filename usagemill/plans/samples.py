"""Deterministic usage views over the generic test tables, for queries that are checked against SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import prices

#: The clock of every checked query.
NOW = datetime(2024, 1, 30, 22, 0, 0)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a canonical usage frame with duplicates, missing fields and large requests."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    i, u, k = F.col("event_id"), F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    kind = F.col("event_type")
    model = F.when(kind == "view", "claude-sonnet-4-20250514").when(kind == "click", "claude-opus-4-20250514").when(kind == "signup", "claude-haiku-4.5").when(kind == "purchase", "gpt-5").when(i % 2 == 0, "<synthetic>")
    path = text("f", u % 20)
    times = e.groupBy(path.alias("_f")).agg(F.min("ts").alias("file_ts"))
    rows = e.select(
        i.alias("line_ord"), F.col("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts_raw"), text("p", u % 10).alias("project"), text("p", u % 10).alias("project_path"), text("s", u % 50).alias("session_id"),
        F.when(i % 17 != 0, text("m", F.floor(i / 2))).alias("message_id"), text("r", u % 3).alias("request_id"), model.alias("model"), F.when(i % 7 == 0, "fast").when(i % 7 == 1, "standard").alias("speed"),
        (k * 100 + F.when(i % 50 == 0, 250_000).otherwise(0)).alias("input_tokens"), (k * 13).alias("output_tokens"), (i % 11 * 40).alias("cache_creation_tokens"), (i % 23 * 900).alias("cache_read_tokens"),
        F.when(i % 3 != 0, F.col("value") / 100).alias("cost_usd"), F.when(i % 5 != 0, text("1.0.", u % 4)).alias("version"), F.when(i % 400 == 0, F.col("ts") + F.expr("interval 3 hours")).alias("reset_ts"),
        path.alias("file_path"), u.alias("user_id"), F.col("value"),
    )
    return rows.join(times, F.col("file_path") == F.col("_f")).drop("_f")


def price_frame(spark: SparkSession) -> DataFrame:
    return prices.load(spark)
