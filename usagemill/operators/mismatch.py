"""Stated against computed cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_off
from .pricing import PREFIXES, priced, token_cost

CLOSE = 0.1


def compared(usage: DataFrame, prices: DataFrame, prefixes: tuple = PREFIXES) -> DataFrame:
    """Rows with a stated cost and a real model: computed_cost, difference, percent_off, is_match."""
    both = usage.where("cost_usd is not null and model is not null and model <> '<synthetic>'")
    out = priced(both, prices, prefixes).withColumn("computed_cost", token_cost())
    out = out.withColumn("percent_off", percent_off(F.col("cost_usd"), F.col("computed_cost")))
    return out.select(*usage.columns, "computed_cost", F.abs(F.col("cost_usd") - F.col("computed_cost")).alias("difference"), "percent_off", (F.col("percent_off") < CLOSE).alias("is_match"))


def stats(checked: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, matches, mismatches and mean percentage, overall or by a column; rows without that column don't count."""
    rows = checked.where(F.col(by).isNotNull()) if by else checked
    aggs = [F.count("*").alias("total"), F.count_if("is_match").alias("matches"), F.count_if(~F.col("is_match")).alias("mismatches"), F.coalesce(F.avg("percent_off"), F.lit(0.0)).alias("avg_percent")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def samples(checked: DataFrame, n: int = 5) -> DataFrame:
    """The first n mismatches by time, then file and line."""
    return checked.where(~F.col("is_match")).orderBy("ts", "file_path", "line_ord").limit(n)
