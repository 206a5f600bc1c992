"""First-seen dedupe and first-seen lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keeps the first row of each key; rows with a null in the key are never duplicates.

    Rows without a whole key are dealt out by a hash of the row, so that they can't pile up in one partition, and the
    source is scanned once.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    spread = F.when(~whole, F.xxhash64(*df.columns))
    place = F.row_number().over(Window.partitionBy(*keys, spread).orderBy(*order))
    return df.withColumns({"_place": place, "_whole": whole}).where("_place = 1 or not _whole").drop("_place", "_whole")


def usage_order() -> list[Column]:
    """Older files first (files without a time last), then path and line."""
    return [F.col("file_ts").asc_nulls_last(), F.col("file_path"), F.col("line_ord")]


def first_request(usage: DataFrame) -> DataFrame:
    """One row for each (message_id, request_id)."""
    return first_by_key(usage, ["message_id", "request_id"], usage_order())


def seen_list(value: Column, order: Column) -> Column:
    """Aggregate: different values in the order in which they were first seen."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))
