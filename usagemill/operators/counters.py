"""Cumulative counters to per-event usage: deltas, model carry-over and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
#: Fixed value: the model of a session that names none.
FALLBACK = "gpt-5"


def deltas(rows: DataFrame, session: str = "session_id", order: str = "line_ord") -> DataFrame:
    """From ordered log rows to usage events.

    rows: session, order, ts, kind ('model' or 'usage'), model (nullable), last and total (nullable structs of FIELDS).
    A usage row's own ``last`` counts; else its ``total`` less the last total before it, never below 0. Rows that add
    nothing are dropped, and their model with them. A model holds until the next; rows before any have FALLBACK, flagged.
    One session is one partition: its events are a sequence.
    """
    before = Window.partitionBy(session).orderBy(order)
    prior = F.last("total", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    less = F.struct(*[F.greatest(F.col(f"total.{f}") - F.coalesce(F.col(f"prior.{f}"), F.lit(0)), F.lit(0)).alias(f) for f in FIELDS])
    raw = rows.withColumn("prior", prior).withColumn("raw", F.coalesce("last", F.when(F.col("total").isNotNull(), less)))
    total = F.when(F.col("raw.total_tokens") > 0, F.col("raw.total_tokens")).otherwise(F.col("raw.input_tokens") + F.col("raw.output_tokens"))
    cached = F.least("raw.cached_input_tokens", "raw.input_tokens")
    raw = raw.withColumns({"input_tokens": F.col("raw.input_tokens"), "cached_input_tokens": cached, "output_tokens": F.col("raw.output_tokens"), "reasoning_output_tokens": F.col("raw.reasoning_output_tokens"), "total_tokens": total})
    adds = (F.col("input_tokens") != 0) | (F.col("cached_input_tokens") != 0) | (F.col("output_tokens") != 0) | (F.col("reasoning_output_tokens") != 0)
    live = raw.where((F.col("kind") == "model") | (F.col("kind") == "usage") & F.coalesce(adds, F.lit(False)))
    carried = F.last("model", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    named = live.withColumn("carried", carried).where("kind = 'usage'")
    return named.withColumns({"model": F.coalesce("carried", F.lit(FALLBACK)), "is_fallback": F.col("carried").isNull()}).drop("carried", "prior", "raw", "last", "total", "kind")


def display_split(input_tokens, cached, output, reasoning):
    """(input without cache, cache read, output, reasoning capped at output) as columns."""
    read = F.least(F.greatest(cached, F.lit(0)), input_tokens)
    return F.greatest(input_tokens - read, F.lit(0)), read, output, F.greatest(F.lit(0), F.least(reasoning, output))
