"""Fixed-length billing blocks, gaps, burn rate and projection.

A block starts at the UTC hour of its first entry and lasts ``hours``; the first entry after its end opens the next.
Where one block ends depends only on the hour of its first entry, so entries are first reduced to slots of a grid that
divides both the hour and the block's length. The chain of blocks is folded over slots, whose number follows the time
span and not the number of entries. Blocks shorter than an hour use a slot for each different time;
entries at the same instant share a block.
"""

from __future__ import annotations

from datetime import datetime
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .dedupe import seen_list

HOUR = 3_600_000_000
HOURS = 5.0
TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def _micros(hours: float) -> int:
    return round(hours * HOUR)


def _slots(usage: DataFrame, keys: list[str], grid: int) -> DataFrame:
    """Entries by (keys, slot, exact, model): sums, first and last time, last reset. exact: just at the slot's begin."""
    at = F.unix_micros("ts")
    slot = at - F.pmod(at, F.lit(grid))
    cost = F.col("cost") if "cost" in usage.columns else F.coalesce("cost_usd", F.lit(0.0))
    reset = F.max_by("reset_ts", F.when(F.col("reset_ts").isNotNull(), at)) if "reset_ts" in usage.columns else F.lit(None).cast("timestamp")
    reset_at = F.max(F.when(F.col("reset_ts").isNotNull(), at)) if "reset_ts" in usage.columns else F.lit(None).cast("long")
    sums = [F.sum(c).alias(c) for c in TOKENS]
    return usage.groupBy(*keys, slot.alias("slot"), (at == slot).alias("exact"), "model").agg(
        *sums, F.sum(cost).alias("cost"), F.count("*").alias("entries"), F.min(at).alias("lo"), F.max(at).alias("hi"), reset.alias("reset_ts"), reset_at.alias("reset_at"))


def _firsts(length: int) -> Column:
    """Fold over ``times`` (sorted first times of slots) to the first time of each block."""
    start = F.struct(F.lit(None).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, lo):
        fresh = acc["end"].isNull() | (lo > acc["end"])
        end = F.when(fresh, lo - F.pmod(lo, F.lit(HOUR)) + length).otherwise(acc["end"])
        return F.struct(end.alias("end"), F.when(fresh, F.concat(acc["out"], F.array(lo))).otherwise(acc["out"]).alias("out"))

    return F.aggregate("times", start, step, lambda acc: acc["out"])


def _chain(each: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, slot, late, first): the block of every slot. A gap longer than a block always opens one, so islands between gaps are folded apart."""
    near = each.groupBy(*keys, "slot", (~F.col("exact")).alias("late")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    along = Window.partitionBy(*keys).orderBy("lo")
    far = F.coalesce(F.col("lo") - F.lag("hi").over(along) > length, F.lit(False))
    near = near.withColumn("far", far.cast("int")).withColumn("island", F.sum("far").over(along))
    folded = near.groupBy(*keys, "island").agg(F.array_sort(F.collect_list("lo")).alias("times"))
    opened = folded.select(*keys, F.explode(_firsts(length)).alias("first"))
    same = F.col("a.lo") == F.col("b.first")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    marked = near.alias("a").join(opened.alias("b"), same, "left").select("a.*", "b.first")
    return marked.select(*keys, "slot", "late", F.last("first", ignorenulls=True).over(along).alias("first"))


def blocks(usage: DataFrame, now: datetime, hours: float = HOURS, keys: tuple = (), gaps: bool = True) -> DataFrame:
    """Blocks of each key (or of all usage), with gap rows between blocks that lie more than ``hours`` apart.

    Columns: keys, block_id, start, end, actual_end, first_ts, is_gap, is_active, entries, token sums, cost, models
    (first seen first), reset_ts. Null times are left out; an empty frame gives no block.
    """
    length = _micros(hours)
    if length <= 0:
        raise ValueError("a block has a positive length")
    grid = gcd(HOUR, length) if length >= HOUR else 1
    keys = list(keys)
    each = _slots(usage.where("ts is not null"), keys, grid)
    chain = _chain(each, keys, length)
    same = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.exact") == ~F.col("b.late"))
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    placed = each.alias("a").join(chain.alias("b"), same).select("a.*", "b.first")
    found = placed.groupBy(*keys, "first").agg(
        *[F.sum(c).alias(c) for c in TOKENS], F.sum("cost").alias("cost"), F.sum("entries").alias("entries"), F.max("hi").alias("last"),
        seen_list(F.col("model"), F.col("lo")).alias("models"), F.max_by("reset_ts", "reset_at").alias("reset_ts"),
    )
    begin = F.col("first") - F.pmod("first", F.lit(HOUR))
    now_at = F.unix_micros(F.lit(now).cast("timestamp"))
    active = (now_at - F.col("last") < length) & (now_at < begin + length)
    out = found.select(
        *keys, F.date_format(F.timestamp_micros(begin), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("block_id"), F.timestamp_micros(begin).alias("start"), F.timestamp_micros(begin + length).alias("end"),
        F.timestamp_micros("last").alias("actual_end"), F.timestamp_micros("first").alias("first_ts"), F.lit(False).alias("is_gap"), active.alias("is_active"),
        "entries", *TOKENS, "cost", "models", "reset_ts",
    )
    if not gaps:
        return out
    # The window runs over blocks, which the time span bounds.
    following = F.lead("first").over(Window.partitionBy(*keys).orderBy("first"))
    idle = found.withColumn("next", following).where(F.col("next") - F.col("last") > length)
    at = F.timestamp_micros(F.col("last") + length)
    empty = idle.select(
        *keys, F.concat(F.lit("gap-"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("block_id"), at.alias("start"), F.timestamp_micros("next").alias("end"),
        F.lit(None).cast("timestamp").alias("actual_end"), F.lit(None).cast("timestamp").alias("first_ts"), F.lit(True).alias("is_gap"), F.lit(False).alias("is_active"),
        F.lit(0).cast("long").alias("entries"), *[F.lit(0).cast(out.schema[c].dataType).alias(c) for c in TOKENS], F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("models"), F.lit(None).cast("timestamp").alias("reset_ts"),
    )
    return out.unionByName(empty)


def total_tokens() -> Column:
    total = F.col(TOKENS[0])
    for c in TOKENS[1:]:
        total = total + F.col(c)
    return total


def with_burn_rate(found: DataFrame) -> DataFrame:
    """Adds tokens_per_minute, indicator (input and output only) and cost_per_hour; null for gaps and blocks without duration."""
    minutes = (F.unix_micros("actual_end") - F.unix_micros("first_ts")) / 60e6
    rate = lambda x: F.when(minutes > 0, x / minutes)
    return found.withColumns({"tokens_per_minute": rate(total_tokens()), "indicator": rate(F.col("input_tokens") + F.col("output_tokens")), "cost_per_hour": rate(F.col("cost") * 60)})


def with_projection(rated: DataFrame, now: datetime) -> DataFrame:
    """Adds projected_tokens, projected_cost and remaining_minutes of active blocks with a burn rate."""
    left = F.greatest(F.lit(0.0), (F.unix_micros("end") - F.unix_micros(F.lit(now).cast("timestamp"))) / 60e6)
    live = F.col("is_active") & F.col("tokens_per_minute").isNotNull()
    return rated.withColumns({
        "projected_tokens": F.when(live, half_up(total_tokens() + F.col("tokens_per_minute") * left)),
        "projected_cost": F.when(live, half_up(F.col("cost") + F.col("cost_per_hour") / 60 * left, 2)),
        "remaining_minutes": F.when(live, half_up(left)),
    })


def with_limit_status(projected: DataFrame, limit: int | None, warn: float = 0.8) -> DataFrame:
    """Adds token_limit, percent_used and limit_status of projected blocks."""
    bound = F.lit(limit if limit and limit > 0 else None).cast("long")
    use = F.col("projected_tokens")
    status = F.when(use > bound, "exceeds").when(use > bound * warn, "warning").when(use.isNotNull() & bound.isNotNull(), "ok")
    return projected.withColumns({"token_limit": bound, "percent_used": use / bound * 100, "limit_status": status})


def most_tokens(found: DataFrame) -> DataFrame:
    """(most): the largest total of a block that is neither a gap nor active; 0 without one."""
    return found.agg(F.coalesce(F.max(F.when(~F.col("is_gap") & ~F.col("is_active"), total_tokens())), F.lit(0)).alias("most"))


def token_limit(text: str | None, most: int) -> int | None:
    """A limit as given: nothing or max is the most so far (None if that is 0); what is no number is None."""
    if text in (None, "", "max"):
        return most or None
    try:
        return int(text)
    except ValueError:
        return None


def recent(found: DataFrame, now: datetime, days: int = 3) -> DataFrame:
    start = F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    return found.where((F.col("start") >= start) | F.col("is_active"))


def burn_status(indicator: Column) -> Column:
    return F.when(indicator < 2000, "normal").when(indicator < 5000, "moderate").when(indicator.isNotNull(), "high")
