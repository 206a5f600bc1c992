"""Price lookup and cost of token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens of a class beyond which the second tier holds; prefixes that are tried in order.
TIER = 200_000
PREFIXES = ("anthropic/", "claude-3-5-", "claude-3-", "claude-", "openrouter/openai/")
COUNTER_PREFIXES = ("openai/", "azure/", "openrouter/openai/")
LEDGER_PREFIXES = ("anthropic/",)
#: Names that are priced as another model.
COUNTER_ALIASES = {"gpt-5-codex": "gpt-5", "gpt-5.3-codex": "gpt-5.2-codex"}
STORE_ALIASES = {"gemini-3-pro-high": "gemini-3-pro-preview"}

CLASSES = ("input", "output", "cache_creation", "cache_read")
PRICE_COLUMNS = tuple(f"{c}_price" for c in CLASSES) + tuple(f"{c}_price_above" for c in CLASSES)
PRICE_SCHEMA = "ordinal int, name string, " + ", ".join(f"{c} double" for c in PRICE_COLUMNS) + ", max_input_tokens long, fast double"
#: Rows of the price table up to which it is broadcast.
MOST_PRICES = 20_000


def price_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Price rows in dataset order; missing prices are null."""
    names = [x.split()[0] for x in PRICE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"ordinal": k, **r}.get(n) for n in names) for k, r in enumerate(rows)], PRICE_SCHEMA)


def _bounded(prices: DataFrame) -> DataFrame:
    if prices.limit(MOST_PRICES + 1).count() > MOST_PRICES:
        raise ValueError(f"a price table has at most {MOST_PRICES} rows")
    return prices


def priced(rows: DataFrame, prices: DataFrame, prefixes: tuple = PREFIXES) -> DataFrame:
    """rows with the price columns of their ``model``; nulls where no price is found.

    The exact name is tried, then each prefix with the name; else the first price in dataset order whose name holds the
    model's or is held by it, in either case. Rows are neither shuffled nor scanned for their models first: what a name can match
    exactly is worked out from the price table, which is broadcast with one more row for the inexact search. That search
    runs for rows without an exact match only.
    """
    table = _bounded(prices).coalesce(1)  # a bounded table needs no shuffle
    price = F.struct(F.col("name").alias("price_name"), *PRICE_COLUMNS, "max_input_tokens", "fast")
    # A price is found by its own name (rank 0), or by what follows the k-th prefix (rank k).
    keys = [F.struct(F.lit(0).alias("rank"), F.col("name").alias("key"))]
    keys += [F.struct(F.lit(k).alias("rank"), F.when(F.col("name").startswith(p), F.substring(F.col("name"), F.lit(len(p) + 1), F.char_length("name"))).alias("key")) for k, p in enumerate(prefixes, 1)]
    each = table.select("ordinal", price.alias("price"), F.explode(F.array(*keys)).alias("x")).select("ordinal", "price", "x.rank", F.col("x.key").alias("_key")).where("_key <> ''")
    exact = each.groupBy("_key").agg(F.min_by("price", F.struct("rank", "ordinal")).alias("_exact"))
    loose = table.agg(F.array_sort(F.collect_list(F.struct("ordinal", F.lower("name").alias("low"), price.alias("price")))).alias("_loose"))
    low = F.lower("model")
    near = F.get(F.filter("_loose", lambda p: p["low"].contains(low) | low.contains(p["low"])), F.lit(0))["price"]
    both = rows.join(F.broadcast(exact), F.col("model") == F.col("_key"), "left").crossJoin(F.broadcast(loose))
    best = F.when(F.col("model") != "", F.coalesce("_exact", near))
    return both.withColumn("_price", best).select(*[rows[c] for c in rows.columns], "_price.*")


def match_prices(models: DataFrame, prices: DataFrame, prefixes: tuple = PREFIXES) -> DataFrame:
    """One row for each different non-empty ``model``, with its price columns."""
    return priced(models.select("model").where("model is not null and model <> ''").distinct(), prices, prefixes)


def tiered(tokens: Column, base: Column, above: Column) -> Column:
    """Cost of one token class: the part beyond TIER at the second price where there is one."""
    plain = tokens * F.coalesce(base, F.lit(0.0))
    split = (tokens - TIER) * above + F.lit(float(TIER)) * F.coalesce(base, F.lit(0.0))
    return F.when(tokens.isNull() | (tokens <= 0), 0.0).when((tokens > TIER) & above.isNotNull(), split).otherwise(plain)


def token_cost(speed: Column | None = None) -> Column:
    """Cost of a row that carries token counts and price columns; 0 without a price."""
    total = F.lit(0.0)
    for c in CLASSES:
        total = total + tiered(F.col(f"{c}_tokens"), F.col(f"{c}_price"), F.col(f"{c}_price_above"))
    if speed is None:
        return total
    return total * F.when(speed == "fast", F.coalesce("fast", F.lit(1.0))).otherwise(1.0)


def with_cost(usage: DataFrame, prices: DataFrame | None, mode: str = "auto", prefixes: tuple = PREFIXES, speed: bool = True, zero_is_missing: bool = False) -> DataFrame:
    """Adds ``cost``. display: the stated cost or 0; calculate: from tokens; auto: the stated cost where there is one.

    In display mode there is no price join in the plan.
    """
    stated = F.coalesce(F.col("cost_usd"), F.lit(0.0))
    if mode == "display":
        return usage.withColumn("cost", stated)
    if prices is None or mode not in ("auto", "calculate"):
        raise ValueError("a cost mode is display, or auto or calculate with prices")
    own = token_cost(F.col("speed") if speed else None)
    if mode == "auto":
        given = F.col("cost_usd") > 0 if zero_is_missing else F.col("cost_usd").isNotNull()
        own = F.when(given, F.col("cost_usd")).otherwise(own)
    return priced(usage, prices, prefixes).withColumn("cost", own).select(*usage.columns, "cost")


def context_limit(models: DataFrame, prices: DataFrame, default: int = 200_000) -> DataFrame:
    """(model, context_limit)."""
    return match_prices(models, prices).select("model", F.coalesce("max_input_tokens", F.lit(default)).alias("context_limit"))


def counter_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, input_rate, cached_rate, output_rate) for cumulative-counter logs.

    Free routes cost nothing. An alias's price holds where the model has none above 0. The cached rate falls back to
    the input rate. A model without any price costs nothing.
    """
    alias = F.coalesce(F.create_map(*[F.lit(x) for p in COUNTER_ALIASES.items() for x in p])[F.col("model")], F.lit(""))
    own = models.select("model").distinct().withColumn("alias", alias)
    every = own.select("model").union(own.select(F.col("alias").alias("model")))
    known = match_prices(every, prices, COUNTER_PREFIXES)
    real = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in ("input_price", "output_price", "cache_read_price")]) > 0
    rate = F.struct("input_price", "cache_read_price", "output_price")
    rates = known.select("model", F.when(F.col("price_name").isNotNull(), rate).alias("rate"), real.alias("real"))
    a, b = rates, rates.select(F.col("model").alias("alias"), F.col("rate").alias("rate2"), F.col("real").alias("real2"))
    both = own.join(a, "model", "left").join(b, "alias", "left")
    pick = F.when(~F.coalesce("real", F.lit(False)) & F.coalesce("real2", F.lit(False)), F.col("rate2")).otherwise(F.col("rate"))
    name = F.lower(F.trim("model"))
    free = (name == "openrouter/free") | name.startswith("openrouter/") & name.endswith(":free")
    both = both.withColumn("r", F.when(~free, pick))
    zero = F.lit(0.0)
    return both.select("model", F.coalesce("r.input_price", zero).alias("input_rate"), F.coalesce("r.cache_read_price", "r.input_price", zero).alias("cached_rate"), F.coalesce("r.output_price", zero).alias("output_rate"))


def counter_cost() -> Column:
    """Cost of a row with counter tokens and rates: cached tokens at their own rate, reasoning not added again."""
    fresh = F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0))
    cached = F.least("cached_input_tokens", "input_tokens")
    return fresh * F.col("input_rate") + cached * F.col("cached_rate") + F.col("output_tokens") * F.col("output_rate")
