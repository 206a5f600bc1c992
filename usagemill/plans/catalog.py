"""Registry of the engine's queries over the generic tables, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import blocks as blk
from ..operators import counters, dedupe, mismatch, pricing
from . import oracle as o
from . import output, reports, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def costed(spark: SparkSession, sf_dir: str, mode: str = "auto") -> DataFrame:
    rows = dedupe.first_request(samples.usage(spark, sf_dir))
    return reports.shown_models(pricing.with_cost(rows, samples.price_frame(spark) if mode != "display" else None, mode))


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns or ("cost",)})


# ---------------------------------------------------------------- reports by calendar keys


@query(o.report(o.DAY, "date"))
def daily(spark, sf_dir):
    return _money(reports.daily(costed(spark, sf_dir)))


@query(o.report(o.day_in("Asia/Tokyo"), "date"))
def daily_tz(spark, sf_dir):
    return _money(reports.daily(costed(spark, sf_dir), "Asia/Tokyo"))


@query(o.report(o.DAY, "date", more="project"))
def daily_by_project(spark, sf_dir):
    return _money(reports.daily(costed(spark, sf_dir), by_project=True))


@query(o.report(o.DAY, "date", "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND project = 'p3'", more="project"))
def daily_filtered(spark, sf_dir):
    return _money(reports.daily(costed(spark, sf_dir), since="20240105", until="2024-01-11", project="p3", order="asc"))


@query(o.report(o.MONTH, "month"))
def monthly(spark, sf_dir):
    return _money(reports.monthly(costed(spark, sf_dir)))


@query(o.report(o.week(0), "week"))
def weekly_sunday(spark, sf_dir):
    return _money(reports.weekly(costed(spark, sf_dir)))


@query(o.report(o.week(1), "week"))
def weekly_monday(spark, sf_dir):
    return _money(reports.weekly(costed(spark, sf_dir), first_day="monday"))


@query(o.report("strftime(ts, '%G-W%V')", "week"))
def iso_week(spark, sf_dir):
    return _money(reports.iso_weekly(costed(spark, sf_dir)))


@query("SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n FROM orders GROUP BY 1")
def iso_week_years(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(dates.iso_week_key(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n"))


@query(f"WITH {o.costed()} SELECT {o.DAY} AS date, coalesce(model, 'unknown') AS model, {o.SUMS} FROM costed WHERE coalesce(model, 'unknown') <> '<synthetic>' GROUP BY ALL")
def model_breakdown(spark, sf_dir):
    rows = costed(spark, sf_dir).withColumn("date", dates.day_key(F.col("ts")))
    return _money(reports.model_breakdown(rows, ["date"]))


@query(f"""WITH {o.costed()}, m AS (SELECT {o.DAY} AS date, coalesce(model, 'unknown') AS model, sum(cost) AS c, min(ts) AS seen FROM costed WHERE coalesce(model, 'unknown') <> '<synthetic>' GROUP BY ALL),
 f AS (SELECT {o.DAY} AS date, model, min(ts) AS seen FROM costed WHERE model IS NOT NULL AND model <> '<synthetic>' GROUP BY ALL)
 SELECT date, (SELECT string_agg(model, ',' ORDER BY c DESC, seen) FROM m WHERE m.date = d.date) AS by_cost, (SELECT string_agg(model, ',' ORDER BY seen, model) FROM f WHERE f.date = d.date) AS by_time FROM (SELECT DISTINCT {o.DAY} AS date FROM costed) d""")
def breakdown_order(spark, sf_dir):
    rows = reports.daily(costed(spark, sf_dir), breakdowns=True)
    return rows.select("date", F.array_join(F.transform("model_breakdowns", lambda x: x["model"]), ",").alias("by_cost"), F.array_join("models_used", ",").alias("by_time"))


@query(f"WITH {o.costed()} SELECT {o.SUMS}, {o.TOTAL} FROM costed")
def totals(spark, sf_dir):
    return _money(reports.totals(reports.daily(costed(spark, sf_dir))))


_SESSION = f"""SELECT project_path, session_id, {o.SUMS}, {o.TOTAL}, strftime(arg_max(ts, ts_raw), '%Y-%m-%d') AS last_activity, coalesce(string_agg(DISTINCT version, ',' ORDER BY version), '') AS versions FROM costed GROUP BY ALL"""


@query(f"WITH {o.costed()} {_SESSION}")
def session(spark, sf_dir):
    return _money(reports.sessions(costed(spark, sf_dir))).withColumn("versions", F.array_join("versions", ","))


@query(f"WITH {o.costed()}, s AS ({_SESSION}) SELECT * FROM s WHERE last_activity = '2024-01-29'")
def session_filtered(spark, sf_dir):
    return _money(reports.sessions(costed(spark, sf_dir), since="20240129", until="20240129")).withColumn("versions", F.array_join("versions", ","))


@query(f"WITH {o.costed()} SELECT {o.SUMS} FROM costed WHERE {o.DAY} = '2024-01-30'")
def today_cost(spark, sf_dir):
    return _money(reports.daily(costed(spark, sf_dir), since="20240130", until="20240130")).drop("date", "total_tokens")


@query(f"WITH {o.costed()}, d AS (SELECT coalesce(project, 'unknown') AS project, {o.DAY} AS date, {o.SUMS}, {o.TOTAL} FROM costed GROUP BY ALL) SELECT project, string_agg(concat_ws(' ', date, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens), ';' ORDER BY date) AS rows, round(sum(cost), 6) AS cost FROM d GROUP BY project")
def project_daily_map(spark, sf_dir):
    rows = costed(spark, sf_dir).withColumn("project", F.coalesce("project", F.lit("unknown")))
    days = reports.daily(rows, by_project=True)
    told = F.concat_ws(" ", "date", *[F.col(c).cast("string") for c in (*reports.TOKENS, "total_tokens")])
    return days.groupBy("project").agg(F.array_join(F.sort_array(F.collect_list(told)), ";").alias("rows"), F.round(F.sum("cost"), 6).alias("cost"))


# ---------------------------------------------------------------- dedupe, prices and cost


@query(f"WITH {o.DEDUP} SELECT line_ord, message_id, request_id, file_path FROM dedup")
def dedupe_first(spark, sf_dir):
    return dedupe.first_request(samples.usage(spark, sf_dir)).select("line_ord", "message_id", "request_id", "file_path")


@query(f"WITH {o.USAGE} SELECT message_id, count(*) AS n, min(line_ord) AS line_ord FROM usage WHERE message_id IS NOT NULL GROUP BY message_id")
def dedupe_by_id(spark, sf_dir):
    rows = samples.usage(spark, sf_dir).where("message_id is not null")
    kept = dedupe.first_by_key(rows, ["message_id"], [F.col("line_ord")]).select("message_id", "line_ord")
    return rows.groupBy("message_id").agg(F.count("*").alias("n")).join(kept, "message_id")


def _modes(mode: str):
    @query(o.report("coalesce(model, 'none')", "model", mode=mode))
    def run(spark, sf_dir):
        rows = costed(spark, sf_dir, mode).withColumn("model", F.coalesce("model", F.lit("none")))
        return _money(reports.by_key(rows, ["model"]))

    QUERIES[f"cost_{mode}"], ORACLES[f"cost_{mode}"] = QUERIES.pop("run"), ORACLES.pop("run")


for _mode in ("auto", "calculate", "display"):
    _modes(_mode)

_NAMES = ["claude-sonnet-4-20250514", "haiku-4.5", "claude-haiku-4.5", "GPT-5", "gpt-5-codex-mini", "Claude-Opus-4-20250514", "nothing", "", "gemini-3-pro-preview", "sonnet"]
_NAME_SQL = " UNION ALL ".join(f"SELECT '{n}' AS model" for n in _NAMES)


@query(f"WITH {o.match(_NAME_SQL)} SELECT model, price_name FROM matched")
def price_fuzzy(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in _NAMES], "model string")
    return pricing.match_prices(names, samples.price_frame(spark)).select("model", "price_name")


@query(f"WITH {o.USAGE}, {o.match('SELECT model FROM usage')} SELECT model, price_name, input_price, output_price_above, fast FROM matched")
def price_exact(spark, sf_dir):
    return pricing.match_prices(samples.usage(spark, sf_dir), samples.price_frame(spark)).select("model", "price_name", "input_price", "output_price_above", "fast")


@query(f"WITH {o.match(_NAME_SQL)} SELECT model, coalesce(max_input_tokens, 200000)::BIGINT AS context_limit FROM matched")
def context_limits(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in _NAMES], "model string")
    return pricing.context_limit(names, samples.price_frame(spark))


@query("SELECT p_partkey, round(" + o._tier("t", "p").replace("p_above", "q") + """, 8) AS cost FROM (SELECT p_partkey, (p_partkey * 701) % 400001 - 100 AS t, CASE WHEN p_size % 3 <> 0 THEN p_size / 1000.0 END AS p, CASE WHEN p_size % 2 = 0 THEN p_size / 500.0 END AS q FROM part)""")
def tiered_cost(spark, sf_dir):
    n = F.col("p_partkey") * 701 % 400_001 - 100
    base, above = F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 1000.0), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 500.0)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(pricing.tiered(n, base, above), 8).alias("cost"))


@query(f"WITH {o.costed('calculate')} SELECT coalesce(speed, 'none') AS speed, count(*) AS n, round(sum(cost), 8) AS cost FROM costed GROUP BY 1")
def fast_multiplier(spark, sf_dir):
    return _money(costed(spark, sf_dir, "calculate").groupBy(F.coalesce("speed", F.lit("none")).alias("speed")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost")))


@query(f"""WITH {o.DEDUP}, {o.match('SELECT model FROM dedup')} SELECT project, round(sum(CASE WHEN cost_usd > 0.2 THEN cost_usd WHEN cost_usd - 0.2 > 0 THEN 0 ELSE {o.TOKEN_COST} END), 8) AS cost
 FROM (SELECT * REPLACE (CASE WHEN cost_usd > 0.2 THEN cost_usd ELSE 0 END AS cost_usd) FROM dedup) d LEFT JOIN matched m ON d.model = m.model GROUP BY project""")
def cost_zero_is_missing(spark, sf_dir):
    rows = dedupe.first_request(samples.usage(spark, sf_dir)).withColumn("cost_usd", F.when(F.col("cost_usd") > 0.2, F.col("cost_usd")).otherwise(0.0))
    out = pricing.with_cost(rows, samples.price_frame(spark), speed=False, zero_is_missing=True)
    return _money(out.groupBy("project").agg(F.sum("cost").alias("cost")))


# ---------------------------------------------------------------- mismatch report

_PAIRS = f"""WITH {o.USAGE}, {o.match('SELECT model FROM usage')}, pairs AS (SELECT u.*, {o.TOKEN_COST} AS own, CASE WHEN cost_usd > 0 THEN abs(cost_usd - {o.TOKEN_COST}) / cost_usd * 100 ELSE 0 END AS pct
 FROM (SELECT * REPLACE (CASE WHEN line_ord % 4 = 1 THEN 0.0 ELSE cost_usd END AS cost_usd) FROM usage) u LEFT JOIN matched m ON u.model = m.model WHERE cost_usd IS NOT NULL AND u.model IS NOT NULL AND u.model <> '<synthetic>')"""
_STATS = "count(*) AS total, count_if(pct < 0.1) AS matches, count_if(NOT pct < 0.1) AS mismatches, round(avg(pct), 4) AS avg_percent"


def _checked(spark, sf_dir):
    rows = samples.usage(spark, sf_dir).withColumn("cost_usd", F.when(F.col("line_ord") % 4 == 1, 0.0).otherwise(F.col("cost_usd")))
    return mismatch.compared(rows, samples.price_frame(spark))


def _rounded(df):
    return df.withColumn("avg_percent", F.round("avg_percent", 4))


@query(f"{_PAIRS} SELECT model, {_STATS.replace('count_if(pct < 0.1)', 'count_if(pct < 0.1)::BIGINT').replace('count_if(NOT pct < 0.1)', 'count_if(NOT pct < 0.1)::BIGINT')} FROM pairs GROUP BY model")
def mismatch_by_model(spark, sf_dir):
    return _rounded(mismatch.stats(_checked(spark, sf_dir), "model"))


@query(f"{_PAIRS} SELECT version, {_STATS.replace('count_if(pct < 0.1)', 'count_if(pct < 0.1)::BIGINT').replace('count_if(NOT pct < 0.1)', 'count_if(NOT pct < 0.1)::BIGINT')} FROM pairs WHERE version IS NOT NULL GROUP BY version")
def mismatch_by_version(spark, sf_dir):
    return _rounded(mismatch.stats(_checked(spark, sf_dir), "version"))


@query(f"{_PAIRS} SELECT {_STATS.replace('count_if(pct < 0.1)', 'count_if(pct < 0.1)::BIGINT').replace('count_if(NOT pct < 0.1)', 'count_if(NOT pct < 0.1)::BIGINT')} FROM pairs")
def mismatch_overall(spark, sf_dir):
    return _rounded(mismatch.stats(_checked(spark, sf_dir)))


@query(f"{_PAIRS} SELECT file_path, ts_raw, model, round(own, 8) AS computed_cost, round(abs(cost_usd - own), 8) AS difference FROM pairs WHERE NOT pct < 0.1 ORDER BY ts, file_path, line_ord LIMIT 5")
def mismatch_samples(spark, sf_dir):
    return _money(mismatch.samples(_checked(spark, sf_dir)).select("file_path", "ts_raw", "model", "computed_cost", "difference"), "computed_cost", "difference")


# ---------------------------------------------------------------- blocks

_BLOCK = "start, stop AS \"end\", last AS actual_end, entries, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, round(cost, 8) AS cost, is_active, reset_ts"


def _blocks(spark, sf_dir, keys=(), hours=5.0, gaps=False):
    return blk.blocks(costed(spark, sf_dir), samples.NOW, hours, keys, gaps)


_SHOWN = ["start", "end", "actual_end", "entries", *blk.TOKENS, "cost", "is_active", "reset_ts"]


@query(f"{o.blocks()} SELECT {_BLOCK} FROM found")
def blocks(spark, sf_dir):
    return _money(_blocks(spark, sf_dir).select(*_SHOWN))


@query(f"{o.blocks(hours=2.5)} SELECT {_BLOCK} FROM found")
def blocks_fractional(spark, sf_dir):
    return _money(_blocks(spark, sf_dir, hours=2.5).select(*_SHOWN))


@query(f"{o.blocks('user_id')} SELECT user_id, {_BLOCK} FROM found")
def blocks_by_user(spark, sf_dir):
    return _money(_blocks(spark, sf_dir, ("user_id",)).select("user_id", *_SHOWN))


@query(f"{o.blocks('user_id', 0.25)} SELECT user_id, {_BLOCK} FROM found")
def blocks_short(spark, sf_dir):
    return _money(_blocks(spark, sf_dir, ("user_id",), 0.25).select("user_id", *_SHOWN))


@query(f"{o.blocks('user_id')} SELECT user_id, start, stop AS \"end\", 'gap-' || strftime(start, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS block_id FROM gaps")
def gap_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, ("user_id",), gaps=True).where("is_gap").select("user_id", "start", "end", "block_id")


@query(f"{o.blocks()}, m AS (SELECT first, model, min(ts) AS seen FROM placed WHERE model IS NOT NULL GROUP BY ALL) SELECT date_trunc('hour', first) AS start, string_agg(model, ',' ORDER BY seen) AS models FROM m GROUP BY first")
def block_models(spark, sf_dir):
    return _blocks(spark, sf_dir).select("start", F.array_join("models", ",").alias("models"))


@query(f"{o.blocks('user_id')} SELECT user_id, start, round({o.RATE.format('total_tokens')}, 4) AS tokens_per_minute, round({o.RATE.format('(input_tokens + output_tokens)')}, 4) AS indicator, round({o.RATE.format('cost * 60')}, 4) AS cost_per_hour FROM found")
def burn_rate(spark, sf_dir):
    rated = blk.with_burn_rate(_blocks(spark, sf_dir, ("user_id",)))
    return rated.select("user_id", "start", *[F.round(c, 4).alias(c) for c in ("tokens_per_minute", "indicator", "cost_per_hour")])


_LEFT = "greatest(0, (epoch_us(stop) - epoch_us(TIMESTAMP '2024-01-30 22:00:00')) / 60000000.0)"
_PROJECTED = f"floor(total_tokens + {o.RATE.format('total_tokens')} * {_LEFT} + 0.5)"


@query(f"{o.blocks('user_id')} SELECT user_id, start, {_PROJECTED}::BIGINT AS projected_tokens, floor((cost + {o.RATE.format('cost')} * {_LEFT}) * 100 + 0.5) / 100 AS projected_cost, floor({_LEFT} + 0.5)::BIGINT AS remaining_minutes FROM found WHERE is_active AND last > first")
def projection(spark, sf_dir):
    rows = blk.with_projection(blk.with_burn_rate(_blocks(spark, sf_dir, ("user_id",))), samples.NOW)
    return rows.where("projected_tokens is not null").select("user_id", "start", "projected_tokens", "projected_cost", "remaining_minutes")


@query(f"{o.blocks('user_id')}, p AS (SELECT user_id, start, {_PROJECTED} AS t FROM found WHERE is_active AND last > first) SELECT user_id, start, CASE WHEN t > 100000 THEN 'exceeds' WHEN t > 80000 THEN 'warning' ELSE 'ok' END AS limit_status, round(t / 100000 * 100, 4) AS percent_used FROM p")
def limit_status(spark, sf_dir):
    rows = blk.with_projection(blk.with_burn_rate(_blocks(spark, sf_dir, ("user_id",))), samples.NOW)
    return blk.with_limit_status(rows, 100_000).where("limit_status is not null").select("user_id", "start", "limit_status", F.round("percent_used", 4).alias("percent_used"))


@query(f"{o.blocks()} SELECT max(total_tokens) FILTER (NOT is_active) AS most FROM found")
def max_block_tokens(spark, sf_dir):
    return blk.most_tokens(_blocks(spark, sf_dir, gaps=True))


@query(f"{o.blocks('user_id')} SELECT user_id, start, entries FROM found WHERE start >= TIMESTAMP '2024-01-27 22:00:00' OR is_active")
def recent_blocks(spark, sf_dir):
    return blk.recent(_blocks(spark, sf_dir, ("user_id",)), samples.NOW).select("user_id", "start", "entries")


@query(f"{o.blocks('user_id')} SELECT user_id, start, entries FROM found WHERE is_active")
def active_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, ("user_id",)).where("is_active").select("user_id", "start", "entries")


@query(f"""{o.blocks('user_id')}, b AS (SELECT user_id, start, false AS is_gap FROM found UNION ALL SELECT user_id, start, true FROM gaps) SELECT is_gap, count(*) AS n FROM b
 WHERE strftime((start AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y%m%d') BETWEEN '20240110' AND '20240112' GROUP BY is_gap""")
def blocks_in_range(spark, sf_dir):
    rows = _blocks(spark, sf_dir, ("user_id",), gaps=True)
    return rows.where(dates.in_range(dates.day_key(F.col("start"), "Asia/Tokyo"), "20240110", "20240112")).groupBy("is_gap").agg(F.count("*").alias("n"))


@query(f"{o.blocks('user_id')}, r AS (SELECT {o.RATE.format('(input_tokens + output_tokens)')} AS i FROM found) SELECT CASE WHEN i < 2000 THEN 'normal' WHEN i < 5000 THEN 'moderate' WHEN i IS NOT NULL THEN 'high' ELSE 'none' END AS status, count(*) AS n FROM r GROUP BY 1")
def burn_status(spark, sf_dir):
    rated = blk.with_burn_rate(_blocks(spark, sf_dir, ("user_id",)))
    return rated.groupBy(F.coalesce(blk.burn_status(F.col("indicator")), F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- cumulative counters


def _counter_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    zero = lambda x: F.when(i % 13 == 0, F.lit(0).cast("long")).otherwise(x)
    rows = e.select(i.alias("line_ord"), "ts", F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"), zero(k * 10).alias("a"), zero(k * 3).alias("b"), zero(k).alias("c"), zero(F.floor(k / 2)).alias("d"), F.when(i % 6 == 0, "gpt-5-codex").when(i % 29 == 0, "openrouter/x:free").alias("model"))
    along = Window.partitionBy("session_id").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"t{c}": F.sum(c).over(along) for c in "abcd"})
    i = F.col("line_ord")
    usage = i % 10 != 9
    reset = F.when(i % 97 == 0, F.floor(F.col("ta") / 2)).otherwise(F.col("ta"))
    names = counters.FIELDS
    total = F.struct(*[x.alias(n) for x, n in zip((reset, F.col("tb"), F.col("tc"), F.col("td"), reset + F.col("tc")), names)])
    last = F.struct(*[x.alias(n) for x, n in zip((F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(0).cast("long")), names)])
    rows = rows.withColumns({"kind": F.when(usage, "usage").when(F.col("model").isNotNull(), "model"), "total": F.when(usage, total), "last": F.when(usage & (i % 4 == 0), last)})
    return rows.where("kind is not null").select("session_id", "line_ord", "ts", "kind", "model", "last", "total")


@query(f"WITH {o.deltas()} SELECT session_id, line_ord, input_tokens, cached_input_tokens, output_tokens, reasoning_output_tokens FROM events2")
def counter_delta(spark, sf_dir):
    return counters.deltas(_counter_rows(spark, sf_dir)).select("session_id", "line_ord", *counters.FIELDS[:4])


@query(f"WITH {o.deltas()} SELECT session_id, line_ord, model, is_fallback FROM events2")
def model_ffill(spark, sf_dir):
    return counters.deltas(_counter_rows(spark, sf_dir)).select("session_id", "line_ord", "model", "is_fallback")


def _counter_events(spark, sf_dir):
    events = counters.deltas(_counter_rows(spark, sf_dir))
    return events, pricing.counter_prices(events, samples.price_frame(spark))


_COUNTER = f"sum(input_tokens)::BIGINT AS input_tokens, sum(cached_input_tokens)::BIGINT AS cached_input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_output_tokens)::BIGINT AS reasoning_output_tokens, {o.COUNTER_COST}, string_agg(DISTINCT model, ',' ORDER BY model) AS models"


def _counter_shown(df, key):
    return df.select(key, *counters.FIELDS[:4], F.round("cost", 10).alias("cost"), F.array_join(F.sort_array(F.map_keys("models")), ",").alias("models"))


def _counter_sql(key, name, where="true"):
    return f"WITH {o.deltas()}, {o.COUNTER_RATES} SELECT {key} AS {name}, {_COUNTER} FROM events2 JOIN rates USING (model) WHERE {where} GROUP BY 1"


@query(_counter_sql(o.DAY, "date"))
def counter_daily(spark, sf_dir):
    return _counter_shown(reports.counter_daily(*_counter_events(spark, sf_dir)), "date")


@query(_counter_sql(o.MONTH, "month"))
def counter_monthly(spark, sf_dir):
    return _counter_shown(reports.counter_monthly(*_counter_events(spark, sf_dir)), "month")


@query(_counter_sql("session_id", "session_id"))
def counter_all_sessions(spark, sf_dir):
    return _counter_shown(reports.counter_sessions(*_counter_events(spark, sf_dir)), "session_id")


@query(_counter_sql("session_id", "session_id", f"{o.DAY} BETWEEN '2024-01-10' AND '2024-01-12'"))
def counter_sessions(spark, sf_dir):
    return _counter_shown(reports.counter_sessions(*_counter_events(spark, sf_dir), since="20240110", until="20240112"), "session_id")


@query(f"WITH {o.deltas()}, {o.COUNTER_RATES} SELECT model, i AS input_rate, c AS cached_rate, o AS output_rate FROM rates")
def counter_rates(spark, sf_dir):
    return _counter_events(spark, sf_dir)[1]


@query("SELECT p_partkey, greatest(p_size * 100 - least(p_partkey % 3000, p_size * 100), 0)::BIGINT AS fresh, least(p_partkey % 3000, p_size * 100)::BIGINT AS cached, least(p_partkey % 70, 40)::BIGINT AS reasoning FROM part")
def counter_split(spark, sf_dir):
    size = F.col("p_size").cast("long") * 100
    fresh, cached, _, reasoning = counters.display_split(size, F.col("p_partkey") % 3000, F.lit(40).cast("long"), F.col("p_partkey") % 70)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fresh.alias("fresh"), cached.alias("cached"), reasoning.alias("reasoning"))


# ---------------------------------------------------------------- session trees, ledgers, agent sessions

_TREE = """meta AS (SELECT DISTINCT 's' || (user_id % 50) AS session_id, CASE WHEN user_id % 50 % 5 <> 0 THEN 's' || (user_id % 50 // 5 * 5) END AS parent_id, 'Title ' || (user_id % 50) AS title FROM events WHERE user_id % 50 <> 7)"""


@query(f"""WITH {o.costed()}, {_TREE}, own AS (SELECT session_id, sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)::BIGINT AS total_tokens, sum(cost) AS cost, max(ts) AS last_activity FROM costed GROUP BY 1),
 told AS (SELECT o.*, coalesce(title, o.session_id) AS title, parent_id, coalesce(parent_id, o.session_id) AS fam FROM own o LEFT JOIN meta m ON o.session_id = m.session_id)
 SELECT session_id, title, parent_id, total_tokens, round(cost, 8) AS cost, last_activity, (sum(total_tokens) OVER (PARTITION BY fam))::BIGINT AS family_tokens, round(sum(cost) OVER (PARTITION BY fam), 8) AS family_cost, count(*) OVER (PARTITION BY fam) AS family_size FROM told""")
def session_tree(spark, sf_dir):
    u = F.col("user_id") % 50
    meta = spark.read.parquet(f"{sf_dir}/events.parquet").where(u != 7).select(F.concat(F.lit("s"), u.cast("string")).alias("session_id"), F.when(u % 5 != 0, F.concat(F.lit("s"), (F.floor(u / 5) * 5).cast("string"))).alias("parent_id"), F.concat(F.lit("Title "), u.cast("string")).alias("title")).distinct()
    out = reports.session_tree(costed(spark, sf_dir), meta)
    return _money(out.select("session_id", "title", "parent_id", "total_tokens", "cost", "last_activity", "family_tokens", "family_cost", "family_size"), "cost", "family_cost")


_LEDGER = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 8) AS cost, round(sum(value), 4) AS credits"


def _ledger(spark, sf_dir, key):
    rows = costed(spark, sf_dir, "calculate").withColumns({"thread_id": F.col("session_id"), "credits": F.col("value"), "total_tokens": F.col("input_tokens") + F.col("output_tokens")})
    return reports.ledger_report(rows, key).select(key, "input_tokens", "output_tokens", F.round("cost", 8).alias("cost"), F.round("credits", 4).alias("credits"))


@query(f"WITH {o.costed('calculate')} SELECT split_part(ts_raw, 'T', 1) AS date, {_LEDGER} FROM costed GROUP BY 1")
def ledger_daily(spark, sf_dir):
    return _ledger(spark, sf_dir, "date")


@query(f"WITH {o.costed('calculate')} SELECT ts_raw[1:7] AS month, {_LEDGER} FROM costed GROUP BY 1")
def ledger_monthly(spark, sf_dir):
    return _ledger(spark, sf_dir, "month")


@query(f"WITH {o.costed('calculate')} SELECT session_id AS thread_id, {_LEDGER} FROM costed GROUP BY 1")
def ledger_threads(spark, sf_dir):
    return _ledger(spark, sf_dir, "thread_id")


_AGENT = f"WITH {o.costed('display')}, a AS (SELECT * REPLACE (coalesce(model, 'unknown') AS model) FROM costed)"


def _agent(spark, sf_dir, key, **options):
    return _money(reports.agent_report(costed(spark, sf_dir, "display"), key, **options)).withColumn("models_used", F.array_join("models_used", ","))


@query(f"{_AGENT} SELECT {o.DAY} AS date, {o.SUMS}, string_agg(DISTINCT model, ',' ORDER BY model) AS models_used FROM a WHERE {o.DAY} >= '2024-01-20' GROUP BY 1")
def agent_daily(spark, sf_dir):
    return _agent(spark, sf_dir, "date", since="20240120")


@query(f"{_AGENT} SELECT {o.DAY} AS date, {o.SUMS}, string_agg(DISTINCT model, ',' ORDER BY model) AS models_used FROM a GROUP BY 1")
def agent_all_days(spark, sf_dir):
    return _agent(spark, sf_dir, "date")


@query(f"{_AGENT} SELECT {o.MONTH} AS month, {o.SUMS}, string_agg(DISTINCT model, ',' ORDER BY model) AS models_used FROM a GROUP BY 1")
def agent_monthly(spark, sf_dir):
    return _agent(spark, sf_dir, "month")


@query(f"{_AGENT} SELECT project, session_id, {o.SUMS}, string_agg(DISTINCT model, ',' ORDER BY model) AS models_used, strftime(max(ts), '%Y-%m-%d') AS last_activity FROM a GROUP BY ALL HAVING strftime(max(ts), '%Y-%m-%d') <= '2024-01-29'")
def agent_sessions(spark, sf_dir):
    return _agent(spark, sf_dir, "session", until="20240129")


# ---------------------------------------------------------------- functions


@query("""WITH m AS (SELECT DISTINCT 'claude-' || lower(c_mktsegment) || CASE c_custkey % 4 WHEN 0 THEN '-4-20250514' WHEN 1 THEN '-4-5-20250929' WHEN 2 THEN '-4-5' ELSE '' END AS raw FROM customer UNION SELECT DISTINCT 'anthropic/claude-opus-' || (c_nationkey % 9) || '.5' FROM customer UNION SELECT DISTINCT '[pi] claude-sonnet-' || (c_nationkey % 9) FROM customer)
 SELECT raw, CASE WHEN regexp_matches(raw, '^\\[pi\\] .') THEN '[pi] ' ELSE '' END || regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\\[pi\\] ', ''), '^anthropic/claude-(\\w+)-([\\d.]+)$', '\\1-\\2'), '^claude-(\\w+)-([\\d-]+)-(\\d{8})$', '\\1-\\2'), '^claude-(\\w+)-([\\d-]+)$', '\\1-\\2') AS short FROM m""")
def model_short_name(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n, s = F.col("c_custkey") % 4, F.col("c_nationkey") % 9
    a = F.concat(F.lit("claude-"), F.lower("c_mktsegment"), F.when(n == 0, "-4-20250514").when(n == 1, "-4-5-20250929").when(n == 2, "-4-5").otherwise(""))
    b, d = F.concat(F.lit("anthropic/claude-opus-"), s.cast("string"), F.lit(".5")), F.concat(F.lit("[pi] claude-sonnet-"), s.cast("string"))
    names = c.select(a.alias("raw")).union(c.select(b)).union(c.select(d)).distinct()
    return names.select("raw", text.model_name(F.col("raw")).alias("short"))


@query("""SELECT DISTINCT raw, CASE c WHEN 0 THEN brand WHEN 1 THEN 'web' ELSE 'edugakko-api' END AS short FROM (SELECT p_partkey % 3 AS c, p_brand AS brand, CASE p_partkey % 3 WHEN 0 THEN '/' || p_brand || '/' WHEN 1 THEN '/Users/me/Code/web' ELSE '-Users-me-Code-' || lower(left(p_name, 3)) || 'xy-edugakko-api--feature-' || (p_partkey % 5) END AS raw FROM part)""")
def project_name(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("/"), F.col("p_brand"), F.lit("/"))).when(k % 3 == 1, "/Users/me/Code/web").otherwise(F.concat(F.lit("-Users-me-Code-"), F.lower(F.left("p_name", F.lit(3))), F.lit("xy-edugakko-api--feature-"), (k % 5).cast("string")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(raw.alias("raw")).distinct().select("raw", text.project_name(F.col("raw")).alias("short"))


@query("SELECT o_orderkey, CASE WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS said, format('{:,}', m * 1000) AS told FROM (SELECT o_orderkey, o_orderkey * 37 % 1000 AS m FROM orders)")
def durations(spark, sf_dir):
    m = F.col("o_orderkey") * 37 % 1000
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", dates.hours_minutes(m).alias("said"), numbers.with_separators(m * 1000).alias("told"))


@query("SELECT p_partkey, (floor(v + 0.5))::BIGINT AS near, least(100, greatest(0, v)) AS held FROM (SELECT p_partkey, p_partkey % 400 / 2.0 - 50 AS v FROM part)")
def js_rounding(spark, sf_dir):
    v = F.col("p_partkey") % 400 / 2.0 - 50
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", numbers.half_up(v).alias("near"), numbers.clamp(v, 0.0, 100.0).alias("held"))


@query("""WITH u AS (SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM customer) SELECT c_custkey, split_part(c_name, '#', 1) || '-x-' || (c_custkey % 9) AS id, 'x-' || (c_custkey % 9) AS tail, right(c_name, 8) AS ends, CASE WHEN length(c_name || c_mktsegment || c_name) > 30 THEN left(c_name || c_mktsegment || c_name, 27) || '...' ELSE c_name || c_mktsegment || c_name END AS title FROM u""")
def short_ids(spark, sf_dir):
    name = F.col("c_name")
    ident = F.concat(F.split_part(name, F.lit("#"), F.lit(1)), F.lit("-x-"), (F.col("c_custkey") % 9).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", ident.alias("id"), text.session_tail(ident).alias("tail"), text.last_characters(name).alias("ends"), text.clipped(F.concat(name, F.col("c_mktsegment"), name)).alias("title"))


@query(f"{o.blocks()}, b AS (SELECT sum(cost) AS c FROM found WHERE is_active), t AS (SELECT sum(cost) AS d FROM costed WHERE {o.DAY} = '2024-01-30') SELECT '🤖 m | 💰 N/A session / $' || printf('%.2f', floor(d * 100 + 0.5) / 100) || ' today / ' || CASE WHEN c IS NULL THEN 'No active block' ELSE '$' || printf('%.2f', floor(c * 100 + 0.5) / 100) || ' block (20m left)' END || ' | 🧠 1,500 (15%)' AS line FROM b, t")
def status_line(spark, sf_dir):
    today = reports.daily(costed(spark, sf_dir), since="20240130", until="20240130").agg(F.sum("cost").alias("d"))
    live = _blocks(spark, sf_dir).where("is_active").agg(F.sum("cost").alias("c"))
    none = F.lit(None).cast("double")
    line = output.status_line(F.lit("m"), none, F.col("d"), F.col("c"), F.lit(20), none, F.lit(1500), F.lit(10_000))
    return today.crossJoin(live).select(line.alias("line"))  # two one-row aggregates


# ---------------------------------------------------------------- order, filters and output


@query(f"WITH {o.costed()} SELECT coalesce(model, 'none') AS model, count(*) AS n FROM costed GROUP BY 1")
def display_models(spark, sf_dir):
    return costed(spark, sf_dir).groupBy(F.coalesce("model", F.lit("none")).alias("model")).agg(F.count("*").alias("n"))


@query(f"WITH {o.costed()} SELECT project, count(*) AS entries, count(*) FILTER (model = '<synthetic>') AS synthetic, string_agg(DISTINCT model, ',' ORDER BY model) FILTER (model <> '<synthetic>') AS models_used FROM costed GROUP BY project")
def synthetic_rows(spark, sf_dir):
    rows = costed(spark, sf_dir)
    counts = rows.groupBy("project").agg(F.count("*").alias("entries"), F.count_if(F.col("model") == reports.SYNTHETIC).alias("synthetic"))
    used = reports.models_used(rows, ["project"]).select(F.col("project").alias("_p"), F.array_join(F.sort_array("models_used"), ",").alias("models_used"))
    return counts.join(used, F.col("project") == F.col("_p")).drop("_p")


@query(f"WITH {o.costed()} SELECT to_json(struct_pack(date := {o.DAY}, inputTokens := sum(input_tokens)::BIGINT, outputTokens := sum(output_tokens)::BIGINT))::VARCHAR AS value FROM costed GROUP BY {o.DAY}")
def json_report(spark, sf_dir):
    return output.json_lines(reports.daily(costed(spark, sf_dir)).select("date", "input_tokens", "output_tokens"))


@query(f"WITH {o.DEDUP} SELECT 'roots' AS kind, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens FROM dedup")
def union_roots(spark, sf_dir):
    """Two roots that share requests: union first, dedupe after."""
    rows = samples.usage(spark, sf_dir)
    both = rows.where("user_id % 2 = 0").unionByName(rows.where("user_id % 2 = 1"))
    return dedupe.first_request(both).agg(F.lit("roots").alias("kind"), F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"))


@query("SELECT p_partkey, (least(100, greatest(0, floor(p_retailprice * 200 / 2000 + 0.5))))::BIGINT AS percent FROM part")
def context_percent(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", output.context_percent(F.col("p_retailprice") * 2, F.lit(2000)).cast("long").alias("percent"))


@query(f"WITH {o.costed()} SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06') AS straddling FROM costed")
def filter_after_dedupe(spark, sf_dir):
    """The date filter stays above the dedupe: a duplicate of an earlier day is gone, not revived."""
    rows = costed(spark, sf_dir)
    return rows.where(dates.in_range(dates.day_key(F.col("ts")), "20240105", "20240105")).agg(F.count("*").alias("straddling"))
