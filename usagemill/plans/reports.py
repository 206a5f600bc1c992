"""Reports over the canonical usage frame: lazy plans, costs per entry before any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import display_model
from ..operators.dedupe import seen_list

TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
SYNTHETIC = "<synthetic>"


def _sums() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in TOKENS], F.sum("cost").alias("cost")]


def _total() -> Column:
    return sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))


def shown_models(usage: DataFrame) -> DataFrame:
    """Replaces the model by its display name."""
    return usage.withColumn("model", display_model(F.col("model"), F.col("speed")))


def by_key(costed: DataFrame, keys: list[str]) -> DataFrame:
    """Sums for each key; synthetic models and missing ones count here."""
    return costed.groupBy(*keys).agg(*_sums()).withColumn("total_tokens", _total())


def model_breakdown(costed: DataFrame, keys: list[str]) -> DataFrame:
    """Sums for each key and model. Synthetic rows are left out; a missing model is unknown."""
    model = F.coalesce("model", F.lit("unknown"))
    return costed.withColumn("model", model).where(F.col("model") != SYNTHETIC).groupBy(*keys, "model").agg(*_sums())


def models_used(costed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, models_used): different real models, first seen first."""
    first = costed.where(f"model is not null and model <> '{SYNTHETIC}'").groupBy(*keys, "model").agg(F.min("ts").alias("seen"))
    return first.groupBy(*keys).agg(seen_list(F.col("model"), F.struct("seen", "model")).alias("models_used"))


def with_breakdowns(costed: DataFrame, keys: list[str], extra: tuple = ()) -> DataFrame:
    """by_key() plus models_used and model_breakdowns (costliest first). One shuffle of partial sums by (key, model) feeds all three.

    extra: pairs of an aggregate by (key, model) and the aggregate by key of what it gave.
    """
    each = costed.groupBy(*keys, "model").agg(*_sums(), F.min("ts").alias("seen"), *[x for x, _ in extra])
    real = F.coalesce("model", F.lit("unknown")) != SYNTHETIC
    item = F.struct((-F.col("cost")).alias("less"), "seen", F.coalesce("model", F.lit("unknown")).alias("model"), *TOKENS, "cost")
    rows = each.groupBy(*keys).agg(
        *_sums(), F.array_sort(F.collect_list(F.when(real, item))).alias("items"),
        seen_list(F.when(F.col("model") != SYNTHETIC, F.col("model")), F.struct("seen", "model")).alias("models_used"), *[x for _, x in extra],
    )
    told = F.transform("items", lambda x: F.struct(x["model"].alias("model"), *[x[c].alias(c) for c in (*TOKENS, "cost")]))
    return rows.withColumn("model_breakdowns", told).withColumn("total_tokens", _total()).drop("items")


def bucket(costed: DataFrame, key: Column, name: str, by_project: bool = False, since: str | None = None, until: str | None = None, project: str | None = None, zone: str = "UTC", order: str = "desc", breakdowns: bool = False) -> DataFrame:
    """Report by a bucket key. Dates are filtered by day after dedupe; a project groups by project and is filtered on."""
    rows = costed.withColumn(name, key)
    if since or until:
        rows = rows.where(dates.in_range(dates.day_key(F.col("ts"), zone), since, until))
    if project is not None:
        rows = rows.where(F.col("project") == project)
    keys = [name, "project"] if by_project or project is not None else [name]
    out = with_breakdowns(rows, keys) if breakdowns else by_key(rows, keys)
    first = F.col(name).asc() if order == "asc" else F.col(name).desc()
    return out.orderBy(first, *keys[1:])


def daily(costed: DataFrame, zone: str = "UTC", **options) -> DataFrame:
    return bucket(costed, dates.day_key(F.col("ts"), zone), "date", zone=zone, **options)


def monthly(costed: DataFrame, zone: str = "UTC", **options) -> DataFrame:
    return bucket(costed, dates.month_key(F.col("ts"), zone), "month", zone=zone, **options)


def weekly(costed: DataFrame, zone: str = "UTC", first_day: str = "sunday", **options) -> DataFrame:
    return bucket(costed, dates.week_key(F.col("ts"), zone, first_day), "week", zone=zone, **options)


def iso_weekly(costed: DataFrame, zone: str = "UTC", **options) -> DataFrame:
    return bucket(costed, dates.iso_week_key(F.col("ts"), zone), "week", zone=zone, **options)


def sessions(costed: DataFrame, zone: str = "UTC", since: str | None = None, until: str | None = None, project: str | None = None, order: str = "desc", breakdowns: bool = False) -> DataFrame:
    """By (project_path, session_id): sums, last_activity (the day of the latest raw time) and versions. Dates filter on last_activity."""
    keys = ["project_path", "session_id"]
    latest, versions = F.max(F.struct("ts_raw", "ts")).alias("_last"), F.collect_set("version").alias("versions")
    if breakdowns:
        both = F.array_distinct(F.flatten(F.collect_list("versions"))).alias("versions")
        out = with_breakdowns(costed, keys, ((latest, F.max("_last").alias("_last")), (versions, both)))
    else:
        out = costed.groupBy(*keys).agg(*_sums(), latest, versions).withColumn("total_tokens", _total())
    out = out.withColumns({"last_activity": dates.day_key(F.col("_last.ts"), zone), "versions": F.sort_array("versions")}).drop("_last")
    if since or until:
        out = out.where(dates.in_range(F.col("last_activity"), since, until))
    if project is not None:
        out = out.where(F.col("project_path") == project)
    return out.orderBy(F.col("last_activity").asc() if order == "asc" else F.col("last_activity").desc(), *keys)


def totals(report: DataFrame) -> DataFrame:
    """Grand totals of a report's rows; zeros for an empty report."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return report.agg(*[zero(c) for c in (*TOKENS, "total_tokens")], F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def session_entries(costed: DataFrame) -> DataFrame:
    """The rows of one session: the stated cost as it is, 0 if there is none."""
    return costed.select("ts_raw", *TOKENS, F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"))


def session_total(costed: DataFrame) -> DataFrame:
    out = costed.agg(*_sums(), F.count("*").alias("entries"))
    return out.withColumn("total_tokens", _total())


def counter_report(events: DataFrame, rates: DataFrame, key: Column, name: str, zone: str = "UTC", since: str | None = None, until: str | None = None) -> DataFrame:
    """Counter events by a key: token sums, cost, and a map of models. Dates filter single events; blank models are skipped."""
    from ..operators.counters import FIELDS
    from ..operators.pricing import counter_cost

    rows = events.where("ts is not null and trim(model) <> ''").withColumn(name, key)
    if since or until:
        rows = rows.where(dates.in_range(dates.day_key(F.col("ts"), zone), since, until))
    each = rows.groupBy(name, "model").agg(*[F.sum(f).alias(f) for f in FIELDS], F.bool_or("is_fallback").alias("is_fallback"), F.max("ts").alias("last_activity"))
    priced = each.join(rates.withColumnRenamed("model", "_m"), F.col("model") == F.col("_m")).withColumn("cost", counter_cost())
    item = F.struct("model", F.struct(*FIELDS, "is_fallback", "cost").alias("use"))
    models = F.map_from_entries(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["model"], x["use"])))
    out = priced.groupBy(name).agg(*[F.sum(f).alias(f) for f in FIELDS], F.sum("cost").alias("cost"), F.max("last_activity").alias("last_activity"), models.alias("models"))
    return out


def counter_daily(events: DataFrame, rates: DataFrame, zone: str = "UTC", **options) -> DataFrame:
    return counter_report(events, rates, dates.day_key(F.col("ts"), zone), "date", zone, **options).drop("last_activity").orderBy("date")


def counter_monthly(events: DataFrame, rates: DataFrame, zone: str = "UTC", **options) -> DataFrame:
    return counter_report(events, rates, dates.month_key(F.col("ts"), zone), "month", zone, **options).drop("last_activity").orderBy("month")


def counter_sessions(events: DataFrame, rates: DataFrame, zone: str = "UTC", **options) -> DataFrame:
    """Sessions by last activity; blank session ids are skipped. directory and file are the parts of the id."""
    rows = events.where("trim(session_id) <> ''").withColumnRenamed("session_id", "_s")
    out = counter_report(rows, rates, F.col("_s"), "session_id", zone, **options)
    folder = F.when(F.col("session_id").contains("/"), F.regexp_replace("session_id", "/[^/]*$", "")).otherwise(F.lit(""))
    return out.withColumns({"directory": folder, "session_file": F.substring_index("session_id", "/", -1)}).orderBy("last_activity", "session_id")


def session_tree(costed: DataFrame, sessions_table: DataFrame) -> DataFrame:
    """Message-store sessions with title, parent, own sums and the subtotal of their top session and its direct children.

    A session without metadata is titled by its id and is a root. Sessions are in order of last activity.
    """
    own = costed.groupBy("session_id").agg(*_sums(), F.max("ts").alias("last_activity"), F.sort_array(F.collect_set("model")).alias("models")).withColumn("total_tokens", _total())
    meta = sessions_table.select(F.col("session_id").alias("_s"), "title", "parent_id")
    told = own.join(meta, F.col("session_id") == F.col("_s"), "left").drop("_s").withColumn("title", F.coalesce("title", "session_id"))
    family = F.coalesce("parent_id", "session_id")
    sub = told.groupBy(family.alias("_root")).agg(F.sum("total_tokens").alias("family_tokens"), F.sum("cost").alias("family_cost"), F.count("*").alias("family_size"))
    return told.join(sub, family == F.col("_root")).drop("_root").orderBy("last_activity", "session_id")


def ledger_report(costed: DataFrame, key: str) -> DataFrame:
    """Thread-ledger events by date (text before T), month (first seven characters) or thread: sums, cost and credits."""
    keyed = {"date": F.substring_index("ts_raw", "T", 1), "month": F.substring("ts_raw", 1, 7), "thread_id": F.col("thread_id")}[key]
    out = costed.withColumn(key, keyed).groupBy(key).agg(*_sums(), F.sum("total_tokens").alias("total_tokens"), F.sum("credits").alias("credits"), F.max("ts").alias("last_activity"), F.sort_array(F.collect_set("model")).alias("models"))
    return out.orderBy(*(["last_activity", key] if key == "thread_id" else [key]))


def agent_report(usage: DataFrame, key: str, zone: str = "UTC", since: str | None = None, until: str | None = None, order: str = "desc") -> DataFrame:
    """Agent sessions by date, month or session. Dates filter single rows, and last activity for sessions."""
    day = dates.day_key(F.col("ts"), zone)
    rows = usage.withColumn("model", F.coalesce("model", F.lit("unknown")))
    if key == "session":
        out = rows.groupBy("project", "session_id").agg(*_sums(), F.max("ts").alias("_last"), F.sort_array(F.collect_set("model")).alias("models_used"))
        out = out.withColumn("last_activity", dates.day_key(F.col("_last"), zone)).drop("_last")
        out = out.where(dates.in_range(F.col("last_activity"), since, until))
        return out.orderBy(F.col("last_activity").asc() if order == "asc" else F.col("last_activity").desc(), "project", "session_id")
    rows = rows.where(dates.in_range(day, since, until)).withColumn(key, {"date": day, "month": dates.month_key(F.col("ts"), zone)}[key])
    out = rows.groupBy(key).agg(*_sums(), F.sort_array(F.collect_set("model")).alias("models_used"))
    return out.orderBy(F.col(key).asc() if order == "asc" else F.col(key).desc())
