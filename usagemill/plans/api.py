"""What a user calls: reports over log folders, as frames or JSON documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import blocks as blk
from ..operators import mismatch as mis
from ..operators.counters import FIELDS
from ..operators.pricing import LEDGER_PREFIXES, STORE_ALIASES, context_limit, counter_prices, with_cost
from ..sources import hook, other_logs, prices, usage_log
from . import output, reports


class Engine:
    """Reports of one set of roots. ``now`` is given, never read from the clock."""

    def __init__(self, spark: SparkSession, roots: list[str], mode: str = "auto", price_table: DataFrame | None = None, zone: str = "UTC", session_from: str = "dir"):
        self.spark, self.roots, self.mode, self.zone, self.session_from = spark, roots, mode, zone, session_from
        self.prices = price_table if price_table is not None or mode == "display" else prices.load(spark)

    def usage(self, project: str | None = None) -> DataFrame:
        """Deduped, costed rows with display models. The project filter comes before dedupe."""
        rows = usage_log.deduped(usage_log.read(self.spark, self.roots, project, self.session_from))
        return reports.shown_models(with_cost(rows, self.prices, self.mode))

    def daily(self, project: str | None = None, **options) -> DataFrame:
        return reports.daily(self.usage(project), self.zone, project=project, **options)

    def weekly(self, project: str | None = None, **options) -> DataFrame:
        return reports.weekly(self.usage(project), self.zone, project=project, **options)

    def monthly(self, project: str | None = None, **options) -> DataFrame:
        return reports.monthly(self.usage(project), self.zone, project=project, **options)

    def sessions(self, **options) -> DataFrame:
        return reports.sessions(self.usage(), self.zone, **options)

    def session(self, session_id: str) -> DataFrame:
        return with_cost(usage_log.session_by_id(self.spark, self.roots, session_id), self.prices, self.mode)

    def blocks(self, now: datetime, hours: float = blk.HOURS, since: str | None = None, until: str | None = None, recent_days: int | None = None, active: bool = False, limit: str | None = None) -> DataFrame:
        """Blocks with burn rate, projection and limit status. ``max`` as limit is the most of all returned blocks before the recent and active filters."""
        found = blk.blocks(self.usage(), now, hours)
        found = found.where(dates.in_range(dates.day_key(F.col("start"), self.zone), since, until))
        bound = blk.token_limit(limit, blk.most_tokens(found).first()["most"]) if limit is not None else None
        if recent_days is not None:
            found = blk.recent(found, now, recent_days)
        if active:
            found = found.where("is_active")
        return blk.with_limit_status(blk.with_projection(blk.with_burn_rate(found), now), bound)

    def mismatches(self) -> DataFrame:
        return mis.compared(usage_log.read(self.spark, self.roots, session_from=self.session_from), self.prices if self.prices is not None else prices.load(self.spark))

    def status_line(self, hook_json: str, now: datetime) -> str:
        """The status line for a hook's input: session, today and active-block cost, burn rate and context use."""
        data = hook.parse(hook_json)
        day = now.strftime("%Y%m%d")
        today = self.daily(since=day, until=day).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("today"))
        own = self.session(data["session_id"]).agg(F.sum("cost").alias("own"))
        live = self.blocks(now, active=True).orderBy("start").limit(1).agg(F.max("cost").alias("block"), F.max("cost_per_hour").alias("burn"), F.max((F.unix_micros("end") - F.unix_micros(F.lit(now).cast("timestamp"))) / 60e6).alias("left"))
        tokens, size = data["context_tokens"], data["context_size"]
        if tokens is None:
            try:
                seen = usage_log.context_tokens(self.spark, data["transcript_path"]).first()
            except Exception:  # the transcript can't be read
                seen = None
            tokens = seen["context_tokens"] if seen else None
            names = self.spark.createDataFrame([(data["model_id"],)], "model string")
            size = context_limit(names, self.prices if self.prices is not None else prices.load(self.spark)).first()["context_limit"]
        number = lambda x, t="double": F.lit(x).cast(t)
        whole = today.crossJoin(own).crossJoin(live)  # three one-row aggregates
        session_cost = number(data["cost"]) if data["cost"] is not None else F.col("own")
        line = output.status_line(number(data["model_name"], "string"), session_cost, F.col("today"), F.col("block"), F.floor(F.col("left") + 0.5), F.col("burn"), number(tokens, "long"), number(size, "long"))
        return whole.select(line.alias("line")).first()["line"]


def counter_reports(spark: SparkSession, folders: list[str], price_table: DataFrame | None = None, zone: str = "UTC", **options) -> dict:
    """Daily, monthly and session reports of counter logs, and the folders that are missing."""
    there, missing = other_logs.present(folders)
    if not there:
        return {"missing": missing}
    events = other_logs.counter_events(spark, there)
    rates = counter_prices(events, price_table if price_table is not None else prices.load(spark))
    return {"daily": reports.counter_daily(events, rates, zone, **options), "monthly": reports.counter_monthly(events, rates, zone, **options), "sessions": reports.counter_sessions(events, rates, zone, **options), "missing": missing}


def store_reports(spark: SparkSession, messages: str, sessions: str, now: datetime, price_table: DataFrame | None = None) -> dict:
    """Daily, weekly (ISO), monthly and session reports of a message store."""
    alias = F.coalesce(F.create_map(*[F.lit(x) for p in STORE_ALIASES.items() for x in p])[F.col("model")], F.col("model"))
    rows = other_logs.store_messages(spark, messages, now).withColumn("own_model", F.col("model")).withColumn("model", alias)
    costed = with_cost(rows, price_table if price_table is not None else prices.load(spark), speed=False, zero_is_missing=True).withColumn("model", F.col("own_model")).drop("own_model")
    return {"daily": reports.daily(costed, order="asc"), "weekly": reports.iso_weekly(costed, order="asc"), "monthly": reports.monthly(costed, order="asc"), "sessions": reports.session_tree(costed, other_logs.store_sessions(spark, sessions))}


def ledger_reports(spark: SparkSession, folder: str, price_table: DataFrame | None = None) -> dict:
    """Daily, monthly and thread reports of thread ledgers."""
    found = other_logs.threads(spark, folder)
    rows = other_logs.ledger_events(found).withColumn("cost_usd", F.lit(None).cast("double"))
    costed = with_cost(rows, price_table if price_table is not None else prices.load(spark), "calculate", LEDGER_PREFIXES, speed=False)
    by_thread = reports.ledger_report(costed, "thread_id")
    titles = found.groupBy(F.col("thread_id").alias("_t")).agg(F.max("title").alias("title"))
    threads = by_thread.join(titles, F.col("thread_id") == F.col("_t"), "left").drop("_t").withColumn("title", F.coalesce("title", F.lit("Untitled"))).orderBy("last_activity", "thread_id")
    return {"daily": reports.ledger_report(costed, "date"), "monthly": reports.ledger_report(costed, "month"), "threads": threads}


def agent_reports(spark: SparkSession, folder: str, zone: str = "UTC", **options) -> dict:
    usage = other_logs.agent_usage(spark, folder)
    return {"daily": reports.agent_report(usage, "date", zone, **options), "monthly": reports.agent_report(usage, "month", zone, **options), "sessions": reports.agent_report(usage, "session", zone, **options)}


def _counter_json(spark: SparkSession, folders: list[str], name: str, options: dict) -> dict:
    out = counter_reports(spark, folders, **options)
    if name not in out:
        return {name: [], "totals": None}
    rows = out[name].collect()
    if not rows:
        return {name: [], "totals": None}
    sums = out[name].agg(*[F.sum(f).alias(f) for f in (*FIELDS, "cost")]).first()
    return {name: [output.plain(r, output.COUNTER) for r in rows], "totals": output.plain(sums, output.COUNTER)}


#: Tools by name, for a server to expose: JSON documents of an engine, or of counter logs.
TOOLS = {
    "daily": lambda e, **o: output.report_json(e.daily(breakdowns=True, **o), "daily", "list"),
    "weekly": lambda e, **o: output.report_json(e.weekly(breakdowns=True, **o), "weekly"),
    "monthly": lambda e, **o: output.report_json(e.monthly(breakdowns=True, **o), "monthly"),
    "session": lambda e, **o: output.report_json(e.sessions(breakdowns=True, **o), "sessions", "list"),
    "blocks": lambda e, **o: output.blocks_json(e.blocks(**o)),
    "counter-daily": lambda spark, folders, **o: _counter_json(spark, folders, "daily", o),
    "counter-monthly": lambda spark, folders, **o: _counter_json(spark, folders, "monthly", o),
    "counter-sessions": lambda spark, folders, **o: _counter_json(spark, folders, "sessions", o),
}
