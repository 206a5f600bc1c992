"""Further log formats: cumulative counters, message stores, thread ledgers and agent sessions."""

from __future__ import annotations

import os
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counters import FIELDS, deltas
from ..operators.dedupe import first_by_key
from . import paths
from . import variants as v
from .usage_log import lines

AGENT_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})$"


def present(folders: list[str]) -> tuple[list[str], list[str]]:
    """Local folders that exist, and those that don't."""
    there = [f for f in folders if os.path.isdir(f)]
    return there, [f for f in folders if f not in there]


def _counter(o: Column, path: str) -> Column:
    """A usage object with missing or non-numeric fields as 0; null if it is no object."""
    part = lambda f: F.coalesce(F.when(v.is_number(o, f"{path}.{f}", required=True), v.whole(o, f"{path}.{f}")), F.lit(0))
    given = F.coalesce(v.kind(o, f"{path}.cached_input_tokens") != "VOID", F.lit(False))
    cached = F.when(given, part("cached_input_tokens")).otherwise(part("cache_read_input_tokens"))
    total = part("total_tokens")
    fields = [part("input_tokens"), cached, part("output_tokens"), part("reasoning_output_tokens"), F.when(total > 0, total).otherwise(part("input_tokens") + part("output_tokens"))]
    return F.when(v.is_object(o, path, required=True), F.struct(*[c.alias(f) for c, f in zip(fields, FIELDS)]))


def _model(o: Column) -> Column:
    tried = ("$.payload.info.model", "$.payload.info.model_name", "$.payload.info.metadata.model", "$.payload.model", "$.payload.metadata.model")
    return F.coalesce(*[v.filled(o, p) for p in tried])


def counter_events(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(session_id, ts, ts_raw, model, is_fallback, token fields) from logs of cumulative counters; the order of lines counts."""
    raws = [lines(spark, [f]).withColumn("root", F.lit(re.sub("^[a-z]+:/+", "/", f).rstrip("/") + "/")) for f in folders]
    raw = raws[0]
    for more in raws[1:]:
        raw = raw.unionByName(more)
    rows = raw.where(F.trim("value") != "").withColumn("o", v.parsed(F.col("value"))).where("o is not null")
    o = F.col("o")
    rows = rows.where(v.is_text(o, "$.type", required=True, empty=True) & v.is_text(o, "$.timestamp", empty=True))
    inside = F.substring(F.col("file_path"), F.length("root") + 1, F.length("file_path"))
    relative = F.when(F.col("file_path").startswith(F.col("root")), inside).otherwise(F.col("file_path"))
    is_model = (v.text(o, "$.type") == "turn_context") & v.is_object(o, "$.payload", required=True)
    info = v.is_object(o, "$.payload.info")
    is_usage = (v.text(o, "$.type") == "event_msg") & (v.text(o, "$.payload.type") == "token_count") & info & v.text(o, "$.timestamp").isNotNull()
    rows = rows.withColumn("kind", F.when(is_model, "model").when(is_usage, "usage")).where("kind is not null")
    ts = v.text(o, "$.timestamp")
    shaped = rows.select(
        F.regexp_replace(relative, r"(?i)\.jsonl$", "").alias("session_id"), "line_ord", ts.alias("ts_raw"), F.try_to_timestamp(ts).alias("ts"), "kind", _model(o).alias("model"),
        F.when(F.col("kind") == "usage", _counter(o, "$.payload.info.last_token_usage")).alias("last"), F.when(F.col("kind") == "usage", _counter(o, "$.payload.info.total_token_usage")).alias("total"),
    )
    return deltas(shaped).select("session_id", "ts", "ts_raw", "line_ord", "model", "is_fallback", *FIELDS)


def store_messages(spark: SparkSession, folder: str, now: datetime) -> DataFrame:
    """Usage rows of a message store: one JSON document for each file; first file of each id. A missing time is ``now``."""
    raw = lines(spark, [folder], "*.json", whole=True).withColumn("o", v.parsed(F.col("value"))).where("o is not null")
    o = F.col("o")
    numbers = ["$.time.created", "$.time.completed", "$.tokens.input", "$.tokens.output", "$.tokens.reasoning", "$.tokens.cache.read", "$.tokens.cache.write", "$.cost"]
    fits = v.is_text(o, "$.id", required=True) & v.is_object(o, "$.time", required=True) & v.is_object(o, "$.tokens", required=True) & v.is_object(o, "$.tokens.cache")
    for p in numbers:
        fits = fits & v.is_number(o, p)
    for p in ("$.sessionID", "$.providerID", "$.modelID"):
        fits = fits & v.is_text(o, p)
    empty = (v.number(o, "$.tokens.input") == 0) & (v.number(o, "$.tokens.output") == 0)
    rows = raw.where(fits & ~F.coalesce(empty, F.lit(False)) & v.text(o, "$.providerID").isNotNull() & v.text(o, "$.modelID").isNotNull())
    zero = lambda p: F.coalesce(v.whole(o, p), F.lit(0))
    out = rows.select(
        v.text(o, "$.id").alias("message_id"), F.coalesce(F.timestamp_millis(v.whole(o, "$.time.created")), F.lit(now).cast("timestamp")).alias("ts"),
        F.coalesce(v.text(o, "$.sessionID"), F.lit("unknown")).alias("session_id"), v.text(o, "$.modelID").alias("model"), v.text(o, "$.providerID").alias("provider"),
        zero("$.tokens.input").alias("input_tokens"), zero("$.tokens.output").alias("output_tokens"), zero("$.tokens.cache.write").alias("cache_creation_tokens"), zero("$.tokens.cache.read").alias("cache_read_tokens"),
        v.number(o, "$.cost").alias("cost_usd"), "file_path", "line_ord",
    )
    return first_by_key(out, ["message_id"], [F.col("file_path"), F.col("line_ord")])


def store_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, parent_id, title, project, directory): the last file of each id wins."""
    raw = lines(spark, [folder], "*.json", whole=True).withColumn("o", v.parsed(F.col("value"))).where("o is not null")
    o = F.col("o")
    parent = F.coalesce(v.kind(o, "$.parentID").isin("VOID", "STRING"), F.lit(True))
    fits = v.is_text(o, "$.id", required=True) & parent & v.is_text(o, "$.title", empty=True) & v.is_text(o, "$.projectID", empty=True) & v.is_text(o, "$.directory", empty=True)
    unknown = F.lit("unknown")
    rows = raw.where(fits).select(
        v.text(o, "$.id").alias("session_id"), F.when(v.kind(o, "$.parentID") == "STRING", v.text(o, "$.parentID")).alias("parent_id"), F.coalesce(v.text(o, "$.title"), v.text(o, "$.id")).alias("title"),
        F.coalesce(v.text(o, "$.projectID"), unknown).alias("project"), F.coalesce(v.text(o, "$.directory"), unknown).alias("directory"), "file_path", "line_ord",
    )
    return first_by_key(rows, ["session_id"], [F.col("file_path").desc(), F.col("line_ord").desc()]).drop("file_path", "line_ord")


_THREAD = """id string, created double, title string,
    messages array<struct<role: string, messageId: bigint, usage: struct<model: string, cacheCreationInputTokens: double, cacheReadInputTokens: double>>>,
    usageLedger struct<events: array<struct<id: string, timestamp: string, model: string, credits: double, tokens: struct<input: double, output: double>, operationType: string, fromMessageId: bigint, toMessageId: bigint>>>"""


def threads(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each valid thread document: thread_id, title, created, messages, events."""
    raw = lines(spark, [folder], "*.json", whole=True).withColumn("o", v.parsed(F.col("value"))).where("o is not null")
    o = F.col("o")
    raw = raw.where(v.is_text(o, "$.id", required=True, empty=True) & v.is_text(o, "$.title", empty=True) & v.is_number(o, "$.created") & v.is_array(o, "$.messages") & v.is_object(o, "$.usageLedger"))
    doc = raw.select(F.from_json(F.to_json("o"), _THREAD).alias("d"), "file_path").where("d.id is not null")
    events = F.filter(F.coalesce("d.usageLedger.events", F.array().cast("array<struct<id: string, timestamp: string, model: string, credits: double, tokens: struct<input: double, output: double>, operationType: string, fromMessageId: bigint, toMessageId: bigint>>")), lambda e: e["timestamp"].isNotNull() & e["model"].isNotNull())
    return doc.select(F.col("d.id").alias("thread_id"), F.coalesce("d.title", F.lit("Untitled")).alias("title"), F.col("d.created").alias("created"), F.col("d.messages").alias("messages"), events.alias("events"))


def ledger_events(found: DataFrame) -> DataFrame:
    """Ledger events with the cache tokens of the assistant message they lead to (first match in the document; no shuffle)."""
    each = found.select("thread_id", "messages", F.explode("events").alias("e"))
    hit = F.get(F.filter("messages", lambda m: (m["role"] == "assistant") & (m["messageId"] == F.col("e.toMessageId"))), F.lit(0))
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    out = each.withColumn("hit", hit).select(
        "thread_id", F.col("e.timestamp").alias("ts_raw"), F.try_to_timestamp("e.timestamp").alias("ts"), F.col("e.model").alias("model"), F.coalesce("e.credits", F.lit(0.0)).alias("credits"), F.coalesce("e.operationType", F.lit("unknown")).alias("operation"),
        zero(F.col("e.tokens.input")).alias("input_tokens"), zero(F.col("e.tokens.output")).alias("output_tokens"), zero(F.col("hit.usage.cacheCreationInputTokens")).alias("cache_creation_tokens"), zero(F.col("hit.usage.cacheReadInputTokens")).alias("cache_read_tokens"),
    )
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def agent_root(custom: str | None = None, env: dict | None = None, variable: str = "PI_AGENT_DIR", default: str | None = None) -> list[str]:
    """The first folder that exists among the given one, the variable's and the default."""
    env = os.environ if env is None else env
    fallback = default or str(Path.home() / ".pi" / "agent" / "sessions")
    return next(([x] for x in (custom, env.get(variable, "").strip(), fallback) if x and os.path.isdir(x)), [])


def agent_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage rows of agent sessions: assistant messages with usage; the first of each (time, total) over all files."""
    raw = lines(spark, [folder]).where(F.trim("value") != "").withColumn("o", v.parsed(F.col("value"))).where("o is not null")
    o, u = F.col("o"), "$.message.usage."
    fits = v.is_text(o, "$.type", empty=True) & v.is_text(o, "$.timestamp", required=True, pattern=AGENT_STAMP) & v.is_object(o, "$.message", required=True) & v.is_text(o, "$.message.model", empty=True)
    for c in ("cacheRead", "cacheWrite", "totalTokens", "cost.total"):
        fits = fits & v.is_number(o, u + c)
    kind = F.coalesce(v.text(o, "$.type"), F.lit("message")) == "message"
    has = v.is_number(o, u + "input", required=True) & v.is_number(o, u + "output", required=True)
    rows = raw.where(fits & kind & (v.text(o, "$.message.role") == "assistant") & has)
    zero = lambda p: F.coalesce(v.whole(o, u + p), F.lit(0))
    name = paths.stem(F.col("file_path"))
    session = F.when(name.contains("_"), F.regexp_replace(name, "^[^_]*_", "")).otherwise(name)
    out = rows.select(
        v.text(o, "$.timestamp").alias("ts_raw"), F.try_to_timestamp(v.text(o, "$.timestamp")).alias("ts"), paths.segment_after(F.col("file_path"), "sessions").alias("project"), session.alias("session_id"),
        F.concat(F.lit("[pi] "), v.text(o, "$.message.model")).alias("model"), zero("input").alias("input_tokens"), zero("output").alias("output_tokens"), zero("cacheWrite").alias("cache_creation_tokens"), zero("cacheRead").alias("cache_read_tokens"),
        F.coalesce(v.number(o, u + "cost.total"), F.lit(0.0)).alias("cost"), F.coalesce(v.whole(o, u + "totalTokens"), zero("input") + zero("output") + zero("cacheRead") + zero("cacheWrite")).alias("total_tokens"), "file_path", "line_ord",
    )
    return first_by_key(out, ["ts_raw", "total_tokens"], [F.col("file_path"), F.col("line_ord")])
