"""Assistant usage logs: JSON lines below <root>/projects/<project>/**, as the canonical usage frame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paths
from . import variants as v

#: The log format's times, versions and limit message.
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"
VERSION = r"^\d+\.\d+\.\d+"
LIMIT_MARK = "Claude AI usage limit reached"

COLUMNS = (
    "ts", "ts_raw", "project", "project_path", "session_id", "message_id", "request_id", "model", "speed", "input_tokens", "output_tokens",
    "cache_creation_tokens", "cache_read_tokens", "cost_usd", "version", "reset_ts", "file_path", "file_ts", "line_ord",
)


def lines(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl", whole: bool = False) -> DataFrame:
    """(value, file_path, file_time, line_ord) of every line (or whole file) below the roots."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    df = read.text(list(roots), wholetext=whole).select("value", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_block_start").alias("begin"))
    order = F.struct("begin", F.monotonically_increasing_id().alias("id"))
    return df.select("value", paths.plain_path(F.col("file_path")).alias("file_path"), "file_time", order.alias("line_ord"))


def valid(o: Column) -> Column:
    """Whether a parsed line is a usage row; optional fields may be absent but not null or of another type."""
    texts = F.try_variant_get(o, "$.message.content", "array<variant>")
    items = F.forall(texts, lambda x: F.schema_of_variant(x).startswith("OBJECT") & F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.lit(True)))
    speed = F.coalesce((v.kind(o, "$.message.usage.speed") == "STRING") & v.text(o, "$.message.usage.speed").isin("standard", "fast"), F.lit(True))
    return (
        v.is_text(o, "$.timestamp", required=True, pattern=STAMP)
        & v.is_object(o, "$.message", required=True) & v.is_object(o, "$.message.usage", required=True)
        & v.is_number(o, "$.message.usage.input_tokens", required=True) & v.is_number(o, "$.message.usage.output_tokens", required=True)
        & v.is_number(o, "$.message.usage.cache_creation_input_tokens") & v.is_number(o, "$.message.usage.cache_read_input_tokens") & speed
        & v.is_text(o, "$.message.model") & v.is_text(o, "$.message.id") & v.is_array(o, "$.message.content") & F.coalesce(items, F.lit(True))
        & v.is_text(o, "$.cwd", empty=True) & v.is_text(o, "$.sessionId") & v.is_text(o, "$.requestId") & v.is_text(o, "$.version", pattern=VERSION)
        & v.is_number(o, "$.costUSD") & v.is_boolean(o, "$.isApiErrorMessage")
    )


def reset_time(o: Column) -> Column:
    """When a usage limit ends: the seconds after | in the first marked text of an error row."""
    texts = F.transform(F.try_variant_get(o, "$.message.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string"))
    said = F.get(F.filter(texts, lambda t: t.contains(LIMIT_MARK)), F.lit(0))
    seconds = F.try_to_number(F.regexp_extract(said, r"\|(\d{1,12})", 1), F.lit("999999999999")).cast("long")
    return F.when(v.text(o, "$.isApiErrorMessage") == "true", F.when(seconds > 0, F.timestamp_seconds(seconds)))


def file_times(raw: DataFrame) -> DataFrame:
    """(file_path, file_ts): the earliest time in any JSON line of a file, valid row or not."""
    seen = F.try_to_timestamp(F.get_json_object("value", "$.timestamp"))
    return raw.groupBy("file_path").agg(F.min(seen).alias("file_ts"))


def read(spark: SparkSession, roots: list[str], project: str | None = None, session_from: str = "dir", pattern: str = "*.jsonl") -> DataFrame:
    """The canonical usage frame, before dedupe. A project restricts the files that are read.

    session_from: dir takes the name of the file's folder as the session, stem the file's own name. Times that pass the pattern
    but aren't real stay, with a null ts: they take part in dedupe and are dropped after it.
    """
    raw = lines(spark, [f"{r.rstrip('/')}/projects" for r in roots], pattern).where(F.trim("value") != "")
    raw = raw.withColumn("project", paths.segment_after(F.col("file_path"), "projects"))
    if project is not None:
        raw = raw.where(F.col("project") == project)
    rows = raw.withColumn("o", v.parsed(F.col("value"))).where(F.col("o").isNotNull())
    rows = rows.where(valid(F.col("o")))
    o, below = F.col("o"), paths.below_root(F.col("file_path"), "projects")
    inner = F.array_join(F.slice(below, F.lit(1), F.greatest(F.lit(0), F.size(below) - 2)), "/")
    session = paths.parent_name(F.col("file_path")) if session_from == "dir" else paths.stem(F.col("file_path"))
    usage = "$.message.usage."
    out = rows.select(
        F.try_to_timestamp(v.text(o, "$.timestamp")).alias("ts"), v.text(o, "$.timestamp").alias("ts_raw"), "project",
        F.when(inner != "", inner).otherwise(F.lit("Unknown Project")).alias("project_path"), session.alias("session_id"),
        v.text(o, "$.message.id").alias("message_id"), v.text(o, "$.requestId").alias("request_id"), v.text(o, "$.message.model").alias("model"), v.text(o, usage + "speed").alias("speed"),
        v.whole(o, usage + "input_tokens").alias("input_tokens"), v.whole(o, usage + "output_tokens").alias("output_tokens"),
        F.coalesce(v.whole(o, usage + "cache_creation_input_tokens"), F.lit(0)).alias("cache_creation_tokens"), F.coalesce(v.whole(o, usage + "cache_read_input_tokens"), F.lit(0)).alias("cache_read_tokens"),
        v.number(o, "$.costUSD").alias("cost_usd"), v.text(o, "$.version").alias("version"), reset_time(o).alias("reset_ts"), "file_path", "line_ord",
    )
    times = file_times(raw).withColumnRenamed("file_path", "_f")
    return out.join(times, F.col("file_path") == F.col("_f"), "left").drop("_f").select(*COLUMNS)


def deduped(usage: DataFrame) -> DataFrame:
    """First request of each key, then rows with a real time."""
    from ..operators.dedupe import first_request

    return first_request(usage).where("ts is not null")


def session_by_id(spark: SparkSession, roots: list[str], session: str) -> DataFrame:
    """Usage rows of the first file named <session>.jsonl, without dedupe; files of other names aren't read."""
    pattern = re.sub(r"([*?\[\]{}\\])", r"\\\1", session) + ".jsonl"
    usage = read(spark, roots, pattern=pattern)
    files = lines(spark, [f"{r.rstrip('/')}/projects" for r in roots], pattern)
    first = files.agg(F.min("file_path").alias("_first"))  # one row
    return usage.join(F.broadcast(first), F.col("file_path") == F.col("_first"), "left_semi").select(*COLUMNS)


def context_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(context_tokens) of a transcript's last assistant row with input tokens: input and both kinds of cache tokens."""
    raw = lines(spark, [path], "*").withColumn("o", v.parsed(F.col("value"))).where("o is not null")
    o, u = F.col("o"), "$.message.usage."
    fits = v.is_text(o, "$.type", empty=True) & v.is_object(o, "$.message") & v.is_object(o, "$.message.usage")
    for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"):
        fits = fits & v.is_number(o, u + c)
    live = raw.where(fits & (v.text(o, "$.type") == "assistant") & v.is_number(o, u + "input_tokens", required=True))
    total = v.whole(o, u + "input_tokens") + F.coalesce(v.whole(o, u + "cache_creation_input_tokens"), F.lit(0)) + F.coalesce(v.whole(o, u + "cache_read_input_tokens"), F.lit(0))
    return live.agg(F.max_by(total, F.col("line_ord")).alias("context_tokens")).where("context_tokens is not null")
