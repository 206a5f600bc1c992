"""Log files of every format, written from the generic test tables, so that queries read them through the sources."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.usage_log import LIMIT_MARK
from . import samples


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a folder under /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/usagemill-logs"


def written(lines: DataFrame, suffix: str = ".jsonl") -> str:
    """Write (folder, stem, ord, value) as files <folder>/<stem><suffix> below a fresh folder, which goes when the driver ends.

    Executors write the text, a file's lines in one task; the driver only renames the files.
    """
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    raw = lines.repartition("folder", "stem").sortWithinPartitions("folder", "stem", "ord").select("folder", "stem", "value")
    raw.write.partitionBy("folder", "stem").text(f"{root}/raw")
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(path(root))
    files = system.listFiles(path(f"{root}/raw"), True)
    while files.hasNext():
        at = files.next().getPath()
        if not at.getName().startswith("part-"):
            continue
        stem = unquote(at.getParent().getName().partition("=")[2])
        folder = unquote(at.getParent().getParent().getName().partition("=")[2])
        system.mkdirs(path(f"{root}/{folder}"))
        system.rename(at, path(f"{root}/{folder}/{stem}{suffix}"))
    system.delete(path(f"{root}/raw"), True)
    return root


def _text(p: str, x: Column) -> Column:
    return F.concat(F.lit(p), x.cast("string"))


def usage_logs(spark: SparkSession, sf_dir: str) -> str:
    """The sample usage rows as projects/<project>/<session>/<file>.jsonl, with bad, blank and invalid lines; the root folder."""
    rows = samples.usage(spark, sf_dir)
    i, u = F.col("line_ord"), F.col("user_id")
    limit = i % 400 == 0
    said = F.array(F.struct(F.concat(F.lit(LIMIT_MARK + "|"), (F.unix_timestamp("ts") + 10_800).cast("string")).alias("text")))
    usage = F.struct("input_tokens", F.when(i % 43 != 0, F.col("output_tokens")).alias("output_tokens"), F.col("cache_creation_tokens").alias("cache_creation_input_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"), "speed")
    message = F.struct(F.col("message_id").alias("id"), "model", usage.alias("usage"), F.when(limit, said).alias("content"))
    line = F.to_json(F.struct(
        F.col("ts_raw").alias("timestamp"), F.col("session_id").alias("sessionId"), F.when(i % 59 == 0, "one").otherwise(F.col("version")).alias("version"), F.col("cost_usd").alias("costUSD"),
        F.col("request_id").alias("requestId"), F.when(limit, F.lit(True)).alias("isApiErrorMessage"), message.alias("message"),
    ))
    value = F.when(i % 41 == 0, "{not json").when(i % 53 == 0, "   ").when(i % 47 == 0, F.regexp_replace(line, r"\}$", ',"cwd":null}')).otherwise(line)
    folder = F.concat(F.lit("projects/"), _text("p", u % 10), F.lit("/"), _text("s", u % 50))
    return written(rows.select(folder.alias("folder"), _text("f", u % 20).alias("stem"), i.alias("ord"), value.alias("value")))


def counter_logs(counted: DataFrame) -> str:
    """Rows of cumulative counters (session_id, line_ord, ts, kind, model, last, total) as counters/<session>.jsonl."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    info = F.struct(F.col("total").alias("total_token_usage"), F.col("last").alias("last_token_usage"), "model")
    told = F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp, F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    model = F.to_json(F.struct(F.lit("turn_context").alias("type"), stamp, F.struct("model").alias("payload")))
    value = F.when(F.col("kind") == "model", model).otherwise(told)
    return written(counted.select(F.lit("counters").alias("folder"), F.col("session_id").alias("stem"), F.col("line_ord").alias("ord"), value.alias("value")))


def transcript(spark: SparkSession, sf_dir: str) -> str:
    """All turns of all conversations as one transcript; its path."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.char_length("text").cast("long")
    usage = F.struct(n.alias("input_tokens"), (n * 2).alias("output_tokens"), F.col("turn").alias("cache_creation_input_tokens"), (F.col("turn") * 3).alias("cache_read_input_tokens"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(usage.alias("usage")).alias("message")))
    return written(rows.select(F.lit("chat").alias("folder"), F.lit("all").alias("stem"), F.struct("conv_id", "turn").alias("ord"), line.alias("value"))) + "/chat/all.jsonl"


def store_messages(spark: SparkSession, sf_dir: str) -> str:
    """A message for each supplier, one JSON document for each file message/<session>/msg_<number>.json."""
    c = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    tokens = F.struct((k % 3 * 10).alias("input"), (k % 3 * 7).alias("output"), F.struct((k % 5).alias("read"), F.when(k % 2 == 0, k % 7).alias("write")).alias("cache"))
    found = F.struct(_text("m", F.floor(k / 2)).alias("id"), F.when(k % 11 != 0, _text("s", n)).alias("sessionID"), F.lit("maker").alias("providerID"), F.when(k % 13 != 0, _text("model-", n % 4)).alias("modelID"), F.struct((k * 1000).alias("created")).alias("time"), tokens.alias("tokens"), (k / 8).alias("cost"))
    return written(c.select(F.concat(F.lit("message/"), _text("s", n)).alias("folder"), F.concat(F.lit("msg_"), F.lpad(k.cast("string"), 9, "0")).alias("stem"), k.alias("ord"), F.to_json(found).alias("value")), ".json")


def store_sessions(spark: SparkSession, sf_dir: str) -> str:
    """A session for each nation, one JSON document for each file session/<project>/<session>.json."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n = F.col("n_nationkey")
    session = F.struct(_text("s", n).alias("id"), F.when(n % 5 != 0, _text("s", n - n % 5)).alias("parentID"), F.when(n % 7 != 0, F.col("n_name")).alias("title"), _text("p", F.col("n_regionkey")).alias("projectID"))
    return written(nations.select(F.concat(F.lit("session/"), _text("p", F.col("n_regionkey"))).alias("folder"), _text("s", n).alias("stem"), n.alias("ord"), F.to_json(session).alias("value")), ".json")


def thread_documents(spark: SparkSession, sf_dir: str) -> str:
    """A thread document for each conversation: its turns as messages, and a ledger event for each turn of the user."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.char_length("text")
    usage = F.when(F.col("role") == "assistant", F.struct(F.lit("model-a").alias("model"), n.alias("cacheCreationInputTokens"), (n * 2).alias("cacheReadInputTokens")))
    message = F.struct("turn", F.struct("role", F.col("turn").alias("messageId"), usage.alias("usage")).alias("m"))
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00.000Z"))
    event = F.struct("turn", F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), stamp.alias("timestamp"), F.lit("model-a").alias("model"), (n / 8).alias("credits"), F.struct(n.alias("input"), (n + 1).alias("output")).alias("tokens"), (F.col("turn") + 1).alias("toMessageId")).alias("e"))
    docs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", event))).alias("e"))
    body = F.struct(_text("T-", F.col("conv_id")).alias("id"), F.when(F.col("conv_id") % 4 != 0, _text("Talk ", F.col("conv_id"))).alias("title"), F.transform("m", lambda x: x["m"]).alias("messages"), F.struct(F.transform("e", lambda x: x["e"]).alias("events")).alias("usageLedger"))
    return written(docs.select(F.lit("threads").alias("folder"), _text("T-", F.col("conv_id")).alias("stem"), F.lit(0).alias("ord"), F.to_json(body).alias("value")), ".json")


def agent_logs(spark: SparkSession, sf_dir: str) -> str:
    """The sample usage rows as sessions/<project>/<time>_<session>.jsonl of an agent, users' turns and other kinds between them."""
    rows = samples.usage(spark, sf_dir)
    i, u = F.col("line_ord"), F.col("user_id")
    total = F.when(i % 3 == 0, F.col("input_tokens"))
    usage = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read_tokens").alias("cacheRead"), F.col("cache_creation_tokens").alias("cacheWrite"), total.alias("totalTokens"), F.struct(F.col("cost_usd").alias("total")).alias("cost"))
    role = F.when(i % 9 == 0, "user").otherwise("assistant")
    line = F.to_json(F.struct(F.when(i % 31 == 0, "session").when(i % 4 != 0, "message").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(role.alias("role"), "model", usage.alias("usage")).alias("message")))
    return written(rows.select(F.concat(F.lit("sessions/"), _text("p", u % 10)).alias("folder"), _text("t1_s", u % 20).alias("stem"), i.alias("ord"), line.alias("value")))
