"""Queries that read log files through the sources; the files are written from the generic tables first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counters
from ..sources import other_logs, usage_log
from . import oracle as o
from . import sample_logs, samples
from .catalog import _counter_rows, query

_BAD = "line_ord % 41 = 0 OR line_ord % 53 = 0"
#: Rows that pass the checks, by file; a file's time is that of its earliest JSON line.
LOGS = f"""{o.USAGE}, lined AS (SELECT * EXCLUDE (file_ts), date_trunc('milliseconds', ts) AS told_at, project || '/' || session_id || '/' || file_path AS file FROM usage),
 timed AS (SELECT *, min(CASE WHEN NOT ({_BAD}) THEN told_at END) OVER (PARTITION BY file) AS file_ts FROM lined),
 logged AS (SELECT * FROM timed WHERE NOT ({_BAD} OR line_ord % 43 = 0 OR line_ord % 47 = 0 OR line_ord % 59 = 0))"""
_ROW = "ts_raw, project, project_path, session_id, message_id, request_id, model, speed, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, cost_usd, version, file_ts"
_SUMS = "count(*) AS entries, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens"


def _sums(rows, *keys):
    return rows.groupBy(*keys).agg(F.count("*").alias("entries"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")])


def _read(spark, sf_dir, **options):
    return usage_log.read(spark, [sample_logs.usage_logs(spark, sf_dir)], **options)


@query(f"WITH {LOGS} SELECT {_ROW} FROM logged")
def log_rows(spark, sf_dir):
    return _read(spark, sf_dir).select(*_ROW.split(", "))


@query(f"WITH {LOGS}, d AS (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY file_ts NULLS LAST, file, line_ord) AS n FROM logged) SELECT project, {_SUMS} FROM d WHERE message_id IS NULL OR n = 1 GROUP BY project")
def log_deduped(spark, sf_dir):
    return _sums(usage_log.deduped(_read(spark, sf_dir)), "project")


@query(f"WITH {LOGS} SELECT project, session_id, {_SUMS} FROM logged WHERE project = 'p3' GROUP BY ALL")
def log_project(spark, sf_dir):
    return _sums(_read(spark, sf_dir, project="p3"), "project", "session_id")


@query(f"WITH {LOGS} SELECT ts_raw, session_id, input_tokens, output_tokens, model FROM logged WHERE file = (SELECT min(file) FROM lined WHERE file_path = 'f7')")
def session_by_id(spark, sf_dir):
    """Rows of one session's file, repeated requests included."""
    rows = usage_log.session_by_id(spark, [sample_logs.usage_logs(spark, sf_dir)], "f7")
    return rows.select("ts_raw", "session_id", "input_tokens", "output_tokens", "model")


@query(f"WITH {LOGS} SELECT project, count(*) AS n, min(reset_ts) AS first_reset, max(reset_ts) AS last_reset FROM (SELECT project, date_trunc('second', reset_ts) AS reset_ts FROM logged) WHERE reset_ts IS NOT NULL GROUP BY project")
def limit_resets(spark, sf_dir):
    rows = _read(spark, sf_dir).where("reset_ts is not null")
    return rows.groupBy("project").agg(F.count("*").alias("n"), F.min("reset_ts").alias("first_reset"), F.max("reset_ts").alias("last_reset"))


@query(f"WITH {LOGS}, f AS (SELECT DISTINCT file, file_ts FROM timed) SELECT file, file_ts, row_number() OVER (ORDER BY file_ts NULLS LAST, file) AS place FROM f")
def file_order(spark, sf_dir):
    raw = usage_log.lines(spark, [sample_logs.usage_logs(spark, sf_dir) + "/projects"])
    files = usage_log.file_times(raw).withColumn("file", F.regexp_extract("file_path", r"([^/]+/[^/]+/[^/]+)\.jsonl$", 1))
    return files.select("file", "file_ts", F.row_number().over(Window.orderBy(F.col("file_ts").asc_nulls_last(), "file")).cast("long").alias("place"))


@query("SELECT (length(text) + turn * 4)::BIGINT AS context_tokens FROM conversations WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 1")
def context_tokens(spark, sf_dir):
    """The last assistant row of a transcript."""
    return usage_log.context_tokens(spark, sample_logs.transcript(spark, sf_dir))


@query(f"WITH {o.deltas()} SELECT session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_raw, model, is_fallback, input_tokens, cached_input_tokens, output_tokens, reasoning_output_tokens FROM events2")
def counter_log(spark, sf_dir):
    root = sample_logs.counter_logs(_counter_rows(spark, sf_dir))
    return other_logs.counter_events(spark, [f"{root}/counters"]).select("session_id", "ts_raw", "model", "is_fallback", *counters.FIELDS[:4])


@query("""WITH c AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), m AS (SELECT *, row_number() OVER (PARTITION BY k // 2 ORDER BY 's' || n, k) AS place FROM c WHERE k % 3 <> 0 AND k % 13 <> 0)
 SELECT 'm' || (k // 2) AS message_id, make_timestamp(k * 1000000) AS ts, CASE WHEN k % 11 <> 0 THEN 's' || n ELSE 'unknown' END AS session_id, 'model-' || (n % 4) AS model, (k % 3 * 10)::BIGINT AS input_tokens, (k % 3 * 7)::BIGINT AS output_tokens,
 (CASE WHEN k % 2 = 0 THEN k % 7 ELSE 0 END)::BIGINT AS cache_creation_tokens, (k % 5)::BIGINT AS cache_read_tokens, k / 8 AS cost_usd FROM m WHERE place = 1""")
def store_log(spark, sf_dir):
    found = other_logs.store_messages(spark, sample_logs.store_messages(spark, sf_dir) + "/message", samples.NOW)
    return found.drop("provider", "file_path", "line_ord")


@query("SELECT 's' || n_nationkey AS session_id, CASE WHEN n_nationkey % 5 <> 0 THEN 's' || (n_nationkey - n_nationkey % 5) END AS parent_id, CASE WHEN n_nationkey % 7 <> 0 THEN n_name ELSE 's' || n_nationkey END AS title, 'p' || n_regionkey AS project, 'unknown' AS directory FROM nation")
def store_session_log(spark, sf_dir):
    return other_logs.store_sessions(spark, sample_logs.store_sessions(spark, sf_dir) + "/session")


@query("""WITH e AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant')
 SELECT 'T-' || e.conv_id AS thread_id, CASE WHEN e.conv_id % 4 <> 0 THEN 'Talk ' || e.conv_id ELSE 'Untitled' END AS title, '2024-01-' || lpad((e.conv_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00.000Z' AS ts_raw, 'model-a' AS model, e.n / 8 AS credits, 'unknown' AS operation,
 e.n::BIGINT AS input_tokens, (e.n + 1)::BIGINT AS output_tokens, coalesce(a.n, 0)::BIGINT AS cache_creation_tokens, coalesce(a.n * 2, 0)::BIGINT AS cache_read_tokens, (e.n * 2 + 1)::BIGINT AS total_tokens FROM e LEFT JOIN a ON a.conv_id = e.conv_id AND a.turn = e.turn + 1""")
def nested_ledger(spark, sf_dir):
    """Ledger events of thread documents with the cache tokens of the message they lead to, and the thread's title."""
    found = other_logs.threads(spark, sample_logs.thread_documents(spark, sf_dir) + "/threads")
    titles = found.select("thread_id", "title")
    return other_logs.ledger_events(found).drop("ts").join(titles, "thread_id")


@query(f"""WITH {o.USAGE}, a AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS said, CASE WHEN line_ord % 3 = 0 THEN input_tokens ELSE input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens END AS total, 's' || (user_id % 20) AS sid FROM usage WHERE line_ord % 31 <> 0 AND line_ord % 9 <> 0),
 d AS (SELECT *, row_number() OVER (PARTITION BY said, total ORDER BY project || '/t1_' || sid || '.jsonl', line_ord) AS n FROM a)
 SELECT said AS ts_raw, project, sid AS session_id, '[pi] ' || model AS model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, coalesce(cost_usd, 0) AS cost, total::BIGINT AS total_tokens FROM d WHERE n = 1""")
def agent_log(spark, sf_dir):
    return other_logs.agent_usage(spark, sample_logs.agent_logs(spark, sf_dir) + "/sessions").drop("ts", "file_path", "line_ord")
