"""Streams against the batch results, and the command line."""

import io
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from usagemill import __main__ as cli
from usagemill.operators import blocks as blk
from usagemill.sources import usage_log
from usagemill.streaming import usage_stream

SONNET = "claude-sonnet-4-20250514"


def say(ts, i=10, mid=None, req=None, cost=0.5):
    message = {"usage": {"input_tokens": i, "output_tokens": 1}, "model": SONNET}
    if mid:
        message["id"] = mid
    out = {"timestamp": ts.strftime("%Y-%m-%dT%H:%M:%S.000Z"), "message": message, "costUSD": cost}
    return out | ({"requestId": req} if req else {})


@pytest.fixture
def logs(tmp_path):
    rnd, start = random.Random(3), datetime(2025, 1, 1)
    times = sorted(start + timedelta(minutes=rnd.randrange(0, 5 * 24 * 60)) for _ in range(150))
    folder = tmp_path / "projects" / "p" / "s"
    folder.mkdir(parents=True)
    for k in range(0, 150, 30):
        rows = [say(t, i=n, mid=f"m{n}", req="r") for n, t in enumerate(times[k : k + 30], k)]
        rows += rows[:3]
        rnd.shuffle(rows)
        path = folder / f"{k:03d}.jsonl"
        path.write_text("\n".join(map(json.dumps, rows)) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # a stream takes older files first
    return tmp_path


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_days_match_batch(spark, logs):
    rows = usage_stream.deduped(usage_stream.rows(spark, f"{logs}/projects", 1), "10 days")
    got = drain(usage_stream.daily(rows), "days", "append")
    batch = usage_log.deduped(usage_log.read(spark, [str(logs)])).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.sum("input_tokens").alias("i"), F.count("*").alias("n"))
    expected = {r.date: (r.i, r.n) for r in batch.collect()}
    assert all(expected[r.date] == (r.input_tokens, r.entries) for r in got.collect())


def test_stream_dedupes(spark, logs):
    rows = usage_stream.deduped(usage_stream.rows(spark, f"{logs}/projects", 1), "10 days")
    assert drain(rows, "deduped", "append").count() == 150


def test_stream_blocks_match_batch(spark, logs):
    stream = usage_stream.rows(spark, f"{logs}/projects", 1).where("message_id is not null").withWatermark("ts", "1 day")
    got = {r.first_ts: r for r in drain(usage_stream.blocks(stream), "closed", "append").collect()}
    usage = usage_log.read(spark, [str(logs)])
    batch = blk.blocks(usage, datetime(2025, 2, 1), gaps=False).collect()
    assert got
    for r in batch:
        if r.first_ts in got:
            g = got[r.first_ts]
            assert (g.start, g.last_ts, g.entries, g.input_tokens) == (r.start, r.actual_end, r.entries, r.input_tokens)
    closed = [r for r in batch if r.end < datetime(2025, 1, 3)]
    assert closed and all(r.first_ts in got for r in closed)


def test_command_line(spark, logs):
    daily = json.loads(cli.main(["daily", "--root", str(logs), "--json", "--mode", "display"], spark))
    assert [r["date"] for r in daily["daily"]] == sorted(r["date"] for r in daily["daily"]) and daily["totals"]["totalCost"] == pytest.approx(75)
    assert json.loads(cli.main(["daily", "--root", str(logs), "--json", "--since", "20300101"], spark)) == []
    assert json.loads(cli.main(["monthly", "--root", str(logs), "--json", "--since", "20300101"], spark))["totals"]["inputTokens"] == 0
    assert "p" in json.loads(cli.main(["daily", "--root", str(logs), "--json", "--instances"], spark))["projects"]
    assert json.loads(cli.main(["session", "--root", str(logs), "--json"], spark))["sessions"][0]["sessionId"] == "s"
    one = json.loads(cli.main(["session", "--root", str(logs), "--json", "--id", "000"], spark))
    assert one["totalCost"] == pytest.approx(16.5) and len(one["entries"]) == 33
    blocks = json.loads(cli.main(["blocks", "--root", str(logs), "--json", "--now", "2025-01-05T23:59:00", "--recent"], spark))["blocks"]
    assert blocks and all(b["startTime"] >= "2025-01-02" for b in blocks)
    assert "+--" in cli.main(["weekly", "--root", str(logs), "--first-day", "monday", "--width", "90"], spark)
    hook = {"session_id": "none", "transcript_path": "/none", "cwd": "/", "model": {"id": "no-such", "display_name": "M"}, "workspace": {"current_dir": "/", "project_dir": "/"}}
    assert cli.main(["statusline", "--root", str(logs), "--now", "2026-01-01"], spark, io.StringIO(json.dumps(hook))) == "🤖 M | 💰 N/A session / $0.00 today / No active block | 🧠 N/A"
