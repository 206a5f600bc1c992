"""The readers and reports over small log folders."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from usagemill.operators import blocks as blk
from usagemill.plans import api, output, reports
from usagemill.sources import config, hook, other_logs, paths, prices, usage_log

SONNET, OPUS = "claude-sonnet-4-20250514", "claude-opus-4-20250514"


def row(ts="2025-01-10T10:00:00.000Z", i=100, o=50, model=SONNET, mid=None, req=None, **more):
    message = {"usage": {"input_tokens": i, "output_tokens": o}}
    if model:
        message["model"] = model
    if mid:
        message["id"] = mid
    out = {"timestamp": ts, "message": message}
    if req:
        out["requestId"] = req
    return out | more


def put(root, name, rows):
    path = root / "projects" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")


@pytest.fixture
def engine(spark, tmp_path):
    def make(files, **options):
        for name, rows in files.items():
            put(tmp_path, name, rows)
        return api.Engine(spark, [str(tmp_path)], **options)

    return make


def test_daily_sums_and_order(engine):
    e = engine({"p/s1/a.jsonl": [row("2025-01-10T10:00:00Z", costUSD=0.01), row("2025-01-11T10:00:00Z", costUSD=0.02)], "q/s2/b.jsonl": [row("2025-01-10T23:30:00.000Z", costUSD=0.03)]})
    out = e.daily().collect()
    assert [(r.date, r.input_tokens, round(r.cost, 6)) for r in out] == [("2025-01-11", 100, 0.02), ("2025-01-10", 200, 0.04)]
    assert [r.date for r in e.daily(order="asc").collect()] == ["2025-01-10", "2025-01-11"]
    assert [r.date for r in e.daily(since="20250111").collect()] == ["2025-01-11"]
    assert [(r.project, r.input_tokens) for r in e.daily(project="q").collect()] == [("q", 100)]
    e.zone = "Asia/Tokyo"
    assert {r.date: r.input_tokens for r in e.daily().collect()} == {"2025-01-10": 100, "2025-01-11": 200}


def test_strict_validation(spark, engine):
    good = row(mid="m", req="r", version="1.0.24-x", cwd="", isApiErrorMessage=False)
    bad = [
        "not json", "", "   ", "[1]", json.dumps(good) + " x", {"timestamp": "2025-01-10T10:00:00Z"}, row(costUSD=None), row(version="x"), row(requestId=""), row(ts="2025-01-10 10:00:00"),
        row(ts="2025-01-10T10:00:00.12Z"), row(costUSD="1"), row(isApiErrorMessage="no"), row(i="5"), row(i=None), row(sessionId=5), row(cwd=3),
        {"timestamp": "2025-01-10T10:00:00Z", "message": {"usage": {"input_tokens": 1, "output_tokens": 1, "speed": "slow"}}},
        {"timestamp": "2025-01-10T10:00:00Z", "message": {"usage": {"input_tokens": 1, "output_tokens": 1}, "content": "text"}},
        {"timestamp": "2025-01-10T10:00:00Z", "message": {"usage": {"input_tokens": 1, "output_tokens": 1}, "content": [{"text": 4}]}},
        {"timestamp": "2025-01-10T10:00:00Z", "message": {"usage": {"input_tokens": 1, "output_tokens": 1}, "model": None}},
    ]
    fine = [good, row(model=None), {"timestamp": "2025-01-10T10:00:00Z", "message": {"usage": {"input_tokens": 1.0, "output_tokens": 1, "speed": "fast"}, "content": [{"text": "a"}, {}]}, "extra": None}]
    e = engine({"p/s/a.jsonl": [*bad, *fine]})
    assert usage_log.read(spark, e.roots).count() == len(fine)


def test_dedupe_keeps_the_older_file(spark, engine):
    e = engine({
        "p/s1/a.jsonl": [row("2025-02-01T00:00:00Z"), row("2025-01-15T10:00:00Z", mid="m", req="r", i=1)],
        "p/s2/b.jsonl": [{"timestamp": "2025-01-01T00:00:00Z", "type": "summary"}, row("2025-01-16T10:00:00Z", mid="m", req="r", i=2), row("2025-01-17T10:00:00Z", mid="m", i=3), row("2025-01-17T10:00:00Z", mid="m", i=3)],
    })
    got = usage_log.deduped(usage_log.read(spark, e.roots)).select("input_tokens").collect()
    assert sorted(r.input_tokens for r in got) == [2, 3, 3, 100]


def test_impossible_dates_shadow_and_go(spark, engine):
    e = engine({"p/s/a.jsonl": [row("2025-13-40T10:00:00Z", mid="m", req="r"), row("2025-01-10T10:00:00Z", mid="m", req="r")]})
    assert usage_log.read(spark, e.roots).count() == 2
    assert usage_log.deduped(usage_log.read(spark, e.roots)).count() == 0


def test_cost_modes(engine):
    files = {"p/s/a.jsonl": [row(i=1000, o=100, costUSD=0.5), row(i=1000, o=100), row(i=1000, o=100, costUSD=0), row(i=1000, o=100, model=None)]}
    own = 1000 * 3e-6 + 100 * 15e-6
    for mode, expected in (("auto", 0.5 + own), ("calculate", 3 * own), ("display", 0.5)):
        assert engine(files, mode=mode).daily().first().cost == pytest.approx(expected), mode


def test_display_mode_has_no_price_join(engine):
    plan = engine({"p/s/a.jsonl": [row()]}, mode="display").daily()._jdf.queryExecution().toString()
    assert "input_price" not in plan


def test_synthetic_counts_in_totals_only(engine):
    e = engine({"p/s/a.jsonl": [row(model="<synthetic>", i=7), row(i=5), row(model=None, i=3)]})
    r = e.daily(breakdowns=True).first()
    assert r.input_tokens == 15 and r.models_used == [SONNET]
    assert sorted(b.model for b in r.model_breakdowns) == [SONNET, "unknown"]


def test_fast_rows_are_apart(engine):
    fast = row(i=1000, o=0)
    fast["message"]["usage"]["speed"] = "fast"
    r = engine({"p/s/a.jsonl": [fast, row(i=1000, o=0)]}).daily(breakdowns=True).first()
    assert [(b.model, round(b.cost, 6)) for b in r.model_breakdowns] == [(SONNET + "-fast", 0.018), (SONNET, 0.003)]


def test_sessions(engine):
    e = engine({"p/sub/s1/a.jsonl": [row("2025-01-10T10:00:00Z", version="1.0.2"), row("2025-01-12T10:00:00Z", version="1.0.1")], "p/s2.jsonl": [row("2025-01-11T10:00:00Z")]})
    out = {r.session_id: r for r in e.sessions().collect()}
    assert (out["s1"].project_path, out["s1"].last_activity, out["s1"].versions) == ("p/sub", "2025-01-12", ["1.0.1", "1.0.2"])
    assert out["p"].project_path == "Unknown Project"
    assert [r.session_id for r in e.sessions(since="20250112").collect()] == ["s1"]
    assert e.session("s2").count() == 1


def test_weekly_and_monthly(engine):
    e = engine({"p/s/a.jsonl": [row("2025-01-04T10:00:00Z"), row("2025-01-05T10:00:00Z"), row("2025-02-01T10:00:00Z")]})
    assert [r.week for r in e.weekly(order="asc").collect()] == ["2024-12-29", "2025-01-05", "2025-01-26"]
    assert [r.week for r in e.weekly(order="asc", first_day="monday").collect()] == ["2024-12-30", "2025-01-27"]
    assert [(r.month, r.input_tokens) for r in e.monthly().collect()] == [("2025-02", 100), ("2025-01", 200)]


def test_limit_reset_time(engine):
    said = row(isApiErrorMessage=True)
    said["message"]["content"] = [{"text": "x"}, {"text": f"{usage_log.LIMIT_MARK}|1736510400"}]
    other = row(isApiErrorMessage=False)
    other["message"]["content"] = said["message"]["content"]
    times = [r.reset_ts for r in engine({"p/s/a.jsonl": [said, other]}).usage().collect()]
    assert sorted(times, key=str) == [datetime(2025, 1, 10, 12), None]


def test_two_roots_and_paths_with_spaces(spark, tmp_path):
    for k in (1, 2):
        put(tmp_path / f"root {k}", f"my project+{k}/s/a.jsonl", [row(i=k)])
    e = api.Engine(spark, [str(tmp_path / f"root {k}") for k in (1, 2)])
    assert {r.project: r.input_tokens for r in e.daily(by_project=True).collect()} == {"my project+1": 1, "my project+2": 2}


def test_roots(tmp_path):
    (tmp_path / "a/projects").mkdir(parents=True)
    (tmp_path / ".claude/projects").mkdir(parents=True)
    assert paths.resolve_roots({"CLAUDE_CONFIG_DIR": f"{tmp_path}/a, {tmp_path}/none,{tmp_path}/a"}, str(tmp_path)) == [str(tmp_path / "a")]
    assert paths.resolve_roots({}, str(tmp_path)) == [str(tmp_path / ".claude")]
    with pytest.raises(FileNotFoundError):
        paths.resolve_roots({"CLAUDE_CONFIG_DIR": f"{tmp_path}/none"}, str(tmp_path))


def test_json_output(engine):
    e = engine({"p/s/a.jsonl": [row("2025-01-10T10:00:00Z", costUSD=0.25)], "q/s/a.jsonl": [row("2025-01-10T10:00:00Z", costUSD=0.5)]})
    doc = output.report_json(e.daily(breakdowns=True), "daily")
    assert doc["daily"][0]["inputTokens"] == 200 and doc["totals"]["totalCost"] == 0.75 and doc["daily"][0]["modelBreakdowns"][0]["modelName"] == SONNET
    assert set(output.by_project_json(e.daily(by_project=True))["projects"]) == {"p", "q"}
    none = e.daily(since="20300101")
    assert output.report_json(none, "daily", "list") == [] and output.report_json(none, "daily")["totals"]["totalCost"] == 0 and output.report_json(none, "daily", "null")["totals"] is None
    assert json.loads(output.json_lines(e.daily()).first().value)["totalTokens"] == 300
    shown = output.table([r.asDict() for r in e.daily().collect()], ["date", "input_tokens", "cost"], 90, ["date", "cost"])
    assert "$0.75" in shown and "Input" not in shown
    assert api.TOOLS["daily"](e)["daily"][0]["date"] == "2025-01-10"


def test_status_line(spark, engine, tmp_path):
    e = engine({"p/s9.jsonl": [row("2025-01-10T10:00:00Z", i=1000, o=100, costUSD=1.5), row("2025-01-10T10:30:00Z", i=1000, o=100, costUSD=0.5)]})
    (tmp_path / "t.jsonl").write_text(json.dumps({"type": "assistant", "message": {"usage": {"input_tokens": 2000, "cache_creation_input_tokens": 200, "cache_read_input_tokens": 800}}}) + "\n" + json.dumps({"type": "user", "message": {}}) + "\nbad\n")
    data = {"session_id": "s9", "transcript_path": str(tmp_path / "t.jsonl"), "cwd": "/", "model": {"id": "no-such", "display_name": "Sonnet"}, "workspace": {"current_dir": "/", "project_dir": "/"}}
    line = e.status_line(json.dumps(data), datetime(2025, 1, 10, 11))
    assert line == "🤖 Sonnet | 💰 $2.00 session / $2.00 today / $2.00 block (4h 0m left) | 🔥 $4.00/hr | 🧠 3,000 (2%)"
    idle = e.status_line(json.dumps(data | {"cost": {"total_cost_usd": 0.1}, "context_window": {"total_input_tokens": 10, "context_window_size": 100}}), datetime(2025, 1, 12))
    assert idle == "🤖 Sonnet | 💰 $0.10 session / $0.00 today / No active block | 🧠 10 (10%)"
    with pytest.raises(ValueError):
        hook.parse("{}")


def test_status_cache():
    cache = output.StatusCache(1.0)
    assert cache.get("s", 0, 5) is None
    cache.put("s", 0, 5, "line")
    assert cache.get("s", 0.5, 5) == "line" and cache.get("s", 0.5, 6) is None and cache.get("s", 2, 5) is None
    cache.begin("s")
    assert cache.get("s", 9, 9) == "line"


def test_config(tmp_path):
    (tmp_path / config.NAME).write_text(json.dumps({"defaults": {"mode": "display"}, "commands": {"daily": {"order": "desc"}}}))
    found = config.load(folders=(str(tmp_path / "none"), str(tmp_path)))
    assert config.merge("daily", {"order": None, "zone": "x"}, found) | {} == config.DEFAULTS | {"mode": "display", "order": "desc", "zone": "x"}
    assert config.load(str(tmp_path / "none.json")) is None
    assert config.merge("daily", {})["mode"] == "auto"


def test_mismatches(engine):
    from usagemill.operators import mismatch

    own = 1000 * 3e-6 + 100 * 15e-6
    e = engine({"p/s/a.jsonl": [row(i=1000, o=100, costUSD=own, version="1.0.0"), row(i=1000, o=100, costUSD=2 * own), row(i=1, costUSD=0), row()]})
    s = mismatch.stats(e.mismatches()).first()
    assert (s.total, s.matches, s.mismatches) == (3, 2, 1) and s.avg_percent == pytest.approx(50 / 3)
    assert mismatch.stats(e.mismatches(), "version").count() == 1
    assert mismatch.samples(e.mismatches()).count() == 1


def test_engine_blocks(engine):
    e = engine({"p/s/a.jsonl": [row(f"2025-01-10T{t}:00Z", i=1000, o=0, costUSD=1) for t in ("10:10", "12:00", "15:00", "15:30", "23:00")]})
    now = datetime(2025, 1, 10, 23, 30)
    rows = e.blocks(now, limit="max").orderBy("start", "is_gap").collect()
    assert [(r.start.hour, r.is_gap, r.entries) for r in rows] == [(10, False, 3), (15, False, 1), (20, True, 0), (23, False, 1)]
    assert [r.is_active for r in rows] == [False, False, False, True]
    assert e.blocks(now, active=True).count() == 1 and e.blocks(now, since="20250111").count() == 0
    docs = output.blocks_json(e.blocks(now, limit="100"))["blocks"]
    assert docs[0]["id"] == "2025-01-10T10:00:00.000Z" and docs[0]["burnRate"] is None and docs[0]["tokenCounts"]["inputTokens"] == 3000
    assert "tokenLimitStatus" not in docs[-1] and docs[-1]["isActive"]  # a single entry has no burn rate
    later = output.blocks_json(e.blocks(datetime(2025, 1, 10, 14), limit="100", until="20250110"))["blocks"]
    assert any(b["isActive"] for b in later)


# ---------------------------------------------------------------- other formats


def test_counter_logs(spark, tmp_path):
    use = lambda i, c, o, t: {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": 0, "total_tokens": t}
    event = lambda ts, **info: {"type": "event_msg", "timestamp": ts, "payload": {"type": "token_count", "info": info}}
    (tmp_path / "2025").mkdir()
    lines = [
        {"type": "turn_context", "payload": {"model": "gpt-5"}}, event("2025-09-11T18:25:40.670Z", last_token_usage=use(1200, 200, 500, 1700), total_token_usage=use(1200, 200, 500, 1700)),
        event("2025-09-11T18:40:00.000Z", total_token_usage=use(2000, 300, 800, 2800)), event("2025-09-11T18:41:00Z", total_token_usage=use(2000, 300, 800, 2800)), event("2025-09-11T18:42:00Z", last_token_usage=use(10, 50, 0, 0)),
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": use(1, 1, 1, 2)}}}, {"type": "event_msg", "timestamp": "2025-09-11T18:42:00Z", "payload": {"type": "token_count", "info": None}}, "bad",
    ]
    (tmp_path / "2025/one.jsonl").write_text("\r\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    (tmp_path / "two.jsonl").write_text(json.dumps(event("2025-09-12T00:00:00Z", last_token_usage=use(5, 0, 5, 0))))
    rows = other_logs.counter_events(spark, [str(tmp_path)]).orderBy("ts").collect()
    assert [(r.session_id, r.model, r.is_fallback, r.input_tokens, r.cached_input_tokens, r.output_tokens, r.total_tokens) for r in rows] == [
        ("2025/one", "gpt-5", False, 1200, 200, 500, 1700), ("2025/one", "gpt-5", False, 800, 100, 300, 1100), ("2025/one", "gpt-5", False, 10, 10, 0, 10), ("two", "gpt-5", True, 5, 0, 5, 10)]
    out = api.counter_reports(spark, [str(tmp_path), str(tmp_path / "none")])
    assert out["missing"] == [str(tmp_path / "none")]
    day = out["daily"].first()
    assert day.cost == pytest.approx((1000 + 700) * 1.25e-6 + 310 * 1.25e-7 + 800 * 1e-5)
    assert [(r.session_id, r.directory, r.session_file) for r in out["sessions"].collect()] == [("2025/one", "2025", "one"), ("two", "", "two")]
    assert [r.month for r in out["monthly"].collect()] == ["2025-09"]
    doc = api.TOOLS["counter-daily"](spark, [str(tmp_path)])
    assert doc["totals"]["inputTokens"] == 2015 and doc["daily"][0]["models"]["gpt-5"]["isFallback"] is False and doc["daily"][0]["costUSD"] > 0
    assert api.TOOLS["counter-daily"](spark, [str(tmp_path / "none")]) == {"daily": [], "totals": None}


def test_message_store(spark, tmp_path):
    messages, sessions = tmp_path / "message", tmp_path / "session"
    messages.mkdir(), sessions.mkdir()
    base = {"sessionID": "a", "providerID": "anthropic", "modelID": SONNET, "time": {"created": 1736510400000}, "tokens": {"input": 1000, "output": 0, "cache": {"read": 5, "write": 6}}}
    docs = [base | {"id": "1", "cost": 0}, base | {"id": "1", "cost": 9}, base | {"id": "2", "cost": 0.5, "sessionID": "b"}, base | {"id": "3", "tokens": {"input": 0, "output": 0}}, base | {"id": "4", "modelID": None}, {"id": "5"}]
    docs += [{k: x for k, x in base.items() if k != "providerID"} | {"id": "6"}]
    for k, d in enumerate(docs):
        (messages / f"msg_{k}.json").write_text(json.dumps(d, indent=1))
    for k, d in enumerate([{"id": "a", "title": "A", "parentID": None}, {"id": "b", "parentID": "a"}, {"id": "b", "parentID": "a", "title": "B2"}, {"title": "x"}]):
        (sessions / f"{k}.json").write_text(json.dumps(d))
    out = api.store_reports(spark, str(messages), str(sessions), datetime(2025, 1, 1))
    tree = {r.session_id: r for r in out["sessions"].collect()}
    own = 1000 * 3e-6 + 5 * 3e-7 + 6 * 3.75e-6
    assert tree["a"].cost == pytest.approx(own) and tree["b"].title == "B2" and tree["a"].family_cost == pytest.approx(own + 0.5) and tree["b"].family_size == 2
    assert out["weekly"].first().week == "2025-W02" and out["daily"].first().input_tokens == 2000


def test_thread_ledgers(spark, tmp_path):
    doc = {"id": "T-1", "created": 1, "title": "Hi", "messages": [{"role": "user", "messageId": 2}, {"role": "assistant", "messageId": 2, "usage": {"cacheCreationInputTokens": 500, "cacheReadInputTokens": 200}}],
           "usageLedger": {"events": [{"id": "e", "timestamp": "2025-11-23T10:00:00.000Z", "model": SONNET, "credits": 1.5, "tokens": {"input": 100, "output": 50}, "operationType": "inference", "fromMessageId": 1, "toMessageId": 2}, {"id": "f", "timestamp": "2025-11-24T10:00:00.000Z", "model": SONNET, "credits": 1, "tokens": {"input": 1}, "toMessageId": 9}]}}
    (tmp_path / "T-1.json").write_text(json.dumps(doc))
    (tmp_path / "T-2.json").write_text(json.dumps({"id": "T-2"}))
    (tmp_path / "T-3.json").write_text("{broken")
    out = api.ledger_reports(spark, str(tmp_path))
    t = out["threads"].collect()
    assert [(r.thread_id, r.title, r.input_tokens, r.total_tokens, r.credits, r.cache_creation_tokens) for r in t] == [("T-1", "Hi", 101, 151, 2.5, 500)]
    assert [r.date for r in out["daily"].collect()] == ["2025-11-23", "2025-11-24"] and out["monthly"].first().month == "2025-11"
    assert t[0].cost == pytest.approx(101 * 3e-6 + 50 * 15e-6 + 500 * 3.75e-6 + 200 * 3e-7)


def test_agent_sessions(spark, tmp_path):
    folder = tmp_path / "sessions" / "proj"
    folder.mkdir(parents=True)
    use = {"input": 10, "output": 5, "cacheRead": 2, "cacheWrite": 1, "cost": {"total": 0.25}}
    say = lambda ts, role="assistant", **more: {"timestamp": ts, "message": {"role": role, "model": "m", "usage": use}} | more
    rows = [say("2025-01-10T10:00:00Z"), say("2025-01-10T10:00:00Z"), say("2025-01-10T23:00:00-05:00", type="message"), say("2025-01-10T11:00:00Z", role="user"), say("2025-01-10T12:00:00Z", type="other"), {"timestamp": "x"}]
    (folder / "2025_abc_d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = api.agent_reports(spark, str(tmp_path / "sessions"))
    assert [(r.date, r.input_tokens, r.cost, r.models_used) for r in out["daily"].collect()] == [("2025-01-11", 10, 0.25, ["[pi] m"]), ("2025-01-10", 10, 0.25, ["[pi] m"])]
    assert [(r.project, r.session_id, r.last_activity) for r in out["sessions"].collect()] == [("proj", "abc_d", "2025-01-11")]
    assert other_logs.agent_root(str(tmp_path)) == [str(tmp_path)] and other_logs.agent_root(None, {}, default=str(tmp_path / "none")) == []


def test_price_rows():
    table = {"a": {"input_cost_per_token": 1e-6, "provider_specific_entry": {"fast": 2}}, "b": {"input_cost_per_token": "x"}, "c": 5, "d": {}}
    assert [(r["name"], r["fast"]) for r in prices.price_rows(table)] == [("a", 2.0), ("d", None)]
    assert [r["name"] for r in prices.price_rows(table, ("d",))] == ["d"]


def test_price_fallback(spark):
    def fails():
        raise OSError

    assert prices.load(spark, fails).count() == prices.load(spark).count() > 0


# ---------------------------------------------------------------- blocks against a plain loop


def greedy(times, hours):
    out, start, length = [], None, round(hours * 3_600_000_000)
    for t in sorted(times):
        if start is None or t - start > length:
            start = t - t % 3_600_000_000
            out.append([])
        out[-1].append(t)
    return [(b[0], b[-1], len(b)) for b in out]


@pytest.mark.parametrize("hours", [5.0, 2.5, 1.0, 24.0, 0.5, 0.25, 1 / 3])
def test_blocks_match_a_loop(spark, hours):
    import random

    rnd = random.Random(7)
    base = 1_736_500_000_000_000
    times = [base + rnd.randrange(0, 200) * 900_000_000 + rnd.choice([0, 0, 1, 500_000]) for _ in range(250)]
    times += [base - base % 3_600_000_000 + k * 3_600_000_000 for k in (0, 5, 10, 100, 105, 106)]
    if hours < 1:  # entries at the same instant share a block
        times = sorted(set(times))
    rows = [(t, "m", 1, 1, 1, 1, 0.5) for t in times]
    df = spark.createDataFrame(rows, "t long, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost double").withColumn("ts", F.timestamp_micros("t"))
    found = blk.blocks(df, datetime(2025, 2, 1), hours, gaps=True).withColumns({"a": F.unix_micros("first_ts"), "b": F.unix_micros("actual_end")}).collect()
    expected = greedy(times, hours)
    assert sorted((r.a, r.b, r.entries) for r in found if not r.is_gap) == expected
    length = round(hours * 3_600_000_000)
    gaps = [(x[1] + length, y[0]) for x, y in zip(expected, expected[1:]) if y[0] - x[1] > length]
    micros = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert sorted((micros(r.start), micros(r.end)) for r in found if r.is_gap) == gaps


def test_block_details(spark):
    t = datetime(2025, 1, 10, 10, 10)
    rows = [(t, "b", 100, 100, 0, 0, 1.0, None), (datetime(2025, 1, 10, 11, 10), "a", 200, 200, 0, 600, None, datetime(2025, 1, 10, 15)), (None, "z", 1, 1, 1, 1, 1.0, None)]
    df = spark.createDataFrame(rows, "ts timestamp, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost_usd double, reset_ts timestamp")
    now = datetime(2025, 1, 10, 12, 0)
    r = blk.with_limit_status(blk.with_projection(blk.with_burn_rate(blk.blocks(df, now)), now), 4000).first()
    assert (r.models, r.reset_ts, r.is_active, r.tokens_per_minute, r.indicator, r.cost_per_hour) == (["b", "a"], datetime(2025, 1, 10, 15), True, 20.0, 10.0, 1.0)
    assert (r.projected_tokens, r.projected_cost, r.remaining_minutes, r.limit_status) == (4800, 4.0, 180, "exceeds")
    assert blk.blocks(df.limit(0), now).count() == 0
    one = blk.with_burn_rate(blk.blocks(df.limit(1), now)).first()
    assert one.tokens_per_minute is None
    assert [blk.token_limit(x, 7) for x in ("max", None, "5", "x")] == [7, 7, 5, None] and blk.token_limit("max", 0) is None


def test_report_is_lazy_and_compact(spark):
    """Costs come before grouping and one partial aggregate feeds sums, models and breakdowns."""
    from usagemill.plans import catalog

    plan = reports.daily(catalog.costed(spark, "/root/testdata/sf0.001"), breakdowns=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 0


def test_session_breakdowns_agree(engine):
    e = engine({"p/sub/s1/a.jsonl": [row("2025-01-10T10:00:00Z", version="1.0.2"), row("2025-01-12T10:00:00Z", version="1.0.1", model=OPUS), row("2025-01-11T10:00:00Z", version="1.0.1")]})
    plain, full = e.sessions().first(), e.sessions(breakdowns=True).first()
    assert all(plain[c] == full[c] for c in ("last_activity", "versions", "input_tokens", "total_tokens")) and full.last_activity == "2025-01-12"
    assert full.models_used == [SONNET, OPUS] and [b.model for b in full.model_breakdowns] == [OPUS, SONNET]
