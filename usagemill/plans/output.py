"""JSON reports, per-project maps, tables and the status line. Only reports, which are aggregates, are collected."""

from __future__ import annotations

import json
import math
import subprocess
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, currency, half_up, with_separators
from ..functions.dates import hours_minutes
from . import reports


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


#: Names in JSON documents that differ from the columns'.
REPORT = {"cost": "totalCost"}
BREAKDOWN = {"model": "modelName"}
COUNTER = {"cost": "costUSD", "session_file": "sessionFile"}
ENTRY = {"ts_raw": "timestamp", "cost_usd": "costUSD"}


def plain(value, names: dict | None = None):
    """JSON-ready form of a collected value; names are those of its own fields, breakdowns have theirs."""
    names = names or {}
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if hasattr(value, "asDict"):
        return {names.get(k, camel(k)): plain(x, BREAKDOWN if k == "model_breakdowns" else None) for k, x in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    if isinstance(value, list):
        return [plain(x, names) for x in value]
    return value


def _totals(rows: list, names: dict) -> dict:
    """reports.totals() of collected rows, so that the report's plan runs once."""
    whole = {c: sum(r[c] or 0 for r in rows) for c in (*reports.TOKENS, "total_tokens")}
    whole["cost"] = math.fsum(r["cost"] or 0.0 for r in rows)
    return {names.get(k, camel(k)): plain(x) for k, x in whole.items()}


def report_json(report: DataFrame, name: str, empty_totals: str = "zeros", names: dict = REPORT) -> dict | list:
    """{name: rows, totals}. An empty report is [] (list), has zero totals (zeros) or null totals (null)."""
    found = report.collect()
    rows = [plain(r, names) for r in found]
    if not rows and empty_totals == "list":
        return []
    if not rows and empty_totals == "null":
        return {name: [], "totals": None}
    return {name: rows, "totals": _totals(found, names)}


def by_project_json(report: DataFrame, name: str = "projects") -> dict:
    """{name: {project: rows}, totals}; rows keep the report's order within a project."""
    out: dict = {}
    found = report.collect()
    for r in found:
        row = plain(r, REPORT)
        out.setdefault(row.pop("project") or "unknown", []).append(row)
    return {name: out, "totals": _totals(found, REPORT)}


def session_json(session_id: str, entries: list, total) -> dict | None:
    """One session with its entries; None if there is none."""
    if not entries:
        return None
    return {"sessionId": session_id, "totalCost": total["cost"], "totalTokens": total["total_tokens"], "entries": [plain(r, ENTRY) for r in entries]}


def block_json(r) -> dict:
    """One block; burn rate and projection are given for active blocks, the limit's status with a projection."""
    live = r["is_active"] and r["tokens_per_minute"] is not None
    limited = live and r["token_limit"] is not None and r["projected_tokens"] is not None
    times = {camel(k): plain(r[v]) for k, v in (("start_time", "start"), ("end_time", "end"), ("actual_end_time", "actual_end"))}
    return {"id": r["block_id"], **times} | {
        "isActive": r["is_active"], "isGap": r["is_gap"], "entries": r["entries"],
        "tokenCounts": {"inputTokens": r["input_tokens"], "outputTokens": r["output_tokens"], "cacheCreationInputTokens": r["cache_creation_tokens"], "cacheReadInputTokens": r["cache_read_tokens"]},
        "totalTokens": r["input_tokens"] + r["output_tokens"] + r["cache_creation_tokens"] + r["cache_read_tokens"], "costUSD": r["cost"], "models": r["models"],
        "burnRate": {"tokensPerMinute": r["tokens_per_minute"], "tokensPerMinuteForIndicator": r["indicator"], "costPerHour": r["cost_per_hour"]} if live else None,
        "projection": {"totalTokens": r["projected_tokens"], "totalCost": r["projected_cost"], "remainingMinutes": r["remaining_minutes"]} if live else None,
        "usageLimitResetTime": plain(r["reset_ts"]),
    } | ({"tokenLimitStatus": {"limit": r["token_limit"], "projectedUsage": r["projected_tokens"], "percentUsed": r["percent_used"], "status": r["limit_status"]}} if limited else {})


def blocks_json(projected: DataFrame) -> dict:
    return {"blocks": [block_json(r) for r in projected.orderBy("start", "is_gap").collect()]}


def json_lines(report: DataFrame) -> DataFrame:
    """The report as one JSON string for each row, for any file sink."""
    return report.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in report.columns])).alias("value"))


def jq(document, program: str) -> str:
    """The document through the jq program, if that is installed."""
    try:
        done = subprocess.run(["jq", program], input=json.dumps(document), capture_output=True, text=True, timeout=60)
    except FileNotFoundError:
        raise RuntimeError("jq is not installed") from None
    if done.returncode:
        raise ValueError(done.stderr.strip())
    return done.stdout


def table(rows: list[dict], columns: list[str], width: int = 120, compact: list[str] | None = None) -> str:
    """A plain-text table; below 100 characters of width only the compact columns are shown."""
    names = compact if compact and width < 100 else columns
    cells = [[c.replace("_", " ").title() for c in names]] + [[_cell(r.get(c)) for c in names] for r in rows]
    sizes = [max(max((len(x) for x in row[k].split("\n")), default=0) for row in cells) for k in range(len(names))]
    rule = "+" + "+".join("-" * (n + 2) for n in sizes) + "+"
    numeric = [bool(rows) and all(isinstance(r.get(c), int | float | None) for r in rows) for c in names]
    out = [rule]
    for i, row in enumerate(cells):
        parts = [x.split("\n") for x in row]
        for k in range(max(map(len, parts))):
            line = [(p[k] if k < len(p) else "") for p in parts]
            out.append("|" + "|".join(f" {x.rjust(n) if num and i else x.ljust(n)} " for x, n, num in zip(line, sizes, numeric)) + "|")
        if not i:
            out.append(rule)
    return "\n".join([*out, rule])


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, float):
        return f"${value:,.2f}"
    return "\n".join(f"- {x}" for x in value) if isinstance(value, list) else str(value)


def status_line(model: Column, session_cost: Column, today_cost: Column, block_cost: Column, minutes_left: Column, cost_per_hour: Column, context_tokens: Column, context_size: Column) -> Column:
    """One line of status; parts that are null are shown as N/A or left out."""
    block = F.when(block_cost.isNull(), "No active block").otherwise(F.concat(currency(block_cost), F.lit(" block ("), hours_minutes(minutes_left), F.lit(" left)")))
    burn = F.when(cost_per_hour.isNull() | block_cost.isNull(), "").otherwise(F.concat(F.lit(" | 🔥 "), currency(cost_per_hour), F.lit("/hr")))
    share = half_up(context_tokens / context_size * 100).cast("long").cast("string")
    context = F.coalesce(F.concat(with_separators(context_tokens), F.lit(" ("), share, F.lit("%)")), F.lit("N/A"))
    session = F.when(session_cost.isNull(), "N/A").otherwise(currency(session_cost))
    return F.concat(F.lit("🤖 "), model, F.lit(" | 💰 "), session, F.lit(" session / "), currency(today_cost), F.lit(" today / "), block, burn, F.lit(" | 🧠 "), context)


def context_percent(tokens: Column, size: Column) -> Column:
    return clamp(half_up(tokens / size * 100).cast("long"), 0, 100)


class StatusCache:
    """Status lines by session: one stays valid for a refresh interval while the transcript's modification time is the same."""

    def __init__(self, refresh: float = 1.0):
        self.refresh, self.kept = refresh, {}

    def get(self, session: str, now: float, modified: float) -> str | None:
        at, seen, line, busy = self.kept.get(session, (float("-inf"), None, None, False))
        if line is not None and (busy or now - at < self.refresh and seen == modified):
            return line
        return None

    def begin(self, session: str) -> None:
        """Others get the old line while this session is being updated."""
        if session in self.kept:
            self.kept[session] = (*self.kept[session][:3], True)

    def put(self, session: str, now: float, modified: float, line: str) -> None:
        self.kept[session] = (now, modified, line, False)
