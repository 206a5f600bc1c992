"""Command line: python -m usagemill REPORT --root FOLDER [options]."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from .plans import api, output
from .session import get_spark
from .sources import config, paths

REPORTS = ("daily", "weekly", "monthly", "session", "blocks", "statusline")
LISTS = {"daily": "daily", "weekly": "weekly", "monthly": "monthly", "session": "sessions"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("usagemill")
    p.add_argument("report", nargs="?", default="daily", choices=REPORTS)
    p.add_argument("--root", action="append", help="folder that holds projects/; repeatable")
    p.add_argument("--mode", choices=("auto", "calculate", "display"))
    p.add_argument("--order", choices=("asc", "desc"))
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--project")
    p.add_argument("--instances", action="store_true", default=None, help="group by project too")
    p.add_argument("--breakdown", action="store_true", default=None)
    p.add_argument("--timezone")
    p.add_argument("--first-day", dest="first_day")
    p.add_argument("--id", help="one session by its file's name")
    p.add_argument("--hours", type=float)
    p.add_argument("--token-limit", dest="token_limit")
    p.add_argument("--recent", action="store_true", default=None)
    p.add_argument("--active", action="store_true", default=None)
    p.add_argument("--now", help="ISO time; default is the clock")
    p.add_argument("--config")
    p.add_argument("--jq")
    p.add_argument("--json", action="store_true", default=None)
    p.add_argument("--width", type=int)
    return p


def main(argv: list[str] | None = None, spark=None, stdin=None) -> str:
    args = vars(parser().parse_args(argv))
    report, roots = args.pop("report"), args.pop("root") or paths.resolve_roots()
    o = config.merge(report, args, config.load(args["config"], (".", *roots)))
    now = datetime.fromisoformat(o["now"]) if o.get("now") else datetime.now(timezone.utc).replace(tzinfo=None)
    engine = api.Engine(spark or get_spark(), roots, o["mode"], zone=o["timezone"])
    if report == "statusline":
        return engine.status_line((stdin or sys.stdin).read(), now)
    dates = {k: o.get(k) for k in ("since", "until")}
    if report == "blocks":
        frame = engine.blocks(now, o["hours"], **dates, recent_days=o["days"] if o.get("recent") else None, active=bool(o.get("active")), limit=o.get("token_limit"))
        doc = output.blocks_json(frame)
        rows = doc["blocks"]
    elif report == "session" and o.get("id"):
        own = engine.session(o["id"])
        from .plans import reports

        doc = output.session_json(o["id"], reports.session_entries(own).collect(), reports.session_total(own).first())
        rows = doc["entries"] if doc else []
    else:
        more = {"breakdowns": bool(o.get("breakdown") or o.get("json") or o.get("jq")), "project": o.get("project"), "order": o["order"]}
        if report != "session":
            more["by_project"] = bool(o.get("instances"))
        if report == "weekly":
            more["first_day"] = o["first_day"]
        frame = {"daily": engine.daily, "weekly": engine.weekly, "monthly": engine.monthly, "session": engine.sessions}[report](**dates, **more)
        if o.get("json") and report == "daily" and o.get("instances"):
            doc, rows = output.by_project_json(frame), []
        else:
            doc = output.report_json(frame, LISTS[report], "list" if report in ("daily", "session") else "zeros")
            rows = doc[LISTS[report]] if isinstance(doc, dict) else []
    if o.get("jq"):
        return output.jq(doc, o["jq"])
    if o.get("json"):
        return json.dumps(doc, indent=2, ensure_ascii=False)
    names = [k for k in (rows[0] if rows else {}) if not isinstance(rows[0][k], list | dict)]
    return output.table(rows, names, o.get("width") or 120, names[:1] + [n for n in names if n in ("totalTokens", "totalCost", "costUSD")])


if __name__ == "__main__":
    print(main())
