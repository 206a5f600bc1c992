"""DuckDB SQL for the checked queries, written apart from the Spark plans."""

from __future__ import annotations

import json

from ..operators.pricing import COUNTER_PREFIXES, PREFIXES
from ..sources.prices import BUNDLED, price_rows

_PRICE = ("input_price", "output_price", "cache_creation_price", "cache_read_price")
_ALL = (*_PRICE, *(f"{p}_above" for p in _PRICE), "max_input_tokens", "fast")


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE"


def _prices() -> str:
    rows = price_rows(json.loads(BUNDLED.read_text()))
    return ", ".join("(" + ", ".join([str(k), _value(r["name"]), *(_value(r.get(c)) for c in _ALL)]) + ")" for k, r in enumerate(rows))


USAGE = """usage AS (
  SELECT *, min(ts) OVER (PARTITION BY file_path) AS file_ts FROM (
    SELECT event_id AS line_ord, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_raw, 'p' || (user_id % 10) AS project, 'p' || (user_id % 10) AS project_path, 's' || (user_id % 50) AS session_id,
      CASE WHEN event_id % 17 <> 0 THEN 'm' || (event_id // 2) END AS message_id, 'r' || (user_id % 3) AS request_id,
      CASE event_type WHEN 'view' THEN 'claude-sonnet-4-20250514' WHEN 'click' THEN 'claude-opus-4-20250514' WHEN 'signup' THEN 'claude-haiku-4.5' WHEN 'purchase' THEN 'gpt-5' ELSE CASE WHEN event_id % 2 = 0 THEN '<synthetic>' END END AS model,
      CASE event_id % 7 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' END AS speed,
      CAST(json_extract(props, '$.k') AS BIGINT) * 100 + CASE WHEN event_id % 50 = 0 THEN 250000 ELSE 0 END AS input_tokens, CAST(json_extract(props, '$.k') AS BIGINT) * 13 AS output_tokens,
      event_id % 11 * 40 AS cache_creation_tokens, event_id % 23 * 900 AS cache_read_tokens, CASE WHEN event_id % 3 <> 0 THEN value / 100 END AS cost_usd,
      CASE WHEN event_id % 5 <> 0 THEN '1.0.' || (user_id % 4) END AS version, CASE WHEN event_id % 400 = 0 THEN ts + INTERVAL 3 HOUR END AS reset_ts, 'f' || (user_id % 20) AS file_path, user_id, value
    FROM events))"""

DEDUP = USAGE + """, dedup AS (
  SELECT * FROM usage WHERE message_id IS NULL
  UNION ALL SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY file_ts NULLS LAST, file_path, line_ord) AS n FROM usage WHERE message_id IS NOT NULL) WHERE n = 1)"""


def match(models: str, prefixes: tuple = PREFIXES) -> str:
    """CTEs prices and matched(model, price_name, ...) for a query of model names."""
    steps = " UNION ALL ".join([f"SELECT model, 0 AS rank, ordinal FROM names JOIN prices ON name = model"] + [f"SELECT model, {k}, ordinal FROM names JOIN prices ON name = '{p}' || model" for k, p in enumerate(prefixes, 1)] + ["SELECT model, 99, ordinal FROM names JOIN prices ON contains(lower(name), lower(model)) OR contains(lower(model), lower(name))"])
    return f"""prices(ordinal, name, {', '.join(_ALL)}) AS (VALUES {_prices()}), names AS (SELECT DISTINCT model FROM ({models}) WHERE model IS NOT NULL AND model <> ''),
 tried AS ({steps}), best AS (SELECT model, arg_min(ordinal, rank * 1000 + ordinal) AS ordinal FROM tried GROUP BY model),
 matched AS (SELECT n.model, p.name AS price_name, {', '.join('p.' + c for c in _ALL)} FROM names n LEFT JOIN best USING (model) LEFT JOIN prices p USING (ordinal))"""


def _tier(tokens: str, price: str) -> str:
    return f"CASE WHEN {tokens} <= 0 THEN 0 WHEN {tokens} > 200000 AND {price}_above IS NOT NULL THEN ({tokens} - 200000) * {price}_above + 200000 * coalesce({price}, 0) ELSE {tokens} * coalesce({price}, 0) END"


TOKEN_COST = "(" + " + ".join(_tier(f"{c}_tokens", f"{c}_price") for c in ("input", "output", "cache_creation", "cache_read")) + ")"
FAST = "CASE WHEN speed = 'fast' THEN coalesce(fast, 1) ELSE 1 END"
_COST = {"auto": f"coalesce(cost_usd, {TOKEN_COST} * {FAST})", "calculate": f"{TOKEN_COST} * {FAST}", "display": "coalesce(cost_usd, 0)"}


def costed(mode: str = "auto") -> str:
    return DEDUP + ", " + match("SELECT model FROM dedup") + f""",
 costed AS (SELECT d.* EXCLUDE (model), CASE WHEN speed = 'fast' THEN d.model || '-fast' ELSE d.model END AS model, {_COST[mode]} AS cost FROM dedup d LEFT JOIN matched m ON d.model = m.model)"""


SUMS = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, round(sum(cost), 8) AS cost"
TOTAL = "sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)::BIGINT AS total_tokens"


def report(key: str, name: str, where: str = "true", mode: str = "auto", more: str = "") -> str:
    extra = f", {more}" if more else ""
    return f"WITH {costed(mode)} SELECT {key} AS {name}{extra}, {SUMS}, {TOTAL} FROM costed WHERE {where} GROUP BY ALL"


DAY, MONTH = "strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m')"


def day_in(zone: str) -> str:
    return f"strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE '{zone}', '%Y-%m-%d')"


def week(first: int) -> str:
    return f"strftime(CAST(ts AS DATE) - CAST((dayofweek(ts) - {first} + 7) % 7 AS INTEGER), '%Y-%m-%d')"


def block_chain(keys: str, source: str, hours: float) -> str:
    """CTEs placed: every row of source with first (its block's first time). keys: one column."""
    span = f"INTERVAL '{round(hours * 3600)} seconds'"
    return f"""times AS MATERIALIZED (SELECT DISTINCT {keys} AS k, ts FROM {source}), ends AS (SELECT k, ts, greatest(ts, date_trunc('hour', ts) + {span}) AS stop FROM times),
 nexts AS MATERIALIZED (SELECT e.k, e.ts, t.ts AS nxt FROM ends e ASOF LEFT JOIN times t ON e.k = t.k AND e.stop < t.ts),
 chain AS (SELECT k, min(ts) AS first FROM times GROUP BY k UNION ALL SELECT n.k, n.nxt FROM chain c JOIN nexts n ON n.k = c.k AND n.ts = c.first WHERE n.nxt IS NOT NULL),
 placed AS (SELECT s.*, c.first FROM {source} s ASOF JOIN chain c ON s.{keys} = c.k AND s.ts >= c.first)"""


def blocks(keys: str = "one", hours: float = 5.0, now: str = "2024-01-30 22:00:00") -> str:
    """CTE found: blocks by key with sums, last, is_active; and gaps."""
    span = f"INTERVAL '{round(hours * 3600)} seconds'"
    body = costed().replace("WITH ", "")
    return f"""WITH RECURSIVE {body}, src AS (SELECT *, 1 AS one FROM costed), {block_chain(keys, 'src', hours)},
 found AS (SELECT {keys}, first, date_trunc('hour', first) AS start, date_trunc('hour', first) + {span} AS stop, max(ts) AS last, count(*) AS entries, {SUMS.replace('round(sum(cost), 8)', 'sum(cost)')}, {TOTAL},
   TIMESTAMP '{now}' - max(ts) < {span} AND TIMESTAMP '{now}' < date_trunc('hour', first) + {span} AS is_active, arg_max(reset_ts, ts) FILTER (reset_ts IS NOT NULL) AS reset_ts FROM placed GROUP BY {keys}, first),
 gaps AS (SELECT * FROM (SELECT {keys}, last + {span} AS start, lead(first) OVER (PARTITION BY {keys} ORDER BY first) AS stop, last FROM found) WHERE stop - last > {span})"""


RATE = "CASE WHEN last > first THEN {} / (epoch_us(last) - epoch_us(first)) * 60000000.0 END"


def deltas() -> str:
    """CTE events2: counter events from the sample view (cumulative totals by session)."""
    sums = ", ".join(f"sum({c}) OVER w AS t_{c}" for c in ("inp", "cac", "out", "rea"))
    return f"""counted AS (SELECT event_id AS line_ord, ts, 's' || (user_id % 50) AS session_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id,
    CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) * 10 END AS inp, CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) * 3 END AS cac,
    CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS out, CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) // 2 END AS rea,
    CASE WHEN event_id % 6 = 0 THEN 'gpt-5-codex' WHEN event_id % 29 = 0 THEN 'openrouter/x:free' END AS model, event_id % 4 = 0 AS has_last FROM events),
 totals AS (SELECT *, {sums} FROM counted WINDOW w AS (PARTITION BY session_id ORDER BY line_ord ROWS UNBOUNDED PRECEDING)),
 kept AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN t_inp // 2 ELSE t_inp END AS r_inp FROM totals WHERE event_id % 10 <> 9 OR model IS NOT NULL),
 usage_rows AS (SELECT *, event_id % 10 <> 9 AS is_usage FROM kept),
 prior AS (SELECT *, last_value(CASE WHEN is_usage THEN r_inp END IGNORE NULLS) OVER p AS p_inp, last_value(CASE WHEN is_usage THEN t_cac END IGNORE NULLS) OVER p AS p_cac,
    last_value(CASE WHEN is_usage THEN t_out END IGNORE NULLS) OVER p AS p_out, last_value(CASE WHEN is_usage THEN t_rea END IGNORE NULLS) OVER p AS p_rea
    FROM usage_rows WINDOW p AS (PARTITION BY session_id ORDER BY line_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 raw AS (SELECT *, CASE WHEN has_last THEN inp ELSE greatest(r_inp - coalesce(p_inp, 0), 0) END AS d_inp, CASE WHEN has_last THEN cac ELSE greatest(t_cac - coalesce(p_cac, 0), 0) END AS d_cac,
    CASE WHEN has_last THEN out ELSE greatest(t_out - coalesce(p_out, 0), 0) END AS d_out, CASE WHEN has_last THEN rea ELSE greatest(t_rea - coalesce(p_rea, 0), 0) END AS d_rea FROM prior),
 live AS (SELECT * FROM raw WHERE NOT is_usage OR d_inp <> 0 OR least(d_cac, d_inp) <> 0 OR d_out <> 0 OR d_rea <> 0),
 carried AS (SELECT *, last_value(model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_ord ROWS UNBOUNDED PRECEDING) AS m FROM live),
 events2 AS (SELECT session_id, line_ord, ts, coalesce(m, 'gpt-5') AS model, m IS NULL AS is_fallback, d_inp::BIGINT AS input_tokens, least(d_cac, d_inp)::BIGINT AS cached_input_tokens, d_out::BIGINT AS output_tokens, d_rea::BIGINT AS reasoning_output_tokens,
    CASE WHEN has_last OR true THEN d_inp + d_out END::BIGINT AS total_tokens FROM carried WHERE is_usage)"""


COUNTER_RATES = match("SELECT model FROM events2 UNION ALL SELECT 'gpt-5'", COUNTER_PREFIXES) + """,
 rates AS (SELECT n.model, CASE WHEN n.model = 'openrouter/x:free' THEN 0 WHEN n.model = 'gpt-5-codex' THEN g.input_price ELSE coalesce(m.input_price, 0) END AS i, CASE WHEN n.model = 'openrouter/x:free' THEN 0 WHEN n.model = 'gpt-5-codex' THEN coalesce(g.cache_read_price, g.input_price) ELSE coalesce(m.cache_read_price, m.input_price, 0) END AS c,
   CASE WHEN n.model = 'openrouter/x:free' THEN 0 WHEN n.model = 'gpt-5-codex' THEN g.output_price ELSE coalesce(m.output_price, 0) END AS o FROM (SELECT DISTINCT model FROM events2) n LEFT JOIN matched m ON m.model = n.model CROSS JOIN (SELECT * FROM matched WHERE model = 'gpt-5') g)"""
COUNTER_COST = "round(sum(greatest(input_tokens - cached_input_tokens, 0) * i + least(cached_input_tokens, input_tokens) * c + output_tokens * o), 10) AS cost"
