"""Price tables: JSON keyed by model, from text, a file or a loader, with a bundled fallback."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.pricing import price_frame

#: JSON name of each price column.
FIELDS = {
    "input_price": "input_cost_per_token", "output_price": "output_cost_per_token", "cache_creation_price": "cache_creation_input_token_cost", "cache_read_price": "cache_read_input_token_cost",
    "input_price_above": "input_cost_per_token_above_200k_tokens", "output_price_above": "output_cost_per_token_above_200k_tokens",
    "cache_creation_price_above": "cache_creation_input_token_cost_above_200k_tokens", "cache_read_price_above": "cache_read_input_token_cost_above_200k_tokens",
}
BUNDLED = Path(__file__).with_name("prices.json")


def price_rows(table: dict, prefixes: tuple[str, ...] | None = None) -> list[dict]:
    """Rows in the table's order; entries that aren't objects, or hold a price that is no number, are skipped."""
    out = []
    for name, entry in table.items():
        if not isinstance(entry, dict) or prefixes is not None and not name.startswith(prefixes):
            continue
        special = entry.get("provider_specific_entry") or {}
        values = {c: entry.get(f) for c, f in FIELDS.items()} | {"fast": special.get("fast") if isinstance(special, dict) else None}
        limit = entry.get("max_input_tokens")
        numbers = [x for x in (*values.values(), limit) if x is not None]
        if any(isinstance(x, bool) or not isinstance(x, int | float) for x in numbers):
            continue
        out.append({"name": name, **{c: None if x is None else float(x) for c, x in values.items()}, "max_input_tokens": None if limit is None else int(limit)})
    return out


def load(spark: SparkSession, loader: Callable[[], dict] | None = None, prefixes: tuple[str, ...] | None = None) -> DataFrame:
    """The loader's table; the bundled one without a loader or if it fails."""
    try:
        table = loader() if loader else None
    except (OSError, ValueError):
        table = None
    return price_frame(spark, price_rows(table if table is not None else json.loads(BUNDLED.read_text()), prefixes))
