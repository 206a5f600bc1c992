"""Configuration files and how they merge with given options."""

from __future__ import annotations

import json
from pathlib import Path

NAME = "usagemill.json"
DEFAULTS = {"mode": "auto", "order": "asc", "timezone": "UTC", "first_day": "sunday", "hours": 5.0, "days": 3}


def load(explicit: str | None = None, folders: tuple[str, ...] = (".",), name: str = NAME) -> dict | None:
    """The explicit file alone (None if it is bad), or else the first valid file in the folders."""
    tried = [Path(explicit)] if explicit else [Path(f) / name for f in folders]
    for path in tried:
        try:
            found = json.loads(path.read_text())
        except (OSError, ValueError):
            continue
        if isinstance(found, dict) and all(isinstance(found.get(k, {}), dict) for k in ("defaults", "commands")):
            return found
    return None


def merge(command: str, options: dict, config: dict | None = None) -> dict:
    """Built-in defaults, then the file's defaults, then its section for the command, then options that aren't None."""
    config = config or {}
    given = {k: x for k, x in options.items() if x is not None}
    return DEFAULTS | config.get("defaults", {}) | config.get("commands", {}).get(command, {}) | given
