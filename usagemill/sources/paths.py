"""Data roots and path-derived columns."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_roots(env: dict | None = None, home: str | None = None, variable: str = "CLAUDE_CONFIG_DIR", inside: str = "projects", defaults: tuple = (".config/claude", ".claude")) -> list[str]:
    """Roots that hold ``inside``: those the variable lists (comma-separated), or else the defaults below home. Each once.

    A variable that is set but names no valid root is an error, and so is finding none.
    """
    env = os.environ if env is None else env
    base = Path(home or env.get("HOME") or Path.home())
    named = [x.strip() for x in env.get(variable, "").split(",") if x.strip()]
    config = Path(env["XDG_CONFIG_HOME"]) / "claude" if env.get("XDG_CONFIG_HOME") and not named else None
    tried = [Path(x).expanduser() for x in named] or [p for p in (config, *(base / d for d in defaults)) if p]
    roots = list(dict.fromkeys(str(p.resolve()) for p in tried if (p / inside).is_dir()))
    if not roots:
        raise FileNotFoundError(f"no folder with {inside!r} among {', '.join(map(str, tried))}")
    return roots


def plain_path(path: Column) -> Column:
    """A scanned file's path without scheme, decoded."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/+", "/"), r"\+", "%2B"))


def segments(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def segment_after(path: Column, name: str, default: str = "unknown") -> Column:
    """The segment that follows the first segment ``name``."""
    parts = segments(path)
    at = F.array_position(parts, name)
    found = F.when(at > 0, F.get(parts, at.cast("int")))
    return F.when(F.trim(found) != "", found).otherwise(F.lit(default))


def below_root(path: Column, name: str) -> Column:
    """Segments below the first segment ``name``."""
    parts = segments(path)
    at = F.array_position(parts, name)
    return F.slice(parts, (at + 1).cast("int"), F.size(parts))


def parent_name(path: Column) -> Column:
    return F.element_at(segments(path), -2)


def stem(path: Column, suffix: str = r"\.jsonl$") -> Column:
    return F.regexp_replace(F.element_at(segments(path), -1), suffix, "")
