"""Display names of projects, models, sessions and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"^[/\\-]+|[/\\-]+$"
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: Segments that say nothing about a project.
_PLAIN_WORDS = ("dev", "development", "feat", "feature", "fix", "bug", "test", "staging", "prod", "production", "main", "master", "branch")
UNKNOWN = "Unknown Project"


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _after_home(parts: Column, otherwise: Column) -> Column:
    """What follows Users, the user's name and one folder."""

    def cut(p: Column) -> Column:
        at = F.array_position(p, "Users")
        return F.when((at > 0) & (at + 2 < F.size(p)), F.array_join(F.slice(p, (at + 3).cast("int"), F.size(p)), "-")).otherwise(otherwise)

    return _let(parts, cut)


def _telling(name: Column) -> Column:
    """The last two or three segments of a long name that say something."""

    def pick(parts: Column) -> Column:
        two, three = F.array_join(F.slice(parts, -2, 2), "-"), F.array_join(F.slice(parts, -3, 3), "-")
        return F.when(F.size(parts) < 2, name).when(F.char_length(two) >= 6, two).when(F.size(parts) >= 3, three).otherwise(name)

    parts = F.filter(F.split(name, "-"), lambda s: (F.char_length(s) > 2) & ~F.lower(s).isin(*_PLAIN_WORDS))
    return F.when(name.contains("-") & (F.char_length(name) > 20), _let(parts, pick)).otherwise(name)


def project_name(raw: Column) -> Column:
    """A short name for a project directory."""
    solid = lambda x, sep: F.filter(F.split(x, sep), lambda s: s != "")
    steps = (
        lambda x: F.when(x.rlike(r"^(?:[A-Z]:)?\\Users\\"), _after_home(F.split(x, r"\\"), x)).otherwise(x),
        lambda x: F.when(x.startswith("-Users-"), _after_home(solid(x, "-"), x)).when(x.startswith("/Users/"), _after_home(solid(x, "/"), x)).otherwise(x),
        lambda x: F.when(x == raw, F.regexp_replace(x, _EDGES, "")).otherwise(x),
        lambda x: F.when(x.rlike(_UUID), F.substring_index(x, "-", -2)).otherwise(x),
        lambda x: F.when(x.contains("--"), F.substring_index(x, "--", 1)).otherwise(x),
        _telling,
        lambda x: F.regexp_replace(x, _EDGES, ""),
        lambda x: F.when(raw.isin("", "unknown"), UNKNOWN).when(x != "", x).otherwise(raw),
    )
    name = raw
    for step in steps:
        name = _let(name, step)
    return name


def project_label(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """project_name() with aliases, which hold for the raw name first, then for the short one."""
    short = project_name(raw)
    if not aliases:
        return short
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(known[raw], known[short], short)


def parse_aliases(text: str | None) -> dict[str, str]:
    """a=b,c=d as a dict; pairs without both sides are skipped."""
    pairs = (x.partition("=") for x in (text or "").split(","))
    return {k.strip(): v.strip() for k, _, v in pairs if k.strip() and v.strip()}


def model_name(raw: Column) -> Column:
    """claude-opus-4-5-20250929 as opus-4-5; a [pi] mark stays in front; other names stay as they are."""
    marked = raw.rlike(r"^\[pi\] .")
    # Marks can repeat: all of them stay in front.
    marks = F.regexp_extract(raw, r"^((?:\[pi\] )*)(?=.)", 1)
    rest = F.when(marked, F.substring(raw, F.char_length(marks) + 1, F.char_length(raw))).otherwise(raw)
    out = rest
    for pattern in (r"^claude-(\w+)-([\d-]+)$", r"^claude-(\w+)-([\d-]+)-(\d{8})$", r"^anthropic/claude-(\w+)-([\d.]+)$"):
        out = F.when(rest.rlike(pattern), F.concat_ws("-", F.regexp_extract(rest, pattern, 1), F.regexp_extract(rest, pattern, 2))).otherwise(out)
    return F.when(marked, F.concat(marks, out)).otherwise(out)


def display_model(model: Column, speed: Column) -> Column:
    """The model, marked -fast where that speed was used; null stays null."""
    return F.when(speed == "fast", F.concat(model, F.lit("-fast"))).otherwise(model)


def session_tail(session: Column) -> Column:
    """Last two parts of a session id."""
    return F.substring_index(session, "-", -2)


def last_characters(text: Column, n: int = 8) -> Column:
    return F.right(text, F.lit(n))


def clipped(title: Column, width: int = 30) -> Column:
    """Titles beyond width end in three dots."""
    return F.when(F.char_length(title) > width, F.concat(F.substring(title, 1, width - 3), F.lit("..."))).otherwise(title)
