"""Strict checks on parsed JSON: absent, null and wrongly typed fields are told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(line: Column) -> Column:
    """VARIANT of a JSON object; null for bad JSON, for what isn't an object, and for text after it."""
    plain = F.trim(F.regexp_replace(line, r"[\r\n\t]+$", ""))
    return F.when(plain.rlike(r"^\s*\{") & plain.rlike(r"\}\s*$"), F.try_parse_json(plain))


def kind(v: Column, path: str) -> Column:
    """Type of a field as written: null if absent, VOID if JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_number(v: Column, path: str, required: bool = False) -> Column:
    ok = kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return F.coalesce(ok, F.lit(not required))


def is_text(v: Column, path: str, required: bool = False, empty: bool = False, pattern: str | None = None) -> Column:
    said = F.try_variant_get(v, path, "string")
    ok = kind(v, path) == "STRING"
    if not empty:
        ok = ok & (F.char_length(said) > 0)
    if pattern:
        ok = ok & said.rlike(pattern)
    return F.coalesce(ok, F.lit(not required))


def is_boolean(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path) == "BOOLEAN", F.lit(True))


def is_object(v: Column, path: str, required: bool = False, null: bool = False) -> Column:
    ok = kind(v, path).startswith("OBJECT")
    if null:
        ok = ok | (kind(v, path) == "VOID")
    return F.coalesce(ok, F.lit(not required))


def is_array(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path).startswith("ARRAY"), F.lit(True))


def number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def whole(v: Column, path: str) -> Column:
    """Token counts: whole numbers; fractions are cut."""
    return F.try_variant_get(v, path, "double").cast("long")


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def filled(v: Column, path: str) -> Column:
    """A string that isn't blank, trimmed; else null."""
    said = F.when(kind(v, path) == "STRING", F.trim(text(v, path)))
    return F.when(said != "", said)
