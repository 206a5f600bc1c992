"""Scalar functions against the documented examples."""

import pytest
from pyspark.sql import functions as F

from usagemill.functions import dates, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "short"),
    [
        ("-Users-me-Development-tracker", "tracker"), ("/Users/me/Development/tracker", "tracker"), ("C:\\Users\\me\\Development\\tracker", "tracker"), ("\\Users\\me\\Dev\\tracker", "tracker"),
        ("-Users-me-Development-adminifi-edugakko-api--feature-ticket-002-configure-dependabot", "configure-dependabot"), ("adminifi-edugakko-api--feature-ticket", "edugakko-api"), ("unknown", "Unknown Project"), ("", "Unknown Project"),
        ("a2cd99ed-a586-4fe4-8f59-b0026409ec09.jsonl", "8f59-b0026409ec09.jsonl"), ("simple", "simple"), ("/-x-/", "x"), ("---", "---"), ("very-long-project-name-feature-main", "project-name"), ("a-b-cde-fgh-ij-kl-mn-op-qr-st", "cde-fgh"),
    ],
)
def test_project_name(spark, raw, short):
    assert one(spark, text.project_name(F.lit(raw))) == short


def test_project_aliases(spark):
    aliases = text.parse_aliases("tracker=Usage Tracker, raw = R ,bad,=x")
    assert aliases == {"tracker": "Usage Tracker", "raw": "R"}
    assert one(spark, text.project_label(F.lit("-Users-me-Development-tracker"), aliases)) == "Usage Tracker"
    assert one(spark, text.project_label(F.lit("raw"), aliases)) == "R"
    assert one(spark, text.project_label(F.lit("other"), None)) == "other"


@pytest.mark.parametrize(("raw", "short"), [("claude-sonnet-4-20250514", "sonnet-4"), ("claude-sonnet-4-5-20250929", "sonnet-4-5"), ("claude-opus-4-5", "opus-4-5"), ("anthropic/claude-opus-4.5", "opus-4.5"), ("[pi] claude-opus-4-5", "[pi] opus-4-5"), ("[pi] [pi] x", "[pi] [pi] x"), ("gpt-5", "gpt-5"), ("[pi] ", "[pi] ")])
def test_model_name(spark, raw, short):
    assert one(spark, text.model_name(F.lit(raw))) == short


@pytest.mark.parametrize(("value", "out"), [(2.5, 3), (-2.5, -2), (-2.6, -3), (0.49, 0)])
def test_rounding(spark, value, out):
    assert one(spark, numbers.half_up(F.lit(value))) == out


def test_number_formats(spark):
    assert one(spark, numbers.currency(F.lit(1234.565))) in ("$1234.57", "$1234.56")
    assert one(spark, numbers.currency(F.lit(None).cast("double"))) == "$0.00"
    assert one(spark, numbers.with_separators(F.lit(1234567))) == "1,234,567"
    assert one(spark, numbers.percent_off(F.lit(0.0), F.lit(1.0))) == 0.0
    assert one(spark, numbers.clamp(F.lit(120.0), 0.0, 100.0)) == 100.0


@pytest.mark.parametrize(("day", "week"), [("2025-06-15", "2025-W24"), ("2025-12-29", "2026-W01"), ("2025-01-05", "2025-W01"), ("2025-01-01", "2025-W01")])
def test_iso_week(spark, day, week):
    assert one(spark, dates.iso_week_key(F.lit(day).cast("timestamp"))) == week


@pytest.mark.parametrize(("first", "start"), [("sunday", "2025-08-03"), ("monday", "2025-08-04"), ("wednesday", "2025-07-30"), ("saturday", "2025-08-02")])
def test_week_start(spark, first, start):
    assert one(spark, dates.week_start(F.lit("2025-08-05").cast("date"), first)) == start


def test_dates(spark):
    assert dates.filter_date("2025-01-02") == "20250102" and dates.filter_date(None) is None
    with pytest.raises(ValueError):
        dates.filter_date("2025-1-2")
    assert one(spark, dates.day_key(F.lit("2025-01-01 23:30:00").cast("timestamp"), "Asia/Tokyo")) == "2025-01-02"
    assert one(spark, dates.hours_minutes(F.lit(125))) == "2h 5m" and one(spark, dates.hours_minutes(F.lit(5))) == "5m"
    assert one(spark, dates.compact_day(F.lit("2025-08-04"))) == "2025\n08-04"


def test_short_texts(spark):
    assert one(spark, text.session_tail(F.lit("a-b-c-d"))) == "c-d"
    assert one(spark, text.last_characters(F.lit("0123456789"))) == "23456789"
    assert one(spark, text.clipped(F.lit("x" * 31))) == "x" * 27 + "..." and one(spark, text.clipped(F.lit("x" * 30))) == "x" * 30
