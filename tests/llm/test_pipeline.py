"""The pipeline's stages on planted cases, and against what each operator decides."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_near_copies import brute
from usagemill.llm import decontaminate, quality

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = cp.staged(cp.keep_quality(spark, docs, SF), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = labels.join(kept.select("doc_id", F.lit(1).alias("in")), "doc_id", "left").toPandas()
    assert left["in"].notna()[left.quality == 1].mean() > 0.97
    assert left["in"].notna()[left.quality == 0].mean() < 0.35
    one = cp.staged(cp.drop_near_copies(spark, kept, SF), "t")
    rows = [(r.doc_id, r.text, "s") for r in kept.select("doc_id", "text").collect()]
    should, stay = {i for _, i in brute(rows)}, {r.doc_id for r in one.select("doc_id").collect()}
    assert should <= stay and len(rows) - len(stay) >= 0.9 * (len(rows) - len(should)) > 0
    clean = cp.staged(cp.drop_contaminated(spark, one, SF), "t")
    bad = decontaminate.report(one, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert bad and clean.count() == one.count() - bad
    safe = cp.staged(cp.redact_secrets(spark, clean, SF), "t")
    assert safe.count() == clean.count() and safe.columns == columns
    assert safe.where(F.col("text").rlike(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}")).count() == 0
    changed = safe.join(clean.select("doc_id", F.col("text").alias("old")), "doc_id").where("not (text <=> old)")
    assert changed.count() == changed.where(F.col("text").contains("[SECRET]")).count() > 0
    assert safe.where("n_chars <> char_length(text)").count() == clean.where("n_chars <> char_length(text)").count()
    out = cp.mix_sources(spark, safe, SF)
    assert out.count() == safe.count()
    total = out.agg(F.sum("taken"), F.sum("size")).first()
    assert total[0] == pytest.approx(total[1], rel=0.02)
    assert [x[1] for x in cp.STAGES] == [cp.keep_quality, cp.drop_near_copies, cp.drop_contaminated, cp.redact_secrets, cp.mix_sources]


def test_odd_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, size long"
    rows = [(1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, "a", 1), (3, "password=abcdefghijklmnop", None, "s", 25, "a", 1), (3, "password=abcdefghijklmnop", None, "s", 25, "a", 1), (4, "w " * 100_000, "en", None, 200_000, "b", 1), (None, "no id here", "en", "t", 10, "b", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert cp.mix_sources(spark, docs, SF).count() == 6
    redacted = {r.doc_id: r.text for r in cp.redact_secrets(spark, docs, SF).collect()}
    assert redacted[3] == "[SECRET]" and redacted[1] is None and redacted[None] == "no id here"


def test_threshold_is_the_contract(spark):
    assert quality.THRESHOLD == 0.7
