"""A training-data pipeline: STAGES are applied in turn to the documents, each over the rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm import decontaminate, mixing, near_copies, quality, secrets
from usagemill.llm.common import crc_of_id, release, staged, table, text_hash


#: Rows of decisions up to which they are broadcast to the texts.
SMALL = 200_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def _by_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id and text hash are (left_semi) or aren't (left_anti) among rows (doc_id, sig); a null doc_id matches a null one.

    rows, a written table, is broadcast if it is counted to be small, so that no text travels; beyond that both sides are shuffled.
    """
    key, sig = _free(docs, "_doc_id"), _free(docs, "_sig")
    other = rows.select(F.col("doc_id").alias(key), F.col("sig").alias(sig))
    other = F.broadcast(other) if rows.limit(SMALL + 1).count() <= SMALL else other
    return docs.join(other, docs["doc_id"].eqNullSafe(other[key]) & (text_hash() == other[sig]), how)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its threshold; it learns from the labels of docs that aren't held out.

    Rows are judged where they are, by their own texts, whether or not they share a doc_id or have none.
    """
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held))
    name = _free(docs, "_score")
    return quality.scored(docs, model, name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the one with the smallest doc_id.

    SimHash fingerprints find the candidates, whose similarity of 5-word shingles must be 0.8 or more.

    Rows that repeat that doc_id with the same text are reduced to one; with another text they are documents of their own.
    """
    rest = _by_text(docs, staged(near_copies.copies(docs), "copies"), "left_anti")
    sig = _free(docs, "_sig")
    repeated = docs.select("doc_id", text_hash().alias(sig)).groupBy("doc_id", sig).agg(F.count("*").alias("n")).where("n > 1")
    return rest if not repeated.limit(1).count() else rest.withColumn(sig, text_hash()).dropDuplicates(["doc_id", sig]).drop(sig)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = staged(found.where("contaminated").select("doc_id", "sig").distinct(), "contaminated")
    return _by_text(docs, bad, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret span by a mask; n_chars follows the text. Documents without secrets are left alone."""
    key, sig, spans = _free(docs, "_doc_id"), _free(docs, "_sig"), _free(docs, "_spans")
    found = secrets.scan(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("sig").alias(sig), F.col("spans").alias(spans))
    found = staged(found.dropDuplicates([key, sig]), "secrets")
    other = F.broadcast(found) if found.limit(SMALL + 1).count() <= SMALL else found
    both = docs.join(other, docs["doc_id"].eqNullSafe(other[key]) & (text_hash() == other[sig]), "left").drop(key, sig)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col(spans)))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: words taken of each document, so that sources meet their targets."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The classifier is trained here and fingerprints use a hash that DuckDB lacks: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and reread."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
