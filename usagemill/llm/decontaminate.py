"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A window (13 words of an item) is contained in a document only if all of its words are, so its prefix is its single
rarest word. Words are ordered by how often they occur in the documents; the prefix words are joined with document
positions; length and positional bounds drop windows that would not fit; what is left is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark words up to which they are broadcast.
SMALL = 200_000


def words(text: Column) -> Column:
    """Words of a text after A-Z are lowered; a null text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)
    return F.filter(parts, lambda x: x != "")


def windows(items: DataFrame, width: int) -> DataFrame:
    """(win, item_id, words) with one row for each different window of an item."""
    own = items.select("item_id", words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(1), F.size("w") - width + 1)
    each = own.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, width))).alias("words")).distinct()
    return each.withColumn("win", F.xxhash64("item_id", F.array_join("words", " ")))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what has been counted to be small; beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, sig, n_words, n_hit, n_items, items (sorted array of strings), contaminated) for every row of docs.

    A document word inside any occurrence of a window is hit; share * n_hit >= n_words contaminates if n_hit > 0. Null
    or wordless texts on either side have no windows. Repeated rows each get a row; equal items with different ids
    all count. Empty tables give empty results or zero hits. sig is a hash of the text, which tells apart rows that
    repeat a doc_id with another text; a row without doc_id is judged like any other. A very long text is taken whole, as
    one array of words. Other columns aren't read, whatever their names.
    """
    each = staged(windows(items, width), "windows")
    text = F.col("text").cast("string")
    used = each.select(F.explode("words").alias("word")).distinct()
    loose = docs.select(F.explode(words(text)).alias("word"))
    counts = staged(loose.join(_small(used), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")), "counts")
    ranked = each.select("win", F.size("words").alias("len"), F.posexplode("words").alias("at", "word")).join(_small(counts), "word")
    # A window with a word that no document has can't occur.
    fits = ranked.groupBy("win").agg(F.min(F.struct("n", "word", "at")).alias("x"), F.count("*").alias("k"), F.first("len").alias("len")).where("k = len")
    prefix = staged(fits.select("win", "len", F.col("x.word").alias("word"), F.col("x.at").alias("at")), "prefixes")
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("_id"), F.xxhash64(text).alias("sig"), text.alias("text"))
    # Each document's words are led by an empty one, whose row carries the count of words past the join.
    split = rows.select("doc_id", "_id", "sig", words(F.col("text")).alias("w"))
    placed = split.select("doc_id", "_id", "sig", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    if prefix.limit(SMALL + 1).count() <= SMALL:
        met = placed.join(F.broadcast(prefix), "word", "left")
    else:  # words are shuffled, so the empty ones stay out of it
        met = placed.where("pos > 0").join(prefix, "word").unionByName(placed.where("pos = 0"), allowMissingColumns=True)
    met = met.withColumn("from", F.col("pos") - 1 - F.col("at")).where("pos = 0 or from >= 0 and from + len <= n_words")
    met = staged(met.select("doc_id", "_id", "sig", "n_words", "win", "from", "len"), "met")
    guesses = met.where("win is not null").drop("doc_id", "n_words").distinct()
    hits = staged(_verified(rows, guesses, each), "hits")
    counted = met.where("win is null").select("doc_id", "_id", "sig", F.col("n_words").cast("long").alias("n_words"))
    keys = ["_id", "sig"]
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.array().cast("array<string>")
    out = counted.join(hits, keys, "left").select("doc_id", "sig", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return out.select("doc_id", "sig", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", bad.alias("contaminated"))


def _verified(rows: DataFrame, guesses: DataFrame, each: DataFrame) -> DataFrame:
    """(_id, sig, n_hit, items) of the guesses whose words are those of the window; _id is a hash of doc_id."""
    keys = ["_id", "sig"]
    by_row = staged(guesses.groupBy(*keys).agg(F.collect_list(F.struct("win", "from", "len")).alias("guess")), "guesses")
    # Only the texts of documents with a guess are shuffled, where these documents are counted to be few.
    own = rows.join(_small(by_row.select(*keys)), keys, "left_semi").join(by_row, keys).dropDuplicates(keys).select(*keys, words(F.col("text")).alias("w"), "guess")
    cut = F.transform("guess", lambda g: F.struct(g["win"].alias("win"), g["from"].alias("from"), F.array_join(F.slice("w", g["from"] + 1, g["len"]), " ").alias("said")))
    said = own.select(*keys, F.explode(cut).alias("x")).select(*keys, "x.*")
    known = each.select("win", "item_id", F.size("words").alias("len"), F.array_join("words", " ").alias("said"))
    real = said.join(_small(known), ["win", "said"])
    runs = F.array_sort(F.collect_set(F.struct("from", (F.col("from") + F.col("len")).alias("to"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["to"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(acc["end"], x["from"]))).alias("n"))
    found = real.groupBy(*keys).agg(runs.alias("runs"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return found.select(*keys, F.aggregate("runs", start, step, lambda acc: acc["n"]).alias("n_hit"), "items")


def report(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """One row for each document: counts, a digest of the items found and the verdict; odd rows as in contamination()."""
    out = contamination(docs, items, width, share)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
