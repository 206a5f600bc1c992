"""Mixing sources to target token weights by entropy balancing, with DataFrame operations only.

The rates r_d minimise sum(KL(r_d | q_d)) over documents under one token constraint for each source,
sum(size_d * r_d) = target_s, and 0 <= r_d <= most. Their solution is the exponential tilt
r_d = min(most, q_d * exp(lambda_s * z_d)), z_d being the document's size in units of its source's mean size; lambda_s
solves the convex dual by Newton's iterations. Gradient and Hessian are sums over documents, kept pre-aggregated by
(source, size, q). A source that gives words up thus loses long documents first, and one that repeats words repeats long
documents first. Rates are rounded into whole copies by carrying the rounding error from larger to smaller documents
within buckets of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, joined_stats, release, staged

#: Documents in a bucket within which rounding errors are carried, on average.
BUCKET = 400
#: Sources up to which what holds for each is broadcast.
SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources plus ``place``: 0-based place of ``source`` by code point, null last, without a one-task sort."""
    order = F.col("source").asc_nulls_last()
    ids = staged(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_id", 33)
    counts = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.join(F.broadcast(starts), part == F.col("_part")).withColumn("place", place).drop("_id", "_part", "_start")


def targets(sources: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, place): shares by weight, stopped at ``most`` times the source's size."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    own = staged(sources.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))), "weights")
    limit = F.col("source_size") * F.lit(float(most))
    level, seen = None, -1
    while True:
        held = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level)
        row = own.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(held, F.col("source_size"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count_if(held).alias("held"),
        ).first()
        if not row["total"] or not row["free"] or row["held"] == seen:
            break
        seen, level = row["held"], max(0.0, row["total"] - most * row["fixed"]) / row["free"]
    return own.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level or 0.0)))).drop("weight")


def _by_source(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """rows ⋈ a row for each source, which is broadcast if few are counted; a source's rows are pre-aggregated by size."""
    other = aims.withColumnRenamed("source", "_s")
    few = aims.limit(SOURCES + 1).count() <= SOURCES
    return rows.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def tilts(masses: DataFrame, aims: DataFrame, most: float = 3.0, rounds: int = 100, close: float = 1e-10) -> DataFrame:
    """(source, tilt): lambda of each source, from (source, z, q, mass) and (source, target).

    mass is the words of the documents with this z and q. Newton's step is taken on the logarithm of the mixed words and
    kept between the tilts that were seen to give too few and too many. A target of all that a source can give has an infinite tilt.
    """
    live = masses.where("mass > 0 and q > 0")
    live = staged(_by_source(live, aims.select("source", "target")).where("target > 0"), "masses")
    none = F.lit(None).cast("double")
    sums = live.groupBy("source").agg(F.first("target").alias("target"), F.sum("mass").alias("all"))
    full = F.col("target") >= F.col("all") * (most * (1 - 1e-12))
    first = F.when(full, F.lit(float("inf"))).otherwise(F.log(F.col("target") / F.col("all")))
    now = staged(sums.select("source", first.alias("tilt"), none.alias("low"), none.alias("high"), full.alias("done")), "tilts")
    for _ in range(rounds):
        if not now.where("not done").limit(1).count():
            break
        raised = F.col("q") * F.exp(F.col("tilt") * F.col("z"))
        got = (
            _by_source(live, now)
            .groupBy("source")
            .agg(
                *[F.first(c).alias(c) for c in ("tilt", "low", "high", "done", "target")],
                F.sum(F.col("mass") * F.least(raised, F.lit(most))).alias("got"),
                F.sum(F.when(raised < most, F.col("mass") * F.col("z") * raised).otherwise(0.0)).alias("slope"),
            )
        )
        off = F.log("target") - F.log(F.greatest("got", F.lit(1e-300)))
        step = F.when(F.col("slope") > 0, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), off * F.col("got") / F.col("slope")))).otherwise(F.signum(off))
        found = got.withColumns({"off": off, "next": F.col("tilt") + step})
        found = found.withColumns({"low": F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("high"))})
        inside = F.coalesce((F.col("next") > F.col("low")) & (F.col("next") < F.col("high")), F.lit(True))
        then = F.when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("done") | (F.abs("off") <= close) | (then == F.col("tilt"))
        before, now = now, staged(found.select("source", F.when(done, F.col("tilt")).otherwise(then).alias("tilt"), "low", "high", done.alias("done")), "tilts")
        release(before)
    return now.select("source", "tilt")


def _copies(most: float) -> Column:
    """Fold over a bucket's (minus size, doc_id, rate, times), largest first: copies of ``times`` equal rows together.

    They are the whole number nearest to their rates and the words carried on, at most one copy a row from the rate.
    """
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("copies"))

    def step(acc, x):
        size, whole = -x["less"], F.floor(x["rate"] + F.lit(1e-9))
        wanted = F.when(size > 0, F.floor(x["rate"] * x["times"] + acc["owed"] / size + F.lit(0.5))).otherwise(whole * x["times"])
        given = F.greatest(F.greatest(whole - 1, F.lit(0)) * x["times"], F.least(F.least(whole + 1, F.lit(int(most))) * x["times"], wanted)).cast("long")
        return F.struct((acc["owed"] + (x["rate"] * x["times"] - given) * size).alias("owed"), F.concat(acc["copies"], F.array(given)).alias("copies"))

    return F.aggregate("items", start, step, lambda acc: acc["copies"])


def _repeated(rows: DataFrame, times: str, most: int = 10_000) -> DataFrame:
    """Each row as often as ``times`` says, made in steps of at most ``most``."""
    last = F.ceil(F.col(times) / F.lit(float(most))).cast("long")
    steps = rows.where(F.col(times) > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("_step"))
    n = F.least(F.lit(most).cast("long"), F.col(times) - (F.col("_step") - 1) * most)
    return steps.select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_one")).drop(times, "_step", "_one")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0, bucket: int = BUCKET, prior: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) for every row of docs (doc_id, source, text).

    prior names a column of docs with the rates q that the mix departs from; without it, or where it is null, q is 1. A
    null text has size 0 and takes nothing, like an empty one; a very long one is but a large size. Null is a source of its
    own, placed last. Repeated rows, rows that share a doc_id and rows without one count and are mixed one by one. Other
    columns aren't read, whatever their names. An empty table gives an empty result.
    """
    own = F.col("source").cast("string").alias("source")
    q = F.coalesce(F.col(prior).cast("double"), F.lit(1.0)) if prior else F.lit(1.0)
    sized = staged(docs.select("doc_id", own, word_count(F.col("text").cast("string")).alias("size"), q.alias("q")), "sizes")
    classes = staged(sized.groupBy("source", "size", "q").agg(F.count("*").alias("n")), "classes")
    sums = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    aims = staged(targets(ranked(sums), weights, most), "targets")
    masses = _by_source(classes, aims.select("source", "source_size", F.col("n").alias("_n"))).select("source", (F.col("size") * F.col("_n") / F.col("source_size")).alias("z"), "q", (F.col("size") * F.col("n")).cast("double").alias("mass"))
    tilt = tilts(masses, aims.select("source", "target"), most).withColumnRenamed("source", "_s")
    known = staged(aims.join(tilt, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "rates")
    # Equal rows are one item until they are dealt out, so that a doc_id that many rows share is spread by size and counted.
    items = joined_stats(sized.groupBy("doc_id", "source", "size", "q").agg(F.count("*").alias("times")), known, "source")
    z = F.col("size") * F.col("n") / F.col("source_size")
    rate = F.when(F.col("size") == 0, F.least(F.lit(float(most)), F.col("q"))).otherwise(F.coalesce(F.least(F.lit(float(most)), F.col("q") * F.exp(F.col("tilt") * z)), F.lit(0.0)))
    part = F.pmod(F.xxhash64("doc_id", "size", "q"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(bucket)))))
    item = F.struct((-F.col("size")).alias("less"), "doc_id", rate.alias("rate"), "times")
    grouped = items.groupBy("place", part.alias("part")).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.array_sort(F.collect_list(item)).alias("items"))
    each = grouped.select("source_size", "target", F.explode(F.arrays_zip("items", _copies(most).alias("copies"))).alias("x"))
    size, times = -F.col("x.items.less"), F.col("x.items.times")
    least = F.floor(F.col("x.copies") / times)
    more = F.col("x.copies") - least * times  # rows that get one more
    each = each.select(
        F.col("x.items.doc_id").alias("doc_id"), size.alias("size"), "source_size", "target", F.col("x.items.rate").alias("rate"),
        F.explode(F.array(F.struct((least + 1).alias("copies"), more.alias("times")), F.struct(least.alias("copies"), (times - more).alias("times")))).alias("y"),
    )
    out = _repeated(each.select("doc_id", "size", "source_size", "target", "rate", "y.copies", "y.times"), "times")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
