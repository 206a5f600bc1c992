"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join has a shuffle on either side and the rows of a star's centre can be split.
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge and isn't its component's smallest node.

    edges has long columns u and v. Each round is cut with a written table, and the tables of earlier rounds go. Stars
    end up with their smallest node at the centre; an empty table gives an empty result.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        large, a = _large_star(now)
        large = staged(large, "large")
        small, b = _small_star(large)
        before, now = now, staged(small, "edges")
        release(before, large, a, b)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
