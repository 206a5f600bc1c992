"""Secret scans: base patterns, and weak parts that are reported only beside their complement.

Matches are located without Python: a text is split by the pattern, and the lengths of the pieces and of the matches
add up to positions in code points. Weak access identifiers, secrets and endpoints are linked by an interval join:
every part falls into a cell as wide as the scope, each cell keeps the first and last start of each part, and a part
looks into its own cell and the two beside it. That is exact and never pairs up the parts of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fixed values of the base kinds: (kind, pattern, cheap test, group whose length counts, least length).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 0, 16),
)
#: Weak parts: (kind, part, pattern, group, least length). Alone they are too common to report.
WEAK = (
    ("weak_id", "id", r"(?i)(?:access_?key_?id|account_?id|client_?id|user_?name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", 0, 1),
    ("weak_secret", "secret", r"(?i)(?:passphrase|pwd|credential|auth)[\"']?\x20*[:=]\x20*[\"']?[^\x20\x09-\x0D\"']{6,}", 0, 1),
    ("endpoint", "endpoint", r"(?i)(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+", 0, 1),
)
#: Parts that the base kinds stand for.
PARTS = {"assign": "secret", "access": "id", "hex": "secret"}
#: A weak part is reported if one of these parts starts within the scope.
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
#: Code points within which complementary parts must start.
SCOPE = 200


_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Matches that a fold takes at a time; folds copy what they have gathered.
CHUNK = 256


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def spans(text: Column, kind: int, pattern: str, test: str | None, group: int, least: int, chunk: int = CHUNK) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches whose group is long enough.

    Positions are running sums of the lengths of pieces and matches: first over chunks of matches, then within each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.transform(found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
    sizes = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), F.transform(found, F.char_length).alias("len"), counted.alias("counted"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["counted"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(items, begin):
        return F.aggregate(items, F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda acc: acc["out"])

    def whole(items):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / chunk).cast("int")), lambda k: F.slice(items, k * chunk + 1, chunk))
        return F.when(F.size(items) <= chunk, placed(items, F.lit(0))).otherwise(_let(chunks, many))

    def many(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"]))
        begins = F.aggregate(totals, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)))
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), F.slice(begins, F.lit(1), F.size(chunks)).alias("b")), lambda x: placed(x["c"], x["b"])))

    # The last piece follows the last match and has none of its own.
    matched = _let(F.filter(sizes, lambda x: x["len"].isNotNull()), whole)
    return F.when(text.rlike(test or pattern), matched).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, doc_id, sig, base, spans) with every base span and every linked weak span, ordered by start, then kind.

    A null text counts as empty. Repeated rows each get a row: ``row`` tells them apart, and sig, a hash of the text. Positions are code points.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [(k, *x[1:]) for k, x in enumerate(BASE)] + [(len(BASE) + k, x[2], None, x[3], x[4]) for k, x in enumerate(WEAK)]
    found = staged(docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("sig"), text.alias("text")).select("doc_id", "sig", F.concat(*[spans(F.col("text"), *x) for x in kinds]).alias("found")).withColumn("row", F.monotonically_increasing_id()), "spans")
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    names = [x[0] for x in BASE] + [x[0] for x in WEAK]
    part = [PARTS.get(n) or next(x[1] for x in WEAK if x[0] == n) for n in names]
    parts = F.array(*[F.lit(p) for p in part])
    # Only documents with a weak part take part in the join.
    each = found.where(F.exists("found", lambda x: x["kind"] >= len(BASE))).select("row", F.explode("found").alias("x")).select("row", "x.*")
    each = each.withColumn("part", F.element_at(parts, F.col("kind") + 1)).withColumn("cell", F.floor(F.col("start") / scope))
    cells = each.groupBy("row", "cell", "part").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = cells.select("row", F.col("part").alias("other"), "first", "last", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    fits = (F.col("first") <= F.col("start") + scope) & (F.col("first") >= F.col("start") - scope) | (F.col("last") <= F.col("start") + scope) & (F.col("last") >= F.col("start") - scope)
    needed = F.lit(False)
    for own, others in NEEDS.items():
        needed = needed | (F.col("part") == own) & F.col("other").isin(*others)
    weak = each.where(F.col("kind") >= len(BASE)).join(near, ["row", "cell"]).where(fits & needed)
    linked = weak.groupBy("row", "start", "kind", "end").agg(F.lit(1).alias("one")).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    both = found.join(linked, "row", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return both.select("row", "doc_id", "sig", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", empty))).alias("spans"))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(x[0]) for x in (*BASE, *WEAK)])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of the base spans and all spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scan(docs, scope).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """text with every span (overlaps merged) replaced by the mask; null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.char_length(text)))))
    return F.when(F.size(found) > 0, F.array_join(done, mask)).otherwise(text)
