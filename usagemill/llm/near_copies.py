"""Near copies by SimHash candidates: classes of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Pairs of that similarity differ in about ten of 64 bits of a fingerprint over shingles, which no affordable set of
deletion variants reaches, since one changed word changes five shingles. Fingerprints are therefore taken over the
different words of a text, have 256 bits, and are cut into eight segments; a pair is a candidate if some segment
differs in at most one bit. Each different segment is looked up with every one of its set bits cleared, once however
many texts have it, and only then do pairs of segments become pairs of texts. Candidates are dropped beyond FAR
differing bits, and verified on their whole sets of shingles. This step is a search: what share of the similar pairs it
finds is measured (README), not proven.

The members of a segment that many fingerprints share, or have but for one bit, aren't paired up. They are compared with
each other by an exact join instead: two sets of similarity 0.8 share a shingle within their prefixes, the first n - ceil(0.8 n) + 1 shingles in an
order that puts rare ones first. A shingle's sets are first compared with one leader, the set with the fewest
shingles of its own. Since only classes are asked for, just sets of different classes meet after that, and are
compared if their sizes, less the shingles that no other set has, let them reach the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, release, small_batches, staged, text_hash
from .components import components
from .simhash import _LOWER, _blocks, spread

WORDS = 5
#: The least similarity is LEAST[0] / LEAST[1].
LEAST = (4, 5)
#: Segments of a fingerprint, of 32 bits each, and the differing bits beyond which a candidate isn't verified.
SEGMENTS = 8
FAR = 48
#: The members of a segment, or of two that differ in one bit, aren't paired up if there are more.
CROWD = 8
#: Shingles up to which a set travels whole with each of its shingles.
LONG = 2_000
#: Rows up to which a counted table is broadcast.
SMALL = 200_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The different hashed shingles of a UTF-8 text, sorted; fewer words than a shingle has are one shingle, none give none."""
    found, carry, digest = [], [], xxhash.xxh64_intdigest
    for block in _blocks(text):
        parts = carry + block.translate(_LOWER).split()
        carry = parts[max(0, len(parts) - words + 1) :]
        if len(parts) >= words:
            whole = b" ".join(parts)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = [digest(whole[s:e], 42) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]
            found.append(np.unique(np.array(hashes, np.uint64).view(np.int64)))
    if not found:
        return np.array([digest(b" ".join(carry), 42)] if carry else [], np.uint64).view(np.int64)
    return np.unique(np.concatenate(found))


def word_print(text: bytes, segments: int = SEGMENTS) -> tuple[int, np.ndarray]:
    """A hash of the sequence of lower-cased words, and the fingerprint of the set of words as signed 32-bit segments (zeros if there is none)."""
    whole, seen, ones = xxhash.xxh64(seed=42), set(), np.zeros(32 * segments, np.int64)
    rounds = -(-segments // 4)
    for block in _blocks(text):
        parts = block.translate(_LOWER).split()
        if parts:
            whole.update(b" ".join(parts) + b" ")
        fresh = set(parts) - seen
        seen |= fresh
        fresh = list(fresh)
        for i in range(0, len(fresh), 1 << 14):
            raw = b"".join([xxhash.xxh3_128_digest(w, r) for w in fresh[i : i + (1 << 14)] for r in range(rounds)])
            ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16 * rounds)[:, : 4 * segments], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return whole.intdigest(), np.packbits(ones * 2 > len(seen), bitorder="little").view(np.int32)


def _bytes(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("sig"), text.alias("text"))


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, node, segments) for every row: node is a hash of the words in order."""
    lists = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("node", pa.int64()), ("segments", lists)])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                found = [word_print(_bytes(t)) for t in batch.column(2)]
                node = pa.array(np.array([n for n, _ in found], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array([x for _, x in found], lists)], schema=schema)

    return _rows(docs).mapInArrow(run, "doc_id long, sig long, node long, segments array<int>")


def _grams(docs: DataFrame, words: int) -> DataFrame:
    """(sig, grams) for every row."""
    schema = pa.schema([("sig", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                grams = [shingles(_bytes(t), words) for t in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(grams, pa.list_(pa.int64()))], schema=schema)

    return _rows(docs).mapInArrow(run, "sig long, grams array<long>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _sets(nodes: DataFrame, docs: DataFrame, heads: DataFrame, words: int) -> DataFrame:
    """(node, grams) of some nodes; only their texts are read."""
    few = staged(heads.join(nodes, "node", "left_semi").select("node", F.col("sig").alias("_sig")), "few")
    # Rows that repeat a text give it once.
    own = docs.select("doc_id", "text").withColumn("_s", text_hash()).join(_small(few.select(F.col("_sig").alias("_s"))), "_s", "left_semi").dropDuplicates(["_s"]).drop("_s")
    out = staged(_grams(own, words).join(few, F.col("sig") == F.col("_sig")).select("node", "grams"), "sets")
    release(few)
    return out


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, both, nu, nv) with the number of shared shingles of every pair of sets."""
    a, b = sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), sets.select(F.col("node").alias("v"), F.col("grams").alias("gv"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("gu", "gv")).alias("both"), F.size("gu").alias("nu"), F.size("gv").alias("nv"))


def _reaches(both: Column, nu: Column, nv: Column, num: int, den: int) -> Column:
    """both / (nu + nv - both) >= num / den, in whole numbers."""
    return both * (num + den) >= (nu + nv) * num


def _prefixes(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(node, n, own, pos, gram) for the shared shingles in the prefix of each set of n shingles, of which ``own`` are in no other set.

    Shingles are ordered by the number of sets that have them. A set whose own shingles fill its prefix is like no other.
    """
    num, den = least
    each = sets.select("node", F.explode("grams").alias("gram"))
    common = staged(each.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "common")
    shared = each.join(common, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "gram"))).alias("shared"))
    rows = sets.select("node", F.size("grams").alias("n")).join(shared, "node").withColumn("own", F.col("n") - F.size("shared"))
    room = F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1 - F.col("own")
    rows = rows.where(room >= 1).select("node", "n", "own", F.posexplode(F.slice("shared", F.lit(1), room.cast("int"))).alias("pos", "x"))
    return rows.select("node", "n", "own", "pos", F.col("x.gram").alias("gram"))


def _forks(rows: DataFrame) -> DataFrame:
    """rows (gram, label, node, n, most) of shingles with several labels, with bit, above and side instead of the label.

    Two rows of a shingle with different labels agree in bit and above, on opposite sides, once: at the highest bit in which
    the labels' numbers differ. Rows of one label never do, so that a large class isn't compared with itself.
    """
    each = Window.partitionBy("gram")
    numbers = rows.select("gram", "label").distinct().select("gram", "label", (F.row_number().over(each.orderBy("label")) - 1).alias("no"), F.count("*").over(each).alias("labels"))
    numbers = staged(numbers.where("labels > 1"), "numbers")
    bits = rows.join(numbers, ["gram", "label"]).select("gram", "node", "n", "most", "no", F.explode(F.expr("sequence(0, char_length(bin(labels - 1)) - 1)")).alias("bit"))
    return bits.select("gram", "bit", F.expr("shiftright(no, bit + 1)").alias("above"), F.expr("shiftright(no, bit) & 1").alias("side"), "node", "n", "most")


def links(sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(u, v) links between sets (node, grams) whose closure is that of all pairs of at least the least similarity."""
    num, den = least
    alike = lambda pairs: _similar(pairs, sets).where(_reaches(F.col("both"), F.col("nu"), F.col("nv"), num, den)).select("u", "v")
    members = staged(_prefixes(sets, least), "members")
    # Written, so that the joins have a shuffle on either side and a frequent shingle's rows can be split.
    leaders = staged(members.groupBy("gram").agg(F.count("*").alias("k"), F.min(F.struct("own", "node")).alias("x")).where("k > 1").select("gram", F.col("x.node").alias("lead")), "leaders")
    led = members.join(leaders, "gram").where("lead <> node").select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v")).distinct()
    found = staged(alike(led), "led")
    labels = members.select("node").distinct().join(components(found).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("label"))
    told = staged(members.join(staged(labels, "labels"), "node"), "told")
    # Shingles with sets of one class are done; n is at least low in the rest.
    open_ = staged(told.groupBy("gram").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.min("n").alias("low")).where("a < z").select("gram", "low"), "open")
    # A pair shares no more than what either set has in common with any.
    # Nor, if this shingle is the first that it shares, what comes later in the order.
    rest = told.join(open_, "gram").withColumn("most", F.col("n") - F.col("own") - F.col("pos")).where(_reaches(F.col("most"), F.col("low"), F.col("n"), num, den))
    rest = _forks(staged(rest.select("gram", "label", "node", "n", "most"), "rest"))
    whole = sets.select(F.col("node").alias("_n"), F.when(F.size("grams") <= LONG, F.col("grams")).alias("grams"))
    rest = rest.join(whole, F.col("node") == F.col("_n")).drop("_n")
    a, b = rest.where("side = 0").alias("a"), rest.where("side = 1").alias("b")
    same = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.bit") == F.col("b.bit")) & (F.col("a.above") == F.col("b.above"))
    fits = same & _reaches(F.least("a.most", "b.most"), F.col("a.n"), F.col("b.n"), num, den)
    short = (F.col("a.n") <= LONG) & (F.col("b.n") <= LONG)
    ends = [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]
    # Short sets are verified inside the join, which gives out links only; of long ones, which don't travel with each shingle, pairs are verified.
    near = a.join(b, fits & short & _reaches(F.size(F.array_intersect("a.grams", "b.grams")), F.col("a.n"), F.col("b.n"), num, den)).select(*ends)
    pairs = a.join(b, fits & ~short).select(*ends).distinct()
    return found.union(staged(near.distinct(), "near")).union(alike(staged(pairs, "long-pairs")))


def _candidates(heads: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) of nodes with a segment that differs in at most one bit, and (node) of those with one that over ``crowd`` nodes share or have beside a bit.

    Two of the latter aren't paired. Segments are looked up as different values, each once however many nodes have it: a value
    has at most 32 others one bit away, while nodes would come once more for each bit that some node of their group has changed.
    """
    value = F.expr("shiftleft(cast(_no as bigint), 32) | (_part & 4294967295L)")
    segments = heads.select("node", F.posexplode("segments").alias("_no", "_part")).select("node", value.alias("value"))
    values = staged(segments.groupBy("value").agg(F.count("*").alias("n")), "values")
    ones = spread(values, 32).select("value", F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_i"))
    ones = ones.where("(shiftright(value, _i) & 1) = 1").select(F.expr("value ^ shiftleft(1L, _i)").alias("low"), "_i", "m")
    beside = ones.join(values, ones["low"] == values["value"]).select("low", F.expr("low | shiftleft(1L, _i)").alias("high"), F.expr("m + n").alias("n"))
    groups = staged(beside.union(values.where("n > 1").select("value", "value", "n")), "groups")
    ends = lambda some: staged(some.select(F.explode(F.array("low", "high")).alias("value")).distinct(), "ends")
    crowded, few = ends(groups.where(F.col("n") > crowd)), groups.where(F.col("n") <= crowd).select("low", "high")
    many = staged(segments.join(_small(crowded), "value", "left_semi").select("node").distinct(), "many")
    paired = ends(few)
    held = segments.join(_small(paired), "value", "left_semi").join(_small(many.withColumn("many", F.lit(True))), "node", "left")
    held = staged(held.select("node", "value", F.coalesce("many", F.lit(False)).alias("many")), "held")
    a, b = held.select(F.col("value").alias("low"), F.col("node").alias("a"), F.col("many").alias("am")), held.select(F.col("value").alias("high"), F.col("node").alias("b"), F.col("many").alias("bm"))
    # Two members of crowded groups are compared by links().
    pairs = few.join(a, "low").join(b, "high").where("(low < high or a < b) and not (am and bm)").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    prints = heads.select("node", "segments")
    off = F.lit(0)
    for k in range(SEGMENTS):
        off = off + F.bit_count(F.col("su")[k].bitwiseXOR(F.col("sv")[k]).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))  # bit_count widens with the sign
    pairs = pairs.join(prints.select(F.col("node").alias("u"), F.col("segments").alias("su")), "u").join(prints.select(F.col("node").alias("v"), F.col("segments").alias("sv")), "v").where(off <= FAR)
    pairs = staged(pairs.select("u", "v"), "pairs")
    release(values, groups, crowded, paired, held)
    return pairs, many


def _found(docs: DataFrame, heads: DataFrame, words: int, least: tuple[int, int], crowd: int) -> DataFrame:
    """(u, v) links between nodes."""
    num, den = least
    pairs, many = _candidates(heads, crowd)
    sets = _sets(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).union(many).distinct(), docs, heads, words)
    found = _similar(pairs, sets).where(_reaches(F.col("both"), F.col("nu"), F.col("nv"), num, den)).select("u", "v")
    if many.limit(1).count():
        found = found.union(links(staged(sets.join(many, "node", "left_semi"), "crowd"), least))
    return found


def copies(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST, crowd: int = CROWD) -> DataFrame:
    """(doc_id, sig) of the rows to drop, so that one is left of each class of near copies: the one with the smallest doc_id.

    Classes are the closure of the pairs found of at least the least similarity. sig is text_hash(); rows without doc_id come
    last, ties fall to the smallest sig, and rows that repeat both aren't told apart. Texts with the same words in order,
    but for A-Z and white space, are copies; so are all without words, null ones included. A text of fewer words than a
    shingle is one shingle. Very long texts are taken in blocks. Other columns aren't read. An empty table gives an empty result.
    """
    prints = staged(_prints(docs), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    heads = staged(prints.groupBy("node").agg(F.min("sig").alias("sig"), F.min(first).alias("first"), F.first("segments").alias("segments")), "heads")
    roots = components(_found(docs, heads, words, least, crowd))
    classes = staged(heads.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"), "classes")
    kept = classes.groupBy("root").agg(F.min("first").alias("kept"))
    of = staged(classes.join(staged(kept, "kept"), "root").select("node", "kept"), "of")
    rows = prints.select("node", "doc_id", "sig").distinct().join(of, "node")
    return rows.where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("sig") == F.col("kept.sig")))).select("doc_id", "sig")
