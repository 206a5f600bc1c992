"""Exact substring dedup by blockwise suffix sorting with a difference cover.

Every ``length``-byte window of a document is the head of a suffix. The suffix's bucket is the least K-byte hash in
its window (leftmost of equals), which depends on the window's bytes alone, so equal windows meet in a bucket at the
same distance from that anchor. Neighbouring windows of one anchor travel as one stretch of text, and only anchors
that occur more than once travel at all.

A block of buckets is sorted at a time. Stretches are laid out with their anchors at multiples of the cover's period;
the sample positions, whose residues form a difference cover, are ranked first. Suffixes are sorted by their first
PERIOD bytes; longer ties are resolved by the rank of the sample suffix within reach, and the few last bytes. Since
equal windows have equal residues, one look-up serves all of a tie. A block takes its buckets in turn, some BLOCK
windows at a time, and no bucket holds more than that, so memory is bounded.

Equal stretches of a frequent anchor are first reduced to one by a partial aggregate over their bytes. A bucket that
still has too many windows is split: windows at distances lo to hi from the anchor all hold the same bytes around it,
their core, and a half of these distances has a longer core, whose hash names a smaller bucket. At one distance the
core is the window itself. Equal windows share every core, so splitting changes no result; bytes decide throughout.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, joined_stats, pieces, release, small_batches, staged

LENGTH = 100
#: Bytes of an anchor.
K = 24
#: A perfect difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Occurrences of an anchor beyond which equal stretches are reduced to one first.
HOT = 200
#: Windows that are sorted at a time, that a bucket may hold, and in a block on average.
BLOCK = 200_000

assert {(a - b) % PERIOD for a, b in product(COVER, COVER)} == set(range(PERIOD))
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Bytes from a residue to the next sample position, by distance to the anchor modulo PERIOD.
_REACH = np.array([next(d for d in range(PERIOD) if (d - o) % PERIOD in COVER) for o in range(PERIOD)])
_INDEX = 24  # bits of a key for the place in a piece
_PIECE = 1 << 20


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from every position as one number; data must be padded by seven bytes."""
    return np.ndarray((len(data) - 7,), order + "u8", data, 0, (1,))


def _least(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of data (whether or not it crosses documents) its anchor's place, and the hash at every place."""
    n, wide = len(data) - length + 1, length - K + 1
    load = _words(data).copy()
    h = load[: n + wide - 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= load[8 : n + wide + 7] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= load[16 : n + wide + 15] * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(30)
    key = (h & np.uint64(0xFFFFFFFFFFFFFFFF ^ ((1 << _INDEX) - 1))) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < wide:
        key = np.minimum(key[: n], key[wide - span : wide - span + n])
    return (key[:n] & np.uint64((1 << _INDEX) - 1)).astype(np.int64), h


def _parts(data: np.ndarray, length: int):
    """(first byte, bytes, ends of documents by byte) of stretches of about _PIECE bytes that hold every window once."""
    n = len(data)
    for at in range(0, max(0, n - length + 1), _PIECE):
        stop = min(n, at + _PIECE + length - 1)
        yield at, np.concatenate((data[at:stop], np.zeros(8, np.uint8))), stop - at


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(first byte, place of each window's anchor, whether the window is inside a document, hashes) for each part."""
    for at, part, n in _parts(data, length):
        place, h = _least(part[: n + 8], length)
        place, windows = place[: n - length + 1], n - length + 1
        inside = np.ones(windows, bool)
        first, last = np.searchsorted(offsets, (at, at + n), side="left")
        for end in offsets[first : last + 1].tolist():  # windows that reach past a document's end
            inside[max(0, end - length + 1 - at) : max(0, end - at)] = False
        yield at, place, inside, h


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, pos) of every place that is the anchor of some window."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                data, offsets = buffers(batch.column(1))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                seen = np.zeros(len(data), bool)
                for at, place, inside, h in anchors(data, offsets, length):
                    mark = np.zeros(len(h), bool)
                    mark[place[inside]] = True
                    found = np.flatnonzero(mark)
                    found = found[~seen[at + found]]  # the last anchors of a part are the first of the next
                    seen[at + found] = True
                    spot = at + found
                    hashes = h[found].view(np.int64)
                    doc = np.searchsorted(offsets, spot, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids[doc]), pa.array((spot - offsets[doc]).astype(np.int32))], schema=schema)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "h long, doc_id long, pos int")


def _stretches(marked: DataFrame, length: int) -> DataFrame:
    """(h, hot, doc_id, start, n, off, bytes) from (doc_id, text, marks): n windows in a row of one repeated anchor.

    marks are 2 * pos + hot of the document's repeated anchors; off is the anchor's place in bytes.
    """
    kinds = [("h", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("bytes", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                data, offsets = buffers(batch.column(1))
                marks = batch.column(2)
                flat = marks.flatten().to_numpy(zero_copy_only=False)
                count = np.diff(marks.offsets.to_numpy())
                flag = np.zeros(len(data), np.uint8)
                flag[np.repeat(offsets[:-1], count) + (flat >> 1)] = 1 + (flat & 1)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for at, place, inside, h in anchors(data, offsets, length):
                    kind = np.where(inside, flag[at + place], 0)
                    edge = np.concatenate(([True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])))
                    begins = np.flatnonzero(edge)
                    n = np.diff(np.append(begins, len(place)))
                    live = kind[begins] > 0
                    begins, n = begins[live], n[live]
                    for i in range(0, len(begins), 20_000):
                        s, c = begins[i : i + 20_000], n[i : i + 20_000]
                        size = c + length - 1
                        ends = np.cumsum(size)
                        raw = data[np.arange(ends[-1]) + np.repeat(at + s - (ends - size), size)]
                        text = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(raw)])
                        doc = np.searchsorted(offsets, at + s, side="right") - 1
                        cols = [h[place[s]].view(np.int64), kind[s] == 2, ids[doc], (at + s - offsets[doc]).astype(np.int32), c.astype(np.int32), (place[s] - s).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), text], schema=schema)

    return small_batches(marked).select("doc_id", "text", "marks").mapInArrow(run, "h long, hot boolean, doc_id long, start int, n int, off int, bytes binary")


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Number of the class of each row, rows being sorted."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def later_windows(h: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, off: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple:
    """(doc, start, n) of the windows of a block that occur earlier in it; rows are stretches of text."""
    first: dict[bytes, int] = {}
    lead = np.zeros(len(h), bool)
    for i in np.lexsort((start, doc)).tolist():
        lead[i] = first.setdefault(texts[i], i) == i
    out = [(doc[~lead], start[~lead].astype(np.int64), n[~lead].astype(np.int64))]
    rows = np.flatnonzero(lead)
    values, where, counts = np.unique(h[rows], return_inverse=True, return_counts=True)
    rows, bucket = rows[counts[where] > 1], where[counts[where] > 1]
    if len(rows):
        reach = length - PERIOD + 1  # bytes by which samples are ranked
        size = (n[rows] + length - 1).astype(np.int64)
        lead_in = -off[rows].astype(np.int64) % PERIOD
        slots = -(-(lead_in + size) // PERIOD) * PERIOD
        base = np.cumsum(slots) - slots + lead_in
        text = np.zeros(int(slots.sum()) + 16, np.uint8)
        text[np.arange(size.sum()) + np.repeat(base - (np.cumsum(size) - size), size)] = np.frombuffer(b"".join([texts[i] for i in rows.tolist()]), np.uint8)
        load = _words(text, ">")
        word = lambda at: load[at].astype(np.uint64)
        # Ranks of the sample suffixes.
        held = size - reach + 1
        sample = np.arange(held.sum()) + np.repeat(base - (np.cumsum(held) - held), held)
        sample = sample[_IN_COVER[sample % PERIOD]]
        keys = [word(sample + k) for k in [*range(0, reach - 8, 8), reach - 8]]
        order = np.lexsort(keys[::-1])
        rank = np.zeros(len(text), np.int64)
        rank[sample[order]] = _dense(*(k[order] for k in keys))
        # Suffixes, bucket by bucket, by their first PERIOD bytes.
        c = n[rows].astype(np.int64)
        row = np.repeat(np.arange(len(rows)), c)
        place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        at, gap = base[row] + place, off[rows][row] - place
        keys = [bucket[row] * (length + 1) + gap, *(word(at + k) for k in (0, 8, 16, PERIOD - 8))]
        order = np.lexsort(keys[::-1])
        tie = _dense(*(k[order] for k in keys))
        many = np.bincount(tie)[tie] > 1
        order, tie = order[many], tie[many]
        if len(order):
            at, gap, row, place = at[order], gap[order], row[order], place[order]
            own, spot = doc[rows][row], start[rows][row] + place
            keys = [tie, rank[at + _REACH[gap % PERIOD]], *(word(at + k) for k in (reach, reach + 8, reach + 16, length - 8))]
            order = np.lexsort((spot, own, *keys[::-1]))
            group = _dense(*(k[order] for k in keys))
            later = order[np.concatenate(([False], group[1:] == group[:-1]))]
            # Windows in a row become runs.
            later = later[np.lexsort((place[later], row[later]))]
            r, p = row[later], place[later]
            begins = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)))) if len(later) else later
            out.append((own[later][begins], spot[later][begins].astype(np.int64), np.diff(np.append(begins, len(later)))))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _sorted_blocks(cold: DataFrame, blocks: int, block: int, length: int) -> DataFrame:
    """(doc_id, start, n) runs of windows that occur earlier; the buckets of a block are sorted some ``block`` windows at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("h").to_numpy(), kind="stable"))).combine_chunks()
        h, doc, start, n, off = (table.column(k).to_numpy() for k in ("h", "doc_id", "start", "n", "off"))
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))  # of buckets
        windows, at, found = np.cumsum(n.astype(np.int64)), 0, []
        while at < len(h):
            most = (windows[at - 1] if at else 0) + block
            k = int(np.searchsorted(windows[ends - 1], most, side="right")) - 1
            end = int(max(ends[max(k, 0)], ends[np.searchsorted(ends, at, side="right")]))
            own = slice(at, end)
            found.append(later_windows(h[own], doc[own], start[own], n[own], off[own], table.column("bytes").slice(at, end - at).to_pylist(), length))
            at = end
        doc, start, n = (np.concatenate([x[k] for x in found]) for k in range(3))
        return pa.Table.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], schema=schema)

    numbered = cold.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))
    return numbered.groupBy("block").applyInArrow(run, "doc_id long, start int, n int")


def _different(frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of equal stretches, and (doc_id, start, n) of the others.

    The first is taken with a partial aggregate, so that copies meet in no task.
    """
    rest = [c for c in frequent.columns if c not in ("doc_id", "start", "bytes")]
    leads = staged(frequent.groupBy("bytes").agg(F.min(F.struct("doc_id", "start", *rest)).alias("f")).select("f.*", "bytes"), "leads")
    ids = leads.select(F.col("bytes").alias("_bytes"), F.col("doc_id").alias("_doc"), F.col("start").alias("_start"))
    # leads is written, so that the join has a shuffle on either side and the rows of frequent bytes can be split.
    copies = frequent.select("doc_id", "start", "n", "bytes").join(ids, F.col("bytes") == F.col("_bytes")).where("doc_id <> _doc or start <> _start")
    return leads, copies.select("doc_id", "start", "n")


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """The rows' windows by halves of their buckets' distances lo to hi; h becomes the hash of the half's longer core."""
    halves = F.array(F.struct(F.col("lo").alias("a"), F.expr("(lo + hi) div 2").cast("int").alias("z")), F.struct(F.expr("(lo + hi) div 2 + 1").cast("int").alias("a"), F.col("hi").alias("z")))
    each = rows.select("*", F.explode(halves).alias("half")).select("*", "half.a", "half.z")
    each = each.withColumn("i", F.greatest(F.lit(0), F.col("off") - F.col("z"))).withColumn("k", F.least(F.col("n") - 1, F.col("off") - F.col("a"))).where("a <= z and i <= k")
    core = F.substring(F.col("bytes"), F.col("off") - F.col("a") + 1, F.lit(length) - F.col("z") + F.col("a"))
    return each.select(
        F.xxhash64("h", "a", core).alias("h"), F.col("a").alias("lo"), F.col("z").alias("hi"), "doc_id", (F.col("start") + F.col("i")).alias("start"),
        (F.col("k") - F.col("i") + 1).alias("n"), (F.col("off") - F.col("i")).alias("off"), F.substring(F.col("bytes"), F.col("i") + 1, F.col("k") - F.col("i") + length).alias("bytes"),
    )


def _split(rows: DataFrame, block: int, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stretches in buckets of at most ``block`` windows, and (doc_id, start, n) of those that were found equal to an earlier one."""
    ready, others = [], []
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(length - K)})
    while True:
        huge = staged(rows.groupBy("h").agg(F.sum("n").alias("w")).where(F.col("w") > block), "huge")
        if not huge.limit(1).count():
            return [*ready, rows], others
        told = joined_stats(rows, huge, "h", "left")
        ready.append(told.where("w is null").drop("w"))
        rows, copies = _different(_halves(told.where("w is not null").drop("w"), length))
        others.append(copies)


def _kept(cut: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept_sha256, kept) from (doc_id, text, runs)."""
    kinds = [("doc_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                data, offsets = buffers(batch.column(1))
                flat, ends = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
                starts, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                rows = []
                for k, ident in enumerate(batch.column(0).to_pylist()):
                    own = data[offsets[k] : offsets[k + 1]]
                    edge = np.zeros(len(own) + 1, np.int32)
                    s, c = starts[ends[k] - ends[0] : ends[k + 1] - ends[0]], n[ends[k] - ends[0] : ends[k + 1] - ends[0]]
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + c - 1 + length, -1)
                    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                    kept = own[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((ident, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return small_batches(cut).select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte is removed if a ``length``-byte string that covers it also starts earlier (at a smaller doc_id, or earlier in the
    document). A null text is empty; texts shorter than ``length`` are kept, and very long ones are taken in parts. Whole
    copies of a text, found by SHA-256, are removed before any sorting: all of their bytes start earlier. Equal rows are
    one document. Of rows that share a doc_id but not the text, the one with the smallest SHA-256 takes part, and the
    others are kept whole. So is a row without doc_id, which has no place in the order. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    if length < K + PERIOD:
        raise ValueError(f"length must be {K + PERIOD} at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    heads = staged(texts.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "heads")
    own = heads.groupBy("doc_id").agg(F.min("sha").alias("sha"), F.count_distinct("sha").alias("k"))
    odd = own.where("k > 1").select("doc_id", F.col("sha").alias("lead"))
    # Whole copies never enter the sort: all of their bytes start earlier.
    first = own.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    copies = staged(joined_stats(own.select("doc_id", "sha"), first, "sha").where("doc_id <> first").select("doc_id"), "copies")
    rows = staged(_anchor_rows(texts.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()), length), "anchors")
    # Written, so that the join has a shuffle on either side and a frequent anchor's rows can be split.
    often = staged(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "often")
    marks = rows.join(often, "h").select("doc_id", (F.col("pos").cast("long") * 2 + (F.col("m") > hot).cast("long")).alias("mark"))
    marks = staged(marks.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "marks")
    release(rows, often)
    taking = texts if not odd.limit(1).count() else texts.withColumn("_sha", F.sha2("text", 256)).join(odd.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left").where("lead is null or lead = _sha").select("doc_id", "text")
    parts = staged(_stretches(taking.join(marks, "doc_id").dropDuplicates(["doc_id"]) if heads.count() > own.count() else taking.join(marks, "doc_id"), length), "stretches")
    cold, more = parts.where("not hot").drop("hot"), []
    if parts.where("hot").limit(1).count():
        leads, others = _different(parts.where("hot").drop("hot"))
        cold, more = cold.unionByName(leads), [others]
    ready, others = _split(cold, block, length)
    cold = ready[0]
    for part in ready[1:]:
        cold = cold.unionByName(part)
    cold = cold.drop("lo", "hi")
    windows = cold.agg(F.sum("n")).first()[0] or 0
    runs = _sorted_blocks(cold, windows // block + 1, block, length)
    for other in [*more, *others]:
        runs = runs.union(other)
    runs = staged(runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs")
    release(marks, parts)
    cut = _kept(taking.join(runs, "doc_id"), length).drop("kept").dropDuplicates(["doc_id"])
    cut = staged(cut.withColumnRenamed("doc_id", "_d"), "cut")
    gone = copies.select(F.col("doc_id").alias("_c"))
    out = heads.join(cut, F.col("doc_id") == F.col("_d"), "left").join(gone, F.col("doc_id") == F.col("_c"), "left")
    if odd.limit(1).count():
        out = out.join(odd.withColumnRenamed("doc_id", "_o"), F.col("doc_id") == F.col("_o"), "left")
    else:
        out = out.withColumn("lead", F.lit(None).cast("string"))
    whole = F.col("lead").isNotNull() & (F.col("lead") != F.col("sha"))
    copy = ~whole & F.col("_c").isNotNull() & (F.col("n_bytes") >= length)
    pick = lambda col, if_copy, if_kept: F.when(whole, if_kept).when(copy, if_copy).otherwise(F.coalesce(col, if_kept))
    return out.select(
        "doc_id", "n_bytes",
        pick(F.col("n_removed"), F.col("n_bytes"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.col("n_spans"), F.lit(1), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.col("kept_sha256"), F.sha2(F.lit(""), 256), F.col("sha")).alias("kept_sha256"),
    )
