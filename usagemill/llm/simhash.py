"""SimHash near-duplicate classes by deletion-variant signatures.

Each 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most two bits have a half that
differs in at most one bit, so they share that half itself or one of its 32 one-wildcard variants, on opposite
sides of the wildcard. Variants are joined by equality and verified on all 64 bits. A variant that holds many
fingerprints isn't paired up: its members are dealt out again by wildcard variants of the other half, whose groups
hold only true links, and each such group gives a star instead of all pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, staged
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: A variant shared by more fingerprints than this gives stars instead of pairs.
CROWD = 32
#: Rows, of 64 bits each, that the broadcast filter of shared keys has at most, whatever the number of keys.
FILTER = 1 << 20


def _blocks(text: bytes, size: int = 1 << 20):
    """Stretches of about ``size`` bytes, cut at white space."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def simhash(text: bytes, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; 0 if it has no word. Memory doesn't grow with the text."""
    ones, n, carry, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for block in _blocks(text):
        parts = carry + block.translate(_LOWER).split()
        carry = parts[max(0, len(parts) - words + 1) :]
        if len(parts) < words:
            continue
        whole = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(whole[s:e], 42) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]
        n += len(hashes)
        bits = np.array(hashes, dtype="<u8")
        for i in range(0, len(bits), 1 << 16):
            ones += np.unpackbits(bits[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n:
        return digest(b" ".join(carry), 42) if carry else 0
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; a null text has no word."""

    def run(batches):
        for batch in batches:
            values = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(rows: DataFrame, parts: Column, count: int) -> DataFrame:
    """rows with key and side for each of ``count`` 32-bit parts (an array): the part as it is (side -1) and with one bit cleared (side: that bit).

    Two parts that differ in one bit share one key, on opposite sides; equal ones share all keys, once at side -1.
    """
    each = rows.select("*", parts.alias("_parts"), F.explode(F.sequence(F.lit(0), F.lit(count * 33 - 1))).alias("_c"))
    each = each.withColumn("_no", F.expr("_c div 33")).withColumn("_i", F.expr("cast(_c % 33 as int) - 1")).withColumn("_part", F.expr("_parts[cast(_no as int)] & 4294967295L"))
    key = F.expr("shiftleft(_no * 64 + _i + 1, 32) | if(_i < 0, _part, _part & ~shiftleft(1L, _i))")
    side = F.expr("cast(if(_i < 0, -1L, shiftright(_part, _i) & 1L) as tinyint)")
    return each.select(key.alias("key"), side.alias("side"), *rows.columns)


def _variants(distinct: DataFrame) -> DataFrame:
    """(key, side, fp) of both halves of a fingerprint."""
    return variants(distinct.select("fp"), F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)), 2)


def shared_members(keyed: DataFrame) -> DataFrame:
    """The rows of variants() whose key several rows share, those on one side of a cleared bit not counted, with their number n."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    # Written, so that the join has a shuffle on either side and a frequent variant's rows can be split.
    shared = staged(shared.where("n > 1 and (lo = -1 or lo < hi)").select("key", "n"), "shared")
    members = staged(_likely(keyed, shared).join(shared, "key"), "variants")
    release(shared)
    return members


def _likely(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of keyed whose key is in shared, and by chance some others, so that few rows are shuffled for the join on key.

    Keys are hashed to the bits of at most FILTER rows, which are broadcast. Very many keys set most bits: more rows are
    shuffled then, and the join gives the same.
    """
    at = F.pmod(F.xxhash64("key"), F.lit(64 * FILTER))
    word, bit = F.shiftright(at, 6), F.expr("shiftleft(1L, cast(_at & 63 as int))")
    bits = shared.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    near = keyed.withColumn("_at", at).withColumn("_bit", bit).join(F.broadcast(bits), word == F.col("_w"))
    return near.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*keyed.columns)


def spread(rows: DataFrame, made: int, most: int = 2_000_000) -> DataFrame:
    """rows dealt out evenly, so that a task makes at most about ``most`` new ones if each row makes ``made``."""
    return rows.repartition(max(1, rows.count() * made // most + 1))


def _rest_variants(many: DataFrame) -> DataFrame:
    """(key, cut, rest, fp) of members of crowded variants: the other half with two bits cleared if the key is a whole half, else with one."""
    two = F.array(*[F.lit(~(1 << i | 1 << j) & 0xFFFFFFFF) for i in range(32) for j in range(i)])
    one = F.array(*[F.lit(~(1 << i) & 0xFFFFFFFF) for i in range(32)])
    tag = F.shiftrightunsigned("key", 32)
    other = F.when(tag >= 64, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    cuts = F.when(tag.bitwiseAND(F.lit(63)) == 0, two).otherwise(one)
    each = many.select("key", "fp", other.alias("other"), F.explode(cuts).alias("cut"))
    return each.select("key", "cut", F.col("other").bitwiseAND(F.col("cut")).alias("rest"), "fp")


def links(distinct: DataFrame, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """(u, v) links between distinct fingerprints (column fp) that differ in at most two bits; their closure is exact."""
    if bits != 2:
        raise ValueError("two halves with one wildcard serve a distance of 2")
    members = shared_members(_variants(spread(distinct, 66)))
    few = members.where(F.col("n") <= crowd)
    a, b = few.select("key", F.col("fp").alias("u"), F.col("side").alias("s")), few.select("key", F.col("fp").alias("v"), F.col("side").alias("t"))
    pairs = a.join(b, "key").where("(s = -1 and u < v) or s < t").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).select("u", "v")
    many = _rest_variants(members.where(F.col("n") > crowd))
    star = many.groupBy("key", "cut", "rest").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = many.join(star, ["key", "cut", "rest"]).where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most two bits.

    Equal fingerprints fall together before anything is joined. Null and empty texts have fingerprint 0 and link
    like any other; very long ones are hashed in blocks. Rows that repeat a doc_id each get a row. A row without doc_id
    has a component_id too, that of the documents it links with, which is null if none has a doc_id. Other columns aren't
    read, whatever their names. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    heads = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    found = links(heads.select("fp"), bits, crowd)
    classes = heads.join(components(found), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "head")
    classes = staged(classes, "classes")
    least = staged(classes.groupBy("root").agg(F.min("head").alias("component_id")), "least")
    of = staged(classes.join(least, "root").select("fp", "component_id"), "roots")
    release(classes, least)
    # Both sides are written tables, so adaptive execution can split the rows of a fingerprint that a third of all documents share.
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
