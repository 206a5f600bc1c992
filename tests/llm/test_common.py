"""Shared pieces: salted joins, staged tables, Arrow buffers and the checkpoint folder."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usagemill.llm import common


@pytest.mark.parametrize("most", [100, 1])
def test_joined_stats_by_broadcast_and_by_salt(spark, most):
    big = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i % 3}", 7) for i in range(60)], "id long, key string, n int")
    stats = spark.createDataFrame([(None, 1), ("k0", 2), ("k9", 3)], "key string, s int")
    inner = common.joined_stats(big, stats, "key", most=most)
    assert inner.columns == ["id", "key", "n", "s"]
    assert {(r.id, r.s) for r in inner.collect()} == {(i, 1 if i % 5 == 0 else 2) for i in range(60) if i % 5 == 0 or i % 3 == 0}
    assert common.joined_stats(big, stats, "key", "left", most=most).count() == 60


def test_staged_and_released(spark):
    out = common.staged(spark.range(10).groupBy((F.col("id") % 2).alias("k")).agg(F.sum("id").alias("s")), "test")
    assert {(r.k, r.s) for r in out.collect()} == {(0, 20), (1, 25)}
    path = out._staged.removeprefix("file://")
    assert os.path.isdir(path)
    common.release(out)
    assert not os.path.exists(path)


class FakeSession:
    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("C", (), {"master": master, "getConf": lambda _: {}})()


def test_shared_folder_is_the_sessions():
    assert common.shared_dir(FakeSession("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert common.shared_dir(FakeSession(None, "local[4]")) == "file:///tmp/usagemill-checkpoints"
    with pytest.raises(ValueError):
        common.shared_dir(FakeSession(None, "yarn"))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_buffers(kind):
    column = pa.array(["x", None, "é", "", "abc"], kind)
    for part, texts in ((column, ["x", "", "é", "", "abc"]), (column.slice(1, 3), ["", "é", ""]), (column.slice(0, 0), [])):
        data, offsets = common.buffers(part)
        raw = [t.encode() for t in texts]
        assert data.tobytes() == b"".join(raw)
        assert offsets.tolist() == np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(int).tolist()


def test_lower_is_ascii_only(spark):
    text = "ABC É İ \u212a straße ZAZ"
    assert spark.range(1).select(common.ascii_lower(F.lit(text)).alias("t")).first().t == "abc É İ \u212a straße zaz"


def test_operators_without_broadcast(spark, monkeypatch):
    """The same results where statistics are too large to broadcast."""
    from functools import partial

    from usagemill.llm import mixing, suffixes, warc

    docs = spark.createDataFrame([(i, "some words here " * (i % 7), f"s{i % 3}" if i % 11 else None) for i in range(200)], "doc_id long, text string, source string")
    pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html")
    runs = (lambda: mixing.mix(docs), lambda: warc.round_trip(pages), lambda: suffixes.dedup(docs))
    before = [sorted(map(tuple, f().collect()), key=str) for f in runs]
    for module in (mixing, warc, suffixes):
        monkeypatch.setattr(module, "joined_stats", partial(common.joined_stats, most=0))
    assert [sorted(map(tuple, f().collect()), key=str) for f in runs] == before
