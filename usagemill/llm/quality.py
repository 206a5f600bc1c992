"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from byte classes, hashed byte pairs and word
repetition; a hidden layer h follows, gated attention weighs the passages by softmax(w . (tanh(V h) * sigmoid(U h))),
and the weighted sum of h is scored. Only document labels are learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import buffers, pieces, small_batches

PASSAGE = 512
#: Bytes that are encoded at a time; a multiple of PASSAGE.
SLICE = 1 << 20
PAIRS = 64
HIDDEN = 32
GATE = 16
#: Bound on the labelled documents that are learned from, on average, and on the passages taken of each.
MOST_LABELLED = 6_000
MOST_PASSAGES = 64
THRESHOLD = 0.7

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:", "!?", "|", "#$%&*@^~", "\"'()-", "/\\_=+<>[]{}`"]


def _class_of() -> np.ndarray:
    out = np.full(256, len(_CLASSES), np.int64)
    for k, chars in enumerate(_CLASSES):
        out[[ord(c) for c in chars]] = k
    out[128:] = len(_CLASSES) + 1
    return out


_CLASS = _class_of()
_KINDS = len(_CLASSES) + 2
WIDTH = _KINDS + PAIRS + 6
_LOW = np.arange(256, dtype=np.int64)
_LOW[65:91] += 32
_MIX = np.random.default_rng(7).integers(1, 2**62, 64).astype(np.uint64) | np.uint64(1)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows) and the number of passages of each document, which is at least 1.

    Documents are cut at multiples of SLICE, and slices are encoded in groups, so that memory doesn't grow with a document.
    Since words and byte pairs end with their passage, this changes nothing.
    """
    sizes = np.diff(offsets)
    slices = np.maximum(1, -(-sizes // SLICE))
    owner = np.repeat(np.arange(len(sizes)), slices)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(slices) - slices, slices)
    cuts = np.append(offsets[:-1][owner] + order * SLICE, offsets[-1])
    rows, bags = [np.zeros((0, WIDTH), np.float32)], np.zeros(len(sizes), np.int64)
    at = 0
    while at < len(owner):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SLICE, side="right")) - 1)
        end = min(end, len(owner))
        x, n = _encode(data[cuts[at] : cuts[end]], cuts[at : end + 1] - cuts[at])
        rows.append(x)
        np.add.at(bags, owner[at:end], n)
        at = end
    return np.concatenate(rows), bags


def _encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    bags = np.maximum(1, -(-sizes // PASSAGE))
    total = int(bags.sum())
    first = np.concatenate(([0], np.cumsum(bags)[:-1]))
    out = np.zeros((total, WIDTH), np.float32)
    if not len(data):
        return out, bags
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(data)) - offsets[:-1][doc]
    of = first[doc] + place // PASSAGE
    length = np.bincount(of, minlength=total).astype(np.float32)
    div = np.maximum(length, 1)[:, None]
    out[:, :_KINDS] = np.bincount(of * _KINDS + _CLASS[data], minlength=total * _KINDS).reshape(total, _KINDS) / div
    low = _LOW[data]
    pair = ((low[:-1] * 31 + low[1:]) * 2654435761 >> 16) % PAIRS
    inside = of[1:] == of[:-1]
    out[:, _KINDS : _KINDS + PAIRS] = np.bincount(of[1:][inside] * PAIRS + pair[inside], minlength=total * PAIRS).reshape(total, PAIRS) / div
    gap = (data == 32) | (data >= 9) & (data <= 13)
    begins = ~gap
    begins[1:] &= gap[:-1] | (of[1:] != of[:-1])
    starts = np.flatnonzero(begins)
    rest = _KINDS + PAIRS
    if len(starts):
        word = np.cumsum(begins) - 1
        # Bytes before the first word have word -1; like all gaps they weigh nothing.
        weight = _MIX[(np.arange(len(data)) - starts[np.maximum(word, 0)]) & 63]
        hashes = np.add.reduceat(np.where(gap, np.uint64(0), (low + 1).astype(np.uint64) * weight), starts)
        lengths = np.add.reduceat((~gap).astype(np.int64), starts)
        own = of[starts]
        words = np.bincount(own, minlength=total).astype(np.float32)
        many = np.maximum(words, 1)
        same = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
        out[:, rest] = np.bincount(own[1:][same], minlength=total) / many
        keyed = np.sort((own.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        fresh = np.concatenate(([True], keyed[1:] != keyed[:-1]))
        out[:, rest + 1] = np.bincount((keyed[fresh] >> np.uint64(40)).astype(np.int64), minlength=total) / many
        out[:, rest + 2] = np.bincount(own, weights=lengths, minlength=total) / many / 10
        out[:, rest + 3] = np.sqrt(np.bincount(own, weights=lengths.astype(float) ** 2, minlength=total) / many) / 10
        out[:, rest + 4] = words / div[:, 0]
    out[:, rest + 5] = np.log1p(length) / 6
    return out, bags


@dataclass
class Model:
    """Weights; ``always`` is the score of every document if there was only one label to learn, or none."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list
    always: float | None = None

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.always is not None:
            return np.full(len(bags), self.always)
        return _forward((x - self.mean) / self.scale, bags, self.weights)[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _forward(x: np.ndarray, bags: np.ndarray, weights: list):
    w1, b1, v, u, w, c, d = weights
    at = np.concatenate(([0], np.cumsum(bags)[:-1]))
    bag = np.repeat(np.arange(len(bags)), bags)
    h = np.maximum(x @ w1 + b1, 0)
    t, g = np.tanh(h @ v), _sigmoid(h @ u)
    logit = (t * g) @ w
    e = np.exp(logit - np.maximum.reduceat(logit, at)[bag])
    a = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return _sigmoid(z @ c + d[0]), (h, t, g, a, z, at, bag)


def _gradients(x: np.ndarray, bags: np.ndarray, y: np.ndarray, weights: list, decay: float) -> list:
    w1, b1, v, u, w, c, d = weights
    p, (h, t, g, a, z, at, bag) = _forward(x, bags, weights)
    dl = (p - y) / len(y)
    dz = dl[:, None] * c
    da = (dz[bag] * h).sum(axis=1)
    dlogit = a * (da - np.add.reduceat(a * da, at)[bag])
    dt, dg = dlogit[:, None] * w * g * (1 - t * t), dlogit[:, None] * w * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ v.T + dg @ u.T
    dpre = dh * (h > 0)
    return [x.T @ dpre + decay * w1, dpre.sum(axis=0), h.T @ dt + decay * v, h.T @ dg + decay * u, (t * g).T @ dlogit, z.T @ dl + decay * c, np.array([dl.sum()])]


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam on the cross-entropy of bags; the same rows give the same model."""
    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH)
    scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(WIDTH)
    if len(set(y.tolist())) < 2:
        return Model(mean, scale, [], float(y[0]) if len(y) else 1.0)
    rnd, x = np.random.default_rng(seed), ((x - mean) / scale).astype(np.float64)
    weights = [rnd.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), rnd.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), rnd.normal(0, GATE**-0.5, GATE), rnd.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, s, n = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
    ends = np.cumsum(bags)
    for epoch in range(epochs):
        order = rnd.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            rows = np.concatenate([np.arange(ends[k] - bags[k], ends[k]) for k in own])
            n += 1
            for k, grad in enumerate(_gradients(x[rows], bags[own], y[own], weights, decay)):
                m[k], s[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * s[k] + 0.001 * grad**2
                weights[k] = weights[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.999**n)) + 1e-8)
    return Model(mean, scale, weights)


def _features(docs: DataFrame, extra: str, most: int) -> DataFrame:
    """(doc_id, extra, n, x): passages of each document, encoded, at most ``most`` of them, evenly spaced; for the bounded sample only."""
    schema = pa.schema([("doc_id", pa.int64()), (extra, pa.int32()), ("n", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                x, bags = encode(*buffers(batch.column(2)))
                taken = [np.arange(n) if n <= most else np.arange(most) * n // most for n in bags]
                raw = [x[e - n + own].tobytes() for e, n, own in zip(np.cumsum(bags), bags, taken)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(own) for own in taken], pa.int32()), pa.array(raw, pa.binary())], schema=schema)

    return small_batches(docs).select("doc_id", extra, "text").mapInArrow(run, f"doc_id long, {extra} int, n int, x binary")


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_passages: int = MOST_PASSAGES) -> Model:
    """Learn from the labelled documents among docs (doc_id, text); labels: (doc_id, quality).

    Beyond most_labelled labels, those whose doc_id has a hash below the bound's share are used, so that the sample has
    a fixed size whatever the input; of a document most_passages passages are learned from at most, evenly spaced, so the
    driver holds some most_labelled * most_passages * WIDTH numbers at most. Null labels count as none; of repeated labels
    the smallest holds. Null texts are empty; rows that share a doc_id have its label each. Without labels every score is 1.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = marked.count()
    if n > most_labelled:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = _features(own.join(F.broadcast(marked), "doc_id"), "quality", most_passages).toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    return train(x, np.array(rows["n"].to_pylist(), np.int64), np.array(rows["quality"].to_pylist(), np.float64))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column, the score of each row's text: no key, no join and no shuffle.

    A null text is scored as an empty one, a very long one over all of its passages. Rows that share a doc_id, or have none,
    are scored by their own texts. docs has no column ``name``; an empty table gives an empty result.
    """
    if name in docs.columns:
        raise ValueError(f"there is a column {name}")
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                x, bags = encode(*buffers(batch.column(at).cast(pa.string())))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(model.score(x, bags), 0.0, 1.0).astype(np.float64))], names=names)

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, sig, score) for every row; odd rows as in scored(). sig, a hash of the text, tells apart rows that share a doc_id or have none."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), text.alias("text"))
    return scored(own, model).select("doc_id", "sig", "score")
