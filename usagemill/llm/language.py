"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. A trigram is the product of its letters'
vectors, the first rotated by two places and the second by one; a text is the sum of its trigrams. A language's
prototype is the sum over its labelled documents, each scaled to length 1. Prediction takes the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Places of a vector.
WIDTH = 512
#: Characters of a text that are taken at a time.
CHUNK = 1 << 20
#: Bound on the labelled documents that prototypes are learned from, on average.
MOST_LABELLED = 20_000
#: Bound on the languages, whose prototypes are sent to every executor.
MOST_LANGUAGES = 2_000
UNKNOWN = "und"


class Space:
    """Letter vectors and a bounded store of trigram vectors, kept by a worker."""

    def __init__(self, width: int = WIDTH, seed: int = 11, most: int = 32_768):
        self.width, self.seed, self.most = width, seed, most
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.full(0x110000, 2, np.uint8)  # 2: not asked yet
        self.rows = np.zeros((1024, width), np.float32)
        self.clear()

    def clear(self) -> None:
        self.codes, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.width).astype(np.float32) * 2 - 1
        return self.letters[code]

    def symbols(self, text: str):
        """Stretches of a text's letters, with a gap (code 32) before, between and after them; each begins with the last two symbols of the one before."""
        low, tail = text.lower(), np.array([32], np.int64)
        for at in range(0, len(low), CHUNK):
            points = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            known = self.is_letter[points]
            if (known == 2).any():
                for p in np.unique(points[known == 2]).tolist():
                    self.is_letter[p] = chr(p).isalpha()
                known = self.is_letter[points]
            known = known.astype(bool)
            keep = known.copy()
            keep[1:] |= known[:-1]  # the first of a gap stays
            keep[0] |= tail[-1] != 32
            s = np.concatenate((tail, np.where(known, points, 32)[keep].astype(np.int64)))
            yield s
            tail = s[-2:]
        if tail[-1] != 32:
            yield np.append(tail, 32)

    def trigrams(self, text: str):
        """Different trigrams and their counts, for each stretch of symbols; what is no letter is a single gap."""
        for s in self.symbols(text):
            grams = np.sort((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])
            edge = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
            yield grams[edge], np.diff(np.append(edge, len(grams)))

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        out, one = np.empty((len(grams), self.width), np.float32), (1 << 21) - 1
        for k, g in enumerate(grams.tolist()):
            out[k] = np.roll(self.letter(g >> 42), 2) * np.roll(self.letter(g >> 21 & one), 1) * self.letter(g & one)
        return out

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of sorted trigrams in the store, which takes up those it lacks."""
        at = np.searchsorted(self.codes, grams)
        lacks = np.ones(len(grams), bool) if not len(self.codes) else self.codes[np.minimum(at, len(self.codes) - 1)] != grams
        new = grams[lacks]
        if len(new):
            if len(self.codes) + len(new) > self.most:
                self.clear()
                new = grams
            first = len(self.codes)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[first : first + len(new)] = self._vectors(new)
            where = np.searchsorted(self.codes, new)
            self.codes, self.slots = np.insert(self.codes, where, new), np.insert(self.slots, where, np.arange(first, first + len(new)))
            at = np.searchsorted(self.codes, grams)
        return self.slots[at]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's vector scaled to length 1; None without a letter."""
        out, any_letter = np.zeros(self.width, np.float64), False
        for grams, counts in self.trigrams(text or ""):  # whole numbers: a long text is just the sum of its stretches
            any_letter |= len(grams) > 0
            for i in range(0, len(grams), 4096):
                part = self.places(grams[i : i + 4096])
                out += counts[i : i + 4096].astype(np.float32) @ self.rows[part]
        if not any_letter:
            return None
        size = float(np.linalg.norm(out))
        return out / size if size else out


def prototypes(labelled: DataFrame, width: int = WIDTH, most_labelled: int = MOST_LABELLED) -> dict[str, np.ndarray]:
    """Language to unit vector, from (text, lang).

    Beyond most_labelled rows, those whose text has a hash below the bound's share are used. Each task sums its own
    documents by language, so only (tasks x languages) vectors are shuffled, and one for each language is collected.
    """
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    n = labelled.select("lang").count()
    if n > most_labelled:
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))

    def run(batches):
        space, sums = Space(width), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = space.bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v * 2**20).astype(np.int64)  # whole numbers: any order gives the same sum
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = small_batches(labelled).mapInArrow(run, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    rows = sums.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for r in rows:
        v = np.array([x["x"] for x in r["v"]], np.float64)
        out[r["lang"]] = v / (np.linalg.norm(v) or 1.0)
    return out


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], width: int = WIDTH, sharp: float = 20.0) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the score is the best language's share among exp(sharp * cosine).

    A text that is null or has no letter gives und and score 0; so does any text if nothing was learned. Equal cosines fall
    to the language that comes first by name. Very long texts are taken in parts, repeated rows each get a row, other
    columns aren't read, whatever their names, and an empty table gives an empty result.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names]) if names else np.zeros((0, width))

    def run(batches):
        space = Space(width)
        for batch in batches:
            said = []
            for text in batch.column(1).to_pylist():
                v = space.bundle(text) if names else None
                if v is None:
                    said.append((UNKNOWN, 0.0))
                    continue
                cos = matrix @ v.astype(np.float64)
                best = int(np.argmax(cos))
                said.append((names[best], float(1 / np.exp(sharp * (cos - cos[best])).sum())))
            frame = pd.DataFrame(said, columns=["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frame.lang_pred, pa.string()), pa.array(frame.score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
