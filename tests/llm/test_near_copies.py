"""Near copies of the pipeline against all pairs, and planted edited copies."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from usagemill.llm import components, near_copies, simhash

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    """The smallest (no id, doc_id) of each class."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a and not b or a and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(best.values())


def edited(rnd, words, edits):
    out = list(words)
    for i in rnd.sample(range(len(out)), edits):
        out[i] = f"edit{rnd.randint(0, 10**6)}"
    return " ".join(out)


def some_texts():
    rnd = random.Random(5)
    some = [f"w{i}" for i in range(300)]
    bases = [[rnd.choice(some) for _ in range(rnd.randint(1, 200))] for _ in range(12)]
    texts = [" ".join(b) for b in bases]
    texts += [edited(rnd, b, rnd.randint(0, 1 + len(b) // 30)) for b in bases for _ in range(10)]
    texts += [" ".join(b[: rnd.randint(len(b) // 2, len(b))]) for b in bases for _ in range(5)]
    return texts + [None, "", " \n", "one", "One ", "one two", texts[0].upper(), texts[1]]


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_links_of_crowded_members_match_all_pairs(spark):
    """The exact join that takes the members of crowded variants."""
    sets = sorted({tuple(near_copies.shingles((t or "").encode()).tolist()) for t in some_texts()} - {()})
    frame = spark.createDataFrame(list(enumerate(map(list, sets))), "node long, grams array<long>")
    found = roots(len(sets), [(r.u, r.v) for r in near_copies.links(frame).collect()])
    real = roots(len(sets), [(i, j) for i, a in enumerate(map(set, sets)) for j, b in enumerate(map(set, sets[:i])) if 5 * len(a & b) >= 4 * len(a | b)])
    group = lambda of: {frozenset(i for i, r in enumerate(of) if r == x) for x in of}
    assert group(found) == group(real)


@pytest.mark.parametrize("crowd", [8, 1])
def test_copies_against_all_pairs(spark, crowd):
    """No document without a similar one goes, one of each class stays, and of edited copies at least 0.9 are found."""
    rnd = random.Random(8)
    bases = [[f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(40, 300))] for _ in range(60)]
    texts = some_texts() + [" ".join(b) for b in bases] + [edited(rnd, b, rnd.randint(1, len(b) // 45 + 1)) for b in bases for _ in range(3)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    dropped = {r.doc_id for r in near_copies.copies(frame(spark, rows), crowd=crowd).collect()}
    rows.sort()
    kept = {i for i, _, _ in rows if i not in dropped}
    should = {i for _, i in brute(rows)}
    assert should <= kept
    assert len(dropped) >= 0.9 * (len(rows) - len(should))


def test_stage_drops_edited_copies(spark):
    rnd = random.Random(6)
    bases = [[f"x{rnd.randint(0, 5000)}" for _ in range(150)] for _ in range(20)]
    rows = [(i, " ".join(b), "s") for i, b in enumerate(bases)]
    # Two edits far apart lose at most 10 of 146 shingles on either side: similarity 0.87.
    rows += [(100 + i, " ".join(["a1" if k in (30, 90) else w for k, w in enumerate(b)]), "s") for i, b in enumerate(bases)]
    # 40 new words in the middle: far below 0.8.
    rows += [(200 + i, " ".join(b[:50] + [f"n{i}x{k}" for k in range(40)] + b[90:]), "s") for i, b in enumerate(bases)]
    out = sorted(r.doc_id for r in cp.drop_near_copies(spark, frame(spark, rows), SF).collect())
    assert out == [*range(20), *range(200, 220)]


def test_rows_that_share_an_id_or_have_none(spark):
    texts = ["the first text of several words here", "a second and quite different one of words", "third words that nobody else has written"]
    rows = [(None, t, "s") for t in texts] + [(7, t + " seven", "s") for t in ("alpha beta gamma delta", "one two three four", "alpha beta gamma delta")]
    out = cp.drop_near_copies(spark, frame(spark, rows), SF).collect()
    assert sorted(r.text for r in out) == sorted({t for _, t, _ in rows})
    assert cp.drop_near_copies(spark, frame(spark, rows).limit(0), SF).count() == 0


def test_tables_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Near copies that have each changed another bit of their fingerprint: no table has more rows a copy if the group is larger."""
    words = [f"w{i}" for i in range(30)]
    made = {}
    for module in (near_copies, simhash, components):
        monkeypatch.setattr(module, "staged", lambda df, name, real=module.staged: [out := real(df, name), made.__setitem__(name, max(made.get(name, 0), out.count()))][0])
    counts = []
    for n in (48, 192):
        docs = frame(spark, [(i, " ".join([*words, f"end{i}"]), "s") for i in range(n)]).cache()
        # Segment i % 8 has bit i // 8 set.
        bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.pmod("doc_id", F.lit(8)) == k, F.expr("shiftleft(1, cast(doc_id div 8 as int))")).otherwise(0))
        monkeypatch.setattr(near_copies, "_prints", lambda docs, bits=bits: docs.select("doc_id", near_copies.text_hash().alias("sig"), F.col("doc_id").alias("node"), bits.alias("segments")))
        made.clear()
        dropped = {r.doc_id for r in near_copies.copies(docs).collect()}
        assert dropped == set(range(1, n))
        counts.append(dict(made))
    assert {k: v for k, v in counts[1].items() if v > 6 * max(counts[0].get(k, 0), 32)} == {}


@pytest.mark.parametrize("crowd", [8, 2])
def test_candidates_against_all_pairs(spark, crowd):
    rnd = random.Random(9)
    heads = []
    for _ in range(40):
        base = [rnd.choice([0, -1, -(2**31), *[rnd.randint(-(2**31), 2**31 - 1)] * 90]) for _ in range(8)]
        for _ in range(rnd.randint(1, 12)):
            heads.append((len(heads), [x ^ rnd.choice([0, 1, -(2**31), 1 << rnd.randint(0, 30), 3, 7 << rnd.randint(0, 28)]) for x in base]))
    prints = [[x % 2**32 for x in s] for _, s in heads]
    at = {}
    for i, s in enumerate(prints):
        for k, x in enumerate(s):
            at.setdefault((k, x), []).append(i)
    # The nodes of each segment, and of each two segments that differ in one bit.
    groups = [(own, own) for own in at.values() if len(own) > 1]
    groups += [(at[k, x], at[k, x | 1 << b]) for k, x in at for b in range(32) if not x >> b & 1 and (k, x | 1 << b) in at]
    size = lambda a, b: len(a) if a is b else len(a) + len(b)
    many = {i for a, b in groups if size(a, b) > crowd for i in [*a, *b]}
    pairs = {(min(i, j), max(i, j)) for a, b in groups if size(a, b) <= crowd for i in a for j in b if i != j and not (i in many and j in many)}
    pairs = {(i, j) for i, j in pairs if sum((x ^ y).bit_count() for x, y in zip(prints[i], prints[j])) <= near_copies.FAR}
    found, crowded = near_copies._candidates(spark.createDataFrame(heads, "node long, segments array<int>"), crowd)
    assert sorted((r.u, r.v) for r in found.collect()) == sorted(pairs) and pairs
    assert sorted(r.node for r in crowded.collect()) == sorted(many) and many


def test_forks_bring_other_classes_together_once(spark):
    """Sets of one class don't meet over a shingle; two of different classes meet once."""
    rnd = random.Random(4)
    rows = [(g, rnd.choice([-7, 3, *range(100, 100 + g)]) if g else 5, 1000 * g + i, 1, 1) for g in range(8) for i in range(30)]
    out = near_copies._forks(spark.createDataFrame(rows, "gram long, label long, node long, n int, most int")).collect()
    met = sorted((min(a.node, b.node), max(a.node, b.node)) for a in out for b in out if a.side < b.side and (a.gram, a.bit, a.above) == (b.gram, b.bit, b.above))
    assert met == sorted((u, v) for g, k, u, _, _ in rows for h, m, v, _, _ in rows if g == h and k != m and u < v) and met
