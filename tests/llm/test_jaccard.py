import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.llm import components, jaccard


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, num, den):
    found = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(found)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(found)
    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    names = {}
    for n, (i, _) in enumerate(found):
        names.setdefault(top(n), []).append(i)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in names.items()}
    return sorted(((i, len(s), least[top(n)], links[n]) for n, (i, s) in enumerate(found)), key=str)


def texts(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 20, 30, 60, 100, 150, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()]
            out.append(rng.choice([" ", "\t", "\n\x0b "]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    big = [word() for _ in range(120)]
    for _ in range(40):  # a large group of near copies
        copy = list(big)
        copy[rng.randrange(120)] = word()
        out.append(" ".join(copy))
    return out + ["", None, "  \n", "x", "X", "x y", "a b c d", *["same old copy of a text with some words"] * 5]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_same_as_brute_force(spark, k, num, den):
    rows = [(i * 3, t) for i, t in enumerate(texts(k))] + [(None, "x"), (None, "lonely words without any id"), (3, "x")]
    df = spark.createDataFrame([(i, t, b"d", 1) for i, t in rows], "doc_id long, text string, digest binary, cid int").repartition(5)
    got = sorted((tuple(r) for r in jaccard.similar(df, k, num, den).collect()), key=str)
    assert got == brute(rows, k, num, den)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SLOT_SETS", 7)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = list(enumerate(texts(9)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.similar(df, 3, 90, 100).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)
    assert jaccard.similar(df.limit(0)).collect() == []


def test_common_elements_go_straight_to_their_classes(spark, monkeypatch):
    """Every element of three classes or more is heavy: the links stay what they are."""
    monkeypatch.setattr(jaccard, "HEAVY_CLASSES", 3)
    monkeypatch.setattr(jaccard, "HELD", 3000)
    rows = list(enumerate(texts(11)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.similar(df, 3, 90, 100).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)


def test_a_phrase_of_all_texts_fills_no_bucket(spark):
    """20,000 short texts with one phrase: its shingles would bring an entry of every text into their buckets."""
    rng = random.Random(1)
    rows = [(i, "the phrase that every text has " + " ".join(str(rng.randrange(10**9)) for _ in range(12))) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).persist()
    both = jaccard.profiles(docs, 3).persist()
    total = both.where("digest IS NOT NULL").agg({"n_shingles": "sum"}).first()[0]
    heavy = jaccard.heavy_elements(both.where("digest IS NULL"), total)
    assert len(heavy[0]) == 4 and len(heavy[0]) <= 1 / jaccard.HEAVY  # what begins within the phrase and ends there

    def largest(found):
        chunks = jaccard._dealt(docs, 3, 64, 0, found).selectExpr("bucket", "octet_length(keys) div 8 AS n")
        sizes = sorted(r[0] for r in chunks.groupBy("bucket").sum("n").select("sum(n)").collect())
        return sizes[-1] / sizes[len(sizes) // 2]

    assert largest(jaccard.NONE_HEAVY) > 5 and largest(heavy) < 1.5
    found = jaccard.alive(docs, 3, 90, 100, 0, heavy)
    assert found.count() == 0  # four shared shingles are too few to link
    docs.unpersist()
    both.unpersist()


def near_group(rng, n, copies):
    base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    out = []
    for _ in range(copies):
        keep = rng.random(len(base)) >= 0.03
        out.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)])))
    return sorted(out, key=len)


@pytest.mark.parametrize("copies", [2, 3, 6, 40])
def test_groups_go_through_lists_and_derivation(copies):
    """Overlaps of near sets come from another's, in small groups as in large ones, and the links are those of all pairs."""
    rng = np.random.default_rng(copies)
    found = near_group(rng, 150, copies)
    size = np.array([len(x) for x in found])
    derived = []
    got = {(r, int(x)) for r, at in jaccard.join_group(found, size, None, 80, 100, 10**9, derived) for x in at}
    want = {(a, b) for a in range(copies) for b in range(a + 1, copies) if 100 * len(np.intersect1d(found[a], found[b])) >= 80 * len(np.union1d(found[a], found[b]))}
    assert got == want and len(derived) >= copies - 2  # all but the first, and the last, which starts no pair
    # what no other set has may be left out
    every, seen = np.unique(np.concatenate(found), return_counts=True)
    some = [np.intersect1d(x, every[seen > 1]) for x in found]
    assert {(r, int(x)) for r, at in jaccard.join_group(some, size, None, 80, 100, 10**9) for x in at} == want


def test_living_classes_hold_every_link(spark):
    """Every linked pair of different sets is alive and shares one of its rare elements."""
    rows = list(enumerate(texts(4)))
    own = {tuple(x.tolist()): x for t in rows for x in jaccard.sets(pa.array([t[1]], pa.string()), 3) if len(x)}
    found = jaccard.alive(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 3, 80, 100).collect()
    living = {(r.id, r.n): set(np.frombuffer(r.rare, np.uint64).tolist()) for r in found}
    name = {key: (jaccard.short_id(jaccard.digest_of(x), 0), len(x)) for key, x in own.items()}
    pairs = [(a, b) for a in own for b in own if a < b and 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))]
    assert len(pairs) > 50
    for a, b in pairs:
        assert living[name[a]] & living[name[b]]
    assert len(living) < len(own)


def test_many_rows_of_one_id(spark):
    """Rows of one id, or of none, with texts of their own."""
    many = [(None if i % 2 else 5, t) for i, t in enumerate(texts(3)[:80])]
    got = sorted((tuple(r) for r in jaccard.similar(spark.createDataFrame(many, "doc_id long, text string"), 3, 90, 100).collect()), key=str)
    assert got == brute(many, 3, 90, 100)


def test_very_long_text(spark):
    word = random.Random(5)
    long = " ".join(str(word.randint(0, 10**6)) for _ in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "end"), (4, long.replace("7", "8"))]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, x) for x in range(201, 260)] + [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    a, b = components.stars(np.array([x for x, y in edges if x != y]), np.array([y for x, y in edges if x != y]))
    want = dict(zip(a.tolist(), b.tolist()))
    assert got == want | {x: x for x in set(want.values())}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_with_hubs(spark, monkeypatch):
    """Small bounds make hubs of most nodes: of the smallest id, of the largest, and ones that share neighbours."""
    monkeypatch.setattr(components, "HUBS", 4)
    monkeypatch.setattr(components, "HUB_ROWS", 3)
    rng = random.Random(5)
    edges = [(0, x) for x in range(1, 60)] + [(999, x) for x in range(50, 120)] + [(500, 120), (500, 999)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(80)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    a, b = components.stars(np.array([x for x, y in edges if x != y]), np.array([y for x, y in edges if x != y]))
    want = dict(zip(a.tolist(), b.tolist()))
    assert got == want | {x: x for x in set(want.values())}


def test_hub_edges_spread(spark):
    """All edges of one hub: after the join with its smallest neighbour no partition holds more than its share."""
    n = 1_000_000
    edges = spark.range(n, numPartitions=8).select(F.lit(0).cast("long").alias("a"), (F.col("id") + 1).alias("b"))
    low = spark.createDataFrame([(0, 0, n)], "a long, low long, n long")
    joined = components.with_low(edges, low, n)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == n and max(sizes) <= n // 8 and joined.where("low <> 0").count() == 0


def test_words():
    column = pa.array(["a b", None, "", "c", " ", "B", "x" * 3000])
    words, ends = jaccard.word_hashes(column)
    assert np.diff(ends).tolist() == [2, 0, 0, 1, 0, 1, 1] and words[1] == words[3]
