import math
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import neardup


def table():
    rng = np.random.default_rng(7)
    rows = [(i * 2, rng.normal(size=16)) for i in range(500)]
    for i in range(40):
        rows.append((2000 + i, rows[i][1] * 3 + rng.normal(size=16) * 0.2))
    base = rng.normal(size=16)
    rows += [(3000 + i, base + rng.normal(size=16) * 0.12) for i in range(150)]
    rows += [(5000 + i, rows[4][1]) for i in range(60)]
    rows = [(i, [float(x) for x in v], 1) for i, v in rows]
    return rows + [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [math.nan] * 16, 1), (9003, [1.0, None], 1), (9004, [1.0, 2.0], 1), (9005, [2.0, 4.0], 1), (None, rows[0][1], 1), (0, rows[7][1], 1), (9006, [1e200, 2e200], 1), (9007, [], 1)]


def brute(rows, threshold):
    sound = [(n, np.array(v) / np.abs(v).max()) for n, (i, v, _) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sound:
        for b, y in sound:
            if b < a and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            least[top(n)] = min(least.get(top(n), i), i)
    return [(i, links[n], None if i is None else least[top(n)]) for n, (i, _, _) in enumerate(rows)]


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 100)
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec int").repartition(3)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=str)
    want = sorted(((i, n, c, i is None or i == c) for i, n, c in brute(rows, 0.9)), key=str)
    assert got == want
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def same(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec int").repartition(3)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted(((i, n, c, i is None or i == c) for i, n, c in brute(rows, 0.9)), key=str)


def test_tiles_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 150)
    monkeypatch.setattr(neardup, "SLOT", 30)
    same(spark, table())


def test_all_pairs_where_the_graph_does_not_do(spark, monkeypatch):
    """An audit that never passes leads to an exact answer, not to an error."""
    monkeypatch.setattr(neardup, "RECALL", 2)
    monkeypatch.setattr(neardup, "SLOT", 64)
    same(spark, table())


def test_a_large_dense_group(spark):
    """20,000 vectors, all near to each other: every link is counted, in bounded memory."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    x = (base + rng.normal(size=(20_000, 16)) * 0.05).round(6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert min((unit[a : a + 1000] @ unit.T).min() for a in range(0, 20_000, 1000)) > 0.9
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = neardup.near_duplicates(df).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.count("*")).first()
    assert tuple(got) == (19_999, 19_999, 0, 20_000)


def test_blocks_hold_bits_not_pairs():
    """A tile of two full slots needs a bit for each pair of its classes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + rng.normal(size=(2000, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = [np.array([(i + 1) % 2000, (i + 7) % 2000]) for i in range(2000)]
    tracemalloc.start()
    assert all(inside.all() for _, inside in neardup.search(x, near, 0.9))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_a_class_without_found_links_is_a_miss(spark):
    """Three classes that all link: no link found, those of one class, all of them."""
    vecs = [np.array([1.0, 0.01 * i]).tobytes() for i in range(3)]
    classes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)], "cid long, vec binary, texts long")
    found = lambda rows: spark.createDataFrame(rows, "cid long, root long, links long")
    assert neardup.recall(classes, found([]), 0.9) == 0
    assert abs(neardup.recall(classes, found([(0, 0, 2)]), 0.9) - 1 / 3) < 1e-9
    assert neardup.recall(classes, found([(i, 0, 2) for i in range(3)]), 0.9) == 1


def test_pruning_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = neardup.pruned(x, rng)
    dots = x @ x.T
    np.fill_diagonal(dots, -2)
    assert (found[:, 0] == dots.argmax(axis=1)).all()
    near = [row[row >= 0] for row in found]
    back = [np.unique(np.concatenate([near[i], np.flatnonzero((found == i).any(axis=1))])) for i in range(300)]
    hits = {i: set(np.flatnonzero(row).tolist()) for own, inside in neardup.search(x, back, 0.8) for i, row in zip(own.tolist(), inside)}
    truth = {i: set(np.flatnonzero(dots[i] >= 0.8).tolist()) | {i} for i in range(300)}
    assert sum(len(hits[i] & truth[i]) for i in truth) >= 0.97 * sum(map(len, truth.values()))
    assert all(hits[i] <= truth[i] for i in truth)
