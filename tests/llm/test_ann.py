import math
import random

import numpy as np

from pairlens.llm import ann


def table():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], 1) for i in range(600)]
    rows += [(i, rows[3][1], 1) for i in range(600, 640)]
    rows += [(700, None, 1), (800, [0.0] * 8, 1), (900, [1.0, math.nan] + [0.0] * 6, 1), (1000, [1.0, None] + [0.0] * 6, 1), (1100, [1e30] * 8, 1), (1200, [math.inf] * 8, 1), (1300, [1.0, 2.0], 1), (1301, [1.0, 5.0], 1), (None, [1.0] * 8, 1), (-100, [1e-30] * 8, 1), (-200, rows[3][1], 1)]
    return rows


def apart(a, b):
    squares = sum((x - y) * (x - y) for x, y in zip(a, b))
    return math.sqrt(squares) if 1e-280 < squares < math.inf else math.dist(a, b)


def brute(rows, every, k):
    sound = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in sound:
        if q % every == 0:
            found = sorted((apart(a, b), i) for i, b in sound if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_exact(spark):
    rows = table()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int")
    got = sorted(tuple(r) for r in ann.nearest(df, 100, 10).collect())
    want = brute(rows, 100, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) <= 1e-12 * max(1, b[3]) for a, b in zip(got, want))
    assert ann.nearest(df.limit(0)).collect() == []


def test_huge_and_tiny_vectors(spark):
    """Vectors whose squares overflow or vanish take part; of six candidates, six are returned."""
    rows = [(100, [1.0] * 8, 1), (1, [1e200] * 8, 1), (2, [1e-200] * 8, 1), (3, [-1e200] + [1.0] * 7, 1), (4, [2e-200] * 8, 1), (5, [1.5] * 8, 1), (200, [3e-200] * 8, 1)]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int"), 100, 10).collect())
    want = brute(rows, 100, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want] and len(got) == 12
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(got, want))
    # more candidates than asked for, all as near as each other but for digits that squares lose
    rows = [(0, [0.0] * 7 + [1e-170], 1), *((i, [i * 1e-168] * 8, 1) for i in range(1, 60)), (77, [1e250] * 8, 1)]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int"), 100, 10).collect())
    assert [x[2] for x in got] == list(range(1, 11)) and all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(got, brute(rows, 100, 10)))
