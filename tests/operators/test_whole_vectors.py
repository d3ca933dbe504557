"""The vector queries use every vector; against brute force on small tables."""

import numpy as np
from pyspark.sql import functions as F

from pairlens.operators import models, vectors
from pairlens.plans import registry
from pairlens.session import load

DIR = "/root/testdata/sf0.001"


def table(spark, n=90, d=4):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    y = np.clip(0.5 + 0.2 * x[:, 0] + 0.1 * rng.normal(size=n), 0, 1)
    rows = [(i, i % 7, i % 3, [float(v) for v in x[i]], float(y[i]), bool(x[i, 1] + rng.normal() > 0)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, family int, fold int, x array<double>, y double, high boolean").repartition(3)


def test_ridge_by_moments_is_kernel_ridge(spark):
    _, df = table(spark)
    args = ("id", "family", "fold", "x", "y", [0.01, 0.1, 1.0])
    want = {r.key: r for r in models.nested_ridge(df, *args).collect()}
    got = {r.key: r for r in models.nested_ridge_by_moments(df, *args).collect()}
    assert set(got) == set(want) and len(got) == 90
    assert all(got[k].alpha == want[k].alpha and got[k].outer == want[k].outer and abs(got[k].predicted - want[k].predicted) < 1e-9 for k in want)


def plain_layers(rows, alphas):
    """rows: (id, layer, fold, x, y). Kernel ridge of each layer, layer and alpha by inner errors; ties: larger alpha, smaller layer."""
    out, folds = {}, sorted({r[2] for r in rows})
    by = {v: [r for r in rows if r[1] == v] for v in sorted({r[1] for r in rows})}

    def predict(level, train, test, alpha):
        a, b = (np.array([r[3] for r in by[level] if r[2] in f]) for f in (train, test))
        return models.ridge_predictions(a @ a.T, np.array([r[4] for r in by[level] if r[2] in train]), b @ a.T, alpha)

    for o in folds:
        rest, scores = [f for f in folds if f != o], []
        for level in by:
            for alpha in alphas:
                gaps = [abs(p - y) for i in rest for p, y in zip(predict(level, [f for f in rest if f != i], [i], alpha), [r[4] for r in by[level] if r[2] == i])]
                scores.append((round(float(np.mean(gaps)), 12), -alpha, level))
        _, alpha, level = min(scores)
        for r, p in zip([r for r in by[level] if r[2] == o], predict(level, rest, [o], -alpha)):
            out[str(r[0])] = (level, o, -alpha, p)
    return out


def test_layers_and_alphas_as_brute_force(spark):
    """The second layer tells most; the fourth repeats it, and gives way; a constant layer ties for all alphas."""
    rng = np.random.default_rng(8)
    y = rng.random(60)
    x = rng.normal(size=(60, 3, 4))
    x[:, 1, 0] += 8 * y
    rows = [(i, v, i % 4, [float(t) for t in (np.ones(4) if v == 2 else x[i, 1 if v == 3 else v])], float(y[i])) for i in range(60) for v in range(4)]
    frame = lambda own: spark.createDataFrame(own, "id long, layer int, fold int, x array<double>, y double").repartition(3)
    for own in (rows, [r for r in rows if r[1] == 2], [r for r in rows if r[1] != 1]):
        got = {r.key: (r.layer, r.outer, r.alpha, r.predicted) for r in models.nested_ridge_by_moments(frame(own), "id", "id", "fold", "x", "y", [0.01, 1.0, 5.0], layer="layer").collect()}
        want = plain_layers(own, [0.01, 1.0, 5.0])
        assert set(got) == set(want) and len(got) == 60
        assert all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-8 for k in want)


def test_logistic_probe(spark):
    rows, df = table(spark)
    got = {int(r.key): r.probability for r in models.logistic_probe(df, "id", "fold", "x", "high").collect()}
    x, y, f = np.array([r[3] for r in rows]), np.array([r[5] for r in rows], float), np.array([r[2] for r in rows])
    assert len(got) == len(rows)
    for o in range(3):
        a, t = x[f != o], y[f != o]
        z = np.c_[(x - a.mean(axis=0)) / a.std(axis=0), np.ones(len(x))]
        p = np.array([got[i] for i in range(len(x)) if f[i] == o])
        w = np.linalg.lstsq(z[f == o], np.log(p / (1 - p)), rcond=None)[0]
        assert np.allclose(z[f == o] @ w, np.log(p / (1 - p)), atol=1e-6)
        # at the optimum the gradient over the training rows is zero
        weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
        assert np.abs(z[f != o].T @ (weight * (1 / (1 + np.exp(-z[f != o] @ w)) - t)) + np.append(np.ones(4), 1e-9) * w).max() < 1e-5


def test_gram_over_tiles(spark):
    rows, df = table(spark)
    got = {(r.family, r.i, r.j): r.k for r in vectors.gram(df, "id", "x", ["family"], tile=4).collect()}
    want = {(a[1], a[0], b[0]): float(np.dot(a[3], b[3])) for a in rows for b in rows if a[1] == b[1] and a[0] <= b[0]}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_vector_counts(spark):
    rows = load(spark, DIR, "embeddings")
    ids = {r[0] for r in rows.select("vec_id").collect()}
    of_label = [r[0] for r in rows.groupBy("label").count().select("count").collect()]
    for name in ("kernel_ridge_cv", "logistic_probe", "layer_ridge_cv"):
        assert {int(r.key) for r in registry.QUERIES[name](spark, DIR).select("key").collect()} == ids
    assert registry.QUERIES["gram_matrix"](spark, DIR).count() == sum(n * (n + 1) // 2 for n in of_label)
    assert registry.QUERIES["same_vs_different"](spark, DIR).where(F.col("difference").isNotNull()).count() == sum(-(-n // 4) for n in of_label)


def test_gram_rounds_in_its_tasks(spark):
    """The same as F.round, which would go over all pairs again; halves away from zero, no negative zero."""
    _, df = table(spark)
    exact = vectors.gram(df, "id", "x", ["family"], tile=4).withColumn("k", F.round("k", 3))
    got = vectors.gram(df, "id", "x", ["family"], tile=4, digits=3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in exact.collect()} and got.count() == exact.count()
    halves = spark.createDataFrame([(1, 0, [0.5]), (2, 0, [0.25]), (3, 0, [-0.25]), (4, 0, [-0.01])], "id long, family int, x array<double>")
    got = {(r.i, r.j): repr(r.k) for r in vectors.gram(halves, "id", "x", ["family"], digits=2).collect()}
    assert (got[1, 2], got[1, 3], got[2, 4]) == ("0.13", "-0.13", "0.0")
    assert "round(" not in registry.QUERIES["gram_matrix"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_gram_moves_a_vector_few_times(spark, monkeypatch):
    """A block of 40,000 vectors is dealt into so many tiles as the cores need (40 before, so each vector was shuffled 40 times), its products come in many batches."""
    rows = spark.range(40_000).selectExpr("id", "1 AS family", "array(cast(id AS float), 1f) AS x")
    times = vectors._tiled(rows, "id", "x", ["family"], vectors.TILE).groupBy("i").count().agg(F.max("count"), F.min("count")).first()
    assert tuple(times) == (6, 6)
    monkeypatch.setattr(vectors, "BATCH", 64)
    names = [f"n{i:03d}" for i in range(60)] + ["n007"] * 2
    df = spark.createDataFrame([(n, i % 2, [float(i), 1.0]) for i, n in enumerate(names)] + [("n000", None, [1.0, 1.0]), (None, 1, [1.0, 1.0])], "id string, family int, x array<double>")
    for tile in (16, 1000):
        got = sorted((r.family, r.i, r.j, r.k) for r in vectors.gram(df, "id", "x", ["family"], tile=tile).collect())
        assert got == sorted((i % 2, m, n, i * j + 1.0) for i, m in enumerate(names) for j, n in enumerate(names) if i % 2 == j % 2 and m <= n)
