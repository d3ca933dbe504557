"""Grouped cross-validation and small models.

nested_ridge() is for folds of hundreds of tasks: its kernels are NumPy inside applyInPandas, folds are what is distributed. For more rows,
nested_ridge_by_moments() and logistic_probe() sum moments over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .selection import placed


def folds(df: DataFrame, family: str, k: int, seed: str = "0") -> DataFrame:
    """Family and fold (0 to k - 1): families in seeded hash order, dealt into k runs of near-equal size."""
    names = df.select(family).distinct().withColumn("_key", F.md5(F.concat_ws("-", F.lit(seed), F.col(family).cast("string"))))
    names = placed(names, ["_key", family], "_p").drop("_key")
    n = F.lit(names.count())
    big, less = F.pmod(n, F.lit(k)), F.floor(n / k)
    fold = F.when(F.col("_p") < big * (less + 1), F.floor(F.col("_p") / (less + 1))).otherwise(big + F.floor((F.col("_p") - big * (less + 1)) / F.greatest(less, F.lit(1))))
    return names.withColumn("fold", fold.cast("int")).drop("_p")


def fold_count(df: DataFrame, label: str, group: str, asked: int) -> int:
    """As many folds as asked for, as the smallest class, and as there are groups."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return max(0, min(asked, smallest, df.select(group).distinct().count()))


def _hashed(seed: str, column: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), F.col(column).cast("string")))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: str = "0") -> DataFrame:
    """Key and fold: rows in order of their label, then in seeded hash order, dealt to the folds in turn, so that no two folds' shares of a
    label differ by more than a row. ``key`` is unique; places come from counts of ranges."""
    rows = placed(df.select(key, label).withColumn("_h", _hashed(seed, key)), [label, "_h", key], "_p")
    return rows.select(key, F.pmod("_p", F.lit(k)).cast("int").alias("fold"))


def dealt_groups(groups: Iterable[tuple[object, dict]], totals: dict, k: int, held: list[dict] | None = None) -> Iterator[tuple[object, int]]:
    """Groups, with their rows of each class, given one after the other to the fold that then has the least spread of class shares.

    Adding n rows of a class to a fold of f such rows adds 2nf + n^2 to the sum of squares, of which only 2nf depends on the fold; classes weigh
    by 1 / total^2. All is in whole numbers. Ties: the fold with fewer rows, then the first. ``held``: the folds' rows of each class before, which is kept up to date.
    """
    weight = {c: math.prod(t * t for d, t in totals.items() if d != c) for c in totals}
    held = [dict.fromkeys(totals, 0) for _ in range(k)] if held is None else held
    size = [sum(h.values()) for h in held]
    for name, own in groups:
        share = [(c, n * weight[c]) for c, n in own.items()]
        best = min(range(k), key=lambda j: (sum(w * held[j][c] for c, w in share), size[j], j))
        for c, n in own.items():
            held[best][c] += n
            size[best] += n
        yield name, best


#: Groups that one task deals out in stratified_group_folds().
DEALT = 20_000


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: str = "0", large: int = 0) -> DataFrame:
    """Group and fold: whole groups, the largest first (then in seeded hash order), each given to the fold that then has the least spread of shares (dealt_groups). Labels
    are few.

    A group's fold depends on all before it, so it is one chain. It is cut into links of ``large`` groups (DEALT if 0): a task streams a link's groups, in order, and
    what each fold has got of each label is summed over the written links for the next one. Only these sums come to the driver.
    """
    spark, step = df.sparkSession, large or DEALT
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    table = counts.groupBy(group).agg(F.collect_list(F.struct(F.col(label).alias("c"), "n")).alias("_own"), F.sum("n").alias("_size")).withColumn("_h", _hashed(seed, group))
    table = stored(placed(table.withColumn("_less", -F.col("_size")), ["_less", "_h", group], "_p").select(group, "_own", F.col("_p").cast("long").alias("_p")).withColumn("_link", F.floor(F.col("_p") / step)), "groups")
    parts = table.select(F.explode("_own").alias("_x")).groupBy("_x.c").agg(F.sum("_x.n").alias("n"))
    totals, n = {r["c"]: r["n"] for r in parts.collect()}, table.count()  # a row for each label
    schema = T.StructType([table.schema[group], T.StructField("_own", table.schema["_own"].dataType), T.StructField("fold", T.IntegerType())])
    out, held = None, [dict.fromkeys(totals, 0) for _ in range(k)]
    for link in range(-(-n // step)):

        def deal(batches: Iterator[pa.RecordBatch], held: list[dict] = held) -> Iterator[pa.RecordBatch]:
            state = [dict(h) for h in held]
            for batch in batches:
                groups = ((None, {x["c"]: x["n"] for x in own}) for own in batch.column("_own").to_pylist())
                folds = [fold for _, fold in dealt_groups(groups, totals, k, state)]
                yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("_own"), pa.array(folds, pa.int32())], names=[group, "_own", "fold"])

        own = table.where(F.col("_link") == link).repartition(1).sortWithinPartitions("_p").select(group, "_own")
        dealt = stored(own.mapInArrow(deal, schema), "dealt")
        out = dealt if out is None else out.unionByName(dealt)
        if (link + 1) * step < n:
            sums = dealt.select("fold", F.explode("_own").alias("_x")).groupBy("fold", "_x.c").agg(F.sum("_x.n").alias("n")).collect()  # folds by labels
            for r in sums:
                held[r["fold"]][r["c"]] += r["n"]
    return spark.createDataFrame([], table.select(group, F.lit(0).alias("fold")).schema) if out is None else out.select(group, "fold")


def cross_validation_folds(df: DataFrame, key: str, group: str, label: str, asked: int, random: bool = False, seed: str = "0") -> DataFrame:
    """Key and fold of each row: as many folds as fold_count() allows, which must be two at least. ``random``: rows are dealt by label, without
    regard to groups; otherwise whole groups are."""
    k = fold_count(df, label, group, asked)
    if k < 2:
        raise ValueError(f"two folds are needed, classes and groups allow {k}")
    if random:
        return stratified_folds(df, key, label, k, seed)
    return df.select(key, group).join(stratified_group_folds(df, group, label, k, seed), group).select(key, "fold")


def ridge_predictions(k: np.ndarray, y: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """M7: kernel ridge with centred kernels scaled by their mean diagonal; the training mean if that is under 1e-12; within [0, 1]."""
    column, whole = k.mean(axis=0), k.mean()
    centred = k - column[None, :] - column[:, None] + whole
    scale = np.trace(centred) / len(k)
    if scale < 1e-12:
        return np.full(len(cross), np.clip(y.mean(), 0, 1))
    w = np.linalg.solve(centred / scale + alpha * np.eye(len(k)), y - y.mean())
    test = cross - cross.mean(axis=1, keepdims=True) - column[None, :] + whole
    return np.clip(y.mean() + test / scale @ w, 0, 1)


#: Rows of a kernel in one task: 800 MB.
MOST_ROWS = 10_000


def nested_ridge(df: DataFrame, key: str, family: str, fold: str, vector: str, truth: str, alphas: list[float]) -> DataFrame:
    """M8: out-of-fold predictions; each outer fold takes the alpha of least mean absolute error over inner leave-one-fold-out runs, ties to
    the larger one. The rows are copied once for each outer fold, a fold's run is one task, which holds the kernel of all rows: for MOST_ROWS rows at most, more
    raise; nested_ridge_by_moments() takes any number."""
    if (n := df.count()) > MOST_ROWS:
        raise ValueError(f"{n} rows; nested_ridge_by_moments() takes more than {MOST_ROWS}")
    outer = df.select(F.col(fold).alias("outer")).distinct()
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(fold).cast("int").alias("fold"), F.col(vector).alias("x"), F.col(truth).cast("double").alias("y")).crossJoin(F.broadcast(outer))  # k rows

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("key")
        x, y, f = np.stack(own["x"].to_numpy()).astype(float), own["y"].to_numpy(), own["fold"].to_numpy()
        test = f == own["outer"].iloc[0]
        k = x @ x.T
        train = ~test
        if not train.any():
            return pd.DataFrame({"key": own["key"], "outer": own["outer"], "alpha": np.nan, "predicted": np.nan, "truth": y})
        scores = []
        for alpha in alphas:
            gaps = []
            for inner in np.unique(f[train]):
                a, b = train & (f != inner), train & (f == inner)
                if a.any():
                    gaps.append(np.abs(ridge_predictions(k[np.ix_(a, a)], y[a], k[np.ix_(b, a)], alpha) - y[b]))
            scores.append((float(np.mean(np.concatenate(gaps))) if gaps else 0.0, -alpha))
        alpha = -min(scores)[1]
        predicted = ridge_predictions(k[np.ix_(train, train)], y[train], k[np.ix_(test, train)], alpha)
        return pd.DataFrame({"key": own["key"][test], "outer": own["outer"][test], "alpha": alpha, "predicted": predicted, "truth": y[test]})

    return rows.groupBy("outer").applyInPandas(run, "key string, outer int, alpha double, predicted double, truth double")


def summed(df: DataFrame, sums, size: int) -> np.ndarray:
    """Totals over all rows of the ``size`` numbers that sums(rows) gives for a pandas batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((sums(b) for b in batches if len(b)), np.zeros(size))
        yield pd.DataFrame({"at": np.flatnonzero(total), "value": total[total != 0]})

    out = np.zeros(size)
    for r in df.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # moments: bounded
        out[r["at"]] = r["value"]
    return out


def _folded_rows(df: DataFrame, key: str, fold: str, vector: str, y: Column, layer: str | None = None) -> tuple[DataFrame, list[int], list[int], int]:
    """The rows as key, layer (0 without one), fold, x, y; their layers and folds, which are few, and the length of the vectors."""
    level = F.lit(0) if layer is None else F.col(layer).cast("int")
    rows = df.select(F.col(key).cast("string").alias("key"), level.alias("layer"), F.col(fold).cast("int").alias("fold"), F.col(vector).cast("array<double>").alias("x"), y.alias("y"))
    facts = rows.groupBy("layer", "fold").agg(F.max(F.size("x")).alias("d")).collect()
    return rows, sorted({r["layer"] for r in facts}), sorted({r["fold"] for r in facts}), max((r["d"] for r in facts), default=0)


#: Numbers in the moments of all layers and folds, which the driver holds: 800 MB.
MOST_MOMENTS = 100_000_000


def nested_ridge_by_moments(df: DataFrame, key: str, family: str, fold: str, vector: str, truth: str, alphas: list[float], layer: str | None = None) -> DataFrame:
    """M8 for many rows with vectors of moderate length: nested_ridge()'s result from the moments of each layer and fold, since the kernel is linear.

    One pass sums the moments, one the inner runs' absolute errors, one predicts; no fold's rows come together. With ``layer``, each row is one layer's vector of a key:
    every outer fold takes the layer and alpha of least inner error, of equal ones the larger alpha, then the smaller layer, and what comes
    out are the rows of that layer.
    """
    rows, layers, names, d = _folded_rows(df, key, fold, vector, F.col(truth).cast("double"), layer)
    width = d + 2  # x, 1, y
    if len(layers) * len(names) * width * width > MOST_MOMENTS:
        raise ValueError(f"{len(layers)} layers and {len(names)} folds of vectors of {d} numbers have too many moments")

    def parts(b: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Layer, fold, (x, 1) and y of a batch's rows."""
        for (level, f), own in b.groupby(["layer", "fold"]):
            yield level, f, np.c_[np.stack(own["x"].to_numpy()), np.ones(len(own))], own["y"].to_numpy()

    places = {(level, f): i for i, (level, f) in enumerate((level, f) for level in layers for f in names)}

    def moments(b: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(places), width, width))
        for level, f, x, y in parts(b):
            z = np.c_[x, y]
            out[places[level, f]] += z.T @ z
        return out.ravel()

    by_fold = dict(zip(places, summed(rows, moments, len(places) * width * width).reshape(len(places), width, width)))

    def fitted(level: int, out: set[int], alpha: float) -> np.ndarray | None:
        """Weights and a constant from all folds of a layer but those in out; None without rows."""
        m = sum((by_fold[level, n] for n in names if n not in out), np.zeros((width, width)))
        n = m[d, d]
        if not n:
            return None
        mean, middle = m[:d, d] / n, m[d, d + 1] / n
        spread = m[:d, :d] - n * np.outer(mean, mean)
        scale = np.trace(spread) / n
        if scale < 1e-12:
            return np.append(np.zeros(d), middle)
        w = np.linalg.solve(spread / scale + alpha * np.eye(d), (m[:d, d + 1] - n * mean * middle) / scale)
        return np.append(w, middle - mean @ w)

    grid = [(level, o, i, a) for level in layers for o in names for i in names if i != o for a in alphas]
    models = [fitted(level, {o, i}, a) for level, o, i, a in grid]
    tested: dict[tuple[int, int], list[int]] = {}  # by layer and inner fold
    for g, (level, _, i, _) in enumerate(grid):
        if models[g] is not None:
            tested.setdefault((level, i), []).append(g)

    def gaps(b: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(grid))
        for level, f, x, y in parts(b):
            for g in tested.get((level, f), []):
                out[g] += np.abs(np.clip(x @ models[g], 0, 1) - y).sum()
        return out

    missed = summed(rows, gaps, len(grid)) if grid else []
    chosen: dict[int, tuple[int, float, np.ndarray | None]] = {}
    for o in names:
        scores = []
        for level in layers:
            for alpha in alphas:
                at = [g for g, (v, p, _, a) in enumerate(grid) if v == level and p == o and a == alpha and models[g] is not None]
                n = sum(by_fold[level, grid[g][2]][d, d] for g in at)
                # rounded, as sums in any order differ in their last digits, and ties are to be seen
                scores.append((round(float(sum(missed[g] for g in at)) / n, 12) if n else 0.0, -alpha, level))
        _, alpha, level = min(scores)
        chosen[o] = (level, -alpha, fitted(level, {o}, -alpha))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[chosen[f][0] == level for f, level in zip(b["fold"], b["layer"])]]
            if len(b):
                x, f = np.c_[np.stack(b["x"].to_numpy()), np.ones(len(b))], b["fold"].to_numpy()
                alpha, predicted = np.full(len(b), np.nan), np.full(len(b), np.nan)
                for o, (_, a, w) in chosen.items():
                    if w is not None:
                        alpha[f == o], predicted[f == o] = a, np.clip(x[f == o] @ w, 0, 1)
                yield pd.DataFrame({"key": b["key"], "layer": b["layer"], "outer": f, "alpha": alpha, "predicted": predicted, "truth": b["y"]})

    out = rows.mapInPandas(run, "key string, layer int, outer int, alpha double, predicted double, truth double")
    return out.drop("layer") if layer is None else out


def label_index(df: DataFrame, label: str) -> Column:
    """Place of a label among the sorted labels."""
    names = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())  # classes: few
    return F.array_position(F.array(*map(F.lit, names)), F.col(label)).cast("int") - 1


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Label and weight n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_k"))
    whole = counts.agg(F.sum("_k").alias("_n"), F.count("*").alias("_c"))
    return counts.crossJoin(F.broadcast(whole)).select(label, (F.col("_n") / (F.col("_c") * F.col("_k"))).alias("weight"))  # one row is broadcast


def logistic_probe(df: DataFrame, key: str, fold: str, vector: str, label: str, ridge: float = 1.0, rounds: int = 100) -> DataFrame:
    """Out-of-fold probabilities of a balanced logistic regression on standardised vectors (label: boolean).

    Each Newton step of all folds is one pass of sums over the rows; no fold's rows come together.
    """
    rows, _, names, d = _folded_rows(df, key, fold, vector, F.col(label).cast("int").cast("double"))
    k, width = len(names), d + 1

    def parts(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(), b["fold"].to_numpy()

    def first(b: pd.DataFrame) -> np.ndarray:
        x, y, f = parts(b)
        return np.concatenate([np.r_[(f == n).sum(), y[f == n].sum(), x[f == n].sum(axis=0)] for n in names])

    sums = summed(rows, first, k * (d + 2)).reshape(k, d + 2)
    held = sums.sum(axis=0) - sums  # of each fold's training rows
    n = np.maximum(held[:, :1], 1)
    mean, share = held[:, 2:] / n, held[:, 1] / n[:, 0]

    def second(b: pd.DataFrame) -> np.ndarray:
        x, _, f = parts(b)
        return np.concatenate([((x[f != o] - mean[i]) ** 2).sum(axis=0) for i, o in enumerate(names)])

    std = np.sqrt(summed(rows, second, k * d).reshape(k, d) / n)
    std[std == 0] = 1
    hold = np.append(np.full(d, ridge), 1e-9)
    w = np.zeros((k, width))
    live = [i for i in range(k) if 0 < share[i] < 1]

    for _ in range(rounds):
        if not live:
            break

        def newton(b: pd.DataFrame) -> np.ndarray:
            x, y, f = parts(b)
            out = []
            for i in live:
                at = f != names[i]
                a, t = np.c_[(x[at] - mean[i]) / std[i], np.ones(at.sum())], y[at]
                weight = np.where(t == 1, 0.5 / share[i], 0.5 / (1 - share[i]))
                q = 1 / (1 + np.exp(-np.clip(a @ w[i], -30, 30)))
                out += [((a * (weight * q * (1 - q))[:, None]).T @ a).ravel(), a.T @ (weight * (q - t))]
            return np.concatenate(out)

        found = summed(rows, newton, len(live) * width * (width + 1)).reshape(len(live), width * (width + 1))
        still = []
        for i, own in zip(live, found):
            step = np.linalg.solve(own[: width * width].reshape(width, width) + np.diag(hold), own[width * width :] + hold * w[i])
            w[i] -= step
            if np.abs(step).max() >= 1e-9:
                still.append(i)
        live = still

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y, f = parts(b)
                p = np.full(len(b), np.nan)
                for i, o in enumerate(names):
                    if held[i, 0]:
                        at = f == o
                        p[at] = 1 / (1 + np.exp(-np.clip(np.c_[(x[at] - mean[i]) / std[i], np.ones(at.sum())] @ w[i], -30, 30))) if 0 < share[i] < 1 else share[i]
                yield pd.DataFrame({"key": b["key"], "outer": f, "probability": p, "label": y.astype(int)})

    return rows.mapInPandas(run, "key string, outer int, probability double, label int")


def probe_examples(df: DataFrame, kind: str, task: str, condition: str, base, passed: str) -> DataFrame:
    """Labelled rows: success (did it pass), condition (which one), rescue (did it pass where the base failed)."""
    if kind == "success":
        return df.withColumn("label", F.col(passed).cast("string"))
    if kind == "condition":
        return df.withColumn("label", F.col(condition).cast("string"))
    failed = df.where((F.col(condition) == F.lit(base)) & ~F.col(passed)).select(task).distinct()
    return df.where(F.col(condition) != F.lit(base)).join(failed, task, "left_semi").withColumn("label", F.col(passed).cast("string"))
