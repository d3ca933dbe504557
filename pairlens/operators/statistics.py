"""Paired-effect statistics (T1-T15): cluster bootstrap, exact McNemar, rank and partial correlation.

Bootstrap draws are a function of (seed, draw, place): ``hash`` draws come from md5 and are the same in any SQL engine; ``numpy`` draws are
NumPy's PCG64 stream over the clusters in string order. Per-cluster sums are what is drawn, so the draws' table has clusters x draws rows and no
observation is replicated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .aggregates import flips, task_means
from .constraints import require, uneven_repeats
from .joins import self_pairs
from .selection import placed

#: Words of 32 bits that a task draws at a time.
WORDS = 1 << 20


def mcnemar(gains: Column, losses: Column, digits: int = 10) -> Column:
    """The two-sided exact p of discordant pairs; 1 without any. Terms are built one from the other in log space."""
    n = (gains + losses).cast("double")
    low = F.least(gains, losses).cast("int")
    # log C(n, i) is a running sum; the state is (log of the last term, sum so far)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i))).alias("s"))
    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>")), start, step)["s"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), digits))


def _numbered(clusters: DataFrame, cluster: str) -> DataFrame:
    """The distinct clusters with their place in string order as _i, found by ranges."""
    names = clusters.select(cluster).distinct().withColumn("_name", F.col(cluster).cast("string"))
    return placed(names, ["_name"], "_i").drop("_name")


def hash_draws(clusters: DataFrame, cluster: str, draws: int, seed: str = "") -> DataFrame:
    """Draw, and the cluster drawn at each of as many places as there are clusters."""
    numbered = _numbered(clusters, cluster)
    size = clusters.select(F.countDistinct(cluster).alias("_g"))
    places = size.select("_g", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("_g", "draw", F.explode(F.sequence(F.lit(0), (F.col("_g") - 1).cast("int"))).alias("place"))
    key = F.concat_ws("-", *([F.lit(seed)] if seed else []), F.col("draw").cast("string"), F.col("place").cast("string"))
    index = F.pmod(F.conv(F.substr(F.md5(key), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.col("_g")).cast("int")
    return places.withColumn("_i", index).join(numbered, "_i").select("draw", "place", cluster)


def numpy_numbers(seed: int, size: int, chunk: int) -> np.ndarray:
    """The numbers below ``size`` (2 to 2^32) that chunk ``chunk`` of NumPy's default generator's stream gives to ``integers``, found by jumping there.

    A word w of 32 bits gives the upper half of w * size, unless the lower half is below 2^32 mod size: such a word gives none, so chunks differ in length.
    """
    words = np.random.PCG64(seed).advance(chunk * WORDS // 2).random_raw(WORDS // 2).astype("<u8").view("<u4")
    products = words.astype(np.uint64) * np.uint64(size)
    return (products >> np.uint64(32))[(products & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % size)].astype(np.int64)


def numpy_draws(clusters: DataFrame, cluster: str, draws: int, seed: int = 0) -> DataFrame:
    """The same shape, from NumPy's generator over the clusters in string order: ``default_rng(seed).integers(0, clusters, (draws, clusters))``.

    Tasks draw chunks of its one stream. How many numbers each chunk gives is counted first (two numbers a chunk come to the driver), which places them.
    """
    numbered, spark = _numbered(clusters, cluster), clusters.sparkSession
    size = numbered.count()
    total = draws * size
    if size < 2:  # nothing is drawn from one
        rows = spark.range(total).select(F.col("id").cast("int").alias("draw"), F.lit(0).cast("long").alias("_i"))
        return rows.join(numbered, "_i").select("draw", F.lit(0).alias("place"), cluster)
    # as many words as are needed, and six deviations more
    words = total / (1 - ((1 << 32) % size) / (1 << 32))
    chunks = math.ceil((words + 6 * math.sqrt(words)) / WORDS) + 1

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"chunk": batch["id"], "n": [len(numpy_numbers(seed, size, c)) for c in batch["id"]]})

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, first in zip(batch["chunk"], batch["first"]):
                drawn = numpy_numbers(seed, size, chunk)[: max(0, total - first)]
                yield pd.DataFrame({"draw": ((first + np.arange(len(drawn))) // size).astype(np.int32), "_i": drawn})

    slices = min(chunks, 10_000)
    counted = sorted(tuple(r) for r in spark.range(0, chunks, 1, slices).mapInPandas(lengths, "chunk long, n long").collect())
    firsts = np.cumsum([0] + [n for _, n in counted])
    if firsts[-1] < total:
        raise ValueError(f"{chunks} chunks gave {firsts[-1]} of {total} numbers")
    places = [(c, int(first)) for (c, _), first in zip(counted, firsts)]
    rows = spark.createDataFrame(places, "chunk long, first long").repartition(slices, "chunk").mapInPandas(numbers, "draw int, _i long")
    return rows.join(numbered, "_i").select("draw", F.lit(0).alias("place"), cluster)


def ratio_draws(sums: DataFrame, draws: DataFrame, cluster: str, numerator: str, denominator: str) -> DataFrame:
    """Of each draw the ratio of sums over its clusters; 0 if the lower one is 0."""
    joined = draws.join(sums.select(cluster, numerator, denominator), cluster)
    lower = F.sum(denominator)
    return joined.groupBy("draw").agg(F.when(lower == 0, 0.0).otherwise(F.sum(numerator) / lower).alias("value"))


def mean_draws(means: DataFrame, draws: DataFrame, cluster: str, value: str) -> DataFrame:
    """T4: of each draw the mean of its clusters' means."""
    return draws.join(means.select(cluster, value), cluster).groupBy("draw").agg(F.avg(value).alias("value"))


def linear_interval(draws: DataFrame, digits: int = 10) -> DataFrame:
    """Linear 2.5 and 97.5 % quantiles over finite draws, and how many those are."""
    sound = draws.where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return sound.agg(q.alias("q"), F.count("*").alias("valid_draws")).select(F.round(F.col("q")[0], digits).alias("ci_low"), F.round(F.col("q")[1], digits).alias("ci_high"), "valid_draws")


def index_interval(draws: DataFrame, digits: int = 10) -> DataFrame:
    """T5: the draws at places int(.025 B) and int(.975 B) - 1 of their order."""
    both = draws.agg(F.array_sort(F.collect_list("value")).alias("v")).withColumn("n", F.size("v"))
    at = lambda share, shift: F.get("v", F.floor(F.col("n") * share).cast("int") - shift)
    return both.select(F.round(at(0.025, 0), digits).alias("ci_low"), F.round(at(0.975, 1), digits).alias("ci_high"), F.col("n").alias("valid_draws"))


def paired_effect(df: DataFrame, base, target, measure: str, task: str = "task", repeat: str = "repeat", condition: str = "condition", cluster: str | None = None, draws: int = 5000, seed: int | str = "", rng: str = "hash") -> dict[str, DataFrame]:
    """The paired difference of two conditions.

    ``summary``: num_tasks, num_clusters, repeats_per_task, paired_difference, ci_low, ci_high, valid_draws. ``per_repeat``: counts, difference and
    the exact p (null if clusters aren't tasks). Unpaired, duplicate or unevenly repeated tasks raise.
    """
    keys = [task, repeat] + ([cluster] if cluster else [])
    pairs = stored(self_pairs(df, keys, condition, base, target, [measure]), "pairs")
    require(uneven_repeats(pairs, task), "tasks of unequal repeats")
    group = cluster or task
    means = task_means(pairs, list(dict.fromkeys([task, group])), measure)
    sums = means.groupBy(group).agg(F.sum("difference").alias("s"), F.count("*").alias("k"))
    drawn = numpy_draws(sums, group, draws, int(seed or 0)) if rng == "numpy" else hash_draws(sums, group, draws, str(seed))
    interval = linear_interval(ratio_draws(sums, drawn, group, "s", "k"))
    whole = means.agg(F.countDistinct(task).alias("num_tasks"), F.countDistinct(group).alias("num_clusters"), F.max("repeats").alias("repeats_per_task"), F.avg("difference").alias("paired_difference"))
    per_repeat = flips(pairs, [repeat], measure).withColumn("difference", F.col("net_gain_rate"))
    p = mcnemar(F.col("gains"), F.col("losses")) if group == task else F.lit(None).cast("double")
    return {"summary": whole.crossJoin(interval), "per_repeat": per_repeat.withColumn("exact_mcnemar_p", p)}  # one row by one row


def against_zero(df: DataFrame, measure: str, condition: str) -> DataFrame:
    """The rows, and as many with a base condition '_zero' whose measure is false."""
    return df.unionByName(df.withColumn(condition, F.lit("_zero")).withColumn(measure, F.lit(False)))


def contrasts_of(kind: str) -> list[tuple[str, str]]:
    """(base, target) of each kind of experiment."""
    return {
        "main": [("nl_only", "nl_tests"), ("inputs_only", "nl_tests"), ("wrong_tests", "nl_tests")],
        "quality": [("quality_random", "quality_high"), ("quality_low", "quality_high"), ("nl_only", "quality_high")],
        "semantic": [(b, f"tests_{s}") for s in "ab" for b in ("nl_only", "inputs_only", f"explicit_{s}")],
        "unrelated": [],
    }[kind]


def kind_of(conditions: set[str]) -> str:
    """The kind of an experiment, by the conditions that it has."""
    if "tests_a" in conditions:
        return "semantic"
    if conditions == {"unrelated_tests"}:
        return "unrelated"
    return "main" if "nl_tests" in conditions else "quality"


def effects(df: DataFrame, pairs: list[tuple], measures: dict[tuple, str] | str, **options) -> DataFrame | None:
    """Base, target, measure and paired_effect()'s summary for each listed pair of conditions (or of models, with condition=<the model's column>); None without
    pairs. ``measures``: one for all pairs, or one for each. A pair's rows are read by themselves, and several times, so df is computed once; clusters are drawn alike for all pairs of the same clusters."""
    df, out = stored(df, "effects"), None
    for base, target in pairs:
        measure = measures if isinstance(measures, str) else measures[base, target]
        own = paired_effect(df, base, target, measure, **options)["summary"].select(F.lit(base).alias("base"), F.lit(target).alias("target"), F.lit(measure).alias("measure"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def report(df: DataFrame, condition: str = "condition", **options) -> DataFrame | None:
    """The contrasts of an experiment, whose kind its conditions tell: on ``passed``, or for pairs of rules on rule_a or rule_b, the one that the target's tests show."""
    kind = kind_of({r[0] for r in df.select(condition).distinct().collect()})  # conditions: few
    pairs = contrasts_of(kind)
    measures = {p: f"rule_{p[1][-1]}" if kind == "semantic" else "passed" for p in pairs}
    return effects(df, pairs, measures, condition=condition, **options)


def correlation(sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, n: Column) -> Column:
    """Pearson's from sums; null if either variance is 1e-12 or less."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), (sxy - sx * sy / n) / F.sqrt(vx * vy))


def _pearson(df: DataFrame, keys: list[str], x: str, y: str, digits: int) -> DataFrame:
    a, b = F.col(x), F.col(y)
    sums = (F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b), F.count("*"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(correlation(*sums), digits).alias("rho"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, digits: int = 9) -> DataFrame:
    """Pearson's on average ranks within each key (null-free rows)."""
    from .windows import average_rank

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys))
    return _pearson(ranked, keys, "_x", "_y", digits)


def spearman_within(df: DataFrame, keys: list[str], family: str, x: str, y: str, digits: int = 9) -> DataFrame:
    """Ranks within families, centred there, then pooled over the key."""
    from .windows import average_rank, centred

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    group = [*keys, family]
    ranked = rows.withColumn("_x", average_rank(x, group)).withColumn("_y", average_rank(y, group))
    ranked = ranked.withColumn("_cx", centred("_x", group)).withColumn("_cy", centred("_y", group))
    sxx, syy, sxy = (F.sum(F.col(a) * F.col(b)) for a, b in (("_cx", "_cx"), ("_cy", "_cy"), ("_cx", "_cy")))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.when((sxx > 1e-12) & (syy > 1e-12), sxy / F.sqrt(sxx * syy)), digits).alias("rho"))


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, z: list[str], digits: int = 9) -> DataFrame:
    """Correlation of x and y, both freed of two covariates by least squares (by recursion on correlations); null where it isn't defined."""
    names = [x, y, *z]
    aggs = [F.count("*").alias("n")]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    for i, j in pairs:
        a, b = F.col(names[i]), F.col(names[j])
        aggs.append(correlation(F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b), F.count("*")).alias(f"r{i}{j}"))
    r = lambda i, j: F.col(f"r{max(i, j)}{min(i, j)}")

    def given(i: int, j: int, k: int) -> Column:
        scale = (1 - r(i, k) * r(i, k)) * (1 - r(j, k) * r(j, k))
        return F.when(scale > 1e-12, (r(i, j) - r(i, k) * r(j, k)) / F.sqrt(scale))

    xy, xw, yw = given(0, 1, 2), given(0, 3, 2), given(1, 3, 2)
    scale = (1 - xw * xw) * (1 - yw * yw)
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in names))
    return rows.groupBy(*keys).agg(*aggs).select(*keys, "n", F.round(F.when(scale > 1e-12, (xy - xw * yw) / F.sqrt(scale)), digits).alias("rho"))


def spearman_draws(df: DataFrame, draws: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """Rank correlation of each draw, with ranks taken anew in it. Rows x draws are ranked within their draw."""
    rows = draws.join(df.select(cluster, x, y), cluster)
    return spearman(rows, ["draw"], x, y, digits=12).select("draw", F.col("rho").alias("value"))


def detection_difference(rates: DataFrame, task: str, suite: str, high, low, value: str) -> DataFrame:
    """Mean of high minus low, and how many tasks are above, at and below 0."""
    wide = rates.groupBy(task).agg(F.max(F.when(F.col(suite) == F.lit(high), F.col(value))).alias("h"), F.max(F.when(F.col(suite) == F.lit(low), F.col(value))).alias("l"))
    gap = F.col("h") - F.col("l")
    return wide.where("h IS NOT NULL AND l IS NOT NULL").agg(F.avg(gap).alias("difference"), F.count_if(gap > 0).alias("positive"), F.count_if(gap == 0).alias("tied"), F.count_if(gap < 0).alias("negative"))
