"""Aggregations (A1-A32): summaries, flips, pivots, transitions, nested means, coverage rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import running_before


def rate(holds: Column) -> Column:
    """Share of true among known values; null without any."""
    return F.avg(holds.cast("int"))


def condition_summary(df: DataFrame, keys: list[str], task: str, measures: list[str]) -> DataFrame:
    """A1-A4: rows, distinct tasks, and for each measure how many are known and their rate."""
    aggs = [F.count("*").alias("observations"), F.countDistinct(task).alias("tasks")]
    for m in measures:
        aggs += [F.count(m).alias(f"{m}_n"), rate(F.col(m)).alias(f"{m}_rate")]
    return df.groupBy(*keys).agg(*aggs)


def flips(pairs: DataFrame, keys: list[str], measure: str, task: str | None = None) -> DataFrame:
    """Counts over rows with base_<measure> and target_<measure>; with a task, also its sorted lists."""
    b, t = F.col(f"base_{measure}"), F.col(f"target_{measure}")
    aggs = [
        F.count("*").alias("n"), F.count_if(b).alias("base_passed"), F.count_if(t).alias("target_passed"), F.count_if(~b & t).alias("gains"), F.count_if(b & ~t).alias("losses"),
        F.count_if(b & t).alias("both_pass"), F.count_if(~b & ~t).alias("both_fail"),
    ]
    if task:
        aggs += [F.array_sort(F.collect_list(F.when(~b & t, F.col(task)))).alias("gained"), F.array_sort(F.collect_list(F.when(b & ~t, F.col(task)))).alias("lost")]
    out = pairs.groupBy(*keys).agg(*aggs)
    return out.withColumn("net_gain", F.col("gains") - F.col("losses")).withColumn("net_gain_rate", F.col("net_gain") / F.col("n"))


def matrix(df: DataFrame, keys: list[str], condition: str, values: list, measure: str, order: str | None = None) -> DataFrame:
    """A row for each key, a column for each listed condition; the last value by ``order`` counts, null where there is none."""
    aggs = []
    for v in values:
        own = F.col(condition) == F.lit(v)
        aggs.append((F.max_by(F.when(own, F.col(measure)), F.when(own, F.col(order))) if order else F.max(F.when(own, F.col(measure)))).alias(str(v)))
    return df.groupBy(*keys).agg(*aggs)


def unpivoted(df: DataFrame, keys: list[str], values: list[str], name: str = "condition", measure: str = "value") -> DataFrame:
    """A7, the other way: a row for each key and column, without nulls."""
    return df.unpivot(keys, values, name, measure).where(F.col(measure).isNotNull())


def task_means(pairs: DataFrame, task: list[str], measure: str) -> DataFrame:
    """Each task's mean of target minus base over its repeats."""
    difference = F.col(f"target_{measure}").cast("int") - F.col(f"base_{measure}").cast("int")
    return pairs.groupBy(*task).agg(F.avg(difference).alias("difference"), F.count("*").alias("repeats"))


def nested_mean(df: DataFrame, levels: list[list[str]], values: list[str]) -> DataFrame:
    """Means over the innermost level, then of those means, and so on outwards (each group weighs the same)."""
    for keys in levels:
        df = df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))
    return df


def grouped_at(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """The same aggregates at several fixed levels; keys outside a level are null, level names it."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    missing = lambda s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
    level = F.lit(None).cast("string")
    for s in sets:
        level = F.when(F.col("_gid") == missing(s), "+".join(s)).otherwise(level)
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id(*keys).alias("_gid"), *aggs)
    return out.withColumn("level", level).drop("_gid")


def transitions(pairs: DataFrame, start: str, end: str, values: list[str]) -> DataFrame:
    """A row for each listed start, counts by end, zeros where nothing went."""
    spark = pairs.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{start} string")
    counts = pairs.groupBy(start).agg(*(F.count_if(F.col(end) == v).alias(f"to_{v}") for v in values))
    return every.join(counts, start, "left").fillna(0)


def group_statistics(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Sums that correlations and regressions of x and y need, to be added up or reweighted."""
    a, b = F.col(x), F.col(y)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))


def detection_rate(results: DataFrame, suite: list[str], program: str, passed: str) -> DataFrame:
    """Of each suite the share of programs that fail at least one of its tests."""
    by_program = results.groupBy(*suite, program).agg(F.bool_or(~F.col(passed)).alias("detected"))
    return by_program.groupBy(*suite).agg(rate(F.col("detected")).alias("detection_rate"), F.count("*").alias("programs"))


def kill_rate(results: DataFrame, test: list[str], passed: str) -> DataFrame:
    """Of each test the share of programs that fail it; 0 without any known result."""
    return results.groupBy(*test).agg(F.coalesce(rate(~F.col(passed)), F.lit(0.0)).alias("kill_rate"), F.count(passed).alias("programs"))


def by_key(df: DataFrame, key: str, passed: str) -> DataFrame:
    """Rows and pass rate by a key, '' where it is missing."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).agg(F.count("*").alias("n"), rate(F.col(passed)).alias("rate"))


def spread(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows, mean and population deviation."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*aggs)


def quartiles(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Linear quartiles, and the upper median (an existing value: the lower median of the descending order). All come from counts of equal values."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    upper = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")
    out = df.groupBy(*keys).agg(q.alias("_q"), F.count(column).alias("n"), upper.alias("upper_median"))
    return out.select(*keys, "n", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "upper_median")


def distinct_values(df: DataFrame, keys: list[str], column: str, k: int, order: str) -> DataFrame:
    """Of each key the first k distinct values by the order in which they come."""
    first = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.min(order).alias("_at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    kept = first.withColumn("_r", rank).where(F.col("_r") <= k)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", column))), lambda x: x[column]).alias("values"))


def single_valued(df: DataFrame, keys: list[str], column: str, repeats: str) -> DataFrame:
    """Of each key how many values it has, and its sorted repeats."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias("values"), F.array_sort(F.collect_list(repeats)).alias("repeats"))


def errors(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Mean absolute and mean squared error."""
    gap = F.col(predicted) - F.col(truth)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))


def classification(df: DataFrame, keys: list[str], truth: str, predicted: str, classes: list) -> DataFrame:
    """Accuracy and macro F1 over the listed classes that occur."""
    aggs = [F.count("*").alias("n"), rate(F.col(truth) == F.col(predicted)).alias("accuracy")]
    for i, c in enumerate(classes):
        t, p = F.col(truth) == F.lit(c), F.col(predicted) == F.lit(c)
        aggs += [F.count_if(t & p).alias(f"_tp{i}"), F.count_if(t).alias(f"_t{i}"), F.count_if(p).alias(f"_p{i}")]
    out = df.groupBy(*keys).agg(*aggs)
    f1 = [F.when(F.col(f"_t{i}") + F.col(f"_p{i}") > 0, 2.0 * F.col(f"_tp{i}") / (F.col(f"_t{i}") + F.col(f"_p{i}"))) for i in range(len(classes))]
    known = F.filter(F.array(*f1), lambda x: x.isNotNull())
    return out.select(*keys, "n", "accuracy", (F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).alias("macro_f1"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks; null if one class is missing. Ties are ranked by counts of equal scores."""
    counts = df.groupBy(score).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    won = running_before(counts, score, "neg", "below").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return won.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def ratio(df: DataFrame, keys: list[str], numerator: str, denominator: str) -> DataFrame:
    """Sum over sum; null if the lower one is 0."""
    return df.groupBy(*keys).agg(F.sum(numerator).alias("numerator"), F.sum(denominator).alias("denominator")).withColumn("ratio", F.try_divide("numerator", "denominator"))


def delta_to(df: DataFrame, keys: list[str], condition: str, base, value: str) -> DataFrame:
    """Each row's value minus the base condition's within its keys; one aggregate pass, then a join on the keys."""
    first = df.where(F.col(condition) == F.lit(base)).select(*keys, F.col(value).alias("_base"))
    joined = df.join(first, keys, "left") if keys else df.crossJoin(F.broadcast(first.limit(1)))  # one row
    return joined.withColumn("delta", F.col(value) - F.col("_base")).drop("_base")
