"""Building experiment protocols: jobs, staged preparation with reasons, audits of transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import best_subset, hash_order, top_k


def jobs(tasks: DataFrame, key: str, conditions: list[str], repeats: int, seed: int = 0) -> DataFrame:
    """A row for each task, condition and repeat, with its order seed and its place among the repeat's jobs as a hash to sort by."""
    rows = tasks.select(key).withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("order_seed", F.col("repeat") + seed)
    return rows.withColumn("order_key", hash_order("job", F.concat_ws("-", F.col("order_seed").cast("string"), F.col(key).cast("string"), "condition")))


def staged(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Df with a column reason: the first check that a row fails, null if it passes all. Nothing is dropped."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reason", reason)


def quality_suites(results: DataFrame, task: str, test: str, size: str, program: str, passed: str, k: int = 3, candidates: int = 12, programs: int = 3) -> DataFrame:
    """Of each task the suites of k tests that catch most and fewest programs (suite: high, low), or why it has none.

    ``results``: a row for each test and program. A task needs ``programs`` programs that some test catches, and k tests.
    """
    known = results.groupBy(task).agg(F.countDistinct(F.when(~F.col(passed), F.col(program))).alias("_caught"), F.countDistinct(test).alias("_tests"))
    judged = staged(known, [("too few programs", F.col("_caught") >= programs), ("too few tests", F.col("_tests") >= k)])
    killed = results.groupBy(task, test, size).agg(F.array_sort(F.collect_set(F.when(~F.col(passed), F.col(program)))).alias("_killed"))
    killed = top_k(killed, [task], [F.col(test)], candidates, "_r").join(judged.where("reason IS NULL").select(task), task, "left_semi")
    suites = None
    for name, highest in (("high", True), ("low", False)):
        part = best_subset(killed, [task], test, size, "_killed", k, highest).select(task, F.lit(name).alias("suite"), F.col("chosen").cast("array<string>").alias("tests"), "n_covered", F.lit(None).cast("string").alias("reason"))
        suites = part if suites is None else suites.unionByName(part)
    rejected = judged.where("reason IS NOT NULL").select(task, F.lit(None).cast("string").alias("suite"), F.lit(None).cast("array<string>").alias("tests"), F.lit(None).cast("int").alias("n_covered"), "reason")
    return suites.unionByName(rejected)


def transform_audit(df: DataFrame, before: str, after: str, interface_before: Column, interface_after: Column) -> DataFrame:
    """How many rows a transform left alone, changed, and changed in their interface."""
    same = F.col(before).eqNullSafe(F.col(after))
    return df.agg(F.count("*").alias("rows"), F.count_if(same).alias("unchanged"), F.count_if(~same).alias("changed"), F.count_if(~interface_before.eqNullSafe(interface_after)).alias("interface_mismatches"))


def variants(tests: DataFrame, key: str, selectors: dict[str, list[Column]], counts: list[int]) -> DataFrame:
    """For each selector (an order) and count, each task's first tests in that order. tests: a row for each test, column test."""
    out = None
    for name, order in selectors.items():
        ranked = top_k(tests, [key], order, max(counts), "_r")
        for n in counts:
            part = ranked.where(F.col("_r") <= n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "test"))), lambda x: x["test"]).alias("tests")).withColumn("selector", F.lit(name)).withColumn("n", F.lit(n))
            out = part if out is None else out.unionByName(part)
    return out
