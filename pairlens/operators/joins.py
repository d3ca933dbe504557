"""Joins (J1-J15): paired, checked, anti, best-match and positional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .constraints import duplicate_keys, require


def checked_join(fact: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which every fact must find exactly one row of dim; raises otherwise."""
    require(duplicate_keys(dim, keys), "keys stand more than once")
    require(fact.select(*keys).distinct().join(dim, keys, "left_anti"), "keys without a match")
    return fact.join(dim, keys)


def with_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Left join, with a value instead of null for each named column."""
    joined = left.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(c, v if isinstance(v, Column) else F.lit(v)) for c, v in defaults.items()})


def without(df: DataFrame, other: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    """Rows of df whose key isn't in other. keys: shared names, or own name to the other's."""
    pairs = keys if isinstance(keys, dict) else {k: k for k in keys}
    right = other.select(*(F.col(b).alias(f"_r_{a}") for a, b in pairs.items())).distinct()
    condition = None
    for a in pairs:
        own = F.col(a) == F.col(f"_r_{a}")
        condition = own if condition is None else condition & own
    return df.join(right, condition, "left_anti")


def only_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key is in other."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def self_pairs(df: DataFrame, keys: list[str], condition: str, base, target, measures: list[str], strict: bool = True) -> DataFrame:
    """One row for each key with both conditions: base_<m> and target_<m>.

    One aggregation instead of a self-join: a single exchange on the keys. strict: duplicates or a missing side raise;
    otherwise a key needs both sides and its last value by natural order of the measure counts.
    """
    rows = df.where(F.col(condition).isin(base, target))
    aggs = []
    for side, value in (("base", base), ("target", target)):
        own = F.col(condition) == F.lit(value)
        aggs += [F.max(F.when(own, F.col(m))).alias(f"{side}_{m}") for m in measures]
        aggs.append(F.count_if(own).alias(f"_n_{side}"))
    paired = rows.groupBy(*keys).agg(*aggs)
    if strict:
        require(paired.where("_n_base <> 1 OR _n_target <> 1"), "rows without exactly one partner")
    else:
        paired = paired.where("_n_base > 0 AND _n_target > 0")
    return paired.drop("_n_base", "_n_target")


def ordered_pairs(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """All pairs of the named values with left before right by ``order``; for a bounded list such as models."""
    a = df.select(F.col(key).alias(f"left_{key}"), F.col(order).alias("_a"), *(F.col(c).alias(f"left_{c}") for c in columns))
    b = df.select(F.col(key).alias(f"right_{key}"), F.col(order).alias("_b"), *(F.col(c).alias(f"right_{c}") for c in columns))
    return a.join(b, F.col("_a") < F.col("_b")).drop("_a", "_b")


def zipped(df: DataFrame, left: str, right: str, strict: bool = True) -> DataFrame:
    """A row for each position of two arrays, pos from 0; strict raises on unequal lengths, else the shorter one ends it."""
    a, b = F.col(left), F.col(right)
    if strict:
        a = F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    n = F.least(F.size(a), F.size(b))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(a, i).alias(left), F.get(b, i).alias(right)))
    rows = df.select("*", F.posexplode(F.when(n > 0, pairs)).alias("pos", "_pair")).drop(left, right)
    return rows.select("*", f"_pair.{left}", f"_pair.{right}").drop("_pair")


def next_in_cycle(df: DataFrame, group: list[str], order: str, value: str) -> Column:
    """The next row's value in each group, the first one's for the last row."""
    w = Window.partitionBy(*group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(value).over(w), F.first(value).over(whole))


def override(base: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """Rows of base for which the condition doesn't hold, and those of other for which it does."""
    return base.where(~condition).unionByName(other.where(condition), allowMissingColumns=True)


def best_match(left: DataFrame, right: DataFrame, block: list[str], key: str, other: str, allowed: Column, score: list[Column], rounds: int = 1) -> DataFrame:
    """For each left row the right rows of least score within a block, ``rounds`` of them, never one twice for the same left row.

    left and right are joined on the block columns; ``allowed`` filters pairs; ``score`` is compared lexicographically, then ``other`` decides.
    """
    pairs = left.join(right, block).where(allowed)
    parts = [F.struct(*(c.alias(f"s{i}") for i, c in enumerate(score)), F.col(other).alias("o")).alias("_score")]
    ranked = pairs.select("*", *parts)
    if rounds == 1:
        best = ranked.groupBy(key).agg(F.min_by(F.col(other), F.col("_score")).alias(other))
        return best.withColumn("position", F.lit(1))
    found = ranked.groupBy(key, other).agg(F.min("_score").alias("_score"))
    position = F.row_number().over(Window.partitionBy(key).orderBy("_score"))
    return found.withColumn("position", position).where(F.col("position") <= rounds).drop("_score")


def incidence(candidates: DataFrame, programs: DataFrame, task: str, flags: str) -> DataFrame:
    """(task, test index, program) for each program that a candidate test fails. flags: array of passed by test."""
    exploded = programs.select(task, "program", F.posexplode(flags).alias("test", "passed"))
    return exploded.where(~F.col("passed")).join(candidates.select(task).distinct(), task, "left_semi").select(task, "test", "program")
