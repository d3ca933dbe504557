"""Integrity constraints: each returns a DataFrame of violations, empty if the data holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Raised by require() with the first violations in its text."""


def require(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raises if there is any violation. All partitions are looked at in one job; a plain limit tries one, then four, and so on."""
    first = violations.limit(shown).coalesce(1).collect()
    if first:
        raise ConstraintError(f"{what}: {[r.asDict() for r in first]}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """V1: key values that stand on more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def grid(df: DataFrame, keys: list[str], values: dict[str, list]) -> DataFrame:
    """Every combination of the keys found in df and the listed values; only keys are shuffled."""
    out = df.select(*keys).distinct()
    for name, listed in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, listed))))
    return out


def coverage(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """V2: keys missing from df or not expected, with a column problem."""
    own, wanted = df.select(*keys).distinct(), expected.select(*keys).distinct()
    missing = wanted.join(own, keys, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(own.join(wanted, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def outside(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """V3: keys of df that are not expected; missing ones are allowed."""
    return df.select(*keys).distinct().join(expected.select(*keys).distinct(), keys, "left_anti")


def incomplete_groups(df: DataFrame, keys: list[str], column: str, needed: list) -> DataFrame:
    """V4, V6: keys whose set of values differs from the needed one, with what is missing and what is extra."""
    want = F.array(*map(F.lit, sorted(needed)))
    found = df.groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias("found"))
    return found.where(F.col("found") != want).select(*keys, F.array_sort(F.array_except(want, "found")).alias("missing"), F.array_sort(F.array_except("found", want)).alias("extra"))


def uneven_repeats(df: DataFrame, task: str) -> DataFrame:
    """V5: tasks whose number of rows isn't the least one."""
    counts = df.groupBy(task).agg(F.count("*").alias("n"))
    least = counts.agg(F.min("n").alias("least"))
    return counts.join(F.broadcast(least), F.col("n") != F.col("least")).select(task, "n", "least")  # one row is broadcast


def several_values_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """V7 for each key: keys with more than one value of a column, and two of them."""
    return df.groupBy(*keys).agg(F.min(column).alias("least"), F.max(column).alias("most")).where("least <> most")


def several_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that should have one; empty if it has."""
    values = df.select(column).distinct()
    return values.join(F.broadcast(values.agg(F.count("*").alias("n")).where("n > 1")))


def differing(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float | None = None) -> DataFrame:
    """Keys on which two sources disagree. With a tolerance, doubles may differ by as much, relatively."""
    a, b = left.select(*keys, *(F.col(c).alias(f"left_{c}") for c in columns)), right.select(*keys, *(F.col(c).alias(f"right_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        x, y = F.col(f"left_{c}"), F.col(f"right_{c}")
        same = same & (x.eqNullSafe(y) if tolerance is None else (x.eqNullSafe(y) | F.coalesce(close(x, y, tolerance), F.lit(False))))
    return a.join(b, keys, "inner").where(~same)


def close(a: Column, b: Column, relative: float = 1e-10, absolute: float = 1e-12) -> Column:
    """whether two doubles are as good as equal."""
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is not finite or not within bounds; nulls are let through."""
    x = F.col(column)
    return df.where(F.isnan(x) | (x < low) | (x > high))


def total_differs(df: DataFrame, expected: int) -> DataFrame:
    """One row with both totals if they differ."""
    return df.agg(F.count("*").alias("observed")).withColumn("expected", F.lit(expected).cast("long")).where("observed <> expected")


def unlike_hashes(df: DataFrame, keys: list[str], found: Column, expected: str) -> DataFrame:
    """Rows whose recorded hash is not the one found from what a second backend has; rows without a record are let through, a null hash against a record is not."""
    return df.select(*keys, found.alias("found"), F.col(expected).alias("expected")).where(F.col("expected").isNotNull() & ~F.col("found").eqNullSafe(F.col("expected")))


def clipped(value: Column, low: float, high: float) -> Column:
    """a double within bounds; NaN and null stay (least() and greatest() alone would take NaN for the largest value and pass over nulls)."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNull() | F.isnan(value), value).otherwise(bounded)
