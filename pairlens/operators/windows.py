"""Window-like operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import running_before


def average_rank(column: str, group: list[str]) -> Column:
    """Rank within the group, ties averaged."""
    by = Window.partitionBy(*group)
    return F.rank().over(by.orderBy(column)) + (F.count("*").over(by.partitionBy(*group, column)) - 1) / 2


def global_average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """W1 over all rows: counts of equal values are summed by ranges, so no task sees all rows."""
    counts = running_before(df.groupBy(column).agg(F.count("*").alias("_n")), column, "_n", "_below")
    ranks = counts.select(column, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, column)


def centred(column: str, group: list[str]) -> Column:
    """Value minus its group's mean."""
    return F.col(column) - F.avg(column).over(Window.partitionBy(*group))


def peak(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """The position of the largest value, the first of several; position 0 only if there is no other."""
    score = F.struct(F.when(F.col(position) > 0, 1).otherwise(0), F.col(value), -F.col(position))
    return df.groupBy(*keys).agg(F.max_by(F.col(position), score).alias("peak_position"), F.max_by(F.col(value), score).alias("peak_value"))


def last_by(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns of each key's last row."""
    return df.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in columns))


def relative_position(position: str, group: list[str]) -> Column:
    """Position over the group's largest; null if that is 0."""
    return F.try_divide(F.col(position).cast("double"), F.max(position).over(Window.partitionBy(*group)).cast("double"))


def leave_group_out_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the mean over the rows of all others."""
    sums = df.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = sums.agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_rows"))
    return sums.crossJoin(F.broadcast(total)).select(group, F.try_divide(F.col("_all") - F.col("_s"), F.col("_rows") - F.col("_n")).alias("others_mean"))  # one row is broadcast


def leave_group_out_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each group (a fold: few) the median over the rows of all others."""
    folds = [r[0] for r in df.select(group).distinct().collect()]  # folds, a handful
    row = df.agg(*(F.percentile(F.when(~F.col(group).eqNullSafe(F.lit(f)), F.col(value)), 0.5).alias(f"m{i}") for i, f in enumerate(folds)))
    pairs = F.array(*(F.struct(F.lit(f).alias(group), F.col(f"m{i}").alias("others_median")) for i, f in enumerate(folds)))
    return row.select(F.explode(pairs).alias("x")).select(f"x.{group}", "x.others_median")
