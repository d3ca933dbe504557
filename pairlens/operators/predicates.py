"""Filters, coalescing measures and case classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import placed


def optional_filters(df: DataFrame, equal: dict[str, object] | None = None, equal_any_case: dict[str, str] | None = None, start: dict[str, str] | None = None, end: dict[str, str] | None = None) -> DataFrame:
    """A conjunction of those filters that are set; bounds are inclusive and compare ISO dates as text."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    for c, v in (equal_any_case or {}).items():
        if v is not None:
            df = df.where(F.lower(c) == v.lower())
    for c, v in (start or {}).items():
        if v is not None:
            df = df.where(F.col(c) >= v)
    for c, v in (end or {}).items():
        if v is not None:
            df = df.where(F.col(c) <= v)
    return df


def measure(df: DataFrame, names: list[str]) -> Column:
    """P5: the first of the named measures that is there and not null; a row without any raises."""
    found = [F.col(n) for n in names if n in df.columns]
    if not found:
        raise ValueError(f"none of {names} is a column")
    return F.coalesce(*found, F.raise_error(F.lit("no measure")).cast("boolean"))


def remap(column: Column, names: dict[str, str]) -> Column:
    """P10: value by a map; others stay."""
    out = column
    for old, new in names.items():
        out = F.when(column == old, new).otherwise(out)
    return out


def two_rules(a: Column, b: Column) -> Column:
    """Both, A, B or neither."""
    return F.when(a & b, "both").when(a, "A").when(b, "B").otherwise("neither")


def flip_type(base: Column, target: Column) -> Column:
    """stable_pass, harm, rescue or stable_fail."""
    return F.when(base & target, "stable_pass").when(base, "harm").when(target, "rescue").otherwise("stable_fail")


def exclusive_outcome(target: Column, alternative: Column) -> Column:
    """Target, alternative or neither; both at once raise."""
    return F.when(target & alternative, F.raise_error(F.lit("both outcomes hold")).cast("string")).when(target, "target").when(alternative, "alternative").otherwise("neither")


def first_of(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first case that holds."""
    out = F.lit(otherwise)
    for holds, label in reversed(cases):
        out = F.when(holds, label).otherwise(out)
    return out


def by_direction(condition: Column, first_values: list[str], a: Column, b: Column) -> Column:
    """A where the condition is one of the values, else b."""
    return F.when(condition.isin(*first_values), a).otherwise(b)


def band(rate: Column) -> Column:
    """Never, variable or always."""
    return F.when(rate == 0, "never").when(rate == 1, "always").when((rate > 0) & (rate < 1), "variable")


def percent(rate: Column, digits: int = 1, signed: bool = False) -> Column:
    """A rate as text in percent; minus zero is zero."""
    value = F.bround(rate * 100, digits) + F.lit(0.0)
    value = F.when(value == 0, F.lit(0.0)).otherwise(value)
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", value)


def shard(df: DataFrame, order: list[str], shards: int, own: int) -> DataFrame:
    """Rows whose place in the order, modulo ``shards``, is ``own``.

    A place needs a global order; zip-with-index by ranges does that without bringing all rows to one task.
    """
    return numbered(df, order).where(F.pmod(F.col("_place"), F.lit(shards)) == own).drop("_place")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _place, each row's place (from 0) in the order: ranges are sorted on their own, then offset by a small table."""
    from ..operators.selection import placed

    return placed(df, order, "_place")


def page(df: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    """Rows start to start + count - 1 in the order."""
    return df.orderBy(*order).offset(start).limit(count)


def first_row_of(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Of each key the columns of its first row, empty strings as null."""
    clean = [F.when(F.col(c).cast("string") == "", None).otherwise(F.col(c)).alias(c) for c in columns]
    return df.groupBy(*key).agg(F.min_by(F.struct(*clean), F.col(order)).alias("_first")).select(*key, *(f"_first.{c}" for c in columns))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: of each key the last row by the order."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
