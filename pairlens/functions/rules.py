"""Pairs of readings of the same words (F52): each pair is two column expressions that differ where a specification is ambiguous."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_in_order(xs: Column) -> Column:
    return F.array_distinct(xs)


def distinct_sorted(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def only_unique(xs: Column) -> Column:
    """Values that stand once."""
    return F.filter(xs, lambda x: F.size(F.filter(xs, lambda y: y == x)) == 1)


def first_argmax(xs: Column) -> Column:
    return F.array_position(xs, F.array_max(xs)).cast("int") - 1


def last_argmax(xs: Column) -> Column:
    return F.size(xs) - F.array_position(F.reverse(xs), F.array_max(xs)).cast("int")


def at_least(xs: Column, t: Column) -> Column:
    return F.filter(xs, lambda x: x >= t)


def above(xs: Column, t: Column) -> Column:
    return F.filter(xs, lambda x: x > t)


def within_closed(xs: Column, low: Column, high: Column) -> Column:
    return F.filter(xs, lambda x: (x >= low) & (x <= high))


def within_half_open(xs: Column, low: Column, high: Column) -> Column:
    return F.filter(xs, lambda x: (x >= low) & (x < high))


def lower_median(xs: Column) -> Column:
    return F.get(F.array_sort(xs), F.floor((F.size(xs) - 1) / 2).cast("int"))


def upper_median(xs: Column) -> Column:
    return F.get(F.array_sort(xs), F.floor(F.size(xs) / 2).cast("int"))


def floor_quotient(a: Column, b: Column) -> Column:
    """Rounded down, of whole numbers of either sign."""
    whole = truncated_quotient(a, b)
    return whole - ((a % b != 0) & ((a < 0) != (b < 0))).cast("long")


def truncated_quotient(a: Column, b: Column) -> Column:
    """Rounded towards 0."""
    return F.call_function("div", a, b)


def floor_remainder(a: Column, b: Column) -> Column:
    """What floor_quotient() leaves, with the divisor's sign."""
    return (a % b + b) % b


def signed_remainder(a: Column, b: Column) -> Column:
    return a % b


def overlapping_count(s: Column, t: Column) -> Column:
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s))), lambda i: F.substr(s, i, F.length(t)) == t))


def separate_count(s: Column, t: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, t, F.lit("")))) / F.length(t)).cast("int")


def separate_count_any_case(s: Column, t: Column) -> Column:
    return separate_count(F.lower(s), F.lower(t))


def fields(s: Column) -> Column:
    return F.split(s, " ")


def full_fields(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda x: x != "")


def alphanumeric(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9A-Za-z]", "")


def alphabetic(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z]", "")


def chunks(xs: Column, n: int, partial: bool = True) -> Column:
    """Runs of n values; the last one may be shorter if ``partial``."""
    last = F.size(xs) - 1 if partial else F.size(xs) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(n)), lambda i: F.slice(xs, i + 1, n))).otherwise(F.slice(F.array(xs), 1, 0))


def run_lengths(xs: Column) -> Column:
    """(value, count) of each run of equal values."""
    starts = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (F.get(xs, i - 1) != x), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda i, k: F.struct(F.get(xs, i).alias("value"), (F.coalesce(F.get(starts, k + 1), F.size(xs)) - i).alias("count")))


def group_counts(xs: Column) -> Column:
    """(value, count) of each distinct value, in order of first sight."""
    return F.transform(F.array_distinct(xs), lambda v: F.struct(v.alias("value"), F.size(F.filter(xs, lambda y: y == v)).alias("count")))


def merged_intervals(xs: Column, touching: bool = True) -> Column:
    """Union of intervals (array of struct<start, end>); those that only touch are merged if ``touching``."""
    empty = F.slice(F.array_sort(xs), 1, 0)

    def one(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & ((x["start"] <= last["end"]) if touching else (x["start"] < last["end"]))
        grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.array_append(out, x))

    return F.aggregate(F.array_sort(xs), empty, one)


def index_of(xs: Column, x: Column, base: int = 0) -> Column:
    return F.array_position(xs, x).cast("int") - 1 + base


def top_values(xs: Column, k: int, ties: bool = False) -> Column:
    """The k largest, or all that are as large as the k-th."""
    down = F.reverse(F.array_sort(xs))
    return F.filter(down, lambda x: x >= F.get(down, F.least(F.lit(k), F.size(down)) - 1)) if ties else F.slice(down, 1, k)
