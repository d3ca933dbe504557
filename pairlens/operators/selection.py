"""Ordering, top-k, diversity, subset search, set operations."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .constraints import duplicate_keys, require


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df dealt out by ranges of an order, sorted within them, with each row's range and its _id within it (rising, with gaps), as a written table.

    It is written once because ranges are cut at sampled values: planned twice in one query, the same rows may be dealt out in two ways.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ranges")


def _offsets(ranged: DataFrame, value: Column) -> DataFrame:
    """_range, _first (its least _id), _before (the sum of a value over the ranges before it): a row for each range."""
    totals = ranged.groupBy("_range").agg(value.alias("_sum"), F.min("_id").alias("_first"))
    before = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(totals.select("_range", "_first", F.coalesce(before, F.lit(0)).alias("_before")))


def placed(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Each row's place (from 0) in a global order, without one task that sees all rows.

    Rows are dealt out by ranges of the order and numbered within their range; ranges before it are counted in a small table.
    """
    ranged = _ranged(df, *order)
    return ranged.join(_offsets(ranged, F.count("*")), "_range").withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_range", "_id", "_first", "_before")


def running_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of a value over all rows before each in a global order; ``order`` is unique in df.

    Sums run within ranges of the order; what lies before a range is added from a table with a row for each range.
    """
    ranged = _ranged(df, order)
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("_inside", inside).join(_offsets(ranged, F.sum(value)), "_range").withColumn(name, F.col("_before") + F.col("_inside"))
    return out.drop("_range", "_id", "_first", "_inside", "_before")


def filled_down(df: DataFrame, order: str, column: str) -> DataFrame:
    """df with each null of a column replaced by the last value before it in a global order, if there is any; ``order`` is unique in df.

    Values are carried within ranges of the order, and from range to range in a table with a row for each range.
    """
    ranged = _ranged(df, order)
    last = F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_id")))
    carried = ranged.groupBy("_range").agg(last.alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(carried.select("_range", before.alias("_carried")))
    inside = F.last(column, ignorenulls=True).over(Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inside", inside).join(offsets, "_range").withColumn(column, F.coalesce("_inside", "_carried")).drop("_range", "_id", "_inside", "_carried")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by the order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hash_order(seed: str | int, text: Column) -> Column:
    """A key whose order is a seeded permutation."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), text))


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order."""
    return top_k(df, keys, [F.col(c) for c in order], 1, "_n").drop("_n")


def round_robin(df: DataFrame, group: list[str], part: str, within: list[Column]) -> DataFrame:
    """Rows of each group in turn from its parts; place from 1."""
    turn = F.row_number().over(Window.partitionBy(*group, part).orderBy(*within))
    rows = df.withColumn("_turn", turn)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("_turn", part))).drop("_turn")


def union_unique(parts: list[DataFrame], keys: list[str], allow_duplicates: bool = False) -> DataFrame:
    """All rows of all parts; a key that stands twice raises unless that is allowed, and then all its rows stay."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if not allow_duplicates:
        require(duplicate_keys(out, keys), "keys stand more than once")
    return out


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often than the other, with a column side; empty if they are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def filled_to(first: Column, more: Column, k: int) -> Column:
    """The first k distinct values of an array, then of another."""
    return F.slice(F.array_distinct(F.concat(first, more)), 1, k)


def visible_hidden(tests: Column, visible: int) -> tuple[Column, Column]:
    """The first tests, and the rest; all of them if there is no rest."""
    rest = F.slice(tests, F.lit(visible + 1), F.size(tests))
    return F.slice(tests, 1, visible), F.when(F.size(rest) == 0, tests).otherwise(rest)


def _upper_median_total(sizes: list[int], k: int) -> int:
    """The upper median of the totals of all subsets of k sizes, from how many subsets have each total: none is built."""
    counts = [Counter() for _ in range(k + 1)]
    counts[0][0] = 1
    for size in sizes:
        for j in range(k, 0, -1):
            for total, n in counts[j - 1].items():
                counts[j][total + size] += n
    place = comb(len(sizes), k) // 2
    for total in sorted(counts[k]):
        place -= counts[k][total]
        if place < 0:
            return total
    raise ValueError("fewer sizes than a subset needs")


def best_subset(df: DataFrame, group: list[str], item: str, size: str, covered: str, k: int = 3, highest: bool = True) -> DataFrame:
    """In each group the k items that together cover most (or least), among those of about the middle total size.

    A group's items are few (at most some dozens) and one task's; its subsets are gone through one after the other, the best one so far kept.
    Only subsets whose total size is within max(1, 15 %) of the upper median total are looked at; ties go to the first items by order. A null
    set covers nothing; a group of fewer items has no row.
    """
    rows = df.select(*group, F.col(item).alias("i"), F.col(size).cast("long").alias("s"), F.array_sort(F.coalesce(covered, F.array().cast(df.schema[covered].dataType))).alias("c"))
    schema = T.StructType([*(df.schema[g] for g in group), T.StructField("chosen", T.ArrayType(df.schema[item].dataType)), T.StructField("n_covered", T.IntegerType()), T.StructField("total_size", T.LongType())])

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = sorted(zip(own["i"], map(int, own["s"]), map(tuple, own["c"])))
        if len(own) < k:
            return pd.DataFrame(columns=schema.names)
        bits: dict = {}
        sets = [sum(1 << bits.setdefault(x, len(bits)) for x in set(c)) for _, _, c in own]
        sizes = [s for _, s, _ in own]
        middle = _upper_median_total(sizes, k)
        reach, best = max(1.0, 0.15 * middle), None
        for at in combinations(range(len(own)), k):
            total = sum(sizes[i] for i in at)
            if abs(total - middle) <= reach:
                union = 0
                for i in at:
                    union |= sets[i]
                n = union.bit_count()
                if best is None or (n > best[0] if highest else n < best[0]):
                    best = n, at, total
        return pd.DataFrame([(*key, [own[i][0] for i in best[1]], best[0], best[2])], columns=schema.names)

    return rows.groupBy(*group).applyInPandas(run, schema)
