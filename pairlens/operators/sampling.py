"""Inputs that tell two readings of a rule apart, found by seeded rejection.

Random numbers are functions of a key and a counter, not of a generator's state: any task computes any of them, in any order, and again after it was lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .constraints import require


def drawn(key: Column, place, low: Column, high: Column) -> Column:
    """a whole number from low to high, both included, by the MD5 of key and place; the bias is below (high - low) / 2**32."""
    digest = F.md5(F.concat_ws("-", key, place.cast("string") if isinstance(place, Column) else F.lit(str(place))))
    return low + F.pmod(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long"), high - low + 1)


def drawn_list(key: Column, size: Column, low: Column, high: Column) -> Column:
    """that many numbers, each of its own place."""
    return F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: drawn(key, i, low, high))


def picked(key: Column, values: Column) -> Column:
    """one of an array's values."""
    return F.get(values, drawn(key, "pick", F.lit(0).cast("long"), F.size(values).cast("long") - 1).cast("int"))


def distinguishing(
    families: DataFrame, family: str, variants: int, inputs: Callable[[Column, Column], Column], readings: tuple[Callable[[Column], Column], Callable[[Column], Column]], cases: int, common: int, attempts: int = 64, most: int = 65536,
) -> DataFrame:
    """Family, variant, kind ('case' or 'common'), place (from 1), input, a, b: for each variant of each family ``cases`` inputs for which the two readings differ, and up to
    ``common`` ones for which they agree; no input twice in a family.

    ``inputs`` makes an input of a key (of family, variant and attempt) and the variant; ``readings`` are the two outcomes of an input. Attempts count in their order, and variants
    in theirs: an input is free for a variant if no earlier one has taken it, though one may have met it after it had enough. Attempts grow fourfold, for the
    families that still lack some, up to ``most``; then a family without its cases raises, and fewer common inputs are let be. Families are independent, so a
    round is a plan over all of them; a variant's round reads what earlier ones took.
    """
    done, left, n = None, stored(families.select(family).distinct(), "families"), attempts
    while True:
        last = n >= most
        taken = _rounds(left, family, variants, inputs, readings, cases, common, n)
        counts = taken.groupBy(family).agg(F.count_if(F.col("kind") == "case").alias("_cases"), F.count("*").alias("_all"))
        full = stored(left.join(counts, family, "left").select(family, (F.coalesce("_cases", F.lit(0)) >= cases * variants).alias("_enough"), (F.coalesce("_all", F.lit(0)) >= (cases + common) * variants).alias("_full")), "full")
        if last:
            require(full.where("NOT _enough").select(family), "families without enough cases")
        ready = taken if last else taken.join(full.where("_full"), family, "left_semi")
        done = ready if done is None else done.unionByName(ready)
        left = full.where("NOT _full").select(family)
        if last or not left.take(1):
            return done
        n *= 4


def _rounds(families: DataFrame, family: str, variants: int, inputs: Callable, readings: tuple, cases: int, common: int, attempts: int) -> DataFrame:
    used = None
    for v in range(variants):
        key = F.concat_ws("-", F.col(family).cast("string"), F.lit(str(v)), F.col("attempt").cast("string"))
        rows = families.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("input", inputs(key, F.lit(v)))
        rows = rows.groupBy(family, "input").agg(F.min("attempt").alias("attempt"))
        if used is not None:
            rows = rows.join(used.select(family, "input"), [family, "input"], "left_anti")
        rows = rows.withColumns({"a": readings[0](F.col("input")), "b": readings[1](F.col("input"))})
        rows = rows.withColumn("kind", F.when(F.col("a").eqNullSafe(F.col("b")), "common").otherwise("case"))
        place = F.row_number().over(Window.partitionBy(family, "kind").orderBy("attempt"))  # of the attempts of one variant
        rows = rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == "case", cases).otherwise(common))
        rows = stored(rows.select(family, F.lit(v).alias("variant"), "kind", "place", "input", "a", "b"), f"variant{v}")
        used = rows if used is None else used.unionByName(rows)
    return used
