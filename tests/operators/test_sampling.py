"""Seeded rejection against a plain loop with the same numbers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairlens.operators import sampling
from pairlens.operators.constraints import ConstraintError


def number(key, place, low, high):
    return low + int(hashlib.md5(f"{key}-{place}".encode()).hexdigest()[:8], 16) % (high - low + 1)


def plain(families, variants, cases, common, most):
    """One family after the other, variant by variant, attempt by attempt."""
    out = []
    for family in families:
        used = set()
        for v in range(variants):
            found = {"case": 0, "common": 0}
            for n in range(most):
                x = (number(f"{family}-{v}-{n}", 1, 0, 4 + v), number(f"{family}-{v}-{n}", 2, 0, 4 + v))
                a, b = min(x), x[0]
                kind = "common" if a == b else "case"
                if x not in used and found[kind] < {"case": cases, "common": common}[kind]:
                    found[kind] += 1
                    used.add(x)
                    out.append((family, v, kind, found[kind], list(x), a, b))
                if found == {"case": cases, "common": common}:
                    break
    return sorted(out)


def go(spark, cases, common, attempts, most=4096):
    families = spark.createDataFrame([(f"f{i}",) for i in range(5)] + [("f1",)], "family string")
    inputs = lambda key, v: sampling.drawn_list(key, F.lit(2), F.lit(0).cast("long"), 4 + v.cast("long"))
    found = sampling.distinguishing(families, "family", 3, inputs, (F.array_min, lambda x: F.get(x, F.lit(0))), cases, common, attempts, most)
    return sorted((r["family"], r["variant"], r["kind"], r["place"], r["input"], r["a"], r["b"]) for r in found.collect())


def test_same_as_a_loop(spark):
    """With 10 + 15 inputs there are, of which variants take 3 + 4 each, attempts must grow; families that are full stay as they are."""
    assert go(spark, 3, 4, attempts=4) == plain([f"f{i}" for i in range(5)], 3, 3, 4, 4096)


def test_too_few(spark):
    """Common inputs may lack, cases may not."""
    got = go(spark, 2, 30, attempts=16, most=64)
    assert got == plain([f"f{i}" for i in range(5)], 3, 2, 30, 64) and len(got) < 5 * 3 * 32
    with pytest.raises(ConstraintError, match="enough cases"):
        go(spark, 20, 1, attempts=16, most=64)


def test_numbers_are_in_their_range_and_even(spark):
    key = F.col("id").cast("string")
    rows = spark.range(20_000).select(sampling.drawn(key, "x", F.lit(-2).cast("long"), F.lit(2).cast("long")).alias("n"), sampling.picked(key, F.array(F.lit("a"), F.lit("b"))).alias("v"))
    counts = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}
    assert set(counts) == {-2, -1, 0, 1, 2} and max(counts.values()) < 1.1 * min(counts.values())
    assert {r["v"] for r in rows.select("v").distinct().collect()} == {"a", "b"}
