"""Donors for every part; against brute force on a small table."""

import math

import numpy as np

from pairlens.plans import integrity


def test_every_part_gets_donors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    parts = [(i, f"t{i % 3}", int(rng.integers(1, 12)), f"n{rng.integers(4)}", float(rng.integers(900, 960))) for i in range(1, 91)]
    parts += [(100, "alone", 1, "n", 1.0), (101, "two", 1, "n", 1.0), (102, "two", 2, "n", 2.0)]
    df = spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int, p_name string, p_retailprice double")
    monkeypatch.setattr(integrity, "load", lambda *_: df)
    want = set()
    for k, mode, size, name, price in parts:
        pool = sorted((size != s, name != n, round(abs(math.log(price / p)), 9), d) for d, m, s, n, p in parts if m == mode and d != k)
        want |= {(k, x[-1], i + 1) for i, x in enumerate(pool[:2])}
    got = [tuple(r) for r in integrity.donor_matching(spark, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {g[0] for g in got} == {p[0] for p in parts} - {100}
