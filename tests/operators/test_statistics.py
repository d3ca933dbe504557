from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import statistics as st
from pairlens.operators.constraints import ConstraintError

SCHEMA = "task string, repeat int, condition string, passed boolean, family string"


def rows(tasks=10, repeats=3, families=10):
    out = []
    for t in range(tasks):
        for r in range(repeats):
            out += [(f"t{t}", r, "a", False, f"f{t % families}"), (f"t{t}", r, "b", t == 0, f"f{t % families}")]
    return out


def one(df):
    return df.collect()[0]


def test_paired_effect_and_row_order(spark):
    found = st.paired_effect(spark.createDataFrame(rows(), SCHEMA), "a", "b", "passed", draws=200)
    first = one(found["summary"])
    assert (first.num_tasks, first.num_clusters, first.repeats_per_task) == (10, 10, 3) and abs(first.paired_difference - 0.1) < 1e-12
    again = one(st.paired_effect(spark.createDataFrame(rows()[::-1], SCHEMA).repartition(3), "a", "b", "passed", draws=200)["summary"])
    assert first == again and first.ci_low <= 0.1 <= first.ci_high
    per = found["per_repeat"].collect()
    assert len(per) == 3 and all(r.gains == 1 and r.losses == 0 and r.exact_mcnemar_p == 1.0 for r in per)


def test_families_have_no_exact_test(spark):
    found = st.paired_effect(spark.createDataFrame(rows(12, families=2), SCHEMA), "a", "b", "passed", cluster="family", draws=50)
    assert one(found["summary"]).num_clusters == 2 and all(r.exact_mcnemar_p is None for r in found["per_repeat"].collect())


def test_numpy_draws(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a = one(st.paired_effect(df, "a", "b", "passed", draws=100, seed=0, rng="numpy")["summary"])
    b = one(st.paired_effect(df.repartition(4), "a", "b", "passed", draws=100, seed=0, rng="numpy")["summary"])
    assert a == b and a.valid_draws == 100


@pytest.mark.parametrize("size", [2, 7, 1000, 1 << 20, 3_000_000_000])
def test_numpy_numbers_are_numpys(size, monkeypatch):
    monkeypatch.setattr(st, "WORDS", 1 << 10)
    got = np.concatenate([st.numpy_numbers(3, size, c) for c in range(9)])
    assert len(got) <= 9 << 10 and np.array_equal(got, np.random.default_rng(3).integers(0, size, len(got)))


@pytest.mark.parametrize("size", [0, 1, 2, 11])
def test_numpy_draws_by_chunks(spark, size, monkeypatch):
    """A stream of several chunks gives each cluster as often to each draw as NumPy does."""
    monkeypatch.setattr(st, "WORDS", 1 << 8)
    df = spark.createDataFrame([(f"c{i:02}",) for i in range(size)], "c string")
    got = Counter((r.draw, r.c) for r in st.numpy_draws(df, "c", 100, 5).collect())
    picks = np.random.default_rng(5).integers(0, size, (100, size)) if size else []
    assert got == Counter((d, f"c{i:02}") for d, row in enumerate(picks) for i in row)


@pytest.mark.parametrize("change", ["unpaired", "duplicate", "uneven"])
def test_bad_pairs_raise(spark, change):
    data = rows()
    data = {"unpaired": data[:-1], "duplicate": data + data[:1], "uneven": data[:-2]}[change]
    with pytest.raises(ConstraintError):
        st.paired_effect(spark.createDataFrame(data, SCHEMA), "a", "b", "passed", draws=5)


def test_exact_p(spark):
    df = spark.createDataFrame([(42, 14), (44, 16), (6, 3), (1, 5), (0, 0), (5, 5), (3000, 2900)], "g long, l long")
    p = [r[0] for r in df.select(st.mcnemar(F.col("g"), F.col("l"))).collect()]
    assert p[:6] == [0.0002344459, 0.0003940432, 0.5078125, 0.21875, 1.0, 1.0] and 0.19 < p[6] < 0.2


def test_no_variance_is_null(spark):
    df = spark.createDataFrame([("f", 1.0, 2.0), ("f", 1.0, 3.0)], "f string, x double, y double")
    assert one(st.spearman(df, [], "x", "y")).rho is None and one(st.spearman_within(df, [], "f", "x", "y")).rho is None
    empty = st.linear_interval(spark.createDataFrame([(0, float("nan"))], "draw int, value double"))
    assert one(empty).valid_draws == 0 and one(empty).ci_low is None


def test_contrasts():
    assert len(st.contrasts_of("semantic")) == 6 and st.contrasts_of("unrelated") == []


def test_kinds_of_experiments(spark):
    """Which contrasts an experiment has follows from its conditions; pairs of rules are measured by the rule that the tests show."""
    assert [st.kind_of(c) for c in ({"nl_only", "tests_a", "tests_b"}, {"unrelated_tests"}, {"nl_only", "nl_tests"}, {"quality_high"})] == ["semantic", "unrelated", "main", "quality"]
    rows = [(t, 0, c, (t + i) % 2 == 0, (t + i) % 3 == 0) for t in range(6) for i, c in enumerate(("nl_only", "inputs_only", "explicit_a", "explicit_b", "tests_a", "tests_b"))]
    df = spark.createDataFrame(rows, "task int, repeat int, condition string, rule_a boolean, rule_b boolean")
    got = {(r["base"], r["target"]): (r["measure"], round(r["paired_difference"], 9)) for r in st.report(df, draws=10).collect()}
    value = {(t, c): (a, b) for t, _, c, a, b in rows}
    want = {}
    for side, at in (("a", 0), ("b", 1)):
        for base in ("nl_only", "inputs_only", f"explicit_{side}"):
            want[base, f"tests_{side}"] = f"rule_{side}", round(sum(value[t, f"tests_{side}"][at] - value[t, base][at] for t in range(6)) / 6, 9)
    assert got == want
    assert st.report(df.where("condition = 'tests_a'").withColumn("condition", F.lit("unrelated_tests"))) is None


def test_effects_compute_their_rows_once(spark):
    """Three pairs of conditions read their rows many times, which may be an aggregation of a large table."""
    from pairlens.operators import statistics as st

    rows = [(t, 0, c, t % 3, (t * 7 + ord(c)) % 5 < 2) for t in range(30) for c in "abc"]
    df = spark.createDataFrame(rows, "task int, repeat int, condition string, cluster int, passed boolean")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    found = st.effects(df.mapInPandas(seen, df.schema), [("a", "b"), ("a", "c"), ("b", "c")], "passed", cluster="cluster", draws=20).collect()
    assert len(found) == 3 and read.value == len(rows)
