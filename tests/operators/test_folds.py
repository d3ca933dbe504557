"""Stratified folds of rows and of whole groups."""

import random
from collections import Counter

import pytest

from pairlens.operators import models


def table(spark, seed, groups, rows):
    rng = random.Random(seed)
    share = [rng.random() for _ in range(groups)]
    weight = [rng.choice([1, 1, 1, 5, 30]) for _ in range(groups)]
    picked = rng.choices(range(groups), weight, k=rows)
    return spark.createDataFrame([(i, f"g{g}", "yes" if rng.random() < share[g] else "no") for i, g in enumerate(picked)], "id long, family string, label string")


@pytest.mark.parametrize("large", [1000, 10, 0])
def test_groups_stay_whole_and_shares_are_alike(spark, large):
    df = table(spark, 3, 120, 6000)
    found = models.stratified_group_folds(df, "family", "label", 5, large=large).collect()
    fold = dict(map(tuple, found))
    assert len(found) == len(fold) == df.select("family").distinct().count() and set(fold.values()) == set(range(5))
    counts = Counter((fold[r["family"]], r["label"]) for r in df.collect())
    for label in ("yes", "no"):
        own = [counts[f, label] for f in range(5)]
        assert max(own) - min(own) < (80 if large == 1000 else 400) * 2, own
    if large == 1000:
        assert max(sum(counts[f, x] for x in ("yes", "no")) for f in range(5)) < 1.1 * 1200


def test_rows_of_a_label_differ_by_one(spark):
    df = table(spark, 4, 10, 1003)
    fold = dict(map(tuple, models.stratified_folds(df, "id", "label", 4).collect()))
    counts = Counter((fold[r["id"]], r["label"]) for r in df.collect())
    for label in ("yes", "no"):
        own = [counts[f, label] for f in range(4)]
        assert max(own) - min(own) <= 1


def test_number_of_folds_and_refusal(spark):
    df = table(spark, 5, 3, 60)
    got = models.cross_validation_folds(df, "id", "family", "label", 10)
    assert got.count() == 60 and got.select("fold").distinct().count() == 3
    assert models.cross_validation_folds(df, "id", "family", "label", 10, random=True).select("fold").distinct().count() == 3
    with pytest.raises(ValueError, match="two folds"):
        models.cross_validation_folds(df.where("family = 'g0'"), "id", "family", "label", 10)


@pytest.mark.parametrize("large", [0, 500])
def test_every_group_is_dealt_by_the_same_rule(spark, large):
    """More groups than 1,000, in links: as one chain over all of them."""
    import hashlib

    df = table(spark, 6, 1600, 20_000)
    own: dict = {}
    for r in df.collect():
        own.setdefault(r["family"], Counter())[r["label"]] += 1
    totals = sum(own.values(), Counter())
    order = sorted(own.items(), key=lambda x: (-sum(x[1].values()), hashlib.md5(f"0-{x[0]}".encode()).hexdigest(), x[0]))
    held, want = [Counter() for _ in range(4)], {}
    for name, counts in order:
        cost = lambda j: sum(n * held[j][c] * (totals["yes"] * totals["no"] // totals[c]) ** 2 for c, n in counts.items())  # noqa: B023, E731
        want[name] = min(range(4), key=lambda j: (cost(j), sum(held[j].values()), j))
        held[want[name]] += counts
    assert len(want) > 1000 and dict(map(tuple, models.stratified_group_folds(df, "family", "label", 4, large=large).collect())) == want
