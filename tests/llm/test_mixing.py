import math
import re
import struct
from collections import Counter

import numpy as np
import xxhash

from pairlens.llm import mixing

DIR = "/root/testdata/sf0.01"


def test_targets_are_met(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == docs.count()
    whole = sum(r.n_tokens for r in got)
    for x, share in mixing.TARGETS.items():
        total = sum(r.n_tokens * r[f"p_{x}"] * r.rate for r in got)
        assert abs(total - share * whole) < 1e-3 * whole, (x, total / whole)
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-6 for r in got)
    known = {r.doc_id: r for r in labels.collect()}
    kind = lambda r: "toxic" if r.toxic else "clean" if r.quality else "junk"
    right = [max(mixing.DOMAINS, key=lambda x: r[f"p_{x}"]) == kind(known[r.doc_id]) for r in got if r.doc_id in known]
    print("right", sum(right) / len(right), [(x, sum(r.n_tokens * r[f"p_{x}"] for r in got) / whole) for x in mixing.DOMAINS])
    assert sum(right) / len(right) > 0.9


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def nearest_rates(p, t, wanted):
    """Nonnegative rates nearest to 1 with these totals, by plain steps of the lazy projected gradient, until nothing changes."""
    total, metric = np.zeros(p.shape[1]), (p * t[:, None]).T @ p
    for _ in range(200_000):
        gap = (t * np.maximum(0, 1 - p @ total)) @ p - wanted
        if np.abs(gap).max() < 1e-7 * t.sum():
            break
        total = total + np.linalg.solve(metric, gap)
    return np.maximum(0, 1 - p @ total)


def plain_mix(docs, labels, targets):
    """From texts and labels to posteriors and rates, with numpy, regular expressions and dictionaries; all labels are in the sample."""
    grams = {i: re.findall(r"[A-Za-z\x80-\U0010FFFF]+|[0-9]+|[!-/:-@\[-`{-~]+", t or "") for i, t in docs}
    place = lambda g: signed(xxhash.xxh64(g.encode(), seed=42).intdigest()) % mixing.PLACES
    places = {i: [place(g) for g in own] for i, own in grams.items()}
    half = lambda i: (signed(xxhash.xxh64(b"half", seed=xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest()) >> 7) % 2
    kind = {i: "toxic" if toxic == 1 else "junk" if quality == 0 else "clean" for i, quality, toxic in labels}
    first = [i for i in kind if half(i) == 0]
    count, size = Counter((kind[i], p) for i in first for p in set(places[i])), Counter(kind[i] for i in first)

    def odds(x, p):
        rest = [y for y in mixing.DOMAINS if y != x]
        if not any(count[y, p] for y in mixing.DOMAINS):
            return 0.0
        share = (count[x, p] + mixing.SMOOTH * size[x] / len(first)) / (size[x] + mixing.SMOOTH)
        return max(0.0, math.log(share / ((sum(count[y, p] for y in rest) + mixing.SMOOTH) / (sum(size[y] for y in rest) + mixing.SMOOTH))) - mixing.PLAIN)

    def trait(i):
        own, n = [sum(odds(x, p) for p in places[i]) for x in mixing.DOMAINS[1:]], len(places[i])
        return [1.0, *map(math.log1p, own), sum(own) / (n + mixing.SHRINK), math.log1p(n) / 8]

    x = np.array([trait(i) for i, _ in docs])
    at = {i: n for n, (i, _) in enumerate(docs)}
    second = [i for i in kind if half(i) == 1]
    own, y = x[[at[i] for i in second]], np.array([[kind[i] == d for d in mixing.DOMAINS[1:]] for i in second], float)
    w = np.zeros((x.shape[1], 2))
    posterior = lambda x, w: (lambda e: e / e.sum(axis=1, keepdims=True))(np.exp(np.clip(np.concatenate([np.zeros((len(x), 1)), x @ w], axis=1), -30, 30)))
    for _ in range(40):  # Newton's method to the optimum
        p = posterior(own, w)[:, 1:]
        slope = own.T @ (p - y) / len(own) + mixing.RIDGE * w
        curve = np.zeros((2, x.shape[1], 2, x.shape[1]))
        for c in range(2):
            for d in range(2):
                curve[c, :, d, :] = (own * (p[:, c] * ((c == d) - p[:, d]))[:, None]).T @ own / len(own)
        curve = curve.reshape(2 * x.shape[1], -1) + mixing.RIDGE * np.eye(2 * x.shape[1])
        step = np.linalg.solve(curve, slope.T.reshape(-1))
        w -= (step / max(1, np.abs(step).max() / 20)).reshape(2, -1).T
    p = posterior(x, w)
    t = np.array([len((text or "").split()) for _, text in docs], float)
    wanted = t.sum() * np.array([targets[d] for d in mixing.DOMAINS])
    return p, nearest_rates(p, t, wanted)


def test_same_as_numpy_from_texts_to_rates(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    p, rate = plain_mix(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()], mixing.TARGETS)
    got = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    assert len(got) == len(rows)
    for (i, _), own, r in zip(rows, p, rate):
        assert all(abs(got[i][f"p_{d}"] - v) < 2e-3 for d, v in zip(mixing.DOMAINS, own)), (i, own, got[i])
        assert abs(got[i].rate - r) < 1e-2, (i, r, got[i])
    assert len({round(r.rate, 6) for r in got.values()}) > len(rows) / 2  # a rate for each document, not for groups of them


def test_rates_are_the_least_squares(spark):
    """Documents of given posteriors, some of which must be left out altogether: totals and optimality of the rates."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400).round(9)
    t = rng.integers(0, 500, 400)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p)], f"{mixing.TOKENS} long, _mix_p0 double, _mix_p1 double, _mix_p2 double")
    for targets in ({"clean": 0.98, "junk": 0.01, "toxic": 0.01}, {"clean": 0.5, "junk": 0.3, "toxic": 0.2}):
        total = mixing.fit_rates(df, targets)
        rate = np.array([r[0] for r in df.select(mixing.rate_after(total)).collect()])
        wanted = t.sum() * np.array([targets[d] for d in mixing.DOMAINS])
        assert np.abs((t * rate) @ p - wanted).max() < 1e-4 * t.sum()
        assert np.abs(rate - nearest_rates(p, t, wanted)).max() < 1e-2
    assert (rate > 0).any()
    # no rates reach this: no document is so clean
    rest = df.where("_mix_p0 < 0.8")
    total = mixing.fit_rates(rest, {"clean": 0.99, "junk": 0.005, "toxic": 0.005})
    assert all(r[0] >= 0 for r in rest.select(mixing.rate_after(total)).collect())


def test_long_texts_ties_and_clashing_names(spark):
    long = "plain words " * 200_000
    docs = spark.createDataFrame([(1, long, 1, 2), (2, "bad !!!", 3, 4), (2, "bad !!!", 3, 4), (3, "plain words", 5, 6)], "doc_id long, text string, _mix_rate int, copies int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert sorted(r.n_tokens for r in got) == [2, 2, 2, 400_000] and len({r.rate for r in got if r.doc_id == 2}) == 1
    rows = mixing.mixed_rows(docs, labels)
    assert rows.columns == docs.columns and {(r._mix_rate, r.copies) for r in rows.collect()} <= {(1, 2), (3, 4), (5, 6)}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 6), (3, "", 7)], "doc_id long, text string, _mix_id int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 4 and [r.n_tokens for r in got if r.doc_id == 3] == [0]
    assert mixing.mix(docs.limit(0), labels.limit(0)).collect() == []
    rows = mixing.mixed_rows(docs, labels)
    assert rows.columns == docs.columns and rows.count() >= 1
    assert all(r.rate == 1 for r in mixing.mix(docs, labels.limit(0)).collect())
