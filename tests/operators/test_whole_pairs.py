"""All pairs of the benchmark and all documents of a (language, source); against brute force on small tables."""

import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from pairlens import session
from pairlens.functions import text as tx
from pairlens.operators import diversity
from pairlens.plans import selections, texts


def words(text):
    return set(re.findall(r"[A-Za-z_]+|-?\d+", text))


def distance(a, b):
    union = words(a) | words(b)
    return 1 - len(words(a) & words(b)) / len(union) if union else float(abs(len(a) - len(b)))


def table(n):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{'abcdefghij'[k]} {k}" for k in rng.integers(0, 10, rng.integers(1, 9)))) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, "!"), (n + 2, "?!"), (n + 3, "é 漢字 𝄞 x 1")]


def test_all_pairs(spark, monkeypatch):
    rows = table(16)
    monkeypatch.setattr(texts, "load", lambda *_: spark.createDataFrame(rows, "item_id long, text string"))
    got = {(r.left, r.right): r.distance for r in texts.jaccard_pairs(spark, "").collect()}
    assert got == {(i, j): round(distance(a, b), 9) for i, a in rows for j, b in rows if i < j}


def test_diverse_documents(spark, monkeypatch):
    rows = [(i, "en" if i % 3 else "de", f"src{i % 2}", t) for i, t in table(120)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    monkeypatch.setattr(selections, "load", lambda *_: df)
    got = selections.diverse_selection(spark, "").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    by_id = {r[0]: r[3] for r in rows}
    for group in {(r.lang, r.source) for r in got}:
        own = sorted((r for r in got if (r.lang, r.source) == group), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        left, taken = list(own), []
        while left:
            best = max(left, key=lambda r: (min((distance(by_id[r.doc_id], by_id[t.doc_id]) for t in taken), default=0), r.score, -r.seed))
            assert best.doc_id == own[len(taken)].doc_id
            left.remove(best)
            taken.append(best)


def test_seeds_of_long_texts(spark):
    rows = [(t,) for _, t in table(5)] + [("",), ("ab𝄞" * 40_000,)]
    for r in spark.createDataFrame(rows, "t string").select("t", tx.stable_seed(F.col("t")).alias("s")).collect():
        seed = 0
        for c in r.t:
            seed = (seed * 131 + ord(c)) % 2147483647
        assert r.s == seed


def test_diverse_order_in_rounds(spark, monkeypatch):
    """Groups far larger than what one task orders at once, and slices of few rows: the same order as by brute force; ties, copies and texts without tokens included."""
    monkeypatch.setattr(diversity, "SLICE", 16)
    rng = np.random.default_rng(5)
    texts_of = [" ".join(f"w{'abcdefghij'[k]}" for k in rng.integers(0, 10, rng.integers(0, 9))) for _ in range(90)] + ["!" * int(k) for k in rng.integers(0, 6, 20)] + ["wa wb"] * 9
    rows = [(i, None if i % 4 == 0 else "x", t, int(rng.integers(0, 3)), i * 5 % 119) for i, t in enumerate(texts_of)]
    df = spark.createDataFrame(rows, "id long, g string, text string, score int, tie int").repartition(3)
    for most in (16, 1000):
        got = {r.id: r.place for r in diversity.diverse_order(df, "g", "text", "score", "tie", ["id"], most).collect()}
        for g in (None, "x"):
            left, taken = [r for r in rows if r[1] == g], []
            near = {r[0]: float("inf") for r in left}
            while left:
                best = max(left, key=lambda r: (near[r[0]], r[3], -r[4]))
                taken.append(best[0])
                left.remove(best)
                near = {r[0]: min(near[r[0]], distance(r[2], best[2])) for r in left}
            assert [got[i] for i in taken] == list(range(1, len(taken) + 1))


def test_diverse_order_leaves_no_rounds(spark, monkeypatch, tmp_path):
    """A round's tables go at its end, and those of the sets at last: what lies on disk doesn't rise with the rounds. Settings are as they were."""
    monkeypatch.setattr(diversity, "SLICE", 16)
    rng = np.random.default_rng(6)
    rows = [(i, "x", " ".join(f"w{'abcdefghijklmnop'[k]}" for k in rng.integers(0, 16, 9)), 0, i) for i in range(48)]
    df = spark.createDataFrame(rows, "id long, g string, text string, score int, tie int").repartition(3)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, tables = spark.conf.get(key), spark.catalog.listTables()
    for most in (12, 1000):
        folder = tmp_path / str(most)
        for module in (session, diversity):
            monkeypatch.setattr(module, "scratch", lambda _, name: f"file://{folder}/{name}-{uuid.uuid4().hex}", raising=False)  # noqa: B023
        out = diversity.diverse_order(df, "g", "text", "score", "tie", ["id"], most)
        kept = {x.parent for x in folder.rglob("*.parquet")}
        assert {x.name.split("-")[0] for x in kept} == {"large", "places", "ranges"} and len(kept) <= 5
        assert not any("_set" in spark.read.parquet(str(x)).columns for x in kept)
        assert sorted(r.place for r in out.collect()) == list(range(1, 49))
    assert spark.conf.get(key) == before and spark.catalog.listTables() == tables
