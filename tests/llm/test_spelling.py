import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairlens.llm import spelling


def plain_words(rows):
    import re

    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        found = sorted((-counts[v], v) for v in counts if v != w and near(w, v))
        form = found[0][1] if found and -found[0][0] >= 5 * n else None
        out[w] = [w, form, w, n, len(found), counts[form] if form else None]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def many(seed, alphabet, lengths, size):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))): rng.choice([5, 6, 25, 30, 150, 900]) for _ in range(size)}


@pytest.mark.parametrize("alphabet, lengths, most, chunk", [("ab", [6, 7, 8], 20_000, 20_000), ("ab", [6, 7, 8, 9], 12, 20), ("abÿ", [6, 7], 30, 10)])
def test_pairs_as_brute_force(spark, monkeypatch, alphabet, lengths, most, chunk):
    """Small bounds: groups are halved again and again, and automata hold few of them."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    counts = many(1, alphabet, lengths, 400)
    counted = table(spark, counts).repartition(3)
    found = spelling.pairs(counted, most=most)
    got = sorted((r["word"], r["near"], r["near_n"]) for r in found.collect())
    assert got == sorted((v, w, counts[w]) for v in counts for w in counts if v != w and near(v, w))
    assert sorted(map(tuple, spelling.forms(counted, found).collect())) == plain(counts)


def test_words_that_share_an_end(spark):
    """One half for all words, in either direction, and long words of one letter."""
    counts = {f"begin{x}{y}{z}": 5 + i for i, (x, y, z) in enumerate((x, y, z) for x in "abcdefg" for y in "abcdefg" for z in "abcd")}
    counts |= {w[::-1]: n for w, n in counts.items()} | {"a" * n: 1000 - n for n in range(6, 40)} | {"x" * 400: 7, "x" * 399 + "y": 70, "y" + "x" * 400: 5}
    got = sorted((r["word"], r["near"]) for r in spelling.pairs(table(spark, counts), most=20).collect())
    assert got == sorted((v, w) for v in counts for w in counts if v != w and abs(len(v) - len(w)) < 2 and near(v, w))


def test_automaton_numbers_words_in_order_and_is_minimal():
    words = sorted(many(2, "abc", [1, 2, 5, 6], 300))
    a = spelling.Automaton(words)
    for i, w in enumerate(words):
        state, number = a.walk(a.root, 0, w, 0)
        assert a.final[state] and number == i
    right: dict = {}

    def language(s):
        return (a.final[s], *((c, language(t)) for c, t in a.edges[s].items()))

    for s in range(len(a.edges)):
        assert right.setdefault(language(s), s) == s


def test_edges_as_brute_force(spark):
    rows = [(3, "Hello-hello HELLO's wörter WÖRTER wÖrter Straße×÷x"), (3, "Hello-hello HELLO's wörter WÖRTER wÖrter Straße×÷x"), (None, "nobody's wörter here"), (4, None), (5, "")]
    rows += [(i, "letters letterz lettres " * (i % 4) + "ÀÿÀÿÀÿÀ " + "z" * 50_000) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("clash"), "group": F.lit(2.0)})
    assert sorted(map(tuple, spelling.variants(docs.repartition(3)).collect())) == plain(plain_words(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short words only")], [(i, "lonely") for i in range(9)]])
def test_few_words(spark, rows):
    assert sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == plain(plain_words(rows))


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(entry.oracle_sql()["op12_spelling"]).fetchall()
    got = [tuple(r) for r in entry.queries()["op12_spelling"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and len(got) > 500
