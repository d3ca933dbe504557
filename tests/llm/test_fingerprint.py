import base64
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairlens.llm import fingerprint as fp

M = 1 << 64


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def word_hash(piece):
    return mix((sum((c + 1) * pow(fp.BASE, i, M) for i, c in enumerate(piece)) + len(piece)) % M)


def plain(text):
    """The fingerprint, a paragraph, a word and a lane at a time, with Python's integers."""
    exact, lanes = [0] * fp.EXACT, [0] * fp.LANES
    for paragraph in (text or "").encode().split(b"\n"):
        if not paragraph:
            continue
        digest = hashlib.blake2b(paragraph, digest_size=8 * fp.EXACT).digest()
        exact = [(x + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) % M for i, x in enumerate(exact)]
        before = int(fp.START)
        for word in paragraph.split():
            for i in range(0, len(word), fp.PIECE):
                own = word_hash(word[i : i + fp.PIECE])
                pair = mix((before * fp.BASE + own) % M)
                lanes[(pair >> 56) % fp.LANES] += 2 * (pair & 1) - 1
                before = own
    return b"".join(x.to_bytes(8, "little") for x in exact) + b"".join((x % 65536).to_bytes(2, "little") for x in lanes)


def like(a, b):
    if a == b:
        return 1.0
    x, y = ([int.from_bytes(v[i : i + 2], "little", signed=True) for i in range(fp.EXACT * 8, fp.WIDTH, 2)] for v in (a, b))
    norm = math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / norm)) if norm else 0.0


def expected(rows):
    """doc_id, text -> the row of edited(), over all rows with an id in one list."""
    known = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (-r[0], r[1].encode()))
    out = []
    for (i, text), (_, follow) in zip(known, known[1:] + known[:1]):
        half = len(text) // 2
        new = text[: len(text) - half] + follow[:half]
        own, after = plain(text), plain(new)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), base64.b64encode(own).decode(), base64.b64encode(after).decode(), like(own, after), like(own, plain(follow))))
    for i, text in rows:
        if i is None:
            new = (text or "")[: len(text or "") - len(text or "") // 2]
            own, after = plain(text), plain(new)
            out.append((None, len(text or ""), hashlib.sha256(new.encode()).hexdigest(), base64.b64encode(own).decode(), base64.b64encode(after).decode(), like(own, after), None))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r[:5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_edges_as_brute_force(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab cé\n中😀 the\t") for _ in range(n))
    rows = [(i * 3 - 40, some(rng.choice([0, 1, 2, 3, 30, 400]))) for i in range(60)]
    rows += [(None, "lost one"), (None, None), (500, None), (501, "twice"), (501, "twice"), (501, "else"), (2**62, "word " * 3000 + "\n" + "x" * 100_000), (2**62 + 1, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"range": F.lit("clash"), "guest": F.lit(1), "fingerprint": F.lit(2.5), "_p": F.lit(1)})
    same(fp.edited(docs.repartition(3)).collect(), expected(rows))


@pytest.mark.parametrize("rows", [[], [(7, "alone\nagain")], [(None, None)], [(1, ""), (1, None)]])
def test_few_rows(spark, rows):
    same(fp.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect(), expected(rows))


def test_whole_table_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(entry.queries()["op11_fingerprints"](spark, "/root/testdata/sf0.001").collect(), expected(rows))


def test_order_does_not_matter_and_halves_are_alike(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(12)) for _ in range(30)]
    shuffled = ["\n".join(rng.sample(t.split("\n"), 12)) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + shuffled)], "doc_id long, text string")
    found = dict(map(tuple, fp.fingerprints(docs).collect()))
    assert all(found[i] == found[i + 30] for i in range(30)) and len(set(found.values())) == 30
    rows = fp.edited(docs.where("doc_id < 30")).collect()
    assert all(0.3 < r["near_edited"] < 0.7 and r["near_next"] < 0.25 for r in rows)


def test_paragraphs_come_and_go(spark):
    rng = random.Random(3)
    held = {i: [f"line {rng.randrange(50)} of {i}" for _ in range(20)] for i in range(6)}
    stored = fp.fingerprints(spark.createDataFrame([(i, "\n".join(p)) for i, p in held.items()], "doc_id long, text string"))
    changes = []
    for i, lines in held.items():
        for _ in range(5):
            changes.append((i, lines.pop(rng.randrange(len(lines))), -1))
        lines.append("new")
        changes += [(i, "new\n", 1), (i, None, 1)]
    held[9] = ["from nothing"] * 300
    changes += [(9, "from nothing", 1)] * 300
    rng.shuffle(changes)
    got = dict(map(tuple, fp.changed(stored, spark.createDataFrame(changes, "doc_id long, text string, sign int").repartition(3)).collect()))
    assert {i: bytes(x) for i, x in got.items()} == {i: plain("\n".join(lines)) for i, lines in held.items()}
