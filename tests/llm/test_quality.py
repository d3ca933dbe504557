import numpy as np
import pyarrow as pa

from pairlens.llm import quality

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = quality.judged(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    right = np.mean([r.predicted == r.quality for r in got])
    print("auc", auc, "accuracy", right, len(got))
    assert auc > 0.95 and right > 0.93


def test_hashes_depend_on_the_row_alone():
    texts = ["a b c", "", None, "!!", "hello, world 12", "é é", "x" * 500, "a b c"]
    places, ends = quality.hashed(pa.array(texts))
    for i, x in enumerate(texts):
        own, _ = quality.hashed(pa.array([x], pa.string()))
        assert own.tolist() == places[ends[i] : ends[i + 1]].tolist()
    assert np.diff(ends).tolist() == [5, 0, 0, 1, 7, 3, 1, 5]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, score int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.judged(docs.limit(0), labels.limit(0)).collect() == []


M = 2**64
CLASS = {**{x: 0 for x in b"\t\n\x0b\x0c\r "}, **{x: 1 for x in [*range(65, 91), *range(97, 123), *range(128, 256)]}, **{x: 2 for x in range(48, 58)}}


def spread(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) % M
    return x ^ x >> 31


def plain_vector(text):
    """Shares of hashed words and word pairs, with Python integers."""
    words, last = [], None
    for byte in (text or "").encode():
        kind = CLASS.get(byte, 3)
        if kind and kind == last:
            words[-1].append(byte)
        elif kind:
            words.append([byte])
        last = kind
    assert all(len(w) <= 64 for w in words)
    hashes = [spread((sum((x + 1) * pow(0x9E3779B97F4A7C15, len(w) - i, M) for i, x in enumerate(w)) + len(w)) % M) for w in words]
    grams = hashes + [spread((a * 3 + b) % M) for a, b in zip(hashes, hashes[1:])]
    out = {}
    for g in grams:
        place = g >> 64 - quality.BITS
        out[place] = out.get(place, 0) + quality.SCALE / len(grams)
    return out


def plain_ftrl(rows):
    """Follow the regularised leader with dictionaries, update by update: weights of a place on demand."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - (quality.L1 if z[i] > 0 else -quality.L1)) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    share = min(0.98, max(0.02, sum(y for _, y in rows) / len(rows)))
    for epoch in range(quality.EPOCHS):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[at]
            x = x | {"bias": 1.0}
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * 0.5 / (share if y else 1 - share) * v
                w, before = weight(i), n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / quality.ALPHA * w
    return weight


def test_same_as_plain_updates_and_scores(spark):
    """From texts and labels to scores, against updates and dot products on dictionaries."""
    import zlib

    texts = [f"{'good plain words' if i % 3 else 'BUY!!! now $$$ 99'} number {i} of {i * 7 % 11} things, é" for i in range(60)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(61)] + [(4, 0)], "doc_id long, quality int")
    learnt = sorted((i, y) for i, y in [*((i, int(i % 3 != 0)) for i in range(61)), (4, 0)] if zlib.crc32(str(i).encode()) % 3 != 1)
    weight = plain_ftrl([(plain_vector(texts[i]), y) for i, y in learnt])
    for r in quality.judged(docs, labels).collect():
        want = 1 / (1 + np.exp(-(sum(weight(i) * v for i, v in plain_vector(texts[r.doc_id]).items()) + weight("bias"))))
        assert abs(r.score - want) < 1e-5 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_sample_is_scanned_in_parallel(spark):
    """The task that learns reads an exchange, not the documents."""
    docs = spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    original = type(docs).mapInArrow

    def watch(self, *args, **kw):
        seen.append(self._jdf.queryExecution().optimizedPlan().toString())
        return original(self, *args, **kw)

    type(docs).mapInArrow = watch
    try:
        quality.fit(docs, labels)
    finally:
        type(docs).mapInArrow = original
    assert seen[0].startswith("Repartition 1, true")


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 1_500_000), (3, "word")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.judged(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).collect()}
    assert len(got) == 3 and all(0 <= x <= 1 for x in got.values())
