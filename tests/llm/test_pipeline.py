import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pairlens.llm import bpe, mixing, pii, quality  # noqa: E402

from .test_jaccard import shingles  # noqa: E402

DIR = "/root/testdata/sf0.001"


def groups(rows):
    found = [(i, shingles(t, 5)) for i, t in rows]
    root = {i: i for i, _ in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in found:
        for b, y in found:
            if b < a and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: top(i) for i in root}


def test_stages_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    columns = docs.columns
    start = {r.doc_id: r for r in docs.collect()}

    one = corpus_pipeline.quality_filter(spark, docs, DIR).persist()
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, quality.learnable())).collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, s in scores.items() if s >= 0.5}

    two = corpus_pipeline.near_copies(spark, one, DIR).persist()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert two.columns == columns and {r.doc_id for r in two.collect()} == set(groups(rows).values())

    three = corpus_pipeline.personal_data(spark, two, DIR).persist()
    weights = pii.model(two)
    assert three.columns == columns
    for r in three.collect():
        assert r.text == pii.masked(start[r.doc_id].text, pii.accepted(start[r.doc_id].text, weights)) and r.n_chars == len(r.text)

    four = corpus_pipeline.mix(spark, three, DIR).persist()
    copies = {r.doc_id: r.copies for r in mixing.mix(three, labels, corpus_pipeline.TARGETS).collect()}
    got = {}
    for r in four.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert four.columns == columns and got == {i: n for i, n in copies.items() if n}

    texts = {r.doc_id: r.text for r in three.collect()}
    own = bpe.Coder(bpe.read_ranks(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY)), corpus_pipeline.public_tokenizers.PATTERN)
    five = corpus_pipeline.tokens(spark, four, DIR).collect()
    assert len(five) == sum(got.values())
    for r in five:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(own.encode([texts[r.doc_id]])[0]).hexdigest()
    assert corpus_pipeline.run(spark, DIR).count() == len(five)


def test_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a", "b", "c", 1), (2, "", "x", "y", 0), (2, "", "x", "y", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DIR)
            docs.collect()
