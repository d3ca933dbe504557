import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from pairlens.llm import bpe
from pairlens.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def cases():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgéèßñ中文🙂 '0123\n\t") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    return ["", " ", "a", "aaaa" * 5000, "a b  c\n\n d", "it's we'll", "\x1c\x85 x", "🙂" * 300, *words, "1" * 70, " " * 1000 + "x", None, words[0]]


def test_same_as_the_library(library):
    own = bpe.Coder(bpe.read_ranks(PATH), PATTERN)
    texts = [x or "" for x in cases()]
    tokens = bpe.token_table(bpe.read_ranks(PATH))
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode_ordinary(text)
        assert ids == b"".join(x.to_bytes(4, "little") for x in want)
        assert bpe.decoded(ids, tokens) == text.encode()


def test_long_and_short_trees_agree():
    own = bpe.Coder(bpe.read_ranks(PATH), PATTERN)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("thereandingß") for _ in range(rng.randint(1, 60))).encode()[:64] for _ in range(300)]
    for piece, ids in zip(pieces, own.merge_short(pieces, 64)):
        assert b"".join(x.to_bytes(4, "little") for x in own.merge_long(piece)) == ids


def test_query(spark, library):
    rows = [(i, x, "z") for i, x in enumerate(cases())] + [(None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, PATTERN).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH, PATTERN).collect() == []
