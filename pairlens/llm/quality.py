"""Quality classifier: logistic regression over hashed word n-grams (operator 5).

A word is a run of letters, of digits or of other printable bytes; words and pairs of neighbouring words are hashed into
``2 ** BITS`` places. A text's vector holds each place's share of the text's n-grams, times ``SCALE``. The weights are
learnt by follow-the-regularised-leader updates (per-place rates, L1 and L2), text by text, and a score is the logistic
function of a sparse dot product.

The classifier is fitted on a bounded sample: the ``SAMPLE`` labelled texts of smallest hash of their id. It is trained
in one task over those, and its weights (``2 ** BITS`` doubles at most, whatever the data) go back out with the scoring
function. Every text is scored whole.

Defined results: null and empty texts have no n-grams and score by the bias alone; a null doc_id stays null and is never
in the sample; labels that are null are left out, and a document with several labels counts once for each; repeated rows
score alike; columns besides doc_id and text are dropped; without labels of both kinds the score is 0.5 throughout; an
empty table gives an empty table; a very long text is a slice of its own and scored whole; ties among hashes of ids in the sample go
by the id, then the label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doc_id_text, joined_bytes, mixed, released, slices

BITS = 18
SCALE = 32.0
#: Bound on the labelled texts that the classifier is fitted on.
SAMPLE = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5

#: Class of each byte: 0 space, 1 letter (and all bytes of other alphabets), 2 digit, 3 the rest.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[:1] = 1
    return np.cumprod(out)


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of a column of texts, and where each row's begin (one more at the end)."""
    data, offsets = joined_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    kind = _CLASS[data]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    inner = offsets[1:-1]
    new[inner[inner < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    word = kind[starts] != 0
    starts, ends = starts[word], ends[word]
    # a word's hash: sum of its bytes times powers by their distance from the word's end
    length = ends - starts
    power = _powers(min(int(length.max(initial=1)), 64) + 1)
    terms = np.zeros(n, np.uint64)
    if len(starts):
        own = np.repeat(ends, length)
        at = np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum())
        terms = data[at].astype(np.uint64) + np.uint64(1)
        terms *= power[np.minimum(own - at, len(power) - 1)]
        words = np.add.reduceat(terms, np.cumsum(length) - length)
    else:
        words = np.zeros(0, np.uint64)
    words = mixed(words + length.astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # first word of each row
    row = np.repeat(np.arange(len(column)), np.diff(first))
    same = row[1:] == row[:-1]
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:])[same]
    rows = np.concatenate([row, row[:-1][same]]) if len(row) else row
    grams = np.concatenate([words, pairs]) if len(row) else words
    order = np.argsort(rows, kind="stable")
    places = (grams >> np.uint64(64 - BITS)).astype(np.int64)[order]
    return places, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(column)))])


def _vector(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(places, return_counts=True)
    return at, count * (SCALE / max(1, len(places)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` rounds of updates over (places, values, label)."""
    size = (1 << BITS) + 1  # the last place is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    share = np.clip(np.mean([y for _, _, y in rows]), 0.02, 0.98) if rows else 0.5
    if rows and 0 < sum(y for _, _, y in rows) < len(rows):
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                at, value, y = rows[i]
                at, value = np.append(at, size - 1), np.append(value, 1.0)
                w = weights(at)
                p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
                g = (p - y) * (0.5 / (share if y else 1 - share)) * value  # either label weighs the same in sum
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - step * w
                n[at] += g * g
    every = weights(np.arange(size))
    return every[:-1], float(every[-1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from the labels (doc_id, quality 0/1) on which ``usable`` holds, a bounded sample of them."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    named = named.where("doc_id IS NOT NULL AND label IN (0, 1)")
    if usable is not None:
        named = named.where(usable)
    sample = F.broadcast(bounded_sample(named, SAMPLE, "doc_id", "label"))  # SAMPLE rows at most
    rows = doc_id_text(docs).join(sample, "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in slices(batches):
            places, ends = hashed(batch.column("text"))
            for i, (own, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist())):
                found.append((own, *_vector(places[ends[i] : ends[i + 1]]), y))
        found.sort(key=lambda x: (x[0], x[3]))
        w, bias = ftrl([x[1:] for x in found])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["place", "weight"])

    # an exchange: every task scans its part of the documents, and the one that learns gets the sample alone
    learnt = rows.repartition(1).mapInArrow(released(run), "place long, weight double").collect()
    w, bias = np.zeros(1 << BITS, np.float32), 0.0
    for place, weight in learnt:
        if place < 0:
            bias = weight
        else:
            w[place] = weight
    return w, bias


def scorer(model: tuple[np.ndarray, float]) -> Callable[[pa.Array], np.ndarray]:
    """Texts to scores."""
    w, bias = model

    def score(column: pa.Array) -> np.ndarray:
        places, ends = hashed(column)
        size = np.diff(ends)
        row = np.repeat(np.arange(len(size)), size)
        mean = np.bincount(row, weights=w[places], minlength=len(size)) / np.maximum(1, size)  # a row's sum by its own order
        return 1 / (1 + np.exp(-np.clip(mean * SCALE + bias, -35, 35)))

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every text."""
    own = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own(batch.column("text")))], ["doc_id", "score"])

    return doc_id_text(docs).mapInArrow(released(run), "doc_id long, score double")


def keep_good(model: tuple[np.ndarray, float], least: float = 0.5) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows with a text column: the rows that score ``least`` or more."""
    own = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(own(batch.column("text")) >= least))

    return released(run)


def learnable() -> Column:
    """Rows whose labels may be learnt from: crc32 of the id's text, modulo 3, isn't 1."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, learnable()))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
