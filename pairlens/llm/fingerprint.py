"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs: the pieces between line feeds, without empty ones. Each paragraph is hashed into a wide vector;
a text's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of two:

* ``EXACT`` lanes modulo 2**64, filled from a 256-bit hash of the paragraph's bytes. Texts of the same paragraphs, in any order, have equal
  lanes; other texts have equal ones only if a 256-bit hash collides.
* ``LANES`` lanes modulo 2**16. Each pair of neighbouring words of the paragraph (the first word with a start mark; words end at ASCII white
  space, longer ones are cut every ``PIECE`` bytes) adds 1 or -1 to one lane. Read as signed numbers, two such vectors have about the
  cosine of the two texts' counts of word pairs, within some 1/sqrt(LANES).

Sums commute and have inverses, so paragraphs are inserted by adding and deleted by subtracting their vectors, in any order, and parts of a
text may be summed in different tasks. As the sum of a paragraph is all that counts, a lane beyond +-32,767 wraps around: then only a
likeness suffers, never an equality.

Defined results: a null text is an empty one; an empty text's fingerprint is all zero, and like only another of these (likeness 1). Rows with
the same doc_id are ordered by their texts; rows of a null doc_id stand in no order: nothing follows them. Columns other than doc_id and
text are ignored. Texts of any length are hashed whole, in memory of a few times the longest one's size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import doc_id_text, joined_bytes, mixed, partitions, slices

#: Lanes of the two kinds.
EXACT, LANES = 4, 256
WIDTH = EXACT * 8 + LANES * 2
#: Bytes of a word that are hashed as one.
PIECE = 16
#: An odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Stands for the word before a paragraph's first.
START = np.uint64(0xD6E8FEB86659FD93)
#: Texts whose neighbours are sought are dealt out by ranges of their ids, so many for each shuffle partition.
RANGES = 4

Vectors = tuple[np.ndarray, np.ndarray]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0:1] = 1
    return np.multiply.accumulate(out)


def _pairs(whole: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each pair of neighbouring words and the row that holds it."""
    space = (whole == 32) | ((whole >= 9) & (whole <= 13))
    at = np.flatnonzero(~space)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row_edge = np.zeros(len(whole) + 1, bool)
    row_edge[starts] = True
    first = np.ones(len(at), bool)  # where a word begins
    first[1:] = (np.diff(at) > 1) | row_edge[at[1:]]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    first |= (np.arange(len(at)) - begin) % PIECE == 0  # words have no gaps, so places in ``at`` count bytes
    edges = np.flatnonzero(first)
    a = at[edges]
    b = at[np.append(edges[1:], len(at)) - 1] + 1
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(whole)), out=sums[1:])
    words = mixed((sums[b] - sums[a]) * _powers(INVERSE, len(whole))[a] + (b - a).astype(np.uint64))
    lines = np.cumsum(whole == 10)[a]
    rows = np.searchsorted(starts, a, "right") - 1
    fresh = np.ones(len(a), bool)
    fresh[1:] = (np.diff(lines) > 0) | (np.diff(rows) > 0)
    before = np.concatenate([words[:1], words[:-1]])
    before[fresh] = START
    return mixed(before * np.uint64(BASE) + words), rows


def vectors(texts: list[str]) -> Vectors:
    """The sums of the vectors of each text's paragraphs: (rows, EXACT) and (rows, LANES)."""
    exact = np.zeros((len(texts), EXACT), np.uint64)
    for i, text in enumerate(texts):
        found = [hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p]
        if found:
            exact[i] = np.frombuffer(b"".join(found), "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    whole, offsets = joined_bytes(pa.array(texts, pa.large_string()))
    hashed, rows = _pairs(whole, offsets[:-1])
    lane = (hashed >> np.uint64(56)).astype(np.int64) % LANES
    sign = (hashed & np.uint64(1)).astype(np.float64) * 2 - 1
    sums = np.bincount(rows * LANES + lane, sign, len(texts) * LANES).reshape(len(texts), LANES)
    return exact, sums.astype(np.int64).astype(np.uint16)


def added(a: Vectors, b: Vectors) -> Vectors:
    """Lane by lane, modulo each lane's power."""
    return a[0] + b[0], a[1] + b[1]


def packed(vectors_: Vectors) -> list[bytes]:
    exact, lanes = vectors_
    return [bytes(x) for x in np.concatenate([exact.astype("<u8").view(np.uint8), lanes.astype("<u2").view(np.uint8)], axis=1)]


def unpacked(prints: list[bytes]) -> Vectors:
    flat = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), WIDTH)
    return flat[:, : EXACT * 8].copy().view("<u8").astype(np.uint64), flat[:, EXACT * 8 :].copy().view("<u2").astype(np.uint16)


def likeness(a: Vectors, b: Vectors) -> np.ndarray:
    """1 for equal fingerprints, else the cosine of the signed lanes, 0 at least and where one is all zero."""
    x, y = a[1].astype(np.int16).astype(np.float64), b[1].astype(np.int16).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip(np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(1) & (a[1] == b[1]).all(1), 1.0, cosine)


def _text(prints: list[bytes]) -> list[str]:
    return [base64.b64encode(x).decode() for x in prints]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (binary, WIDTH bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch]):
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed(vectors(texts)), pa.binary())], ["doc_id", "fingerprint"])

    return doc_id_text(docs).mapInArrow(run, "doc_id long, fingerprint binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one doc_id summed up; what is held is one batch and one fingerprint."""

    def out(ids: list, sums: Vectors) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed(sums), pa.binary())], ["doc_id", "fingerprint"])

    held: tuple[list, Vectors] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, found = batch.column("doc_id").to_pylist(), unpacked(batch.column("fingerprint").to_pylist())
        if held:
            ids, found = held[0] + ids, tuple(np.concatenate(x) for x in zip(held[1], found))
        edges = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        sums = tuple(np.add.reduceat(x, edges, axis=0, dtype=x.dtype) for x in found)
        ids = [ids[i] for i in edges]
        held = ids[-1:], tuple(x[-1:] for x in sums)
        if len(ids) > 1:
            yield out(ids[:-1], tuple(x[:-1] for x in sums))
    if held:
        yield out(*held)


def changed(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """``stored`` (doc_id, fingerprint binary) after ``changes`` (doc_id, text, sign: 1 inserts the text's paragraphs, -1 deletes them).

    A doc_id without a stored row begins as an empty text; rows of one doc_id, in either table, are summed. Changes are summed in their
    map tasks first, so a doc_id with very many of them sends one row for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch]):
                exact, lanes = vectors([x or "" for x in part.column("text").to_pylist()])
                sign = np.array([x or 0 for x in part.column("sign").to_pylist()], np.int64)[:, None]
                both = exact * sign.astype(np.uint64), lanes * sign.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed(both), pa.binary())], ["doc_id", "fingerprint"])

    schema = "doc_id long, fingerprint binary"
    texts = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("sign").cast("long").alias("sign"))
    both = stored.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint").unionByName(texts.mapInArrow(run, schema))
    partial = both.sortWithinPartitions("doc_id").mapInArrow(_summed, schema)
    return partial.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_summed, schema)


def _in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, guest: rows dealt out by descending ranges of doc_id. A range also has, as guests, the rows that follow it: those of
    the next range's largest doc_id, or of the largest of all behind the last range."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("double").alias("_id")).where("_id IS NOT NULL")
    n = RANGES * partitions(spark)
    cuts = sorted(set(ids.approxQuantile("_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="_id", outputCol="_b")
    placed = bucket.transform(docs.where("doc_id IS NOT NULL").withColumn("_id", F.col("doc_id").cast("double")))
    placed = placed.withColumn("range", (F.lit(len(splits)) - F.col("_b")).cast("int")).drop("_id", "_b")
    heads = placed.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # a row for each range
    follow = [Row(head=b["head"], of=a["range"]) for a, b in zip(heads, heads[1:] + heads[:1])]
    guests = F.broadcast(spark.createDataFrame(follow, "head long, of int"))  # as few
    both = placed.join(guests, F.col("doc_id") == F.col("head"), "left")
    places = F.filter(F.array(F.struct("range", F.lit(0).alias("guest")), F.struct(F.col("of").alias("range"), F.lit(1).alias("guest"))), lambda x: x["range"].isNotNull())
    return both.select("doc_id", "text", F.explode(places).alias("_p")).select("doc_id", "text", "_p.range", "_p.guest")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(rows: list[tuple], follows: list[str | None]) -> pa.RecordBatch:
    """One batch of EDITED. Both fingerprints come from three sums: the paragraphs that the edit leaves alone, those that it takes out and
    those that it brings in."""
    ids, texts = [x[0] for x in rows], [x[1] for x in rows]
    same, out, into, edited = [], [], [], []
    for text, follow in zip(texts, follows):
        half = len(text) // 2
        new = text[: len(text) - half] + (follow or "")[:half]
        cut = text.rfind("\n", 0, len(text) - half) + 1
        same.append(text[:cut])
        out.append(text[cut:])
        into.append(new[cut:])
        edited.append(hashlib.sha256(new.encode()).hexdigest())
    kept = vectors(same)
    own, after = added(kept, vectors(out)), added(kept, vectors(into))
    near = likeness(own, after)
    known = [i for i, x in enumerate(follows) if x is not None]
    # the next row's fingerprint is the row behind, but for the last
    beyond = tuple(np.concatenate([x[1:], y]) for x, y in zip(own, vectors([follows[-1] or ""])))
    near_next = [None] * len(rows)
    for i, x in zip(known, likeness(tuple(x[known] for x in own), tuple(x[known] for x in beyond))):
        near_next[i] = float(x)
    columns = [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(edited), pa.array(_text(packed(own))), pa.array(_text(packed(after))), pa.array(near), pa.array(near_next, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in EDITED.split(", ")])


def _followed(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, range, guest), sorted: each is judged with the next one of its range; guests are only followers.

    Held are the rows of about a megabyte of text.
    """
    held: list[tuple] = []
    size = 0
    for row in rows:
        if held and (row[3] or row[2] != held[-1][2] or size > 1 << 20):
            yield _judged(held, [x[1] for x in held[1:]] + [row[1] if row[2] == held[-1][2] else None])
            held, size = [], 0
        if not row[3]:
            held.append(row)
            size += len(row[1])
    if held:
        yield _judged(held, [x[1] for x in held[1:]] + [None])


def edited(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, its edited text's, and how like it they and the next document's are.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by descending
    doc_id; the first follows the last. A single document follows itself. For a null doc_id nothing follows: near_next is null, and the edited
    text is its first half.
    """
    docs = doc_id_text(docs)
    ranged = _in_ranges(docs).repartition("range").sortWithinPartitions("range", F.col("guest"), F.col("doc_id").desc(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c if i != 1 else [x or "" for x in c] for i, c in enumerate(batch.column(k).to_pylist() for k in ("doc_id", "text", "range", "guest")))))
        yield from _followed(rows)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch]):
                for text in part.column("text").to_pylist():
                    yield _judged([(None, text or "")], [None])

    return ranged.mapInArrow(run, EDITED).unionAll(docs.where("doc_id IS NULL").mapInArrow(alone, EDITED))
