"""Removal of repeated passages by a sparse suffix sort (operator 2).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Of each such window of bytes the
run of ``KMER`` bytes with the smallest hash is its anchor (the leftmost, if several are); equal windows have equal anchors at
equal places. So only suffixes at anchors need sorting, about one in fourteen, and of those only the ones whose anchor is in several
documents:

1. Fingerprints of anchors are dealt out by hash, one for each anchor and map batch; anchors found in more than one document come
   back to their documents (a chance collision costs a comparison, nothing else).
2. Each batch of documents sorts its suffixes at those anchors (up to the end of the last window that has the anchor, then what lies
   before the anchor, backwards), merges equal ones into one with its smallest document, and sends the sorted run
   front-coded: the length of the prefix shared with the entry before, and the rest.
3. The runs of a bucket of anchors are combined by a loser tree that knows for each run's head how much it shares with the last
   winner: heads are compared from there on only, and mostly not at all. What comes out side by side with a shared prefix of an anchor is a
   group; in it, each window's smallest document is found, which decides the window for all others.
4. A document's repeated windows are joined into spans, cut out and digested.

Defined results: a null text is empty; texts shorter than LENGTH keep all; rows of equal doc_id never repeat each other, as
neither's id is smaller, and rows that are equal altogether give equal results; a null doc_id is neither smaller nor larger than another, so
such rows keep all; columns besides doc_id and text are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_id_text, joined_bytes, mixed, partitions, released, slices, written

LENGTH, KMER = 50, 24
#: Positions of an anchor in a window.
PLACES = LENGTH - KMER + 1
#: A row of the sort: a byte unused, LENGTH bytes from the anchor, PLACES - 1 before it, backwards (zeros beyond its windows), a byte
#: unused, the anchor's place in its last window, how many windows have it.
ROW = 80
#: A table of spans of up to so many bytes is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 24 << 20
#: Anchors or suffixes in a batch; documents in it. Keys of anchors take 47 bits, so buckets 15 and texts of a slice 17.
BATCH, BATCH_DOCS, MOST_BUCKETS = 1_000_000, 30_000, 1 << 15
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_PLACE = np.uint64((1 << 31) - 1)


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the KMER (24) bytes from each position."""
    n = len(data) - KMER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = (data.astype(np.uint64) + np.uint64(1)) * _STEPS[0]
    eight = None
    for step, width in zip(_STEPS[1:], (1, 2, 4, 8)):
        h = h[:-width] * step + h[width:]
        h ^= h >> np.uint64(29)
        if width == 4:
            eight = h
    return mixed(h[:n] * _STEPS[0] + eight[16 : 16 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts that lie in ``data`` from offset to offset: position, hash, first window, last window and text of each anchor."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none, none
    full = kmer_hashes(data)
    h = (full & ~_PLACE) | np.arange(len(full), dtype=np.uint64)  # equal hashes: the leftmost
    for width in (1, 2, 4, 8):
        h = np.minimum(h[:-width], h[width:])
    low = np.minimum(h[:n], h[PLACES - 16 : PLACES - 16 + n])
    at = (low & _PLACE).astype(np.int64)
    sizes = np.diff(offsets)
    sound = np.zeros(n + 1, np.int64)  # windows that end within their text
    some = sizes >= LENGTH
    np.add.at(sound, offsets[:-1][some], 1)
    np.add.at(sound, np.minimum(offsets[1:][some] - LENGTH + 1, n), -1)
    p = np.flatnonzero(np.cumsum(sound)[:n] > 0)
    if not len(p):
        return none, none.astype(np.uint64), none, none, none
    own = at[p]
    new = np.ones(len(p), bool)
    new[1:] = own[1:] != own[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    position = own[first]
    return position, full[position], p[first], p[last], np.searchsorted(offsets, position, "right") - 1


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (above) and fingerprint (lower 32 bits) of an anchor. Anchors have small hashes, so these are mixed anew."""
    short = mixed(hashes + _STEPS[1]) >> np.uint64(20)
    return (((short >> np.uint64(12)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32) | (short & np.uint64(0xFFFFFFFF))


#: Documents are dealt to buckets by their ids alone, alike in Spark and in numpy, without overflow.
_PRIME, _FACTORS = 2_147_483_647, (48_271, 69_621)


def bucket_of(doc_id: Column, buckets: int) -> Column:
    out = F.pmod(doc_id, F.lit(_PRIME).cast("long"))
    for factor in _FACTORS:
        out = F.pmod(F.shiftright(out, 3).bitwiseXOR(out) * factor, F.lit(_PRIME).cast("long"))
    return F.pmod(out, F.lit(buckets)).cast("int")


def buckets_of(doc_ids: np.ndarray, buckets: int) -> np.ndarray:
    out = np.mod(doc_ids, _PRIME)
    for factor in _FACTORS:
        out = np.mod(((out >> 3) ^ out) * factor, _PRIME)
    return np.mod(out, buckets)


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys as bytes: if all are of one bucket, that and their fingerprints (4 bytes each); else as they are, after a mark."""
    bucket = keys >> np.uint64(32)
    if (bucket == bucket[0]).all():
        return np.array([bucket[0]], np.uint32).tobytes() + keys.astype(np.uint32).tobytes()
    return b"\xff\xff\xff\xff" + keys.tobytes()


def unpacked_keys(payload: bytes) -> np.ndarray:
    if payload[:4] == b"\xff\xff\xff\xff":
        return np.frombuffer(payload, np.uint64, offset=4)
    own = np.frombuffer(payload, np.uint32)
    return own[1:].astype(np.uint64) | np.uint64(int(own[0]) << 32)


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """to, docs, sizes, keys: for buckets of documents, the anchors of each document that another has, too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        docs_held: list = []
        n = 0

        def out() -> pa.RecordBatch:
            table, index = np.unique(np.array(docs_held, np.int64), return_inverse=True)
            pairs = np.unique(np.concatenate([(k << np.uint64(15)) | index[d].astype(np.uint64) for k, d in held]))
            key, doc = pairs >> np.uint64(15), (pairs & np.uint64(0x7FFF)).astype(np.uint16)
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            several = np.zeros(len(key), bool)
            several[:-1] = ~first[1:]
            several |= ~first
            tag = doc | (several.astype(np.uint16) << 15)
            k, t = key[first], tag[first]
            ends = np.searchsorted(k >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for b, (x, y) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                if y > x:
                    used, small = np.unique(t[x:y] & 0x7FFF, return_inverse=True)
                    rows.append((b, (k[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (small.astype(np.uint16) | (t[x:y] & 0x8000)).astype(np.uint16).tobytes(), table[used].tobytes()))
            if several.any():  # known to be shared already: these only pass
                k, d = key[several], doc[several]
                order = np.argsort(d, kind="stable")
                rows.append((int(k[0]) % buckets, None, k[order].tobytes(), table[d[order]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "prints", "tags", "table"])

        for batch in slices(batches, most=1 << 20):
            data, offsets = joined_bytes(batch.column("text"))
            _, hashes, _, _, text = anchors(data, offsets)
            held.append((_keys(hashes, buckets), text + len(docs_held)))
            docs_held += batch.column("doc_id").to_pylist()
            n += len(hashes)
            if n > BATCH or len(docs_held) > BATCH_DOCS - 10_000:
                if n:
                    yield out()
                held, docs_held, n = [], [], 0
        if n:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(docs: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            """A row for each bucket of documents: their ids, how many keys each has, the keys."""
            to = buckets_of(docs, buckets)
            order = np.lexsort((docs, to))
            docs, keys, to = docs[order], keys[order], to[order]
            edges = np.searchsorted(to, np.arange(buckets + 1)).tolist()
            out = []
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    own, size = np.unique(docs[a:b], return_counts=True)
                    out.append((i, own.tobytes(), size.astype(np.uint32).tobytes(), packed_keys(keys[a:b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["to", "docs", "sizes", "keys"])

        held: dict[int, list] = {}
        for batch in batches:
            for bucket, prints, tags, table in zip(*(batch.column(i).to_pylist() for i in range(4))):
                table = np.frombuffer(table, np.int64)
                if prints is None:
                    yield from rows(table, np.frombuffer(tags, np.uint64))
                else:
                    tags = np.frombuffer(tags, np.uint16)
                    held.setdefault(bucket, []).append((np.frombuffer(prints, np.uint32), table[tags & 0x7FFF], tags >> 15))
        for bucket, found in held.items():
            prints, docs, several = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(prints, kind="stable")
            prints, docs, several = prints[order], docs[order], several[order].astype(bool)
            first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            size = np.diff(np.append(first, len(prints)))
            shared = (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)) | np.logical_or.reduceat(several, first)
            back = np.repeat(shared, size) & ~several
            if back.any():
                yield from rows(docs[back], prints[back].astype(np.uint64) | np.uint64(bucket << 32))

    dealt = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(released(deal), "bucket int, prints binary, tags binary, table binary")
    return dealt.repartition(buckets, "bucket").mapInArrow(released(meet), "to int, docs binary, sizes binary, keys binary")


def suffix_rows(data: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows of the sort (ROW bytes each) for anchors at ``position`` that windows from ``first`` to ``last`` have."""
    out = np.zeros((len(position), ROW), np.uint8)
    out[:, ROW - 2], out[:, ROW - 1] = position - last, last - first + 1
    padded = np.concatenate([np.zeros(LENGTH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view
    for i in range(0, len(position), 100_000):
        at, part = position[i : i + 100_000] + LENGTH, out[i : i + 100_000]
        part[:, 1 : 1 + LENGTH] = view(padded, LENGTH)[at]
        part[:, 1 + LENGTH : LENGTH + PLACES] = view(padded, PLACES - 1)[at - PLACES + 1][:, ::-1]
        part[:, : ROW - 2] *= _filled(part[:, ROW - 2 :])
    return out


def _filled(tails: np.ndarray) -> np.ndarray:
    """Which bytes of rows hold text, by their last two."""
    place, count = tails[:, :1].astype(np.int64), tails[:, 1:].astype(np.int64)
    at = np.arange(ROW - 2)
    return ((at >= 1) & (at < 1 + LENGTH - place)) | ((at > LENGTH) & (at <= LENGTH + place + count - 1))


def sorted_run(rows: np.ndarray) -> np.ndarray:
    """Order of rows by their bytes."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort(words[:, 2::-1].T)
    some = words[order, :3]
    tied = (some[1:] == some[:-1]).all(axis=1)
    tied = np.flatnonzero(np.concatenate([tied, [False]]) | np.concatenate([[False], tied]))
    order[tied] = order[tied][np.lexsort(words[order[tied]].T[::-1])]  # ties are few, and stay in their places
    return order


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), ROW)
    return out


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A sorted run: lengths of the prefixes shared with the row before, the rest of each row's text, the rows' last bytes."""
    shared = shared_prefix(rows)
    rest = rows[:, : ROW - 2][_filled(rows[:, ROW - 2 :]) & (np.arange(ROW - 2) >= shared[:, None])]
    return shared.astype(np.uint8).tobytes(), zstandard.compress(rest.tobytes(), 1), rows[:, ROW - 2 :].tobytes()


def decoded(shared: bytes, rest: bytes, tails: bytes) -> np.ndarray:
    """The rows of a front-coded run."""
    known, tail = np.frombuffer(shared, np.uint8), np.frombuffer(tails, np.uint8).reshape(-1, 2)
    rows = np.zeros((len(known), ROW), np.uint8)
    own = np.arange(ROW - 2) >= known[:, None]
    text = np.zeros((len(known), ROW - 2), np.uint8)
    text[_filled(tail) & own] = np.frombuffer(zstandard.decompress(rest), np.uint8)
    source = np.maximum.accumulate(np.where(own, np.arange(len(known))[:, None], 0), axis=0)
    rows[:, : ROW - 2] = text[source, np.arange(ROW - 2)]
    rows[:, ROW - 2 :] = tail
    return rows


def full_text(row: bytes) -> bytes:
    """All windows of a row in one: the text from the first window's start to the last one's end."""
    behind = row[ROW - 2] + row[ROW - 1] - 1
    return row[1 + LENGTH : 1 + LENGTH + behind][::-1] + row[1 : 1 + LENGTH - row[ROW - 2]]


class Run:
    """A front-coded sorted run, read row by row."""

    def __init__(self, shared: bytes, rest: bytes, tails: bytes):
        flat = decoded(shared, rest, tails).tobytes()
        self.rows = [flat[i : i + ROW] for i in range(0, len(flat), ROW)]
        self.shared = [*shared, -1]  # -1: the end
        self.at, self.row = -1, b""

    def step(self) -> int:
        """To the next row; the length of the prefix it shares with the one before, -1 at the end."""
        self.at = i = self.at + 1
        known = self.shared[i]
        self.row = self.rows[i] if known >= 0 else b"\xff"
        return known


def loser_tree(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """The entries of all runs in order: run, number in it, row, length of the prefix it shares with the entry before.

    ``known[r]`` is how much the head of run r shares with the last winner. Of two heads, the one that shares more is
    smaller, and shares with the other what that one shares with the winner: no byte is looked at. Only heads that share as much are
    compared, from there on.
    """
    k = len(runs)
    known = [r.step() for r in runs]
    tree = [0] * k  # the losers; tree[0] the winner

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = runs[a].row, runs[b].row
        if x == y:
            low, high = (a, b) if a < b else (b, a)
            known[high] = ROW
            return low, high
        start = known[a]
        differ = int.from_bytes(x[start:], "big") ^ int.from_bytes(y[start:], "big")
        low, high = (a, b) if x < y else (b, a)
        known[high] = ROW - 1 - (differ.bit_length() - 1) // 8
        return low, high

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while known[winner] >= 0:
        run = runs[winner]
        yield winner, run.at, run.row, known[winner]
        known[winner] = run.step()
        node = (winner + k) // 2
        while node:
            other = tree[node]
            if known[winner] > known[other]:
                pass
            elif known[winner] < known[other]:
                winner, tree[node] = other, winner
            else:
                winner, tree[node] = play(winner, other)
            node //= 2


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Their union, as sorted spans that do not touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def united_spans(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (doc, text, start, end) of the spans' union, text by text, sorted; all texts at once."""
    order = np.lexsort((start, text, doc))
    doc, text = doc[order], text[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    base = (np.cumsum(new) - 1) << 32  # each text's spans lie in a stretch of their own
    first, last = _spans(start[order].astype(np.int64) + base, end[order].astype(np.int64) + base)
    at = np.flatnonzero(new)[first >> 32]
    return np.stack([doc[at], text[at], first & 0xFFFFFFFF, last & 0xFFFFFFFF], axis=1)


RUNS = "bucket int, shared binary, rest binary, tails binary, count binary, places binary, owner binary"


def runs(docs: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """Front-coded runs by bucket; as rows without ``shared``, the spans that a batch settles by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        ids: list[tuple[int, int]] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows, hashes, first, owner = (np.concatenate(x) for x in zip(*held))
            table = np.array(ids, np.int64).reshape(-1, 2)
            order = sorted_run(rows)
            rows, hashes, first, owner = rows[order], hashes[order], first[order], owner[order]
            shared = shared_prefix(rows)
            new = shared < ROW
            new[0] = True
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(rows)))
            doc = table[owner, 0]
            low = np.repeat(np.minimum.reduceat(doc, at), size)
            later = doc > low
            result = []
            if later.any():  # a smaller document of this batch has these windows, all of them
                o = owner[later]
                found = united_spans(table[o, 0], table[o, 1], first[later], first[later] + rows[later, ROW - 1] - 1 + LENGTH)
                result.append((int(found[0, 0]) % buckets, None, found.tobytes(), b"", b"", b"", b""))
            entry = np.cumsum(new) - 1
            stay = ~later
            per = np.bincount(entry[stay], minlength=len(at))
            places, owners = first[stay], owner[stay]
            stops = np.concatenate([[0], np.cumsum(per)])
            bucket = (_keys(hashes[at], buckets) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                own = by[edges[b] : edges[b + 1]]
                if not len(own):
                    continue
                which = np.repeat(stops[own] - np.concatenate([[0], np.cumsum(per[own])[:-1]]), per[own]) + np.arange(per[own].sum())
                used, small = np.unique(owners[which], return_inverse=True)
                result.append((b, *front_coded(rows[at[own]]), per[own].astype(np.uint32).tobytes(), places[which].astype(np.uint32).tobytes() + small.astype(np.uint32).tobytes(), table[used].tobytes()))
                if len(result) >= 64:
                    yield batch_of(result)
                    result = []
            if result:
                yield batch_of(result)

        def batch_of(result: list) -> pa.RecordBatch:
            kinds = [pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*result), kinds)], [x.split()[0] for x in RUNS.split(", ")])

        now, docs_of, keys_of = None, [], []
        starts, wanted_docs, wanted_keys = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in slices(batches, "payload", 1 << 20):
            texts, own_ids, asked = [], [], []
            for to, own, text, payload, docs, sizes, keys in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if to != now:
                    now, docs_of, keys_of, wanted_docs = to, [], [], np.zeros(0, np.int64)
                if text is None:  # a bucket's keys come before its texts
                    docs_of.append(np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.uint32)))
                    keys_of.append(unpacked_keys(keys))
                    continue
                if docs_of:
                    every, wanted_keys = np.concatenate(docs_of), np.concatenate(keys_of)
                    order = np.argsort(every, kind="stable")
                    wanted_keys = wanted_keys[order]
                    wanted_docs, starts = np.unique(every[order], return_index=True)
                    starts = np.append(starts, len(every))
                    docs_of, keys_of = [], []
                at = int(np.searchsorted(wanted_docs, own))
                if at < len(wanted_docs) and wanted_docs[at] == own and len(payload) >= LENGTH:
                    asked.append(wanted_keys[starts[at] : starts[at + 1]] | np.uint64(len(own_ids) << 47))
                    texts.append(payload)
                    own_ids.append((own, text))
            if not texts:
                continue
            data = np.frombuffer(b"".join(texts), np.uint8)
            position, hashes, first, last, owner = anchors(data, np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
            some = np.isin(_keys(hashes, buckets) | owner.astype(np.uint64) << np.uint64(47), np.concatenate(asked))
            if some.any():
                position, first, last, owner = position[some], first[some], last[some], owner[some]
                start = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                held.append((suffix_rows(data, position, first, last), hashes[some], first - start[owner], owner + len(ids)))
                ids += own_ids
                n += len(first)
            if n > BATCH // 4:
                yield from out()
                held, ids, n = [], [], 0
        if n:
            yield from out()

    nothing = F.lit(None).cast("binary")
    text = docs.where("doc_id IS NOT NULL").select(bucket_of(F.col("doc_id"), buckets).alias("to"), "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("payload"), nothing.alias("docs"), nothing.alias("sizes"), nothing.alias("keys"))
    long = F.lit(None).cast("long")
    both = keys.select("to", long.alias("doc_id"), long.alias("text_hash"), nothing.alias("payload"), "docs", "sizes", "keys").unionAll(text)
    return both.repartition(buckets, "to").sortWithinPartitions("to", F.col("text_hash").isNotNull()).mapInArrow(released(run), RUNS)


def _settle(group: list[tuple[int, int, bytes]], low_of: list[np.ndarray]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(run, entry, spans from the entry's start) of a group's entries with repeated windows."""
    docs = [int(low_of[r][i]) for r, i, _ in group]
    low = min(docs)
    if group[0][2] == group[-1][2]:  # sorted: all are equal
        whole = [(0, group[0][2][ROW - 1] - 1 + LENGTH)]
        for (r, i, _), doc in zip(group, docs):
            if doc > low:
                yield r, i, whole
        return
    least: dict[bytes, int] = {}
    own: dict[bytes, list[bytes]] = {}
    for (_, _, row), doc in zip(group, docs):
        if row not in own:
            text = full_text(row)
            own[row] = [text[j : j + LENGTH] for j in range(row[ROW - 1])]
        for window in own[row]:
            if least.get(window, doc) >= doc:
                least[window] = doc
    for (r, i, row), doc in zip(group, docs):
        if doc > low:
            spans: list[tuple[int, int]] = []
            for j, window in enumerate(own[row]):
                if least[window] < doc:
                    if spans and spans[-1][1] >= j:
                        spans[-1] = (spans[-1][0], j + LENGTH)
                    else:
                        spans.append((j, j + LENGTH))
            if spans:
                yield r, i, spans


def repeated_spans(dealt: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text_hash, spans (binary: pairs of longs) of every document with repeated windows: one row each."""

    def dealt_out(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Spans, as a row for each bucket of documents."""
        found = united_spans(doc, text, start, end)
        to = buckets_of(found[:, 0], buckets)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(buckets + 1)).tolist()
        rows = [(i, found[order[a:b]].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.binary()))], ["to", "spans"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if row[0] is None:
                    yield from dealt_out(*np.frombuffer(row[1], np.int64).reshape(-1, 4).T)
                else:
                    by_bucket.setdefault(bucket, []).append(row)
        for found in by_bucket.values():
            stops = [np.concatenate([[0], np.cumsum(np.frombuffer(x[3], np.uint32), dtype=np.int64)]) for x in found]
            places = [np.frombuffer(x[4], np.uint32).reshape(2, -1) for x in found]
            tables = [np.frombuffer(x[5], np.int64).reshape(-1, 2) for x in found]
            low_of = [t[p[1][s[:-1]], 0] for t, p, s in zip(tables, places, stops)]  # an entry's places are all of its smallest document
            verdicts: list[list[tuple[int, int, int]]] = [[] for _ in found]
            group: list[tuple[int, int, bytes]] = []
            for r, i, row, known in loser_tree([Run(*x[:3]) for x in found]):
                if known <= KMER and group:
                    if len(group) > 1:
                        for q, j, spans in _settle(group, low_of):
                            verdicts[q] += [(j, a, b) for a, b in spans]
                    group = []
                group.append((r, i, row))
            if len(group) > 1:
                for q, j, spans in _settle(group, low_of):
                    verdicts[q] += [(j, a, b) for a, b in spans]
            parts = []
            for q, own in enumerate(verdicts):
                if own:
                    entry, a, b = np.array(own, np.int64).T
                    size = stops[q][entry + 1] - stops[q][entry]
                    which = np.repeat(stops[q][entry] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    start, owner = places[q][0][which].astype(np.int64), places[q][1][which]
                    parts.append((tables[q][owner, 0], tables[q][owner, 1], start + np.repeat(a, size), start + np.repeat(b, size)))
            if parts:
                yield from dealt_out(*(np.concatenate(x) for x in zip(*parts)))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, np.int64).reshape(-1, 4) for batch in batches for x in batch.column("spans").to_pylist()]
        if not held:
            return
        found = united_spans(*np.concatenate(held).T)
        held.clear()
        edges = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1), [True]])).tolist()
        for i in range(0, len(edges) - 1, 5000):
            part = edges[i : i + 5001]
            spans = [found[a:b, 2:].tobytes() for a, b in zip(part, part[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found[part[:-1], 0]), pa.array(found[part[:-1], 1]), pa.array(spans, pa.binary())], ["doc_id", "text_hash", "spans"])

    kind = "doc_id long, text_hash long, spans binary"
    pieces = dealt.repartition(buckets, "bucket").mapInArrow(released(meet), "to int, spans binary")
    return pieces.repartition(buckets, "to").mapInArrow(released(united), kind)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), spans (binary: pairs of longs, byte offsets) of every document that has repeated passages."""
    docs = doc_id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    buckets = min(MOST_BUCKETS, partitions(docs.sparkSession))
    return written(repeated_spans(runs(docs, shared_anchors(docs, buckets), buckets), buckets), "spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) of every document."""
    docs = doc_id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    spans = spans_of(docs).select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_text"), "spans")
    if (spans.agg(F.sum(F.length("spans") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    joined = docs.join(spans, (F.col("doc_id") == F.col("own")) & (F.xxhash64("text") == F.col("own_text")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = joined_bytes(batch.column("text"))
            data, ends = data.tobytes(), offsets.tolist()
            removed, count, kept = [], [], []
            for a, b, own in zip(ends, ends[1:], batch.column("spans").to_pylist()):
                cut = np.frombuffer(own or b"", np.int64).reshape(-1, 2).tolist()
                edges = [a, *(a + x for pair in cut for x in pair), b]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2])))
                removed.append(b - a - len(kept[-1]))
                count.append(len(cut))
            arrays = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
