"""Byte-level BPE encoding and decoding (operator 4).

A text is cut by the tokenizer's pattern; each match whose bytes are a token is that token, any other is merged pair by
pair, always the leftmost pair of lowest rank. The pair ranks of a match are the leaves of a segment tree over its byte
positions: the root is the leftmost minimum, and a merge updates the leaves of the merged pair, of the pair to its left
and of the swallowed position, in logarithmic time. So a match of n bytes takes O(n log n), however long. Short
matches that a batch holds for the first time go through the same tree for all of them at once, a row of numpy arrays
each; long ones go one by one. What has been encoded is kept in a bounded cache of the worker.

Defined results: a null text is encoded as an empty one (no ids); a null doc_id stays null; repeated rows are encoded
each; columns besides doc_id and text are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_id_text, released, slices

#: Rank of a pair that is no token.
NONE = np.int32(1 << 30)
#: Entries of a worker's cache, which is emptied beyond that.
CACHE = 200_000
#: Longest match in bytes that goes through the trees of many matches at once.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Coder:
    """Encodes by one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs: dict[int, int] = {}  # filled when the first long match comes
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.cache: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        if not len(self.pair_keys):
            return np.full(len(key), NONE, np.int32)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one match, by its own segment tree."""
        if not self.pairs:
            self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        n, pairs = len(piece), self.pairs
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        none = int(NONE) * size * 2
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                at >>= 1
                low = tree[2 * at] if tree[2 * at] < tree[2 * at + 1] else tree[2 * at + 1]
                if tree[at] == low:
                    break
                tree[at] = low

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone], after[at] = rank, -1, right
            put(gone, none)
            rank = None
            if right < n:
                before[right] = at
                rank = pairs.get(ids[at] << 32 | ids[right])
            put(at, none if rank is None else rank * size + at)
            if (left := before[at]) >= 0:
                rank = pairs.get(ids[left] << 32 | ids[at])
                put(left, none if rank is None else rank * size + left)
        return [x for x in ids if x >= 0]

    def merge_short(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of many matches of at most ``size`` bytes (a power of two): the trees are rows of one array."""
        n = len(pieces)
        lengths = np.array([len(x) for x in pieces], np.int32)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(n, size)
        ids = self.single[raw]
        place = np.arange(size, dtype=np.int32)
        tree = np.full((n, 2 * size), NONE, np.int32)
        rows, at = np.nonzero(place[None, :-1] < lengths[:, None] - 1)
        rank = self.pair_rank(ids[rows, at], ids[rows, at + 1])
        tree[rows, size + at] = np.where(rank < NONE, rank * np.int32(size) + at.astype(np.int32), NONE)
        width = size
        while width > 1:
            width //= 2
            np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2], out=tree[:, width : 2 * width])
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        live = place[None, :] < lengths[:, None]

        def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = size + at
            tree[rows, node] = np.where(rank < NONE, rank * np.int32(size) + at, NONE)
            while True:
                node = node >> 1
                if node[0] == 0:
                    break
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root % size, root // size
            gone = after[rows, at]
            right = after[rows, gone]
            ids[rows, at], live[rows, gone], after[rows, at] = rank, False, right
            put(rows, gone, np.full(len(rows), NONE, np.int32))
            inside = right < lengths[rows]
            before[rows[inside], right[inside]] = at[inside]
            new = np.full(len(rows), NONE, np.int32)
            new[inside] = self.pair_rank(rank[inside], ids[rows[inside], right[inside]])
            put(rows, at, new)
            left = before[rows, at]
            some = left >= 0
            if some.any():
                put(rows[some], left[some], self.pair_rank(ids[rows[some], left[some]], rank[some]))
            rows = rows[tree[rows, 1] < NONE]
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, new: list[str]) -> None:
        """Puts the ids of matches into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode()
            if (rank := self.ranks.get(data)) is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(data) > SHORT:
                self.cache[piece] = np.array(self.merge_long(data), "<u4").tobytes()
            else:
                by_size.setdefault(max(8, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for size, found in by_size.items():
            for i in range(0, len(found), 1 << 14):
                part = found[i : i + (1 << 14)]
                self.cache.update(zip((x for x, _ in part), self.merge_short([x for _, x in part], size)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        found = [self.find(x) for x in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.learn(list(set().union(*found).difference(self.cache)))
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in found]



def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_TOKENS: dict[str, list[bytes]] = {}
_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder for a file of ranks."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


Batches = Iterator[pa.RecordBatch]


def _encoding(path: str, pattern: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = coder(path, pattern)
        for batch in slices(batches, most=2 << 20):
            ids = own.encode([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decoding(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        if path not in _TOKENS:
            _TOKENS[path] = token_table(read_ranks(path))
        own = _TOKENS[path]
        for batch in slices(batches, "ids", most=4 << 20):
            texts = [decoded(x, own) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of every text.

    ``path`` is the file of ranks, at the same place on every executor.
    """
    return doc_id_text(docs).mapInArrow(released(_encoding(path, pattern)), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encode() and decoded (binary: the bytes that the ids stand for)."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(released(_decoding(path)), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again, by one worker for each task."""
    sums = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())

    def run(batches: Batches) -> Batches:
        for batch in _decoding(path)(_encoding(path, pattern)(batches)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], sums(batch.column("ids")), sums(batch.column("decoded"))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_id_text(docs).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
