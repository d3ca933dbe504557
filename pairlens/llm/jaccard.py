"""N-gram Jaccard join by set-relation skipping (operator 1).

A text's words are runs of bytes that are no white space, A-Z in lower case; its set holds the 64-bit hashes of its distinct shingles
of ``k`` words. Two sets link when ``den * intersection >= num * union``.

1. Equal sets are one class (a row for each, with its number of texts); only classes are joined.
2. Every class's elements are dealt into buckets by their hashes, one of each class from a map task. A bucket counts in how many classes an
   element stands, and gives those that stand in several back to their classes. An element so common that its entries alone would weigh on a bucket (HEAVY of
   all elements, so there are 1 / HEAVY of them at most; counted in the map tasks that read the texts first) is known to be shared: it goes straight to its class. A class of n elements links only with sets that have
   ``ceil(num / den * n)`` of them, so one with fewer shared elements than that links with nothing and is settled. Of the others,
   linked sets have one of their rarest ``n - ceil(num / den * n) + 1`` elements in common (any order that is the same for all sets does,
   the rarest first makes the fewest candidates); what is not shared counts as rarest.
3. Classes with such an element in common are joined to the smallest of them, in map tasks first, so an element that a third of all texts
   share is one row from each task. Set sizes fall into bands, and a class also joins the band below if a smaller partner may be there.
4. Candidate groups (components of those edges within a band) are joined exactly, from the shared elements alone: the others count in no
   intersection. A group's index lists are sorted by set size, and of each list only the block of positions that can link is read. A set's
   overlaps with all others are derived from those of a highly similar set computed before: only the lists of the elements in which they
   differ are added or taken away. Larger groups are cut into tiles, each pair of sets meeting in one of them.
5. The links' components give each text its class id.

Each similar pair of classes is found once, so links are counted exactly; no pair of texts is ever a row.

Defined results: null, empty and wordless texts have empty sets, link with nothing and are their own component; a text of fewer than k
words has its whole sequence as one shingle; repeated rows and doc_ids are texts of their own, results stand for each row; a null
doc_id stays null and never names a component that has another id (a component of null ids alone has a null id); columns besides
doc_id and text are dropped; an empty table gives an empty table. A very long text is one set like others, held by one task at a time; ties
in rarity go by the element's hash, so every set orders them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id_text, joined_bytes, mixed, partitions, released, slices, written
from .components import components, stars

#: Sizes of a band go up to this times its least.
SPREAD = 1.5
#: A map task deals its classes' elements once it holds so many.
HELD = 800_000
#: The share of all elements from which on an element goes straight to its classes, and the number of classes that must have it in any case.
HEAVY, HEAVY_CLASSES = 4e-5, 64
#: Parts in which a bucket's elements are counted, one after the other.
PARTS = 4
#: A tile has two slots of about so many sets and so many elements at most.
SLOT_SETS, SLOT_ELEMENTS = 1500, 400_000
#: A table of up to so many rows of one number each is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a column of texts, and where each row's begin (one more at the end)."""
    data, offsets = joined_bytes(column)
    n = len(data)
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    start[inner] = ~space[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    word = np.cumsum(start)[~space] - 1
    at = np.flatnonzero(~space)
    length = np.bincount(word, minlength=len(starts))
    power = np.full(int(length.max()), _BASE)
    power[0] = 1
    power = np.cumprod(power)
    terms = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * power[at - starts[word]]
    hashes = mixed(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(starts, offsets)


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    words, ends = word_hashes(column)
    n = len(words)
    shingle = words.copy()
    for j in range(1, k):
        shingle[: n - j] = mixed(shingle[: n - j] * _STEP + words[j:])
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        if b - a >= k:
            yield np.unique(shingle[a : b - k + 1])
        elif b > a:
            own = words[a : a + 1]
            for j in range(a + 1, b):
                own = mixed(own * _STEP + words[j : j + 1])
            yield mixed(own + np.uint64(b - a))
        else:
            yield words[:0]


class Bands:
    """Bands of set sizes for a threshold num / den; linked sets stand in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        if not 2 * num > den:
            raise ValueError("the threshold must be over one half")
        self.num, self.den = num, den
        spread = max(SPREAD, den / num + 0.01)
        self.least = [1]
        while self.least[-1] < 1 << 40:
            self.least.append(max(self.least[-1] + 1, int(self.least[-1] * spread)))
        self.edges = np.array(self.least)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def below(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a partner of sets of sizes n may stand in the band below theirs."""
        return (band > 0) & (-(-self.num * n // self.den) < self.edges[band])


def digest_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _common(found: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Elements that stand in many of these sets, and in how many: all that make up HEAVY of the sets' elements, so no more than 1 / HEAVY."""
    keys, seen = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    many = seen >= max(8, HEAVY * seen.sum())
    return keys[many].tobytes(), seen[many].astype(np.int64).tobytes()


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set of every text; and, in rows without a digest, the elements (keys) that stand in many (seen) of a run's different sets."""
    names = ["doc_id", "n_shingles", "digest", "keys", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            keys, seen = _common(list(held.values()))
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([keys], pa.binary()), pa.array([seen], pa.binary())], names)

        for batch in slices(batches, most=1 << 19):
            n, digests = [], []
            for own in sets(batch.column("text"), k):
                n.append(len(own))
                digests.append(digest_of(own))
                if len(own) and digests[-1] not in held:
                    held[digests[-1]] = own
                    size += len(own)
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), none, none], names)
            if size > HELD:
                yield counted()
                held, size = {}, 0
        if size:
            yield counted()

    return docs.mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, keys binary, seen binary")


def heavy_elements(counted: DataFrame, elements: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of profiles() without a digest: the elements that stand in HEAVY of all ``elements`` or more, ascending, and their rarity. At most 1 / HEAVY of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, seen in zip(batch.column("keys").to_pylist(), batch.column("seen").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(seen, np.int64))], ["key", "seen"])

    each = counted.select("keys", "seen").mapInArrow(run, "key long, seen long").groupBy("key").agg(F.sum("seen").alias("seen"))
    found = each.where(F.col("seen") >= max(HEAVY_CLASSES, HEAVY * elements)).collect()
    keys, seen = (np.array([r[c] for r in found], np.int64) for c in ("key", "seen"))
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], rarity_of(seen[order])


def rarity_of(seen: np.ndarray) -> np.ndarray:
    """1 to 255, the rarest first, of elements that several classes have."""
    return np.minimum(255, 8 * np.log2(np.maximum(seen, 2))).astype(np.uint8)


def short_id(digest: bytes, start: int) -> int:
    return int.from_bytes(digest[start : start + 8], "big", signed=True)


def short_ids(classes: DataFrame) -> tuple[DataFrame, int]:
    """Classes with ``id``, eight bytes of their digests, and where in them these begin: where id and size name each class alone."""
    for start in range(9):
        found = classes.withColumn("id", F.conv(F.hex(F.substr("digest", F.lit(start + 1), F.lit(8))), 16, -10).cast("long"))
        if not found.groupBy("id", "n").count().where("count > 1").head(1):
            return found, start
    raise RuntimeError("nine ways to shorten the digests all gave equal ids to different sets")


CHUNK = "bucket int, direct boolean, ids binary, sizes binary, counts binary, keys binary, places binary"


def _chunks(bucket: np.ndarray, node: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, places: np.ndarray, direct: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: its nodes' ids and sizes, how many elements each has there, and those, node after node. direct: each node has all its heavy elements
    in its row, and every task that deals the class deals the same.

    bucket, node, keys and places are by element, in order of bucket and node; ids and sizes are by node.
    """
    if not len(bucket):
        return
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])
    first = np.append(np.flatnonzero(new), len(bucket))
    counts, nodes, of = np.diff(first).astype(np.uint32), node[first[:-1]], bucket[first[:-1]]
    some = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of))
    rows: list[tuple] = []
    for x, y in zip(some.tolist(), some[1:].tolist()):
        at = slice(first[x], first[y])
        rows.append((int(of[x]), direct, ids[nodes[x:y]].tobytes(), sizes[nodes[x:y]].tobytes(), counts[x:y].tobytes(), keys[at].tobytes(), places[at].tobytes()))
    cols = list(zip(*rows))
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["bucket", "direct", "ids", "sizes", "counts", "keys", "places"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """ids and sizes of the distinct nodes of a partition's chunks; node and number of elements of each entry; key and place of each element; whether an entry is direct."""
    held: list[list[np.ndarray]] = [[] for _ in range(5)]
    direct = [np.zeros(0, bool)]
    for batch in batches:
        direct += [np.full(len(x) // 8, d) for x, d in zip(batch.column("ids").to_pylist(), batch.column("direct").to_pylist())]
        for to, name, kind in zip(held, ("ids", "sizes", "counts", "keys", "places"), (np.int64, np.int32, np.uint32, np.uint64, np.uint8)):
            to += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    ids, sizes, counts, keys, places = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(held, (np.int64, np.int32, np.uint32, np.uint64, np.uint8)))
    del held
    order = np.lexsort((sizes, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    node = np.empty(len(ids), np.int32)
    node[order] = np.cumsum(new) - 1
    return ids[order][new], sizes[order][new], node, counts, keys, places, np.concatenate(direct)


def _by_class(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each class."""
    return (mixed(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _dealt(docs: DataFrame, k: int, n: int, start: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All elements of each class, in chunks by the element's bucket, heavy ones, with their rarity, by the class's; a class comes once from each run of
    HELD elements of a task."""
    common, rarity = heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in held.values()], np.int32)
            keys, node = np.concatenate(list(held.values())), np.repeat(np.arange(len(sizes)), sizes)
            ids = np.array([short_id(x, start) for x in held], np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
                found = common[at] == keys
                if found.any():
                    home = _by_class(ids, n)
                    order = np.flatnonzero(found)
                    order = order[np.argsort(home[node[order]], kind="stable")]
                    yield from _chunks(home[node[order]], node[order], ids, sizes, keys[order], rarity[at[order]], direct=True)
                    keys, node = keys[~found], node[~found]
            bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16) if n <= 65536 else bucket, kind="stable")
            yield from _chunks(bucket[order], node[order], ids, sizes, keys[order], np.zeros(0, np.uint8))

        for batch in slices(batches, most=1 << 19):
            for own in sets(batch.column("text"), k):
                if len(own) and (digest := digest_of(own)) not in held:
                    held[digest] = own
                    size += len(own)
            if size > HELD:
                yield from out()
                held, size = {}, 0
        if size:
            yield from out()

    return docs.select("text").mapInArrow(released(run), CHUNK)


def _shared(n: int):
    """Of a bucket's elements those of several classes, with their rarity (the rarest first), in chunks by class. Direct chunks are by class already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def to_count() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                direct = batch.column("direct")
                passed.append(batch.filter(direct))
                yield batch.filter(pc.invert(direct))

        ids, sizes, entry, counts, keys, _, _ = _unpacked(to_count())
        yield from passed
        passed.clear()
        if not len(keys):
            return
        # a class that several tasks dealt counts once: the elements of its first entry stay
        once = np.zeros(len(entry), bool)
        once[np.unique(entry, return_index=True)[1]] = True
        if not once.all():
            keys = keys[np.repeat(once, counts)]
        node = np.repeat(entry[once], counts[once])
        rarity = np.zeros(len(keys), np.uint8)
        for part in range(PARTS):  # equal elements are in one part; parts hold memory down
            at = np.flatnonzero(keys % np.uint64(PARTS) == part).astype(np.int32)
            at = at[np.argsort(keys[at], kind="stable")]
            own = keys[at]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            seen = np.diff(np.append(first, len(own)))
            rarity[at] = np.repeat(np.where(seen > 1, rarity_of(seen), 0).astype(np.uint8), seen)
        some = rarity > 0
        node, keys, rarity = node[some], keys[some], rarity[some]
        bucket = _by_class(ids, n)
        order = np.lexsort((node, bucket[node]))
        yield from _chunks(bucket[node[order]], node[order], ids, sizes, keys[order], rarity[order])

    return run


def _alive(num: int, den: int):
    """Classes with so many shared elements that they may link: id, n, those elements (ascending), and the rarest, of which a partner has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, entry, counts, keys, rarity, direct = _unpacked(batches)
        if direct.any():  # of a class's direct entries, which are all the same, the first stays
            once = ~direct
            at = np.flatnonzero(direct)
            once[at[np.unique(entry[at], return_index=True)[1]]] = True
            keys, rarity, entry, counts = keys[np.repeat(once, counts)], rarity[np.repeat(once, counts)], entry[once], counts[once]
        node = np.repeat(entry, counts)
        shared = np.bincount(node, minlength=len(ids))
        least = -(-num * sizes.astype(np.int64) // den)
        alive = shared >= least
        own = alive[node]
        node, keys, rarity = node[own], keys[own], rarity[own]
        order = np.lexsort((keys, rarity, node))
        ends = np.concatenate([[0], np.cumsum(np.where(alive, shared, 0))])
        rare = np.where(alive, shared - least + 1, 0)  # n - least + 1, without those that aren't shared
        rows: list[tuple] = []
        held = 0
        for i in np.flatnonzero(alive).tolist():
            by_rarity = keys[order[ends[i] : ends[i + 1]]]
            rows.append((int(ids[i]), int(sizes[i]), np.sort(by_rarity).tobytes(), by_rarity[: rare[i]].tobytes()))
            held += len(by_rarity)
            if held > 200_000:
                yield _alive_rows(rows)
                rows, held = [], 0
        if rows:
            yield _alive_rows(rows)

    return run


def _alive_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["id", "n", "elements", "rare"])


NONE_HEAVY = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def alive(docs: DataFrame, k: int, num: int, den: int, start: int = 0, heavy: tuple[np.ndarray, np.ndarray] = NONE_HEAVY) -> DataFrame:
    """id, n, elements, rare of every class that may link."""
    n = partitions(docs.sparkSession)
    some = _dealt(docs, k, n, start, heavy).repartitionById(n, F.col("bucket")).mapInArrow(released(_shared(n)), CHUNK)
    return some.repartitionById(n, F.col("bucket")).mapInArrow(released(_alive(num, den)), "id long, n long, elements binary, rare binary")


def _first_of_key(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys with their smallest nodes; edges from that node to the key's others."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    low = nodes[first][np.cumsum(first) - 1]
    other = low != nodes
    edges = np.unique(np.stack([low[other], nodes[other]], axis=1), axis=0)
    return keys[first], nodes[first], edges[:, 0], edges[:, 1]


def candidate_edges(living: DataFrame, bands: Bands) -> DataFrame:
    """Edges between nodes (57 bits of the id, times 64, and the band) of classes that share a rare element in a band."""
    n = partitions(living.sparkSession)
    names = ["bucket", "keys", "nodes", "edges"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, nodes, a, b = _first_of_key(np.concatenate([x for x, _ in held]), np.repeat([y for _, y in held], [len(x) for x, _ in held]))
            bucket = (keys >> np.uint64(20)) % np.uint64(n)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
            rows = [(i, keys[order[x:y]].tobytes(), nodes[order[x:y]].tobytes(), b"") for i, (x, y) in enumerate(zip(ends.tolist(), ends[1:].tolist())) if y > x]
            if len(a):  # edges found here
                rows.append((int(a[0]) % n, b"", b"", np.stack(stars(a, b), axis=1).tobytes()))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names)

        for batch in batches:
            sizes = batch.column("n").to_numpy()
            band = bands.of(sizes)
            below = bands.below(sizes, band)
            for own, rare, level, also in zip(batch.column("id").to_pylist(), batch.column("rare").to_pylist(), band.tolist(), below.tolist()):
                keys = np.frombuffer(rare, np.uint64)
                for x in (level, level - 1)[: 2 if also else 1]:
                    held.append((mixed(keys + np.uint64((x + 1) * int(_BASE) % 2**64)), (own % 2**64 >> 7) * 64 + x))
                    size += len(keys)
            if size > HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, edges = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for batch in batches:
            for to, kind, name in ((keys, np.uint64, "keys"), (nodes, np.int64, "nodes"), (edges, np.int64, "edges")):
                to += [np.frombuffer(x, kind).reshape((-1, 2) if to is edges else -1) for x in batch.column(name).to_pylist()]
        _, _, a, b = _first_of_key(np.concatenate(keys), np.concatenate(nodes))
        held = np.concatenate([np.stack([a, b], axis=1), *edges])
        a, b = stars(held[:, 0], held[:, 1]) if len(held) else (a, b)
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], ["a", "b"])

    dealt = living.select("id", "n", "rare").mapInArrow(released(deal), "bucket int, keys binary, nodes binary, edges binary")
    return dealt.repartitionById(n, F.col("bucket")).mapInArrow(released(meet), "a long, b long")


def join_group(found: list[np.ndarray], size: np.ndarray, slots: list[int] | None, num: int, den: int, below: int, derived: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a group, the later ones in order of size that it links with; sets of ``below`` elements or more start no pair.

    ``found`` holds the elements (all but those that no other set has) of sets of the sizes ``size``, which ascend. With slots, only sets of
    different slots are compared. ``derived`` takes the ranks of sets whose overlaps came from another's.
    """
    g = len(found)
    slot = np.arange(g) if slots is None else np.array(slots)
    last = np.searchsorted(size, size * den // num, "right")  # beyond it, sets are too large to link
    linked = lambda r, at, over: at[(den * over >= num * (size[r] + size[at] - over)) & (slot[at] != slot[r])]
    flat = np.concatenate(found)
    _, token = np.unique(flat, return_inverse=True)
    held = [len(x) for x in found]
    ends = np.concatenate([[0], np.cumsum(held)])
    own = [token[a:b] for a, b in zip(ends, ends[1:])]  # ascending
    rank = np.repeat(np.arange(g), held)
    # index lists, each sorted by position (rank by size): token * g + rank, ascending
    lists = np.sort(token * np.int64(g) + rank)

    def counts(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the lists hold each rank from low to high - 1; what lies before or after is skipped as a block."""
        a = np.searchsorted(lists, tokens * np.int64(g) + low)
        n = np.searchsorted(lists, tokens * np.int64(g) + high) - a
        stop = np.cumsum(n)
        at = np.repeat(a - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)
        return np.bincount(lists[at] % g - low, minlength=high - low)

    reach = np.searchsorted(size, size * den // num * den // num, "right")
    leaders: list[tuple[int, np.ndarray]] = []  # (rank, overlaps with the ranks after it up to its reach)
    for r in range(g):
        if size[r] >= below:
            return
        if last[r] <= r + 1:
            continue
        over = None
        for i, (x, known) in enumerate(leaders):
            if last[r] <= reach[x] and 2 * (size[x] + size[r] - 2 * known[r - x - 1]) < size[r]:
                less, more = np.setdiff1d(own[x], own[r], assume_unique=True), np.setdiff1d(own[r], own[x], assume_unique=True)
                over = known[r - x : last[r] - x - 1] - counts(less, r + 1, last[r]) + counts(more, r + 1, last[r])
                leaders.insert(0, leaders.pop(i))
                if derived is not None:
                    derived.append(r)
                break
        if over is None:
            known = counts(own[r], r + 1, reach[r])
            over = known[: last[r] - r - 1]
            leaders.insert(0, (r, known))
            del leaders[8:]
        if len(at := linked(r, np.arange(r + 1, last[r]), over)):
            yield r, at


def _group_links(num: int, den: int, least: list[int]):
    names, kinds = ["cid", "root", "links"], [pa.int64(), pa.int64(), pa.int64()]

    def links(key: tuple, rows: dict[int, tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        cids = sorted(rows, key=lambda c: (rows[c][2], c))
        texts = np.array([rows[c][1] for c in cids])
        n = np.zeros(len(cids), np.int64)
        a, b = [], []
        sizes = np.array([rows[c][2] for c in cids])
        for r, at in join_group([rows[c][3] for c in cids], sizes, None if key[2] == key[3] else [rows[c][0] for c in cids], num, den, least[key[0] + 1]):
            n[r] += texts[at].sum()
            n[at] += texts[r]
            a.append(np.full(len(at), r))
            b.append(at)
        if not a:
            return []
        ids = np.array(cids)
        x, root = stars(ids[np.concatenate(a)], ids[np.concatenate(b)])
        roots = dict(zip(x.tolist(), root.tolist()))
        return [(c, roots.get(c, c), m) for c, m in zip(cids, n.tolist()) if m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("band", "root", "i", "j", "slot", "cid", "texts", "n", "elements")]
            for band, root, i, j, slot, cid, texts, n, elements in zip(*cols):
                if (key := (band, root, i, j)) != now:
                    if len(rows) > 1:
                        out += links(now, rows)
                    now, rows = key, {}
                rows[cid] = (slot, texts, n, np.frombuffer(elements, np.uint64))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                out = []
        if len(rows) > 1:
            out += links(now, rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return run


def similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every text. Texts link when den * intersection >= num * union."""
    bands = Bands(num, den)
    docs = doc_id_text(docs)
    both = written(profiles(docs, k), "profiles")
    rows = both.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("texts"), F.first("n_shingles").alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "least_id", "texts", "n"), "classes")
    classes, start = short_ids(classes)
    heavy = heavy_elements(both.where("digest IS NULL"), rows.agg(F.sum("n_shingles")).first()[0] or 0)
    living = written(alive(docs, k, num, den, start, heavy), "alive")
    groups = components(candidate_edges(living, bands))
    nodes = groups.select(F.shiftright("node", 6).alias("short"), F.pmod("node", F.lit(64)).cast("int").alias("band"), "root")
    size = F.shiftright(F.octet_length("elements"), 3).alias("shared")
    members = living.select("id", "n", size).join(classes.select("id", "n", "cid", "texts"), ["id", "n"]).withColumn("short", F.shiftrightunsigned("id", 7)).join(nodes, "short")
    members = written(members.select("band", "root", "id", "n", "cid", "texts", "shared"), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / SLOT_SETS, F.sum("shared") / SLOT_ELEMENTS)).cast("int").alias("slots"))
    # a slot is one of the group's; a tile is a pair of slots, (i, i) for pairs within one
    slot = F.pmod(F.xxhash64("cid"), F.col("slots")).cast("int")
    placed = members.join(sizes, "root").withColumn("slot", slot)
    placed = placed.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda x: F.struct(F.least(x, "slot").alias("i"), F.greatest(x, "slot").alias("j")))))
    placed = placed.select("band", "root", "tile.i", "tile.j", "slot", "cid", "texts", "id", "n").join(living.select("id", "n", "elements"), ["id", "n"])
    full = placed.repartition(partitions(docs.sparkSession), "band", "root", "i", "j").sortWithinPartitions("band", "root", "i", "j")
    found = written(full.mapInArrow(released(_group_links(num, den, bands.least)), "cid long, root long, links long"), "links")

    named = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("cid").agg(F.sum("links").alias("links"))
    small = classes.select("cid", "digest", "least_id", "texts").join(named.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = small.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = small.join(ids, "root").join(totals, "cid", "left").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"))
    out = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(by_class, "digest").select("doc_id", "n_shingles", "component_id", "n_links")
    return out.unionAll(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
