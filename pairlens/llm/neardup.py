"""Near-duplicate vectors by a robust-pruned flat graph (operator 6).

1. Equal vectors become one class; only classes go on.
2. Centroids come from a bounded sample, those near to each other make one shard; every class joins the OVERLAP shards of the nearest centroids.
3. In each shard, a class's candidates (its nearest, the shard's medoid, some at random) are pruned robustly: a candidate goes if one kept
   before is ALPHA times nearer to it than the class is. What is left, and the reverse edges, are its neighbours.
4. The adjacency lists of all its shards are united.
5. In each shard, every class is searched from the medoid by a greedy beam over the united lists; once within range, the search
   goes on through every node in range until no new one turns up, so it has no limit on how many it finds. Searches of a block of
   classes go on together: a node that one of them reaches is measured against all of them in one product, so a dense group costs
   products of blocks and a bit for each pair, not a row.
6. Cosines of what is found are taken in double precision; pairs under the threshold never link. A pair that several shards hold
   counts in the first of them, so links are counted without a row for a pair.
7. A shard of many classes is dealt into slots, and its tiles (pairs of slots) are built and searched each for itself; a pair of classes meets
   in one tile of a shard. So no task holds more than two slots, however many vectors are near to each other.
8. The links of a bounded set of classes are counted again by brute force over all classes. If the share found falls short of RECALL,
   the graph is built again with more overlap; if that doesn't help either, all classes become one shard, whose tiles are measured whole.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors without another of
their length; equal vectors link; repeated rows are rows of their own; a null vec_id takes no part (no links, null component, kept);
columns besides vec_id and embedding are dropped; an empty table gives an empty table; vectors as near to two centroids join the first
of them; very large and very small finite components are scaled before they are squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import bounded_sample, partitions, written
from .components import components, stars

#: Classes that centroids are fitted on, at most; classes in a shard, about; centroids, at most; classes in a slot, about.
SAMPLE, SHARD, CENTROIDS, SLOT = 16_384, 1200, 4096, 4096
OVERLAP, NEAREST, RANDOM, DEGREE, ALPHA, BEAM = 3, 40, 12, 20, 1.2, 12
#: Classes whose links are counted by brute force, and the share of them that must be found.
AUDITED, RECALL = 256, 0.95


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (binary of doubles) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["vec_id", "vec"])

    return usable(vectors).mapInArrow(run, "vec_id long, vec binary")


def centroids(classes: DataFrame, n: int, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit centroids for each length of vectors, by spherical k-means over a bounded sample, and where each shard's begin.

    Centroids that are as near to each other as linked vectors are, or hang together by such, are of one shard, so that a dense group is not cut.
    """
    sample = [bytes(r.vec) for r in bounded_sample(classes, SAMPLE, "vec", "cid").select("vec").collect()]
    out = {}
    for size in sorted({len(x) for x in sample}):
        x = unit([y for y in sample if len(y) == size])
        k = max(1, min(CENTROIDS, len(x) // 4, round(n * len(x) / len(sample) / SHARD)))
        rng = np.random.default_rng(0)
        mid = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            own = np.concatenate([(x[i : i + 4096] @ mid.T).argmax(axis=1) for i in range(0, len(x), 4096)])
            total = np.zeros_like(mid)
            np.add.at(total, own, x)
            size_of = np.sqrt((total * total).sum(axis=1, keepdims=True))
            mid = np.where(size_of > 1e-9, total / np.maximum(size_of, 1e-9), mid)
        root = np.arange(k)
        a, b = np.nonzero(np.triu(mid @ mid.T >= threshold, 1))  # CENTROIDS squared at most
        node, low = stars(a, b)
        root[node] = low
        order = np.argsort(root, kind="stable")
        out[size] = mid[order], np.flatnonzero(np.diff(root[order], prepend=-1))
    return out


def sharded(classes: DataFrame, mids: dict[int, tuple[np.ndarray, np.ndarray]], overlap: int) -> DataFrame:
    """cid, texts, vec, shards (all of the class's), shard: a row for each shard of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            sizes = np.array([len(x) for x in vecs])
            shards: list[list[int]] = [[0]] * len(vecs)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                base = size // 8 << 32
                if size not in mids:
                    near = np.zeros((len(rows), 1), np.int64)
                else:
                    mid, starts = mids[size]
                    near = np.maximum.reduceat(unit([vecs[i] for i in rows]) @ mid.T, starts, axis=1)
                    near = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                for i, own in zip(rows.tolist(), np.sort(near + base, axis=1).tolist()):
                    shards[i] = own
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("texts"), batch.column("vec"), pa.array(shards, kind)], ["cid", "texts", "vec", "shards"])

    found = classes.select("cid", "texts", "vec").mapInArrow(run, "cid long, texts long, vec binary, shards array<long>")
    return found.withColumn("shard", F.explode("shards"))


def one_shard(classes: DataFrame) -> DataFrame:
    """As sharded(), all classes of a length in one shard."""
    shard = F.octet_length("vec").cast("long")
    return classes.select("cid", "texts", "vec", F.array(shard).alias("shards"), shard.alias("shard"))


def tiled(members: DataFrame) -> DataFrame:
    """A row for each tile of a member, as ``tile``, and its slot; a pair of members of a shard meets in one tile, or in one where both have its only slot."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    rows = members.join(sizes, "shard").withColumn("slot", F.pmod(F.xxhash64("cid", F.lit("slot")), F.col("slots")).cast("int"))
    pair = lambda x: F.struct(F.least(x, "slot").alias("i"), F.greatest(x, "slot").alias("j"))
    rows = rows.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), pair)))
    tile = F.xxhash64("shard", "at.i", "at.j").alias("tile")
    return rows.select(tile, "shard", F.when(F.col("at.i") < F.col("at.j"), F.col("slot")).otherwise(-1).alias("slot"), "cid", "texts", "vec", "shards")


def pruned(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Neighbours (DEGREE a row, -1 for none) of each row among the rows, robustly pruned; row 0 is the medoid."""
    m = len(x)
    out = np.full((m, DEGREE), -1, np.int64)
    if m == 1:
        return out
    near = min(NEAREST, m - 1)
    for a in range(0, m, 256):
        own = np.arange(a, min(m, a + 256))
        dots = x[own] @ x.T
        dots[np.arange(len(own)), own] = -np.inf
        pool = np.argpartition(-dots, near - 1, axis=1)[:, :near]
        pool = np.concatenate([pool, rng.integers(0, m, (len(own), RANDOM)), np.zeros((len(own), 1), np.int64)], axis=1)
        far = 1 - np.take_along_axis(dots, pool, axis=1)  # 1 - cosine is half the squared distance
        order = np.argsort(far, axis=1, kind="stable")
        pool, far = np.take_along_axis(pool, order, axis=1), np.take_along_axis(far, order, axis=1)
        alive = np.isfinite(far)
        between = 1 - np.einsum("qad,qbd->qab", x[pool], x[pool])
        for j in range(DEGREE):
            has = alive.any(axis=1)
            if not has.any():
                break
            first = alive.argmax(axis=1)
            rows = np.flatnonzero(has)
            best = first[rows]
            out[own[rows], j] = pool[rows, best]
            gone = ALPHA**2 * between[rows, best] <= far[rows]
            gone |= pool[rows] == pool[rows, best][:, None]
            alive[rows] &= ~gone
    return out


def tile_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[list]]]:
    """The columns of each tile, of rows that are sorted by tile."""
    now, held = None, [[] for _ in names]
    for batch in batches:
        shards = batch.column("tile").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        cols = [batch.column(x).to_pylist() for x in names]
        for a, b in zip(edges, edges[1:]):
            if b > a and shards[a] != now:
                if held[0]:
                    yield now, held
                now, held = int(shards[a]), [[] for _ in names]
            for to, values in zip(held, cols):
                to += values[a:b]
    if held[0]:
        yield now, held


def ordered(cids: list[int], vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a shard's rows (the medoid first, then by cid), their cids and unit vectors in that order."""
    x, ids = unit(vecs), np.array(cids)
    order = np.argsort(ids)
    medoid = order[(x[order] @ x.mean(axis=0)).argmax()]
    order = np.concatenate([[medoid], order[order != medoid]])
    return order, ids[order], x[order]


def adjacency(members: DataFrame) -> DataFrame:
    """cid, near (array of cids): each class's neighbours, united over its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, (cids, vecs) in tile_rows(batches, ["cid", "vec"]):
            _, ids, x = ordered(cids, vecs)
            found = pruned(x, np.random.default_rng(tile % 2**64))
            a, j = np.nonzero(found >= 0)
            b = found[a, j]
            pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)  # reverse edges, too
            edges = np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1))
            near = [ids[pairs[s:e, 1]].tolist() for s, e in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near, pa.list_(pa.int64()))], ["cid", "near"])

    lists = members.select("tile", "cid", "vec").mapInArrow(run, "cid long, near array<long>")
    return lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list for each of its few shards


def search(x: np.ndarray, near: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows, and which of all rows each finds within range: a greedy beam from row 0, then everything that hangs together in range."""
    m = len(x)
    width = max(1, max(map(len, near)))
    lists = np.full((m, width), m, np.int64)  # m: none
    for i, own in enumerate(near):
        lists[i, : len(own)] = own
    padded = np.concatenate([x, np.zeros((1, x.shape[1]))])
    block = max(32, min(512, 40_000_000 // (width * x.shape[1] * 8)) // 8 * 8)
    for a in range(0, m, block):
        own = np.arange(a, min(m, a + block))
        q, rows = len(own), np.arange(len(own))
        seen = np.zeros((q, m + 1), bool)
        seen[:, m] = seen[:, 0] = True
        ids, far = np.full((q, BEAM), m), np.full((q, BEAM), np.inf)
        ids[:, 0], far[:, 0] = 0, 1 - x[own] @ x[0]
        open_ = np.zeros((q, BEAM), bool)
        open_[:, 0] = True
        reached = np.zeros(m, bool)  # by any row of the block, within its range
        reached[0] = (1 - far[:, 0] >= threshold).any()
        while len(live := np.flatnonzero(open_.any(axis=1))):
            best = np.where(open_[live], far[live], np.inf).argmin(axis=1)
            open_[live, best] = False
            to = lists[ids[live, best]]
            new = ~seen[live[:, None], to]
            seen[live[:, None], to] = True
            dots = np.einsum("qd,qnd->qn", x[own[live]], padded[to])
            gap = np.where(new, 1 - dots, np.inf)
            reached[to[new & (dots >= threshold)]] = True
            every = np.concatenate([far[live], gap], axis=1)
            top = np.argpartition(every, BEAM - 1, axis=1)[:, :BEAM]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], to], axis=1), top, axis=1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], np.isfinite(gap)], axis=1), top, axis=1)
            far[live] = np.take_along_axis(every, top, axis=1)
        inside = np.zeros((q, m), bool)
        measured = np.zeros(m + 1, bool)
        measured[m] = True
        fresh = np.flatnonzero(reached)
        while len(fresh):  # the range: through all that is in it
            measured[fresh] = True
            hit = np.zeros(len(fresh), bool)
            for s in range(0, len(fresh), 4096):
                part = x[own] @ x[fresh[s : s + 4096]].T >= threshold
                inside[:, fresh[s : s + 4096]] = part
                hit[s : s + 4096] = part.any(axis=0)
            to = np.unique(lists[fresh[hit]])
            fresh = to[~measured[to]]
        yield own, inside


def measured(x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As search(), with every pair of rows measured."""
    for a in range(0, len(x), 512):
        own = np.arange(a, min(len(x), a + 512))
        yield own, x[own] @ x.T >= threshold


def links(members: DataFrame, near: DataFrame | None, threshold: float) -> DataFrame:
    """cid, root, links: for each class with links in a tile, the smallest class it hangs together with, and its links that count there.

    Without ``near``, all pairs of a tile are measured.
    """

    names = ["cid", "texts", "vec", "shards", "shard", "slot", *(["near"] if near is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (cids, texts, vecs, shards, shard, slot, *lists) in tile_rows(batches, names):
            order, ids, x = ordered(cids, vecs)
            m = len(ids)
            sorted_at = np.argsort(ids)
            known = ids[sorted_at]

            def local(own: list[int]) -> np.ndarray:
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                return sorted_at[at[known[at] == own]]

            weight, slots = np.array(texts, np.float64)[order], np.array(slot)[order]
            # the tile's pairs as bits, a row for each of its classes; found from either side
            bits = np.zeros((m, -(-m // 8)), np.uint8)
            blocks = measured(x, threshold) if not lists else search(x, [local(np.array(lists[0][at] or [], np.int64)) for at in order.tolist()], threshold)
            for own, inside in blocks:
                inside[np.arange(len(own)), own] = False
                inside &= (slots[own][:, None] != slots[None, :]) | (slots[own] < 0)[:, None]
                bits[own] |= np.packbits(inside, axis=1)
                at = int(own[0]) // 8  # blocks begin at multiples of 8
                other = np.packbits(inside.T, axis=1)
                bits[:, at : at + other.shape[1]] |= other
            first = np.full((m, max(map(len, shards))), -1, np.int64)
            for i, at in enumerate(order.tolist()):
                first[i, : len(shards[at])] = shards[at]
            earlier = np.where(first < shard[0], first, -1)
            n, root = np.zeros(m), np.arange(m)
            for a in range(0, m, 512):
                own = np.arange(a, min(m, a + 512))
                inside = np.unpackbits(bits[own], axis=1, count=m).astype(bool)
                some = inside.any(axis=1)
                root[own] = np.minimum(own, np.where(some, inside.argmax(axis=1), own))
                before = np.zeros(inside.shape, bool)  # both are in an earlier shard, too
                for u in range(earlier.shape[1]):
                    for v in range(earlier.shape[1]):
                        before |= (earlier[own, u] >= 0)[:, None] & (earlier[own, u][:, None] == earlier[None, :, v])
                n[own] = (inside & ~before) @ weight
            some = np.flatnonzero(bits.any(axis=1))
            if not len(some):
                continue
            # every class to its first neighbour, and each first neighbour's to one another, until nothing changes
            while True:
                new = root.copy()
                for a in range(0, m, 512):
                    own = np.arange(a, min(m, a + 512))
                    inside = np.unpackbits(bits[own], axis=1, count=m).astype(bool)
                    new[own] = np.minimum(new[own], np.where(inside, root[None, :], m).min(axis=1))
                np.minimum.at(new, root, new.copy())
                while not np.array_equal(new, new[new]):
                    new = new[new]
                if np.array_equal(new, root):
                    break
                root = new
            low = np.full(m, np.iinfo(np.int64).max)
            np.minimum.at(low, root, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(low[root[some]]), pa.array(np.rint(n[some]).astype(np.int64))], ["cid", "root", "links"])

    rows = members if near is None else members.join(near, "cid", "left")
    rows = rows.select("tile", *names).repartition(partitions(members.sparkSession), "tile").sortWithinPartitions("tile", "cid")
    return rows.mapInArrow(run, "cid long, root long, links long")


def recall(classes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Share of the links between classes of a bounded set and all classes that were found."""
    asked = bounded_sample(classes, AUDITED, "cid").select("cid", "vec").collect()
    by_size: dict[int, list] = {}
    for r in asked:
        by_size.setdefault(len(r.vec), []).append((r.cid, bytes(r.vec)))
    blocks = {s: (np.array([c for c, _ in rows]), unit([v for _, v in rows])) for s, rows in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, cids, texts = (batch.column(x).to_pylist() for x in ("vec", "cid", "texts"))
            for size, (ids, x) in blocks.items():
                rows = [i for i, v in enumerate(vecs) if len(v) == size]
                if rows:
                    hit = x @ unit([vecs[i] for i in rows]).T >= threshold
                    hit &= ids[:, None] != np.array([cids[i] for i in rows])[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ np.array([texts[i] for i in rows]))], ["cid", "true_links"])

    truth = classes.select("cid", "texts", "vec").mapInArrow(run, "cid long, true_links long").groupBy("cid").agg(F.sum("true_links").alias("true_links"))
    own = found.groupBy("cid").agg(F.sum("links").alias("links"))
    got, real = truth.join(own, "cid", "left").agg(F.sum(F.least(F.coalesce("links", F.lit(0)), "true_links")), F.sum("true_links")).first()
    return (got or 0) / real if real else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    rows = written(packed(vectors), "vectors")
    classes = rows.groupBy("vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("texts"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "vec", "least_id", "texts"), "classes")
    n = classes.count()
    mids = centroids(classes, n, threshold) if n else {}
    found, overlap = None, OVERLAP
    while n and overlap <= 4 * OVERLAP:
        members = written(tiled(sharded(classes, mids, overlap)), "members")
        near = adjacency(members.repartition(partitions(spark), "tile").sortWithinPartitions("tile", "cid"))
        found = written(links(members, near, threshold), "links")
        if recall(classes, found, threshold) >= RECALL:
            break
        overlap, found = 2 * overlap, None
    if found is None:
        found = written(links(tiled(one_shard(classes)), None, threshold), "links")
    named = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    totals = found.groupBy("cid").agg(F.sum("links").alias("links"))
    small = classes.join(named, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = small.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = small.join(ids, "root").join(totals, "cid", "left").select("vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"))
    linked = rows.join(by_class, "vec").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    vec = F.col("embedding").cast("array<double>")
    sound = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    out = F.col("vec_id").isNull() | ~F.coalesce(sound, F.lit(False))
    alone = vectors.where(out).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionAll(alone)
