"""Approximate nearest neighbours by a block matrix join (operator 9).

Vectors go to blocks of fixed size. A block holds its vectors as int8 codes with one scale a vector, and for each vector
the exact length of what the codes leave out. Every block of queries meets every block of candidates once, in one cell of a grid whose
cells are the shuffle's partitions (a stated query set against all rows, in blocks): the product of the two code matrices (exact in float32: 127 * 127 * dimensions stays under
2 ** 24 up to 1,040 dimensions, float64 beyond) gives all distances of the tile, and the residual lengths bound each
error. What can't be among a query's k nearest by its bounds goes; the rest is recomputed from the original vectors in
double precision, dimension after dimension, and heaps of k merge within a tile, within a task and at last by query. As the
bounds are proven, the result is exact.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries or as
candidates; very large and very small finite ones do; vectors of another length than the query's are never compared with it; ties go to the smaller vec_id; fewer
than k candidates are all returned; repeated vec_ids are compared as rows of their own, but never with their own id; other columns
are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Vectors in a block of queries, of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 2048
#: Pairs whose distances are recomputed at once.
PAIRS = 100_000
#: Sums of squares below this have lost digits; so much of a distance may be lost in squares of scaled vectors, whose largest component is about 1.
TINY, LOST = 1e-280, 1e-150


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array of double) of the vectors that take part."""
    vec = F.col("embedding").cast("array<double>")
    sound = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row, length of each row's remainder (rounded up)."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    rest = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, rest * (1 + 1e-9) + 1e-300


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """dim, block rows: n, ids, vecs (binary of longs and doubles). Blocks hold ``size`` vectors at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = zip(*held.pop(dim))
            arrays = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(rows, np.float64).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["dim", "n", "ids", "vecs"])

        for batch in batches:
            column = batch.column("vec")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
            for i, own in enumerate(batch.column("vec_id").to_pylist()):
                row = flat[ends[i] : ends[i + 1]]
                held.setdefault(len(row), []).append((own, row))
                if len(held[len(row)]) == size:
                    yield block(len(row))
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(run, "dim int, n int, ids binary, vecs binary")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of x to the same row of y, component after component.

    Where the squares leave the range of a double, the differences are scaled by the largest of them first.
    """
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            step = x[:, j] - y[:, j]
            total += step * step
        out = np.sqrt(total)
        bad = np.flatnonzero(~np.isfinite(total) | (total < TINY))
        half = x[bad] / 2 - y[bad] / 2  # may not overflow
        most = np.maximum(np.abs(half).max(axis=1, initial=0), 5e-324)
        out[bad] = 2 * np.sqrt(((half / most[:, None]) ** 2).sum(axis=1)) * most
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query of a tile, its k nearest (distance, id) in the tile."""
    # bounds are taken of vectors scaled by a power of two, so that no square overflows; what underflows then is in the slack
    unit = 2.0 ** -int(np.frexp(max(np.abs(q).max(), np.abs(c).max()))[1] // 2)
    qc, qs, qr = quantised(q * unit * unit)
    cc, cs, cr = quantised(c * unit * unit)
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    dots = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    norms = lambda codes, scale: (codes.astype(np.int64) ** 2).sum(axis=1) * scale**2
    q2, c2 = norms(qc, qs), norms(cc, cs)
    near = np.sqrt(np.maximum(q2[:, None] + c2[None, :] - 2 * dots, 0))
    slack = qr[:, None] + cr[None, :] + 1e-7 * (np.sqrt(q2)[:, None] + np.sqrt(c2)[None, :]) + LOST  # rounding of the line above, too
    low, high = near - slack, near + slack
    own = q_ids[:, None] == c_ids[None, :]
    high[own] = np.inf
    bound = np.partition(high, k - 1, axis=1)[:, k - 1] if c.shape[0] > k else np.full(len(q), np.inf)
    rows, at = np.nonzero(~(low > bound[:, None]) & ~own)  # a bound that is no number keeps its pair
    score = np.concatenate([np.zeros(0), *(distances(q[rows[i : i + PAIRS]], c[at[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS))])
    ids = c_ids[at]
    order = np.lexsort((ids, score, rows))
    rows, score, ids = rows[order], score[order], ids[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    last = np.searchsorted(rows, np.arange(len(q)), "right")
    for i in range(len(q)):
        a, b = first[i], min(last[i], first[i] + k)
        yield i, list(zip(score[a:b].tolist(), ids[a:b].tolist()))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each vector whose id is divisible by ``every``."""
    n = partitions(vectors.sparkSession)
    rows = max(1, round((n / max(1, every)) ** 0.5))  # the grid's cells are about square, in vectors
    columns = max(1, n // rows)
    sound = usable(vectors)
    cell = lambda salt, most: F.pmod(F.xxhash64("ids", F.lit(salt)), F.lit(most)).cast("int")
    every_one = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    asked = blocks(sound.where(F.col("vec_id") % every == 0).repartition(max(1, n // 4)), QUERY_BLOCK)
    queries = asked.select("dim", cell("q", rows).alias("g"), every_one(columns).alias("s"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    offered = blocks(sound, CANDIDATE_BLOCK)
    candidates = offered.select("dim", cell("c", columns).alias("s"), every_one(rows).alias("g"), F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    pairs = candidates.join(queries.hint("merge"), ["dim", "g", "s"])  # a row is a block; each pair of blocks is one tile, in one cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(q, i, s) for q, found in heaps.items() for s, i in found]
            heaps.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                dim, q_ids, c_ids, qv, cv = (batch.column(x)[i].as_py() for x in ("dim", "q_ids", "c_ids", "q_vecs", "c_vecs"))
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                for j, found in tile(q_ids, np.frombuffer(qv).reshape(-1, dim), c_ids, np.frombuffer(cv).reshape(-1, dim), k):
                    own = int(q_ids[j])
                    heaps[own] = heapq.nsmallest(k, heaps.get(own, []) + found)
                if len(heaps) > 50_000:
                    yield out()
        yield out()

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
