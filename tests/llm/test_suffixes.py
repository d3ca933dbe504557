import hashlib
import random

import numpy as np
import pytest

from pairlens.llm import suffixes

L = suffixes.LENGTH


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - L + 1):
                w = b[p : p + L]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - L + 1):
                if least[b[p : p + L]] < i:
                    gone[p : p + L] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def table(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(["a", "b", "c", "the ", "é", "\n", "🙂"]) for _ in range(n))
    shared = [text(rng.randint(20, 200)) for _ in range(12)]
    rows = []
    for i in range(120):
        t = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s))
            t += s[a : a + rng.randint(10, 200)] + text(rng.choice([0, 0, 1, 30]))
        rows.append((i * 2, t))
    rows += [(500 + i, rows[5][1]) for i in range(6)] + [(600, "a" * 3000), (601, "a" * 2000 + "b" * 60), (602, "\0" * 80), (603, "\0" * 90 + "x"), (604, "a" * 49), (605, ""), (606, None)]
    rows += [(None, rows[5][1]), (700, shared[0] * 3), (700, shared[1] * 3), (700, shared[0] * 3), (10, rows[6][1]), (-3, rows[9][1][10:])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(suffixes, "BROADCAST_BYTES", -1)
    rows = table(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(5)
    assert sorted((tuple(r) for r in suffixes.digests(df).collect()), key=str) == brute(rows)
    assert suffixes.digests(df.limit(0)).collect() == []


def test_loser_tree():
    rng = np.random.default_rng(3)
    runs, every = [], []
    data = np.tile(rng.integers(97, 99, 300).astype(np.uint8), 8)
    data[rng.integers(0, len(data), 60)] = 0
    position, _, first, last, _ = suffixes.anchors(data, np.array([0, 500, 1000, len(data)]))
    every_row = suffixes.suffix_rows(data, position, first, last)
    for i in range(7):
        rows = every_row[rng.random(len(every_row)) < 0.4]
        rows = np.unique(rows[suffixes.sorted_run(rows)], axis=0)
        assert suffixes.sorted_run(rows).tolist() == list(range(len(rows)))
        coded = suffixes.front_coded(rows)
        assert (suffixes.decoded(*coded) == rows).all()
        runs.append(suffixes.Run(*coded))
        every += [bytes(x) for x in rows]
    for row, a, b in zip(every_row, first, last):
        assert suffixes.full_text(bytes(row)) == bytes(data[a : b + L])
    got = list(suffixes.loser_tree(runs))
    assert [x[2] for x in got] == sorted(every)
    for a, b in zip(got, got[1:]):
        assert b[3] == next((i for i, (x, y) in enumerate(zip(a[2], b[2])) if x != y), suffixes.ROW)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 100, 60).astype(np.uint8), text, text[:300], rng.integers(97, 100, 30).astype(np.uint8)])
    offsets = np.array([0, 10, 460, 790])
    position, _, first, last, owner = suffixes.anchors(data, offsets)
    windows = {}
    for p, a, b, o in zip(position, first, last, owner):
        assert offsets[o] <= a and b + L <= offsets[o + 1]
        for w in range(a, b + 1):
            windows.setdefault(bytes(data[w : w + L]), set()).add(int(p - w))
    assert sum(len(x) for x in windows.values()) == len(windows)
    assert len(windows) == len({bytes(data[p : p + L]) for o, e in zip(offsets, offsets[1:]) for p in range(o, e - L + 1)})
