"""Chat formatting by columnar byte assembly (operator 3).

Each turn becomes ``### role: text </turn>`` and a line feed. In a text, a backslash goes before every backslash, every
``###`` and every ``</turn>``; in a role also before every colon. So the template's own marks are exactly those that no
backslash stands before, and taking one backslash away from each escape gives the turn back. The bytes of a batch are
assembled in numpy: lengths of all segments, their cumulative offsets, one scatter of headers, contents and escapes into
one preallocated buffer, which the Arrow column then shares.

A conversation comes as one or more chunks of whole turns, each of about ``CHUNK`` bytes at most (a longer turn stands
alone), so that no row grows with a conversation. With each chunk come the spans of its loss mask, in code points: the
assistant's texts.

Defined results: null texts and roles are empty; rows of a null conv_id form one conversation with a null id; ties of
turn go by role, then text, nulls first; a null turn comes before the others; repeated rows are repeated turns; columns
besides the four are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, partitions, slices

CHUNK = 1 << 20
LEARNT = "assistant"
OPEN, CLOSE, MARK, END, ESCAPE = "### ", ": ", "###", "</turn>", "\\"
FOOTER = f" {END}\n"
CHUNKS = "conv_id long, chunk long, formatted string, loss_start array<long>, loss_end array<long>"


def _found(data: np.ndarray, what: str) -> np.ndarray:
    """Whether ``what`` starts at each byte."""
    word = np.frombuffer(what.encode(), np.uint8)
    out = np.zeros(len(data), bool)
    if len(data) >= len(word):
        n = len(data) - len(word) + 1
        hit = data[:n] == word[0]
        for i in range(1, len(word)):
            hit &= data[i : i + n] == word[i]
        out[:n] = hit
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def header(role: str) -> str:
    escaped = role.replace(ESCAPE, ESCAPE * 2).replace(":", ESCAPE + ":")
    return OPEN + re.sub(f"(?={MARK})|(?={END})", lambda _: ESCAPE, escaped) + CLOSE


def assemble(roles: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all formatted turns; start of each turn (one more at the end); start and end of each text in them."""
    data, offsets = joined_bytes(texts)
    escaped = data == ord(ESCAPE)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    for word in (MARK, END):
        at = np.flatnonzero(_found(data, word))
        escaped[at[at + len(word) <= row_end[at]]] = True
    before = np.concatenate([[0], np.cumsum(escaped)])
    text_len = np.diff(offsets) + before[offsets[1:]] - before[offsets[:-1]]
    known = {x: header(x).encode() for x in dict.fromkeys(roles)}
    place = dict(zip(known, np.cumsum([0, *(len(x) for x in known.values())]).tolist()))
    head_len = np.array([len(known[x]) for x in roles], np.int64)
    head_at = np.array([place[x] for x in roles], np.int64)
    footer = np.frombuffer(FOOTER.encode(), np.uint8)
    starts = np.concatenate([[0], np.cumsum(head_len + text_len + len(footer))])
    out = np.empty(starts[-1], np.uint8)
    heads = np.frombuffer(b"".join(known.values()), np.uint8)
    out[_ranges(starts[:-1], head_len)] = heads[_ranges(head_at, head_len)]
    text_at = starts[:-1] + head_len
    # a byte lands after its row's start, the bytes before it in the row and the escapes up to it
    to = np.repeat(text_at - offsets[:-1] - before[offsets[:-1]], np.diff(offsets)) + np.arange(len(data)) + before[1:]
    out[to] = data
    out[to[escaped] - 1] = ord(ESCAPE)
    out[_ranges(text_at + text_len, np.full(len(roles), len(footer), np.int64))] = np.tile(footer, len(roles))
    return out, starts, text_at, text_at + text_len


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Chunks of the formatted conversations: conv_id, chunk (from 0), formatted, loss_start, loss_end.

    The chunks of a conversation are in one partition, one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = (None, None), -1
        for batch in slices(batches, most=4 << 20):
            ids = batch.column("conv_id").to_pylist()
            roles = [x or "" for x in batch.column("role").to_pylist()]
            out, starts, text_start, text_end = assemble(roles, batch.column("text"))
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            cuts, numbers, kept = [], [], []
            for i, own in enumerate(ids):
                new = last != ("is", own)
                if new or not cuts or starts[i + 1] - starts[cuts[-1]] > CHUNK:
                    chunk = 0 if new else chunk + 1
                    last = ("is", own)
                    cuts.append(i)
                    numbers.append(chunk)
                    kept.append(own)
            first = starts[cuts]
            learnt = np.array([x == LEARNT for x in roles])
            chunk_of = np.repeat(np.arange(len(cuts)), np.diff([*cuts, len(ids)]))[learnt]
            sizes = np.concatenate([[0], np.cumsum(np.bincount(chunk_of, minlength=len(cuts)))]).astype(np.int32)
            spans = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(points[x[learnt]] - points[first[chunk_of]])) for x in (text_start, text_end)]
            texts = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(first, starts[-1]).astype(np.int64)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(numbers, pa.int64()), texts.cast(pa.string()), *spans], ["conv_id", "chunk", "formatted", "loss_start", "loss_end"])

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    rows = conversations.select(*columns).repartition(partitions(conversations.sparkSession), "conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, CHUNKS)


def turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn, read back from formatted bytes."""
    data = np.frombuffer(formatted, np.uint8)
    slash = data == ord(ESCAPE)
    at = np.arange(len(data))
    run_start = np.maximum.accumulate(np.where(slash, -1, at)) + 1  # of the run of backslashes that a byte is in
    active = slash & ((at - run_start) % 2 == 0)
    free = np.concatenate([[True], ~active[:-1]])
    opens = np.flatnonzero(_found(data, OPEN) & free)
    ends = np.flatnonzero(_found(data, END) & free)
    colons = np.flatnonzero(_found(data, CLOSE) & free)
    colons = colons[np.searchsorted(colons, opens)]
    plain = data[~active].tobytes()
    to = np.concatenate([[0], np.cumsum(~active)])
    marks = zip(to[opens + len(OPEN)].tolist(), to[colons].tolist(), to[colons + len(CLOSE)].tolist(), to[ends - 1].tolist())
    return [(plain[a:b], plain[c:d]) for a, b, c, d in marks]


def read_back(chunks: DataFrame) -> DataFrame:
    """One row per conversation, from what format_conversations() returns: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Digests are carried from chunk to chunk, so a conversation is never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None
        unescape = re.compile(r"\\(.)", re.S).sub

        def result(rows: list[list]) -> pa.RecordBatch:
            columns = zip(*[[i, n, t.hexdigest(), lc, ls.hexdigest(), c] for i, n, t, lc, ls, c in rows])
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names)

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["chunk"] == 0:
                    if state is not None:
                        done.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = turns(row["formatted"].encode())
                state[1] += len(found)
                state[2].update(b"".join(b"%b\n%b\n" % x for x in found))
                for a, b in zip(row["loss_start"], row["loss_end"]):
                    text = unescape(r"\1", row["formatted"][a:b])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["formatted"])
            if done:
                yield result(done)
        if state is not None:
            yield result([state])

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
