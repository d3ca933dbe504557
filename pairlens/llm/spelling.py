"""Spelling variants: words that differ by one code point, found with forward and backward minimal automata.

Words are counted in the map tasks first. Two words that differ by one inserted, deleted or replaced code point, the shorter one of m code
points, share either their first floor(m / 2) code points or their last m - floor(m / 2). So each word is dealt, as one of m and as the longer one of
m - 1, to the group of its first half and to the group of its last half; a task takes whole groups, up to a bounded number of words
at a time, and builds of them one minimal acyclic automaton of the words and one of the reversed words. A word matches its half exactly, then
completes with one error; a state counts the words below it, so a path gives its word's number in sorted order, and counts are read by number.

A group beyond ``most`` words is halved again: its words share one half, so what remains of two near ones shares a half of that. This goes
on until a group is small or at most two code points remain, so no group is larger than the alphabet allows; each halving of such a group doubles its
rows. A pair is found once: in the forward group if its common beginning reaches the half, else in the backward one.

Defined results: a null text has no words; a null doc_id counts as an empty one in the hash; repeated rows count as often as they
stand; columns other than doc_id and text are ignored. Texts and words of any length are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_id_text, released, slices, written

LEAST_CHARS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Distinct words that a map task counts before it passes them on.
HELD = 200_000
#: Words of one automaton, beyond which the next group begins another; and of a group, beyond which it is halved.
CHUNK, MOST = 20_000, 20_000
#: No bound on the common beginning.
FAR = (1 << 31) - 1


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: the words of at least so many code points and occurrences.

    A run of letters, A-Z lower-cased, loses the code point h % length where ``every`` divides h, the crc32 of ``<doc_id>:<run>``.
    """
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            found = sorted(held.items())
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices([batch]):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    begin = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                    lowered = (text or "").encode().lower().decode()  # of bytes, so A-Z only
                    for word, n in Counter(runs.findall(lowered)).items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_chars:
                                continue
                        held[word] += n
                if len(held) > HELD:
                    yield from out()
                    held.clear()
        yield from out()

    counted = doc_id_text(docs).mapInArrow(released(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words. ``edges[s]`` maps a code point to the next state, in order; ``final[s]``; ``below[s]`` is
    the number of words from s on; ``skip[s][c]`` the number of them before those through c, so that a path's sum is its word's number."""

    def __init__(self, sorted_words: Iterable[str]) -> None:
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.below: list[int] = []
        self.skip: list[dict[str, int]] = []
        known: dict = {}
        path: list[list] = [[{}, False]]  # the last word's states, which may still change

        def settled(state: list) -> int:
            key = (state[1], tuple(state[0].items()))
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.edges)
                n, skip = int(state[1]), {}
                for c, t in state[0].items():
                    skip[c] = n
                    n += self.below[t]
                self.edges.append(state[0])
                self.final.append(state[1])
                self.below.append(n)
                self.skip.append(skip)
            return at

        last = ""
        for word in sorted_words:
            common, most = 0, min(len(word), len(last))
            while common < most and word[common] == last[common]:
                common += 1
            while len(path) > common + 1:
                state = path.pop()
                path[-1][0][last[len(path) - 1]] = settled(state)
            path.extend([{}, False] for _ in range(len(word) - common))
            path[-1][1] = True
            last = word
        while len(path) > 1:
            state = path.pop()
            path[-1][0][last[len(path) - 1]] = settled(state)
        self.root = settled(path[0])

    def walk(self, state: int, number: int, word: str, i: int) -> tuple[int, int] | None:
        """The state behind word[i:] and the number so far; None if it isn't there."""
        edges, skip = self.edges, self.skip
        for k in range(i, len(word)):
            c = word[k]
            t = edges[state].get(c)
            if t is None:
                return None
            number += skip[state][c]
            state = t
        return state, number

    def near(self, word: str, half: int) -> Iterator[int]:
        """The numbers of the words that begin like the first ``half`` code points and, behind them, have one code point replaced or one more."""
        found = self.walk(self.root, 0, word[:half], 0)
        for i in range(half, len(word) + 1):
            if found is None:
                return
            state, number = found
            own = word[i] if i < len(word) else None
            for c, t in self.edges[state].items():
                first = number + self.skip[state][c]
                if own is not None and c != own:  # replaced
                    end = self.walk(t, first, word, i + 1)
                    if end and self.final[end[0]]:
                        yield end[1]
                end = self.walk(t, first, word, i)  # one more before word[i]
                if end and self.final[end[0]]:
                    yield end[1]
            if own is not None:
                t = self.edges[state].get(own)
                found = None if t is None else (t, number + self.skip[state][own])


def common_beginning(a: str, b: str) -> int:
    """How many code points two words share from the start, at most: by halving, as slices compare fast."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


PAIR = "word string, near string, near_n long"


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (back, exact, m, least, beyond, word, n, group), sorted by group: both ways of each pair (word, near) of whole groups.

    exact: how many code points a group shares, from the start or, with back, from the end.
    """

    def chunks() -> Iterator[list[list[tuple]]]:
        groups: list[list[tuple]] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("group", "back", "exact", "m", "least", "beyond", "word", "n"))):
                if row[0] != last:
                    if groups and len(groups[-1]) == 1:  # a word alone
                        size -= len(groups.pop())
                    if size >= CHUNK:
                        yield groups
                        groups, size = [], 0
                    groups.append([])
                    last = row[0]
                groups[-1].append(row)
                size += 1
        yield groups

    out: tuple[list, list, list] = ([], [], [])

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
        for x in out:
            x.clear()
        return made

    for groups in chunks():
        for back in (False, True):
            counts: dict[str, int] = {}
            asked: set[tuple] = set()  # a word asks once, though it is in several groups
            for group in groups:
                if len(group) > 1 and group[0][1] == back:
                    for _, _, exact, m, least, beyond, word, n in group:
                        counts[word[::-1] if back else word] = n
                        if len(word) == m:
                            asked.add((word, exact, least, beyond))
            ordered = sorted(counts)
            automaton = Automaton(ordered)
            for word, exact, least, beyond in asked:
                turned = word[::-1] if back else word
                for number in set(automaton.near(turned, exact)):
                    found = ordered[number]
                    near = found[::-1] if back else found
                    if len(near) == len(word) and near < word:
                        continue  # it is in the same group, and asks for this pair itself
                    if least <= common_beginning(word, near) < beyond:
                        n, near_n = counts[turned], counts[found]
                        for x, y in ((word, (near, near_n)), (near, (word, n))):
                            out[0].append(x)
                            out[1].append(y[0])
                            out[2].append(y[1])
                if len(out[0]) >= 10_000:
                    yield batch_of()
    if out[0]:
        yield batch_of()


def _halves(rows: DataFrame) -> DataFrame:
    """Each group's rows, dealt to the groups of the halves of what remains of its words between what all of them share.

    start and end: how many code points the group shares; beyond: pairs whose common beginning is that long belong to another group.
    """
    rest = F.col("m") - F.col("start") - F.col("end")
    half = F.floor(rest / 2).cast("int")

    def side(back: bool) -> Column:
        start = F.col("start") if back else F.col("start") + half
        end = F.col("end") + rest - half if back else F.col("end")
        beyond = F.least("beyond", F.col("start") + half) if back else F.col("beyond")
        return F.struct(start.alias("start"), end.alias("end"), F.col("start").alias("least") if back else start.alias("least"), beyond.alias("beyond"), F.lit(back).alias("back"))

    dealt = rows.select("word", "n", "m", F.explode(F.array(side(False), side(True))).alias("_s")).select("word", "n", "m", "_s.*")
    shared = F.struct("back", "m", "start", "end", "beyond", F.substring("word", F.lit(1), F.col("start")).alias("first"), F.when(F.col("end") > 0, F.substring("word", -F.col("end"), F.col("end"))).otherwise("").alias("last"))
    return dealt.withColumn("group", shared)


def pairs(counted: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n: each pair of near words both ways, once. counted: word, n."""
    size = F.char_length("word")
    shortest = counted.agg(F.min(size)).first()[0] or 0
    lengths = F.array(size, F.when(size > shortest, size - 1))
    zero = F.lit(0)
    rows = counted.select("word", "n", F.explode(F.filter(lengths, lambda x: x.isNotNull())).alias("m"))
    groups = _halves(rows.select("*", zero.alias("start"), zero.alias("end"), F.lit(FAR).alias("beyond")))
    ready: DataFrame | None = None
    while True:
        table = written(groups, "groups")
        counts = table.groupBy("group").agg(F.count("*").alias("_n")).where((F.col("_n") > most) & (F.col("group.m") - F.col("group.start") - F.col("group.end") > 2))
        large = written(counts.select(F.col("group").alias("_g")), "large")
        if not large.take(1):
            discard(large)
            ready = table if ready is None else ready.unionByName(table)
            break
        rest = table.join(large, F.col("group") == F.col("_g"), "left_anti")
        ready = rest if ready is None else ready.unionByName(rest)
        groups = _halves(table.join(large, F.col("group") == F.col("_g"), "left_semi").select("word", "n", "m", "start", "end", "beyond"))
    exact = F.when(F.col("back"), F.col("end")).otherwise(F.col("start")).alias("exact")
    dealt = ready.select(F.col("group").cast("string").alias("group"), "back", exact, "m", "least", "beyond", "word", "n")
    return dealt.repartition("group").sortWithinPartitions("group", "word").mapInArrow(released(_matched), PAIR)


def forms(counted: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n. The form is the near word of largest n (ties: the smallest), if that is ``ratio`` times the word's own or more."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("_best"))
    joined = counted.join(best, "word", "left")
    large = -F.col("_best.less") >= ratio * F.col("n")
    known = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("_best.near")).alias("form"), F.when(large, -F.col("_best.less")).alias("form_n")), "forms")
    # a form has ratio times the count, so chains are short; each round doubles what a root reaches
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    roots = written(roots, "roots")
    while True:
        ahead = roots.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        new = written(roots.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = bool(new.where("moved").take(1))
        discard(roots)
        roots = new
        if not moved:
            break
    out = known.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The words of docs, their near words and their forms."""
    counted = written(words(docs), "words")
    return forms(counted, pairs(counted))
