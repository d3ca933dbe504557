r"""Personal data by weak supervision (operator 8).

The base finds four kinds by fixed rules. Around them stand candidates: spans that look like personal data but that no
rule settles (written-out addresses, telephone numbers without +, numbers that fail a base rule, cards with other separators, keys and
tokens, titles with a name). Labelers vote on each candidate and each base match alike: the base rule, a strict shape (regex), lists of
known words and prefixes (gazetteer), cue words before it (context), its check digits, sizes or variety of characters, and whether it is
torn out of a longer token. Counts of vote patterns over all documents (their number is bounded by kinds and votes, not by the data) go
through expectation-maximisation, which estimates how reliable each labeler is, how common true spans of each kind are and how likely each
pattern; nothing is taken as settled. A logistic span classifier is then fitted on those likelihoods, with kind, votes and shape as features.
Candidates that it scores at 0.5 or more join the base's spans, which stay by contract.

Defined results: a null text is empty; rows are judged one by one, so repeated rows give equal results; a null doc_id
stays null; columns besides doc_id and text are dropped; an empty table gives an empty table, and a table without
candidates trains nothing and adds nothing; very long texts are read whole, by rules that take linear time; of candidates with the same
kind, start and end one stays, and a candidate that overlaps a base match is dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id_text, joined_bytes, released, slices

# The kinds in their order, and the base rules.
KINDS = ["email", "ip", "card", "phone"]
#: A local part never holds @, so one try for each @, from the earliest start, finds what a search from the left would.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+$")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Possessive and from the start of a run of digits only: a try that fails within a run fails for all of it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Further kinds and words of the labelers.
MORE_KINDS = ["id", "person", "secret"]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
CUES = {
    "email": ["mail", "e-mail", "email", "correo", "courriel", "contact"],
    "ip": ["ip", "address", "host", "server", "adresse"],
    "card": ["card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"],
    "phone": ["phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "téléphone", "teléfono"],
    "id": ["ssn", "passport", "id", "ausweis", "dni", "iban", "social"],
    "person": ["dear", "name", "by", "from", "liebe", "cher", "querido"],
    "secret": ["token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "auth", "bearer", "credential"],
}
SECRET_PREFIXES = ["sk-", "pk-", "ghp_", "gho_", "xoxb-", "xoxp-", "AKIA", "AIza"]
LABELERS = ["base rule", "strict shape", "gazetteer", "context", "check", "edges"]
CARD_PREFIXES = ["3", "4", "5", "6"]
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "eu", "io"]

#: Ridge of the span classifier.
RIDGE = 1e-4
#: Candidates that no base rule takes, by kind; all of them run in linear time on any text.
WRITTEN_OUT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
    r"(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}"
    r"|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,5})"
)
AT_HINTS = ["[at]", "(at)", "{at}", " dot "]
OTHER = [
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.-])00[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9./_-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/-]{16})[A-Za-z0-9_+/-]{1,128}+(?![A-Za-z0-9_+/-])")),
]
_LETTER = re.compile("[A-Za-z]")
PERSON = r"\b(?:" + "|".join(TITLES) + r")\.?\x20[A-ZÀ-Þ][\w'-]{1,40}"
_PERSON = re.compile(PERSON)
#: For pre-selection over whole columns; finds every text that PERSON may match.
_PERSON_HINT = "(?:" + "|".join(TITLES) + r")\.? ."
_AT_HINT = "|".join(map(re.escape, AT_HINTS))


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    shape: int


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_and_failing(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, holds) of each match of a base rule."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    if DIGITS.search(text):
        for m in IP.finditer(text):
            yield "ip", m.start(), m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 7:
                continue
            digits = _digits(m[0])
            yield "card", m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in PHONE.finditer(text):
                yield "phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def _varied(found: str) -> bool:
    """Whether the characters are as mixed as a random key's: three bits each or more."""
    n = len(found)
    return -sum(x / n * np.log2(x / n) for x in Counter(found).values()) >= 3


def _votes(text: str, kind: str, start: int, end: int, base: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 nothing to say, of each labeler. base: 1 if a base rule holds, -1 if it fails, 0 if there is none."""
    found = text[start:end]
    digits = _digits(found) if kind not in ("person", "secret") else ""
    if kind == "email":
        strict = 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63}){1,8}", found) else 0
        known = 1 if re.split(r"[^a-z]", found.strip("]})").lower())[-1] in TOP_DOMAINS else 0
        check = 1 if len(found) <= 254 else -1
    elif kind == "ip":
        strict = 1 if re.fullmatch(r"[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}", found) else -1
        known = 0
        check = 1 if all(len(x) <= 3 and int(x) <= 255 for x in found.split(".")) else -1
    elif kind == "card":
        strict = 1 if re.fullmatch(r"[0-9]{13,19}|([0-9]{4}[ ./_-]){3}[0-9]{1,7}", found) else -1
        known = 1 if found[0] in CARD_PREFIXES else -1
        check = 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
    elif kind == "phone":
        strict = 1 if re.fullmatch(r"(\+|00)[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}([ .-]?[0-9]{2,4}){1,4}|(\([0-9]{3}\) ?|[0-9]{3}[. -])[0-9]{3}[. -][0-9]{4}", found) else -1
        known = 1 if found[0] == "+" and found[1] != "0" else 0
        check = 1 if 9 <= len(digits) <= 15 else -1
    elif kind == "id":
        strict, known, check = 1, 0, -1 if found[:3] in ("000", "666") or found[0] == "9" else 1
    elif kind == "secret":
        strict = 1 if re.fullmatch(r"[0-9a-f]{20,}|[0-9A-F]{20,}|[A-Za-z0-9_+/-]{20,}", found) else -1
        known = 1 if found.startswith(tuple(SECRET_PREFIXES)) else 0
        check = 1 if _varied(found) else -1
    else:
        strict, known, check = 0, 1, 1 if found[-1:].isalpha() else -1
    before = text[max(0, start - 40) : start].lower()
    words = set(re.findall(r"[\w-]+", before)[-4:])
    cue = 1 if words.intersection(CUES[kind]) else -1 if any(words.intersection(v) for k, v in CUES.items() if k != kind) else 0
    torn = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "._%+-@/")) or (end < len(text) and (text[end].isalnum() or text[end] in "@_%/"))
    return base, strict, known, cue, check, -1 if torn else 1


def spans_of(text: str) -> list[Span]:
    """Base matches that hold, and candidates that overlap none of them."""
    rows = [(kind, a, b, 1 if holds else -1) for kind, a, b, holds in base_and_failing(text)]
    if any(x in text for x in AT_HINTS):
        rows += [("email", m.start(), m.end(), 0) for m in WRITTEN_OUT.finditer(text)]
    if DIGITS.search(text):
        for kind, rule in OTHER:
            rows += [(kind, m.start(), m.end(), 0) for m in rule.finditer(text) if kind != "secret" or (DIGITS.search(m[0]) and _LETTER.search(m[0]))]
    if any(x in text for x in TITLES):
        rows += [("person", m.start(), m.end(), 0) for m in _PERSON.finditer(text)]
    held = sorted((a, b) for _, a, b, base in rows if base == 1)
    starts = [a for a, _ in held]
    furthest = np.maximum.accumulate([b for _, b in held]).tolist() if held else []
    out = {}
    for kind, a, b, base in rows:
        i = int(np.searchsorted(starts, b)) if held else 0
        if base < 1 and i and furthest[i - 1] > a:
            continue
        shape = min(5, (b - a) // 6)
        if (kind, a, b) not in out:
            out[kind, a, b] = Span(kind, a, b, base == 1, _votes(text, kind, a, b, base), shape)
    return list(out.values())


def _flagged(column: pa.Array) -> np.ndarray:
    """Rows that may hold a span: a digit, an @, a written-out at, or a title."""
    data, offsets = joined_bytes(column)
    hit = ((data >= 48) & (data <= 57)) | (data == 64)
    total = np.concatenate([[0], np.cumsum(hit)])
    rows = total[offsets[1:]] > total[offsets[:-1]]
    more = pc.match_substring_regex(column, _PERSON_HINT + "|" + _AT_HINT)
    return rows | pc.fill_null(more, False).to_numpy(zero_copy_only=False)


def vote_counts(docs: DataFrame) -> DataFrame:
    """kind, votes (comma-joined), shape, n: how often each pattern stands, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in slices(batches):
            column = batch.column("text")
            for i in np.flatnonzero(_flagged(column)).tolist():
                for x in spans_of(column[i].as_py()):
                    count[x.kind, ",".join(map(str, x.votes)), x.shape] += 1
        rows = [(*k, n) for k, n in count.items()]
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)], ["kind", "votes", "shape", "n"])

    found = doc_id_text(docs).mapInArrow(released(run), "kind string, votes string, shape int, n long")
    return found.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, weight: np.ndarray, kind: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likelihood of each pattern; of each labeler, the chance of each vote (-1, 0, 1) given a true and a false span; the prior of each kind."""
    patterns, labelers = votes.shape
    kind = np.zeros(patterns, np.int64) if kind is None else kind
    chance = np.tile(np.array([[0.15, 0.25, 0.6], [0.6, 0.25, 0.15]]), (labelers, 1, 1))
    prior, likely = np.full(kind.max() + 1, 0.5), np.full(patterns, 0.5)
    for _ in range(rounds):
        logs = np.stack([np.log(chance[np.arange(labelers)[None, :], side, votes + 1]).sum(axis=1) for side in (0, 1)])
        gap = np.clip(logs[0] - logs[1] + np.log(prior / (1 - prior))[kind], -30, 30)
        likely = 1 / (1 + np.exp(-gap))
        sides = np.stack([weight * likely, weight * (1 - likely)])
        true = np.bincount(kind, weights=sides[0], minlength=len(prior))
        prior = np.clip((true + 1) / (np.bincount(kind, weights=weight, minlength=len(prior)) + 2), 0.02, 0.98)
        for v in range(3):
            chance[:, :, v] = ((votes + 1 == v).astype(float).T @ sides.T + 1) / (sides.sum(axis=1) + 3)
    return likely, chance, prior


def features(kind: str, votes: tuple[int, ...], shape: int) -> list[int]:
    """Places of the ones in a span's feature vector."""
    kinds = KINDS + MORE_KINDS
    return [0, 1 + kinds.index(kind), 1 + len(kinds) + shape, *(7 + len(kinds) + 3 * i + v + 1 for i, v in enumerate(votes))]


def train(counts: list[tuple[str, str, int, int]], rounds: int = 40) -> np.ndarray:
    """Weights of the span classifier, from the counts of all vote patterns."""
    size = 7 + len(KINDS + MORE_KINDS) + 3 * len(LABELERS)
    if not counts:
        return np.zeros(size) - 1e-9
    counts = sorted(counts)
    votes = np.array([[int(v) for v in x[1].split(",")] for x in counts])
    weight = np.array([x[3] for x in counts], float)
    likely, _, _ = reliabilities(votes, weight, np.array([(KINDS + MORE_KINDS).index(x[0]) for x in counts]))
    x = np.zeros((len(counts), size))
    for i, (kind, _, shape, _) in enumerate(counts):
        x[i, features(kind, tuple(votes[i].tolist()), shape)] = 1
    # Newton's method, with a ridge
    w, share = np.zeros(size), weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - likely)) + RIDGE * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(size)
        w -= np.linalg.solve(curve, gradient)
    return w


def model(docs: DataFrame) -> np.ndarray:
    """The trained weights; what comes to the driver is a table of vote patterns, bounded by their kinds."""
    return train([tuple(x) for x in vote_counts(docs).collect()])


def accepted(text: str, weights: np.ndarray) -> list[Span]:
    return [x for x in spans_of(text) if x.base or weights[features(x.kind, x.votes, x.shape)].sum() >= 0]


def _listed(spans: list[Span]) -> str:
    order = KINDS + MORE_KINDS
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in sorted(spans, key=lambda x: (x.start, order.index(x.kind), x.end)))


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text."""
    weights = model(docs) if weights is None else weights
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            n = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            digest, listed = [nothing] * batch.num_rows, [""] * batch.num_rows
            for i in np.flatnonzero(_flagged(column)).tolist():
                spans = accepted(column[i].as_py(), weights)
                base = [x for x in spans if x.base]
                for x in base:
                    n[i, KINDS.index(x.kind)] += 1
                digest[i] = hashlib.sha256(_listed(base).encode()).hexdigest()
                listed[i] = _listed(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[:, j]) for j in range(4)), pa.array(digest), pa.array(listed)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return doc_id_text(docs).mapInArrow(released(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind, in angle brackets."""
    out, done = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= done:
            out += [text[done : x.start], f"<{x.kind.upper()}>"]
        done = max(done, x.end)
    return "".join(out) + text[done:]


def mask_texts(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows with a text column: the same rows with masked texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            rows = np.flatnonzero(_flagged(column))
            new = {i: masked(text, accepted(text, weights)) for i in rows.tolist() for text in [column[i].as_py()]}
            if new:
                values = pa.array([new.get(i) for i in range(batch.num_rows)], column.type)
                column = pc.if_else(pa.array(np.isin(np.arange(batch.num_rows), rows)), values, column)
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([column if i == at else x for i, x in enumerate(batch.columns)], schema=batch.schema)

    return released(run)
