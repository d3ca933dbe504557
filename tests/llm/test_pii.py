import hashlib
import math
import random
import re
import time

import numpy as np

from pairlens.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = "".join(re.findall("[0-9]", m[0]))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(RULES).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def texts():
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (988) 555-2485", "+", "-", " ", "x", "é", "9", "12", "5.6.7.8.9", "(", ")", "Mr. Smith", "me [at] x [dot] com", "555-123-4567", "123-45-6789", "０１２", "٣"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + ["", None, "mail me: bosbt.42@mail8.example.com or call 212-555-1234", "1" * 60_000, "+" + "1 " * 40_000, "a." * 50_000 + "@", "@" * 50_000, "a@" * 30_000 + "b.c"]


def test_base_is_the_rule(spark):
    rows = [(i, x, "w") for i, x in enumerate(texts())] + [(None, "a@b.c", None)]
    began = time.time()
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert time.time() - began < 60
    for i, text, _ in rows:
        if len(text or "") > 10_000 and "1" not in text[:3]:
            continue
        want = brute(text) if text and len(text) < 10_000 else None
        if want is None:
            continue
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k + ":") for x in want) for k in RULES)
        assert set(want) <= set(got[i].spans.split(","))
    assert got[1500].base_sha256 == got[1501].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(df.limit(0)).collect() == []


def test_method_learns_reliability():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.6, 0.85, 0.8])
    votes = np.where(rng.random((4000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    likely, chance, prior = pii.reliabilities(patterns, counts.astype(float))
    assert np.all(np.abs(chance[:, 0, 2] - right) < 0.06) and abs(prior[0] - 0.4) < 0.05


def test_masking():
    w = pii.train([])
    assert pii.masked("call +1 (988) 555-2485 now a@b.co", pii.accepted("call +1 (988) 555-2485 now a@b.co", w)) == "call <PHONE> now <EMAIL>"
    assert pii.masked("nothing here", []) == "nothing here"


def plain_candidates(text):
    """(kind, start, end, base) of every candidate, by searching with every rule."""
    rows = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = "".join(re.findall("[0-9]", m[0]))
            holds = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if kind != "card" or m.end() - m.start() >= 7:
                rows.append((kind, m.start(), m.end(), 1 if holds else -1))
    held = [(a, b) for _, a, b, base in rows if base == 1]
    others = [("email", pii.WRITTEN_OUT), *pii.OTHER, ("person", re.compile(pii.PERSON))]
    for kind, rule in others:
        rows += [(kind, m.start(), m.end(), 0) for m in rule.finditer(text) if kind != "secret" or (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))]
    out = {}
    for kind, a, b, base in rows:
        if base == 1 or not any(a < y and x < b for x, y in held):
            out.setdefault((kind, a, b), base)
    return [(*k, base) for k, base in out.items()]


def plain_accepted(texts):
    """Candidates and base matches that stay, span by span: expectation-maximisation and gradient steps over every single span."""
    spans = [(n, kind, a, b, base, pii._votes(t, kind, a, b, base)) for n, t in enumerate(texts) for kind, a, b, base in plain_candidates(t)]
    kinds = pii.KINDS + pii.MORE_KINDS
    start = [[0.15, 0.25, 0.6], [0.6, 0.25, 0.15]]
    chance = [[list(start[0]), list(start[1])] for _ in pii.LABELERS]
    prior = dict.fromkeys(kinds, 0.5)
    for _ in range(60):
        likely = []
        for _, kind, _, _, _, votes in spans:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(chance[i][0][v + 1] / chance[i][1][v + 1]) for i, v in enumerate(votes))
            likely.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        for kind in kinds:
            own = [p for p, x in zip(likely, spans) if x[1] == kind]
            prior[kind] = max(0.02, min(0.98, (sum(own) + 1) / (len(own) + 2)))
        for i in range(len(pii.LABELERS)):
            for side in (0, 1):
                mass = [1 - p if side else p for p in likely]
                chance[i][side] = [(sum(m for m, x in zip(mass, spans) if x[5][i] == v) + 1) / (sum(mass) + 3) for v in (-1, 0, 1)]
    x = np.zeros((len(spans), 7 + len(kinds) + 3 * len(pii.LABELERS)))
    for i, (_, kind, a, b, _, votes) in enumerate(spans):
        x[i, pii.features(kind, votes, min(5, (b - a) // 6))] = 1
    w, momentum = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-x @ w))
        momentum = 0.95 * momentum - (x.T @ (p - likely) / len(spans) + pii.RIDGE * w)
        w = w + 0.5 * momentum
    order = kinds.index
    out = {}
    for i, (n, kind, a, b, base, _) in enumerate(spans):
        if base == 1 or x[i] @ w >= 0:
            out.setdefault(n, []).append((a, order(kind), b, f"{kind}:{a}:{b}"))
    return {n: ",".join(y[3] for y in sorted(found)) for n, found in out.items()}


def test_all_spans_are_the_plain_method_s(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = ["call 0049 30 1234567 or (212) 555-1234", "write to jane.roe at mail dot example dot com", "x [at] example [dot] org", "card 4111/1111/1111/1111 expires", "auth sk-A1b2C3d4E5f6G7h8I9j0", "build 20240101-20240131 ok", "Dr. Jones", "id 123-45-6789", None, "", "5.6.7.8.9 1234567890123"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(made)] + [(0, "again a@b.c")]
    got = [(r.doc_id, r.spans) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    found = plain_accepted([t or "" for _, t in rows])
    want = [(i, found.get(n, "")) for n, (i, _) in enumerate(rows)]
    assert sorted(got) == sorted(want)
    assert sum("secret:" in s for _, s in got) > 10 and sum("phone:" in s for i, s in got if i == 10_000) == 1


def test_planted_tokens_are_found_and_prose_left_alone(spark):
    """Added spans against what is planted: keys after token =, in texts without other numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    rows = docs.collect()
    planted = {r.doc_id for r in rows if re.search('token = "[0-9a-f]{40}"', r.text or "")}
    assert planted and all("secret:" in got[i] for i in planted)
    assert all("secret:" not in got[r.doc_id] for r in rows if r.doc_id not in planted)
    assert all(not got[r.doc_id] for r in rows if not re.search("[0-9]", r.text or ""))


def test_very_long_texts_take_linear_time(spark):
    began = time.time()
    rows = list(enumerate(["ab1" * 300_000, "a1-" * 200_000, "0 at " * 100_000, "12/" * 200_000, "a dot " * 100_000, "00 11 " * 100_000]))
    assert len(pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 6
    assert time.time() - began < 60
