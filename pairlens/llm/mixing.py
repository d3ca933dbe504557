"""Mixing sources to target weights (operator 10), with DataFrame functions only.

Domains are soft. A classifier learnt from the label table gives each document a posterior over them. A text's n-grams (runs of
letters, of digits and of marks) are hashed into PLACES; half of a bounded sample of the labelled documents gives each place its log-odds of
every domain against the others (naive Bayes over document counts); what these exceed PLAIN is summed over a text's n-grams, and the
sums' logarithms, their mean over n-grams and the text's length are its traits. On the other half, which those log-odds have not seen, a multinomial logistic regression turns traits into posteriors: Newton
steps whose gradients and curvatures are sums over that half.

A document's rate r says how often it goes into the mix. With tokens t and posteriors p, domain k gets ``got[k] = sum(t * p[k] * r)``
tokens in expectation. Of the nonnegative rates with the least squares of ``got - wanted``, those nearest to 1 (in tokens) are found by
projected gradient in its lazy form: gradient steps are summed up, and the sum is projected, ``r = max(0, 1 - p' * total)``. Steps are
taken in the metric of ``M = sum(t * p * p')``, in which the largest curvature is exactly 1, so that a step never overshoots; M of
the documents with rates above 0 points nearer to the goal, so some lengths of its step are tried with the safe one, and the best taken.
Each round is two aggregations over all documents, pre-aggregated in every task; what comes to the driver are a value for each step tried, K sums and
M, and each document's rate is an expression over its own posteriors. Targets that no rates reach end after ROUNDS rounds, as near as these came.

Defined results: a null text is empty and has no tokens; domains that no label names have no posterior and stay unfilled; null ids and
repeated rows are mixed like others (null ids share one rounding); labels that are null are left out; columns besides doc_id and text
are dropped by mix(), kept by mixed_rows(), whatever their names; without labels or documents all rates are 1; an empty table gives an empty
table; very long texts count whole; of rows that tie in the sample's order all those with the smaller hash come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, written

#: Labelled documents that the classifier is learnt from, at most; places of hashed n-grams.
SAMPLE, PLACES = 6000, 1 << 16
#: Smoothing of a place's counts; log-odds that say nothing yet; n-grams that a short text's mean is shrunk by; ridge and rounds of the regression.
SMOOTH, PLAIN, SHRINK, RIDGE, STEPS = 1.0, 1.5, 10, 1e-3, 9
ROUNDS, CLOSE_ENOUGH = 24, 1e-5
#: Lengths of a step that are tried in a round.
LENGTHS = [4.0, 2.0, 1.0, 0.5, 0.25]
#: Domains, and their shares of all tokens in the mix.
DOMAINS = ["clean", "junk", "toxic"]
TARGETS = {"clean": 0.89, "junk": 0.04, "toxic": 0.07}
GRAM = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[!-/:-@\[-`{-~]+"
#: Names of the columns that the operator adds; others of these names stay as they are, as every row is nested first.
TOKENS, RATE = "_mix_tokens", "_mix_rate"


def domain_of_label() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")


def _tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \n\t\r]+")).cast("long")


def _places(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(GRAM), F.lit(0)), lambda x: F.pmod(F.xxhash64(x), F.lit(PLACES)).cast("int"))


def _table(values: list[float]) -> Column:
    """A constant array, as one literal once it is folded."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """half, domain, text of at most SAMPLE labelled documents."""
    named = labels.select(F.col("doc_id").cast("long").alias("id"), domain_of_label().alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    sample = F.broadcast(bounded_sample(named, SAMPLE, "id", "domain"))  # SAMPLE rows at most
    half = F.pmod(F.shiftright(F.xxhash64("id", F.lit("half")), 7), F.lit(2)).cast("int").alias("half")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, F.col("doc_id") == F.col("id")).select(half, "domain", _places(F.col("text")).alias("places"))


def log_odds(rows: DataFrame, known: list[str]) -> list[list[float]]:
    """For each known domain but the first, by how much every place's log-odds against the other domains exceed PLAIN. rows: domain, places."""
    each = rows.select("domain", F.explode(F.array_distinct("places")).alias("place"))
    counts = {r.place: r for r in each.groupBy("place").agg(*(F.count_if(F.col("domain") == x).alias(x) for x in known)).collect()}  # PLACES rows at most
    sizes = rows.agg(*(F.count_if(F.col("domain") == x).alias(x) for x in known)).first()

    def odds(x: str, i: int) -> float:
        if i not in counts:
            return 0.0
        rest = [y for y in known if y != x]
        share = (counts[i][x] + SMOOTH * sizes[x] / sum(sizes)) / (sizes[x] + SMOOTH)
        other = (sum(counts[i][y] for y in rest) + SMOOTH) / (sum(sizes[y] for y in rest) + SMOOTH)
        return max(0.0, math.log(share / other) - PLAIN)

    return [[odds(x, i) for i in range(PLACES)] for x in known[1:]]


def evidence(places: Column, odds: list[list[float]]) -> list[Column]:
    """Each domain's evidence in a text with these places, and how many these are."""
    total = lambda w: F.aggregate(places, F.lit(0.0), lambda s, x: s + F.element_at(w, x + 1))
    return [*(total(_table(own)) for own in odds), F.size(places)]


def traits(found: list[Column]) -> list[Column]:
    """1, each domain's evidence, that of all by n-gram, and the length, from a text's evidence()."""
    *each, n = found
    return [F.lit(1.0), *map(F.log1p, each), sum(each[1:], each[0]) / (n + SHRINK) if each else F.lit(0.0), F.log1p(n.cast("double")) / 8]


def softmax(x: list[Column], weights: list[list[float]]) -> list[Column]:
    """Posteriors of the first domain and of those with weights."""
    logs = [F.lit(0.0), *(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((F.lit(w) * v for w, v in zip(own[1:], x[1:])), F.lit(own[0]) * x[0]))) for own in weights)]
    if len(logs) == 1:
        return [F.lit(1.0)]
    most = F.greatest(*logs)
    raw = [F.exp(v - most) for v in logs]
    return [v / sum(raw[1:], raw[0]) for v in raw]


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """The solution of a small linear system, by elimination; what is undetermined is 0."""
    n = len(b)
    rows = [list(x) + [y] for x, y in zip(a, b)]
    scale = max((abs(x) for r in a for x in r), default=0.0)
    done: list[int] = []
    for j in range(n):
        left = [i for i in range(n) if i not in done]
        best = max(left, key=lambda i: abs(rows[i][j]))
        if abs(rows[best][j]) <= 1e-12 * scale:
            done.append(-j - 1)
            continue
        done.append(best)
        for i in range(n):
            if i != best and rows[i][j]:
                f = rows[i][j] / rows[best][j]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[best])]
    return [rows[i][n] / rows[i][j] if i >= 0 else 0.0 for j, i in enumerate(done)]


def regression(rows: DataFrame, known: list[str], width: int) -> list[list[float]]:
    """Weights of the multinomial logistic regression, for each known domain but the first. rows: domain, x0, x1, ..."""
    k = len(known) - 1
    weights = [[0.0] * width for _ in range(k)]
    if not k:
        return weights
    x = [F.col(f"x{i}") for i in range(width)]
    at = [(c, i) for c in range(k) for i in range(width)]
    for _ in range(STEPS):
        p = rows.withColumns({f"p{c}": v for c, v in enumerate(softmax(x, weights)[1:])})
        slopes = [F.sum((F.col(f"p{c}") - (F.col("domain") == known[c + 1]).cast("double")) * x[i]) for c, i in at]
        half = [(r, s) for r in range(len(at)) for s in range(r + 1)]  # the matrix is symmetric
        curves = [F.sum(F.col(f"p{at[r][0]}") * (float(at[r][0] == at[s][0]) - F.col(f"p{at[s][0]}")) * x[at[r][1]] * x[at[s][1]]) for r, s in half]
        found = [v or 0.0 for v in p.agg(F.count("*"), *slopes, *curves).first()]
        n, slope = max(found[0], 1), found[1 : 1 + len(at)]
        curve = dict(zip(half, found[1 + len(at) :]))
        matrix = [[curve[max(r, s), min(r, s)] / n + (RIDGE if r == s else 0.0) for s in range(len(at))] for r in range(len(at))]
        step = solved(matrix, [slope[r] / n + RIDGE * weights[c][i] for r, (c, i) in enumerate(at)])
        longest = max(1.0, max(map(abs, step)) / 20)
        for (c, i), v in zip(at, step):
            weights[c][i] -= v / longest
        if max(map(abs, step)) < 1e-3:
            break
    return weights


class Domains:
    """The classifier: of each domain a posterior, by a text."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        rows = written(sampled(docs, labels), "labelled")
        seen = {(r.half, r.domain) for r in rows.select("half", "domain").distinct().collect()}
        # a domain that only one half has seen can't be told from its text; both halves serve for both then
        split = all((0, d) in seen and (1, d) in seen for _, d in seen)
        self.known = [x for x in DOMAINS if any(d == x for _, d in seen)]
        self.odds = log_odds(rows.where("half = 0") if split else rows, self.known) if self.known else []
        x = traits(evidence(F.col("places"), self.odds))
        other = rows.where("half = 1") if split else rows
        self.weights = regression(written(other.select("domain", *(v.alias(f"x{i}") for i, v in enumerate(x))), "traits"), self.known, len(x)) if self.known else []

    def on(self, rows: DataFrame, text: Column) -> DataFrame:
        """rows with TOKENS and a posterior _mix_p0, _mix_p1, ... for each domain."""
        found = evidence(F.col("_mix_places"), self.odds)
        names = [f"_mix_e{i}" for i in range(len(found))]
        out = rows.withColumn("_mix_places", _places(text)).withColumn(TOKENS, _tokens(text))
        # a generator of one row: nothing above it, such as a filter pushed down, sums the evidence up again
        out = out.select(*rows.columns, TOKENS, F.inline(F.array(F.struct(*(v.alias(x) for x, v in zip(names, found))))))
        x = traits([F.col(v) for v in names])
        out = out.withColumns({f"_mix_x{i}": v for i, v in enumerate(x)})
        p = dict(zip(self.known, softmax([F.col(f"_mix_x{i}") for i in range(len(x))], self.weights))) if self.known else {}
        out = out.withColumns({f"_mix_p{k}": F.round(p[d], 9) if d in p else F.lit(0.0) for k, d in enumerate(DOMAINS)})
        return out.drop(*names, *(f"_mix_x{i}" for i in range(len(x))))


def rate_after(total: list[float]) -> Column:
    """A document's rate once the steps so far sum up to ``total``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"_mix_p{k}") * F.lit(v) for k, v in enumerate(total)), F.lit(0.0)))


def fit_rates(rows: DataFrame, targets: dict[str, float]) -> list[float]:
    """The sum of steps that gives the rates of rows (TOKENS, _mix_p0, ...)."""
    k = range(len(DOMAINS))
    p, t = [F.col(f"_mix_p{i}") for i in k], F.col(TOKENS)
    pairs = [(i, j) for i in k for j in k if i <= j]

    def sums(what: list[Column]) -> list[float]:
        return [float(v or 0) for v in rows.agg(*what).first()]

    def values(totals: list[list[float]]) -> list[float]:
        """For each sum of steps the part of the dual value that depends on rows."""
        pulls = [(rate_after(total), sum((p[i] * F.lit(v) for i, v in enumerate(total)), F.lit(0.0))) for total in totals]
        return sums([F.sum(t * ((rate - 1) * (rate - 1) / 2 + pull * rate)) for rate, pull in pulls])

    def state(total: list[float]) -> tuple[list[float], list[list[float]]]:
        """What each domain gets, and M of the documents with rates above 0."""
        now = rows.withColumn(RATE, rate_after(total))
        own = F.when(F.col(RATE) > 0, t)
        found = [float(v or 0) for v in now.agg(*(F.sum(t * p[i] * F.col(RATE)) for i in k), *(F.sum(own * p[i] * p[j]) for i, j in pairs)).first()]
        cell = dict(zip(pairs, found[len(k) :]))
        return found[: len(k)], [[cell[min(i, j), max(i, j)] for j in k] for i in k]

    total = [0.0 for _ in k]
    had, every = state(total)
    got, free, whole = had, every, sum(had)
    wanted = [whole * targets.get(x, 0.0) / (sum(targets.values()) or 1) for x in DOMAINS]
    for _ in range(ROUNDS):
        missing = [got[i] - wanted[i] if had[i] else 0.0 for i in k]
        if not whole or max(map(abs, missing)) <= CLOSE_ENOUGH * whole:
            break
        steps = [[x * v for v in solved(free, missing)] for x in LENGTHS] + [solved(every, missing)]
        ways = [[x + y for x, y in zip(total, step)] for step in steps]
        value = [v - sum(x * w for x, w, h in zip(way, wanted, had) if h) for v, way in zip(values(ways), ways)]
        total = ways[max(range(len(ways)), key=value.__getitem__)]
        got, free = state(total)
    return total


def _copies(doc_id: Column) -> Column:
    """How often a document comes: the whole part of its rate, and once more by a hash of its id with the rest as its chance."""
    frac = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return (F.floor(RATE) + (frac < F.col(RATE) - F.floor(RATE)).cast("int")).cast("int")


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], kept: list[Column]) -> DataFrame:
    """``kept`` of every document, with TOKENS, posteriors and RATE; written once, so that texts are read for their traits only once."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    domains = Domains(plain, labels)
    rows = domains.on(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_mix_text"), *kept), F.col("_mix_text")).drop("_mix_text")
    rows = written(rows, "posteriors")
    return rows.withColumn(RATE, rate_after(fit_rates(rows, targets)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, posteriors (p_<domain>), rate and copies of every document."""
    rows = _fitted(docs, labels, targets, [F.col("doc_id").cast("long").alias("doc_id")])
    return rows.select("doc_id", F.col(TOKENS).alias("n_tokens"), *(F.col(f"_mix_p{k}").alias(f"p_{x}") for k, x in enumerate(DOMAINS)), F.col(RATE).alias("rate"), _copies(F.col("doc_id")).alias("copies"))


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, each as often as its rate says (the fraction by a hash of its id)."""
    rows = _fitted(docs, labels, targets, [F.struct(*docs.columns).alias("row")])
    copies = rows.select("row", _copies(F.col("row.doc_id").cast("long")).alias("copies")).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
