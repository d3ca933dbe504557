"""URL filters by path-template trees (operator 7), with DataFrame functions only.

A url is judged by the longest rule (host, path) that fits it. The rest go to the method: each host has a tree of path
templates. Segments with digits lose them to a wildcard; a segment with many values that are each rarely seen becomes a wildcard as a
whole; sibling branches with the same children and of a like labelled rate are merged, unless one's rate differs from theirs together (two-sided test); unlabelled ones
of the same children join them.

A template's purity is its labelled share of blocked pages, smoothed with a weight of STRENGTH towards what its branch (the first
segment) makes likely: the rates of the branch of that name on similar hosts, a host counting once; and these, where they are few, towards the
host's other labelled branches, a branch counting once, and PRIOR. Hosts are similar in a branch that both have labelled at a like rate. To keep
the pairs of branches in proportion to the branches, a host is compared by at most ANCHORS of its own: of each class of names the one with the most labels.
A template is rejected when its purity reaches THRESHOLD. Labels are those given, or else what the rules themselves say about the pages they fit.

Rows are counted per host and template before anything is exchanged, so a hot host costs as many rows as it has templates.
The first LEVELS segments are generalised by their counts; deeper ones by their digits alone, none is cut off.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed by the method unless
labels of such urls say otherwise; repeated rows are judged alike; a null page_id stays null; columns besides page_id and url are dropped;
an empty table gives an empty table; of two rules of the same length that fit, the one listed first wins; very long urls are matched whole,
their segments past LEVELS as one; of branches with as many labels, the one of the larger name stands for its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The rules (host and path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LEVELS = 3
#: A segment is variable if its place holds at least so many values, and so few rows for each of them.
MANY, RARE = 24, 3.0
PRIOR, STRENGTH, THRESHOLD = 0.1, 2.0, 0.5
#: Branches by which a host is compared with others, at most.
ANCHORS = 16
#: Branches are alike if their rates lie within so many standard errors.
ALIKE = 1.96


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last condition put on top is tried first
    for rule, says in sorted(reversed(rules), key=lambda x: len(x[0])):
        where, slash, rest = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def band_of(rate: Column) -> Column:
    """Rates of a band are like ones."""
    return F.round(4 * rate).cast("int")


def likely(branches: DataFrame) -> DataFrame:
    """host, branch, likely: what similar hosts and the host's other branches say of a branch. branches: host, branch, labelled, blocked, one row each."""
    known = branches.where("labelled > 0").withColumn("rate", F.col("blocked") / F.col("labelled")).withColumn("band", band_of(F.col("rate")))
    of_class = [F.max(F.when(F.pmod(F.xxhash64("branch"), F.lit(ANCHORS)) == i, F.struct("labelled", "branch", "band"))).alias(f"a{i}") for i in range(ANCHORS)]
    hosts = known.groupBy("host").agg(F.sum("rate").alias("rates"), F.count("*").alias("known"), *of_class)
    anchors = hosts.select("host", F.explode(F.filter(F.array(*(f"a{i}" for i in range(ANCHORS))), lambda x: x.isNotNull())).alias("a"))
    anchors = anchors.select("host", F.col("a.branch").alias("anchor"), F.col("a.band").alias("anchor_band"))
    # what hosts with such an anchor say about their other branches; a host's own word is left out below
    pairs = anchors.join(known.select("host", "branch", "rate"), "host").where("anchor <> branch")
    said = pairs.groupBy("anchor", "anchor_band", "branch").agg(F.count("*").alias("hosts"), F.sum("rate").alias("rate"))
    own = branches.select("host", "branch", F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).alias("own"))
    heard = own.join(anchors, "host").join(said, ["anchor", "anchor_band", "branch"])
    heard = heard.groupBy("host", "branch").agg(F.sum(F.col("hosts") - F.col("own").isNotNull().cast("int")).alias("heard"), F.sum(F.col("rate") - F.coalesce("own", F.lit(0.0))).alias("heard_rates"))
    rest = own.join(hosts.select("host", "rates", "known"), "host", "left").join(heard, ["host", "branch"], "left")
    none = F.lit(0)
    siblings = F.coalesce("rates", none) - F.coalesce("own", none), F.coalesce("known", none) - F.col("own").isNotNull().cast("int")
    up = (siblings[0] + STRENGTH * PRIOR) / (siblings[1] + STRENGTH)
    return rest.select("host", "branch", ((F.coalesce("heard_rates", none) + STRENGTH * up) / (F.coalesce("heard", none) + STRENGTH)).alias("likely"))


def templates(rows: DataFrame) -> DataFrame:
    """host, leaf (a path by its digits alone), template, purity. rows: host, path, label (1 block, 0 allow, null none)."""
    leaf = F.regexp_replace("path", "[0-9]+", "*")
    counted = rows.groupBy("host", leaf.alias("leaf")).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    tree = counted.withColumn("segments", F.split("leaf", "/")).withColumn("prefix", F.lit(""))
    for level in range(1, LEVELS + 1):
        segment = F.coalesce(F.get("segments", F.lit(level)), F.lit(None).cast("string"))
        tree = tree.withColumn("segment", segment)
        # variable segments: many values, each rarely seen
        children = tree.where("segment IS NOT NULL").groupBy("host", "prefix", "segment").agg(F.sum("n").alias("own"))
        places = children.groupBy("host", "prefix").agg(F.count("*").alias("values"), F.sum("own").alias("all"))
        variable = places.where((F.col("values") >= MANY) & (F.col("all") <= RARE * F.col("values"))).select("host", "prefix", F.lit(True).alias("variable"))
        tree = tree.join(variable, ["host", "prefix"], "left")
        tree = tree.withColumn("segment", F.when(F.col("variable") & F.col("segment").isNotNull(), "*").otherwise(F.col("segment"))).drop("variable")
        if level == 1:
            tree = tree.withColumn("branch", F.coalesce("segment", F.lit("")))
        # alike branches: the same set of what follows, and rates that do not differ
        rest = F.xxhash64(F.slice("segments", F.lit(level + 2), F.size("segments")))
        sides = tree.groupBy("host", "prefix", "segment", rest.alias("rest")).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        branch = sides.groupBy("host", "prefix", "segment").agg(F.bit_xor("rest").alias("shape"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).where("segment IS NOT NULL")
        unlabelled = branch.where("labelled = 0").select("host", "prefix", "segment", "shape")
        branch = branch.where("labelled > 0").withColumn("band", band_of(F.col("blocked") / F.col("labelled")))
        pooled = branch.groupBy("host", "prefix", "shape", "band").agg(F.sum("labelled").alias("pool"), F.sum("blocked").alias("pool_blocked"), F.count("*").alias("branches")).where("branches > 1")
        rate, whole = (F.col("blocked") + PRIOR) / (F.col("labelled") + 1), (F.col("pool_blocked") + PRIOR) / (F.col("pool") + 1)
        error = F.sqrt(whole * (1 - whole) * (1 / F.col("labelled") + 1 / F.col("pool")))
        merged = branch.join(pooled, ["host", "prefix", "shape", "band"]).where(F.abs(rate - whole) <= ALIKE * error)
        merged = merged.select("host", "prefix", "segment", "shape", "band", "pool", F.concat(F.lit("~"), F.hex("shape"), F.col("band").cast("int").cast("string")).alias("merged"))
        # unlabelled branches of that shape join the merged one with the most labels
        known = merged.groupBy("host", "prefix", "shape").agg(F.max_by("merged", F.struct("pool", F.col("band"))).alias("merged"))
        merged = merged.select("host", "prefix", "segment", "merged").unionByName(unlabelled.join(known, ["host", "prefix", "shape"]).select("host", "prefix", "segment", "merged"))
        tree = tree.join(merged, ["host", "prefix", "segment"], "left").withColumn("segment", F.coalesce("merged", "segment")).drop("merged")
        tree = written(tree.withColumn("prefix", F.concat_ws("/", "prefix", "segment")).drop("segment"), "tree")
    tree = tree.withColumn("template", F.concat_ws("/", "prefix", F.array_join(F.slice("segments", F.lit(LEVELS + 2), F.size("segments")), "/")))
    # a template's branches (several, if they were merged) count by their pages
    branches = tree.groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    tree = tree.join(likely(branches), ["host", "branch"])
    purity = tree.groupBy("host", "template").agg(((F.sum("blocked") + F.sum(F.col("likely") * F.col("n")) / F.sum("n") * STRENGTH) / (F.sum("labelled") + STRENGTH)).alias("purity"))
    return tree.select("host", "leaf", "template").join(purity, ["host", "template"])


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. labels: page_id, label (1 block, 0 allow)."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", name).withColumn("says", verdict)
    if labels is None:
        named = ruled.withColumn("label", F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0))
    else:
        named = ruled.join(labels.groupBy("page_id").agg(F.max("label").alias("label")), "page_id", "left")
    found = templates(named.select("host", "path", "label"))
    rejected = found.where(F.col("purity") >= THRESHOLD).select("host", "leaf", F.lit("block").alias("method"))
    open_rows = ruled.where("says IS NULL").withColumn("leaf", F.regexp_replace("path", "[0-9]+", "*")).join(rejected, ["host", "leaf"], "left")
    out = lambda df, says: df.select("page_id", "host", "path", "rule", says.alias("verdict"))
    return out(ruled.where("says IS NOT NULL"), F.col("says")).unionByName(out(open_rows, F.coalesce("method", F.lit("allow"))))
