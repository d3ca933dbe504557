"""Paired contrasts: counts, exact tests, bootstrap intervals, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import statistics as st
from ..operators.joins import self_pairs
from ..operators.predicates import band, flip_type, two_rules
from .catalog import query
from .tables import OBSERVATIONS, observations

DRAWS = 200


def _pairs(spark: SparkSession, sf_dir: str, measures: list[str]) -> DataFrame:
    return self_pairs(observations(spark, sf_dir), ["task", "repeat", "cluster"], "condition", "F", "O", measures)


@query(f"""WITH {OBSERVATIONS}
SELECT repeat, count(*) AS n, count_if(b) AS base_passed, count_if(t) AS target_passed, count_if(NOT b AND t) AS gains, count_if(b AND NOT t) AS losses,
  count_if(b AND t) AS both_pass, count_if(NOT b AND NOT t) AS both_fail, count_if(NOT b AND t) - count_if(b AND NOT t) AS net_gain,
  (count_if(NOT b AND t) - count_if(b AND NOT t)) / count(*) AS net_gain_rate
FROM pairs GROUP BY repeat""")
def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, A5, A6, A8."""
    return agg.flips(_pairs(spark, sf_dir, ["passed"]), ["repeat"], "passed")


@query(f"""WITH {OBSERVATIONS}
SELECT string_agg(CAST(task AS VARCHAR), ',' ORDER BY CAST(task AS VARCHAR)) FILTER (NOT b AND t) AS gained, string_agg(CAST(task AS VARCHAR), ',' ORDER BY CAST(task AS VARCHAR)) FILTER (b AND NOT t) AS lost, repeat
FROM pairs GROUP BY repeat""")
def paired_task_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: which tasks gained and lost."""
    pairs = _pairs(spark, sf_dir, ["passed"]).withColumn("task", F.col("task").cast("string"))
    return agg.flips(pairs, ["repeat"], "passed", "task").select("repeat", F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


@query(f"""WITH {OBSERVATIONS}, m AS (SELECT task, avg(CAST(t AS INT) - CAST(b AS INT)) AS d, count(*) AS r FROM pairs GROUP BY task)
SELECT count(*) AS num_tasks, max(r) AS repeats_per_task, round(avg(d), 10) AS paired_difference FROM m""")
def paired_point_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of task means."""
    means = agg.task_means(_pairs(spark, sf_dir, ["passed"]), ["task"], "passed")
    return means.agg(F.count("*").alias("num_tasks"), F.max("repeats").alias("repeats_per_task"), F.round(F.avg("difference"), 10).alias("paired_difference"))


@query(f"""WITH {OBSERVATIONS}, c AS (SELECT repeat, CAST(count_if(NOT b AND t) AS BIGINT) AS g, CAST(count_if(b AND NOT t) AS BIGINT) AS l FROM pairs GROUP BY repeat),
k AS (SELECT repeat, g, l, unnest(range(0, CAST(least(g, l) + 1 AS BIGINT))) AS i FROM c),
p AS (SELECT repeat, g, l, sum(exp(lgamma(CAST(g + l + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(g + l - i + 1 AS DOUBLE)) - (g + l) * ln(2))) AS s FROM k GROUP BY ALL)
SELECT repeat, g AS gains, l AS losses, CASE WHEN g + l = 0 THEN 1.0 ELSE round(least(1.0, 2 * s), 8) END AS exact_mcnemar_p FROM p""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    counts = agg.flips(_pairs(spark, sf_dir, ["passed"]), ["repeat"], "passed")
    return counts.select("repeat", "gains", "losses", st.mcnemar(F.col("gains"), F.col("losses"), 8).alias("exact_mcnemar_p"))


_DRAWS = f"""m AS (SELECT task, cluster, avg(CAST(t AS INT) - CAST(b AS INT)) AS d FROM pairs GROUP BY task, cluster),
sums AS (SELECT cluster, sum(d) AS s, count(*) AS k, avg(d) AS mean, row_number() OVER (ORDER BY CAST(cluster AS VARCHAR)) - 1 AS i FROM m GROUP BY cluster),
g AS (SELECT count(*) AS g FROM sums),
draws AS (SELECT b.b AS draw, p.p AS place, CAST(('0x' || substr(md5(b.b || '-' || p.p), 1, 8)) AS BIGINT) % g AS i
  FROM g, unnest(range(0, {DRAWS})) AS b(b), unnest(range(0, g)) AS p(p))"""


@query(f"""WITH {OBSERVATIONS}, {_DRAWS}, v AS (SELECT draw, sum(s) / sum(k) AS value FROM draws JOIN sums USING (i) GROUP BY draw)
SELECT (SELECT count(*) FROM m) AS num_tasks, (SELECT g FROM g) AS num_clusters, round((SELECT avg(d) FROM m), 9) AS paired_difference,
  round(quantile_cont(value, 0.025), 9) AS ci_low, round(quantile_cont(value, 0.975), 9) AS ci_high FROM v""")
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the paired difference by a bootstrap over clusters."""
    found = st.paired_effect(observations(spark, sf_dir), "F", "O", "passed", cluster="cluster", draws=DRAWS)["summary"]
    return found.select("num_tasks", "num_clusters", *(F.round(c, 9).alias(c) for c in ("paired_difference", "ci_low", "ci_high")))


def _cluster_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = agg.task_means(_pairs(spark, sf_dir, ["passed"]), ["task", "cluster"], "passed")
    return means.groupBy("cluster").agg(F.sum("difference").alias("s"), F.count("*").alias("k"), F.avg("difference").alias("mean"))


@query(f"""WITH {OBSERVATIONS}, {_DRAWS}, v AS (SELECT draw, avg(mean) AS value FROM draws JOIN sums USING (i) GROUP BY draw)
SELECT round(quantile_cont(value, 0.025), 9) AS ci_low, round(quantile_cont(value, 0.975), 9) AS ci_high, count(*) AS valid_draws FROM v""")
def family_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: interval of the mean of family means."""
    sums = _cluster_sums(spark, sf_dir)
    return st.linear_interval(st.mean_draws(sums, st.hash_draws(sums, "cluster", DRAWS), "cluster", "mean"), 9)


@query(f"""WITH {OBSERVATIONS}, {_DRAWS}, v AS (SELECT draw, sum(s) / sum(k) AS value FROM draws JOIN sums USING (i) GROUP BY draw), o AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM v)
SELECT round(v[CAST(floor(n * 0.025) AS INT) + 1], 9) AS ci_low, round(v[CAST(floor(n * 0.975) AS INT)], 9) AS ci_high, CAST(n AS INTEGER) AS valid_draws FROM o""")
def index_percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: an interval by places in the sorted draws."""
    sums = _cluster_sums(spark, sf_dir)
    return st.index_interval(st.ratio_draws(sums, st.hash_draws(sums, "cluster", DRAWS), "cluster", "s", "k"), 9)


@query(f"""WITH {OBSERVATIONS}, {_DRAWS}, r AS (SELECT cluster, count_if(ba AND tb) AS num, count_if(ba) AS den FROM pairs GROUP BY cluster),
v AS (SELECT draw, CASE WHEN sum(den) = 0 THEN 0 ELSE sum(num) / sum(den) END AS value FROM draws JOIN sums USING (i) JOIN r USING (cluster) GROUP BY draw)
SELECT round((SELECT sum(num) / sum(den) FROM r), 9) AS ratio, round(quantile_cont(value, 0.025), 9) AS ci_low, round(quantile_cont(value, 0.975), 9) AS ci_high FROM v""")
def conditional_ratio_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those with rule A at the base, how many have rule B at the target, with an interval over clusters."""
    pairs = _pairs(spark, sf_dir, ["rule_a", "rule_b"])
    sums = pairs.groupBy("cluster").agg(F.count_if(F.col("base_rule_a") & F.col("target_rule_b")).alias("num"), F.count_if("base_rule_a").alias("den"))
    interval = st.linear_interval(st.ratio_draws(sums, st.hash_draws(sums, "cluster", DRAWS), "cluster", "num", "den"), 9)
    return agg.ratio(sums, [], "num", "den").select(F.round("ratio", 9).alias("ratio")).crossJoin(interval.select("ci_low", "ci_high"))


@query(f"""WITH {OBSERVATIONS}, z AS (SELECT task, cluster, avg(CAST(passed AS INT)) AS d FROM obs WHERE condition = 'O' GROUP BY task, cluster),
sums AS (SELECT cluster, sum(d) AS s, count(*) AS k, row_number() OVER (ORDER BY CAST(cluster AS VARCHAR)) - 1 AS i FROM z GROUP BY cluster), g AS (SELECT count(*) AS g FROM sums),
draws AS (SELECT b.b AS draw, CAST(('0x' || substr(md5(b.b || '-' || p.p), 1, 8)) AS BIGINT) % g AS i FROM g, unnest(range(0, {DRAWS})) AS b(b), unnest(range(0, g)) AS p(p)),
v AS (SELECT draw, sum(s) / sum(k) AS value FROM draws JOIN sums USING (i) GROUP BY draw)
SELECT round((SELECT avg(d) FROM z), 9) AS rate, round(quantile_cont(value, 0.025), 9) AS ci_low, round(quantile_cont(value, 0.975), 9) AS ci_high FROM v""")
def rate_with_cluster_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate's interval, as a paired effect against a condition that never passes."""
    rows = st.against_zero(observations(spark, sf_dir).where("condition = 'O'"), "passed", "condition")
    found = st.paired_effect(rows, "_zero", "O", "passed", cluster="cluster", draws=DRAWS)["summary"]
    return found.select(F.round("paired_difference", 9).alias("rate"), F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@query(f"""WITH {OBSERVATIONS} SELECT task, repeat, CASE WHEN b AND t THEN 'stable_pass' WHEN b THEN 'harm' WHEN t THEN 'rescue' ELSE 'stable_fail' END AS flip_type FROM pairs""")
def flip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return _pairs(spark, sf_dir, ["passed"]).select("task", "repeat", flip_type(F.col("base_passed"), F.col("target_passed")).alias("flip_type"))


_CLASS = "CASE WHEN {0}a AND {0}b THEN 'both' WHEN {0}a THEN 'A' WHEN {0}b THEN 'B' ELSE 'neither' END"


@query(f"""WITH {OBSERVATIONS}, c AS (SELECT {_CLASS.format('b')} AS s, {_CLASS.format('t')} AS e FROM pairs), v AS (SELECT unnest(['A', 'B', 'both', 'neither']) AS start)
SELECT start, count_if(e = 'A') AS "to_A", count_if(e = 'B') AS "to_B", count_if(e = 'both') AS to_both, count_if(e = 'neither') AS to_neither FROM v LEFT JOIN c ON s = start GROUP BY start""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, P11."""
    pairs = _pairs(spark, sf_dir, ["rule_a", "rule_b"])
    moved = pairs.select(two_rules(F.col("base_rule_a"), F.col("base_rule_b")).alias("start"), two_rules(F.col("target_rule_a"), F.col("target_rule_b")).alias("end"))
    return agg.transitions(moved, "start", "end", ["A", "B", "both", "neither"])


@query(f"""WITH {OBSERVATIONS}, s AS (SELECT task, cluster, avg(CAST(ba AND tb AS INT)) AS r FROM pairs GROUP BY task, cluster)
SELECT cluster, count(*) AS tasks, round(avg(r), 9) AS switch_rate, count_if(r = 0) AS never, count_if(r > 0 AND r < 1) AS variable, count_if(r = 1) AS always FROM s GROUP BY cluster""")
def paired_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a task follows rule A at the base and rule B at the target."""
    pairs = _pairs(spark, sf_dir, ["rule_a", "rule_b"])
    rates = pairs.groupBy("task", "cluster").agg(agg.rate(F.col("base_rule_a") & F.col("target_rule_b")).alias("r")).withColumn("band", band(F.col("r")))
    return rates.groupBy("cluster").agg(F.count("*").alias("tasks"), F.round(F.avg("r"), 9).alias("switch_rate"), *(F.count_if(F.col("band") == b).alias(b) for b in ("never", "variable", "always")))


@query(f"""WITH {OBSERVATIONS}
SELECT task, repeat, max(CASE WHEN condition = 'F' THEN CAST(passed AS INT) END) AS "F", max(CASE WHEN condition = 'O' THEN CAST(passed AS INT) END) AS "O" FROM obs GROUP BY task, repeat""")
def task_condition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    rows = observations(spark, sf_dir).withColumn("passed", F.col("passed").cast("int"))
    return agg.matrix(rows, ["task", "repeat"], "condition", ["F", "O"], "passed", "repeat")


@query(f"""WITH {OBSERVATIONS} SELECT task, repeat, condition, CAST(passed AS INT) AS value FROM obs""")
def matrix_unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, back to rows."""
    return agg.unpivoted(task_condition_matrix(spark, sf_dir), ["task", "repeat"], ["F", "O"])


@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, length(u.text) AS base_size, length(a.text) AS target_size FROM u JOIN a USING (conv_id, turn)""")
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the answer to it; turns without one are left out."""
    from ..session import load

    rows = load(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").withColumn("size", F.length("text").cast("long"))
    rows = rows.withColumn("turn", F.when(F.col("role") == "assistant", F.col("turn") - 1).otherwise(F.col("turn")))
    return self_pairs(rows, ["conv_id", "turn"], "role", "user", "assistant", ["size"], strict=False)


@query(f"""WITH {OBSERVATIONS}, r AS (SELECT task, condition, avg(CAST(passed AS INT)) AS v FROM obs GROUP BY task, condition), w AS (SELECT task, max(v) FILTER (condition = 'O') AS h, max(v) FILTER (condition = 'F') AS l FROM r GROUP BY task)
SELECT round(avg(h - l), 9) AS difference, count_if(h > l) AS positive, count_if(h = l) AS tied, count_if(h < l) AS negative FROM w""")
def detection_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15."""
    rates = observations(spark, sf_dir).groupBy("task", "condition").agg(agg.rate(F.col("passed")).alias("v"))
    found = st.detection_difference(rates, "task", "condition", "O", "F", "v")
    return found.withColumn("difference", F.round("difference", 9))


@query(f"""WITH {OBSERVATIONS}, per AS (SELECT cluster, task, repeat, avg(CAST(rule_a AND NOT rule_b AS INT)) AS a, avg(CAST(rule_b AND NOT rule_a AS INT)) AS b FROM obs GROUP BY ALL),
t AS (SELECT cluster, task, avg(a) AS a, avg(b) AS b FROM per GROUP BY ALL), f AS (SELECT cluster, avg(a) AS a, avg(b) AS b FROM t GROUP BY ALL)
SELECT round(avg(a), 9) AS only_a, round(avg(b), 9) AS only_b FROM f""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat, task, family, overall; each level's groups weigh the same."""
    rows = observations(spark, sf_dir).withColumn("only_a", (F.col("rule_a") & ~F.col("rule_b")).cast("int")).withColumn("only_b", (F.col("rule_b") & ~F.col("rule_a")).cast("int"))
    means = agg.nested_mean(rows, [["cluster", "task", "repeat"], ["cluster", "task"], ["cluster"], []], ["only_a", "only_b"])
    return means.select(F.round("only_a", 9).alias("only_a"), F.round("only_b", 9).alias("only_b"))


def _effects_sql(pairs: list[tuple[str, str, str, str]]) -> str:
    """Of (base, target, base's column of pairs, target's column) the paired differences and their intervals."""
    each = " UNION ALL ".join(f"SELECT task, cluster, '{b}' AS base, '{t}' AS target, CAST({y} AS INT) - CAST({x} AS INT) AS d FROM pairs" for b, t, x, y in pairs)
    return f"""WITH {OBSERVATIONS}, e AS ({each}), m AS (SELECT base, target, task, cluster, avg(d) AS d FROM e GROUP BY ALL),
c AS (SELECT base, target, cluster, sum(d) AS s, count(*) AS k FROM m GROUP BY base, target, cluster),
sums AS (SELECT *, row_number() OVER (PARTITION BY base, target ORDER BY CAST(cluster AS VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY base, target) AS g FROM c),
draws AS (SELECT base, target, b.b AS draw, CAST(('0x' || substr(md5(b.b || '-' || p.p), 1, 8)) AS BIGINT) % g AS i FROM (SELECT DISTINCT base, target, g FROM sums), unnest(range(0, {DRAWS})) AS b(b), unnest(range(0, g)) AS p(p)),
v AS (SELECT base, target, draw, sum(s) / sum(k) AS value FROM draws JOIN sums USING (base, target, i) GROUP BY ALL),
w AS (SELECT base, target, round(quantile_cont(value, 0.025), 9) AS ci_low, round(quantile_cont(value, 0.975), 9) AS ci_high FROM v GROUP BY ALL)
SELECT base, target, count(*) AS num_tasks, round(avg(d), 9) AS paired_difference, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM m JOIN w USING (base, target) GROUP BY base, target"""


def _conditions(spark: SparkSession, sf_dir: str, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Named conditions: each one of the two conditions, with one of the two rules as what passed."""
    shown = [F.when(F.col("condition") == condition, F.struct(F.lit(name).alias("name"), F.col(rule).alias("passed"))) for name, (condition, rule) in names.items()]
    rows = observations(spark, sf_dir).select("task", "repeat", "cluster", F.explode(F.filter(F.array(*shown), lambda x: x.isNotNull())).alias("_x"))
    return rows.select("task", "repeat", "cluster", "_x.name", "_x.passed")


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("base", "target", "num_tasks", *(F.round(c, 9).alias(c) for c in ("paired_difference", "ci_low", "ci_high")))


@query(_effects_sql([("nl_only", "nl_tests", "ba", "ta"), ("inputs_only", "nl_tests", "bb", "ta"), ("wrong_tests", "nl_tests", "tb", "ta")]))
def contrast_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrasts of an experiment of kind main."""
    rows = _conditions(spark, sf_dir, {"nl_only": ("F", "rule_a"), "inputs_only": ("F", "rule_b"), "nl_tests": ("O", "rule_a"), "wrong_tests": ("O", "rule_b")})
    return _rounded(st.report(rows, condition="name", cluster="cluster", draws=DRAWS))


@query(_effects_sql([("m1", "m2", "ba", "bb"), ("m1", "m3", "ba", "ta"), ("m2", "m3", "bb", "ta")]))
def model_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of models compared as if they were conditions."""
    rows = _conditions(spark, sf_dir, {"m1": ("F", "rule_a"), "m2": ("F", "rule_b"), "m3": ("O", "rule_a")})
    pairs = [("m1", "m2"), ("m1", "m3"), ("m2", "m3")]
    return _rounded(st.effects(rows, pairs, "passed", condition="name", cluster="cluster", draws=DRAWS))
