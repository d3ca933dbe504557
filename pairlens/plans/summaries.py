"""Summaries: rates, medians, group statistics, coverage of programs by tests, classification quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import windows as win
from ..session import load
from .catalog import query
from .tables import OBSERVATIONS, observations


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    return rows.withColumn("high", F.col("value") > 10).withColumn("known", F.when(F.col("value") > 5, F.col("value") > 20))


@query("""SELECT event_type, count(*) AS observations, count(DISTINCT user_id) AS tasks, count(value) AS high_n, avg(CAST(value > 10 AS INT)) AS high_rate,
  count(CASE WHEN value > 5 THEN 1 END) AS known_n, avg(CASE WHEN value > 5 THEN CAST(value > 20 AS INT) END) AS known_rate FROM events GROUP BY event_type""")
def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A4: rates with unknown values left out of their denominators."""
    return agg.condition_summary(_events(spark, sf_dir), ["event_type"], "user_id", ["high", "known"])


@query(f"""WITH {OBSERVATIONS}
SELECT cluster, condition, 'cluster+condition' AS level, count(*) AS n, avg(CAST(passed AS INT)) AS rate FROM obs GROUP BY cluster, condition
UNION ALL SELECT NULL, condition, 'condition', count(*), avg(CAST(passed AS INT)) FROM obs GROUP BY condition""")
def two_level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return agg.grouped_at(observations(spark, sf_dir), [["cluster", "condition"], ["condition"]], [F.count("*").alias("n"), agg.rate(F.col("passed")).alias("rate")])


@query("SELECT coalesce(o_orderpriority, '') AS o_orderpriority, count(*) AS n, avg(CAST(o_orderstatus = 'F' AS INT)) AS rate FROM orders GROUP BY 1")
def pass_rate_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    rows = load(spark, sf_dir, "orders").withColumn("passed", F.col("o_orderstatus") == "F")
    return agg.by_key(rows, "o_orderpriority", "passed")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std FROM events GROUP BY event_type")
def layer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation."""
    out = agg.spread(load(spark, sf_dir, "events"), ["event_type"], ["value"])
    return out.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_std")})


@query("""SELECT c_mktsegment, count(c_acctbal) AS n, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75,
  list_sort(list(c_acctbal))[CAST(count(*) // 2 AS INT) + 1] AS upper_median FROM customer GROUP BY c_mktsegment""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21, A22."""
    out = agg.quartiles(load(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS n FROM f)
SELECT user_id, string_agg(event_type, ',' ORDER BY n) AS kinds FROM r WHERE n <= 3 GROUP BY user_id""")
def bounded_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three kinds of event of each user."""
    return agg.distinct_values(load(spark, sf_dir, "events"), ["user_id"], "event_type", 3, "event_id").select("user_id", F.array_join("values", ",").alias("kinds"))


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS "values", string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS repeats FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1""")
def single_valued_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    out = agg.single_valued(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey").where("values = 1")
    return out.select("o_custkey", "values", F.array_join(F.col("repeats").cast("array<string>"), ",").alias("repeats"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brand as task, line number as test, supplier nation as program: passed unless the discount is high."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return rows.groupBy(F.col("p_brand").alias("task"), F.col("l_linenumber").alias("test"), F.pmod("l_suppkey", F.lit(7)).cast("int").alias("program")).agg((F.max("l_discount") < 0.1).alias("passed"))


_RESULTS = """r AS (SELECT p_brand AS task, l_linenumber AS test, CAST(l_suppkey % 7 AS INT) AS program, max(l_discount) < 0.1 AS passed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query(f"""WITH {_RESULTS}, d AS (SELECT task, program, bool_or(NOT passed) AS detected FROM r WHERE test <= 2 GROUP BY ALL)
SELECT task, avg(CAST(detected AS INT)) AS detection_rate, count(*) AS programs FROM d GROUP BY task""")
def suite_detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that a suite of two tests catches."""
    return agg.detection_rate(_results(spark, sf_dir).where("test <= 2"), ["task"], "program", "passed")


@query(f"""WITH {_RESULTS} SELECT task, test, coalesce(avg(CAST(NOT passed AS INT)), 0) AS kill_rate, count(passed) AS programs FROM r GROUP BY ALL""")
def test_kill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return agg.kill_rate(_results(spark, sf_dir), ["task", "test"], "passed")


@query("""WITH s AS (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY 1)
SELECT s_nationkey, count(*) AS n, round(avg(abs(m - s_acctbal)), 6) AS mae, round(avg((m - s_acctbal) * (m - s_acctbal)), 4) AS mse FROM supplier JOIN s USING (s_nationkey) GROUP BY 1""")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of a nation's mean as the prediction."""
    rows = load(spark, sf_dir, "supplier")
    means = rows.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"))
    out = agg.errors(rows.join(means, "s_nationkey"), ["s_nationkey"], "s_acctbal", "m")
    return out.withColumn("mae", F.round("mae", 6)).withColumn("mse", F.round("mse", 4))


@query("""WITH d AS (SELECT o_orderstatus AS t, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 50000 THEN 'O' ELSE 'P' END AS p FROM orders),
c AS (SELECT unnest(['F', 'O', 'P']) AS c), f AS (SELECT c, count_if(t = c AND p = c) AS tp, count_if(t = c) AS nt, count_if(p = c) AS np FROM c, d GROUP BY c)
SELECT (SELECT count(*) FROM d) AS n, (SELECT avg(CAST(t = p AS INT)) FROM d) AS accuracy, round(avg(CASE WHEN nt + np > 0 THEN 2.0 * tp / (nt + np) END), 9) AS macro_f1 FROM f""")
def classification_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    price = F.col("o_totalprice")
    rows = load(spark, sf_dir, "orders").withColumn("p", F.when(price > 200000, "F").when(price > 50000, "O").otherwise("P"))
    return agg.classification(rows, [], "o_orderstatus", "p", ["F", "O", "P"]).withColumn("macro_f1", F.round("macro_f1", 9))


@query("""WITH d AS (SELECT l_returnflag = 'R' AS t, l_quantity AS s FROM lineitem), c AS (SELECT s, count_if(t) AS pos, count_if(NOT t) AS neg FROM d GROUP BY s),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM w""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve by average ranks."""
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("t"), F.col("l_quantity").alias("s"))
    return agg.auc(rows, "t", "s").select(F.round("auc", 9).alias("auc"))


@query("""WITH r AS (SELECT event_type, user_id % 5 AS g, avg(CAST(value > 10 AS INT)) AS v FROM events GROUP BY ALL), b AS (SELECT g, v AS base FROM r WHERE event_type = 'click')
SELECT event_type, g, v, v - base AS delta FROM r LEFT JOIN b USING (g)""")
def delta_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    rows = _events(spark, sf_dir).groupBy("event_type", F.pmod("user_id", F.lit(5)).alias("g")).agg(agg.rate(F.col("high")).alias("v"))
    return agg.delta_to(rows, ["g"], "event_type", "click", "v")


@query("""SELECT l_returnflag, min(length(p_name)) AS least, max(length(p_name)) AS most, round(avg(length(p_name)), 9) AS mean, count_if(p_size BETWEEN 10 AND 20) AS within, round(avg(CAST(p_size BETWEEN 10 AND 20 AS INT)), 9) AS share
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, A30."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.length("p_name").alias("size"), F.col("p_size").between(10, 20).alias("ok"))
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(parts, "l_partkey")
    return rows.groupBy("l_returnflag").agg(F.min("size").cast("long").alias("least"), F.max("size").cast("long").alias("most"), F.round(F.avg("size"), 9).alias("mean"), F.count_if("ok").alias("within"), F.round(agg.rate(F.col("ok")), 9).alias("share"))


@query("SELECT l_shipmode_like AS outcome, count(*) AS n FROM (SELECT CASE WHEN l_discount > 0.05 AND l_tax > 0.04 THEN 'both' WHEN l_discount > 0.05 THEN 'A' WHEN l_tax > 0.04 THEN 'B' ELSE 'neither' END AS l_shipmode_like FROM lineitem) GROUP BY 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, P11."""
    from ..operators.predicates import two_rules

    rows = load(spark, sf_dir, "lineitem").select(two_rules(F.col("l_discount") > 0.05, F.col("l_tax") > 0.04).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS layer, o_totalprice AS v FROM orders),
k AS (SELECT *, max(layer) OVER (PARTITION BY o_custkey) AS last FROM m), c AS (SELECT * FROM k WHERE layer > 0 OR last = 0)
SELECT o_custkey, arg_max(layer, (v, -layer)) AS peak_position, max(v) AS peak_value FROM c GROUP BY o_custkey""")
def peak_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a customer's largest order stands; the first one only if there is no other."""
    return win.peak(_layers(spark, sf_dir), ["o_custkey"], "layer", "o_totalprice")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", (F.row_number().over(w) - 1).cast("int").alias("layer"))


@query("""SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1""")
def final_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return win.last_by(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("""SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1""")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, W5."""
    from ..operators.predicates import first_row_of

    return first_row_of(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS layer FROM orders)
SELECT o_custkey, o_orderkey, round(layer / nullif(max(layer) OVER (PARTITION BY o_custkey), 0), 9) AS position FROM m""")
def relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    return _layers(spark, sf_dir).select("o_custkey", "o_orderkey", F.round(win.relative_position("layer", ["o_custkey"]), 9).alias("position"))


@query("""SELECT s_nationkey, round(((SELECT sum(s_acctbal) FROM supplier) - sum(s_acctbal)) / nullif((SELECT count(*) FROM supplier) - count(*), 0), 4) AS others_mean FROM supplier GROUP BY 1""")
def leave_group_out_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    out = win.leave_group_out_mean(load(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal")
    return out.withColumn("others_mean", F.round("others_mean", 4))


@query("""WITH f AS (SELECT DISTINCT c_mktsegment AS s FROM customer) SELECT s AS c_mktsegment, round((SELECT quantile_cont(c_acctbal, 0.5) FROM customer WHERE c_mktsegment <> s), 6) AS others_median FROM f""")
def leave_fold_out_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    out = win.leave_group_out_median(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return out.withColumn("others_median", F.round("others_median", 6))
