"""The paired-experiment model over the star tables: a supplier is a task, a return flag a repeat, a line status a condition, a nation a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load


def hundredths(column: str):
    """A two-decimal amount as an exact integer, so that sums are the same in any order."""
    return F.round(F.col(column) * 100).cast("long")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, repeat, condition, cluster, rule_a, rule_b: mean discount over 5 %, mean tax over 4 %."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum(hundredths("l_discount")).alias("d"), F.sum(hundredths("l_tax")).alias("t"), F.count("*").alias("n"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").alias("cluster"))
    rows = lines.select(F.col("l_suppkey").alias("task"), F.col("l_returnflag").alias("repeat"), F.col("l_linestatus").alias("condition"), (F.col("d") > 5 * F.col("n")).alias("rule_a"), (F.col("t") > 4 * F.col("n")).alias("rule_b"))
    return rows.join(suppliers, "task").withColumn("passed", F.col("rule_a"))


OBSERVATIONS = """
obs AS (
  SELECT l_suppkey AS task, l_returnflag AS repeat, l_linestatus AS condition, any_value(s_nationkey) AS cluster,
    sum(CAST(round(l_discount * 100) AS BIGINT)) > 5 * count(*) AS rule_a, sum(CAST(round(l_tax * 100) AS BIGINT)) > 4 * count(*) AS rule_b,
    sum(CAST(round(l_discount * 100) AS BIGINT)) > 5 * count(*) AS passed
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3
), pairs AS (
  SELECT b.task, b.repeat, b.cluster, b.passed AS b, t.passed AS t, b.rule_a AS ba, b.rule_b AS bb, t.rule_a AS ta, t.rule_b AS tb
  FROM obs b JOIN obs t USING (task, repeat) WHERE b.condition = 'F' AND t.condition = 'O'
)"""
