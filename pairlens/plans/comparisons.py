"""Ranks and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import statistics as st
from ..operators import windows as win
from ..session import load
from .catalog import query
from .tables import hundredths

_S = """s AS (SELECT l_suppkey AS task, any_value(s_nationkey) AS family, any_value(s_acctbal) AS x, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) AS y, sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS z1, count(*) AS z2
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("task")).agg((F.sum(hundredths("l_discount")) / F.count("*")).alias("y"), (F.sum(hundredths("l_tax")) / F.count("*")).alias("z1"), F.count("*").alias("z2"))
    return lines.join(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").alias("family"), F.col("s_acctbal").alias("x")), "task")


def _ranked(column: str, part: str = "") -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f"rank() OVER ({by}ORDER BY {column}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{column}) - 1) / 2"


@query(f"SELECT s_suppkey, {_ranked('s_nationkey')} AS rank FROM supplier")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all rows, by counts of equal values."""
    return win.global_average_rank(load(spark, sf_dir, "supplier"), "s_nationkey", "rank").select("s_suppkey", "rank")


@query("""WITH r AS (SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) + (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1) / 2 AS r FROM customer)
SELECT c_custkey, r AS rank, round(r - avg(r) OVER (PARTITION BY c_nationkey), 9) AS centred FROM r""")
def avg_rank_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    rows = load(spark, sf_dir, "customer").withColumn("rank", win.average_rank("c_mktsegment", ["c_nationkey"]))
    return rows.select("c_custkey", "rank", F.round(win.centred("rank", ["c_nationkey"]), 9).alias("centred"))


@query(f"WITH {_S}, r AS (SELECT {_ranked('x')} AS a, {_ranked('y')} AS b FROM s) SELECT count(*) AS n, round(corr(a, b), 7) AS rho FROM r")
def spearman_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    rows = win.global_average_rank(win.global_average_rank(_suppliers(spark, sf_dir), "x", "rx"), "y", "ry")
    return st._pearson(rows, [], "rx", "ry", 7)


@query(f"WITH {_S}, r AS (SELECT family, {_ranked('x', 'family')} AS a, {_ranked('y', 'family')} AS b FROM s) SELECT family, count(*) AS n, round(CASE WHEN var_pop(a) * count(*) > 1e-12 AND var_pop(b) * count(*) > 1e-12 THEN corr(a, b) END, 7) AS rho FROM r GROUP BY family")
def spearman_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 for each family; null without variance."""
    return st.spearman(_suppliers(spark, sf_dir), ["family"], "x", "y", 7)


@query(f"""WITH {_S}, r AS (SELECT family, {_ranked('x', 'family')} AS a, {_ranked('y', 'family')} AS b FROM s), c AS (SELECT a - avg(a) OVER (PARTITION BY family) AS a, b - avg(b) OVER (PARTITION BY family) AS b FROM r)
SELECT count(*) AS n, round(CASE WHEN sum(a * a) > 1e-12 AND sum(b * b) > 1e-12 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) END, 7) AS rho FROM c""")
def spearman_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8."""
    return st.spearman_within(_suppliers(spark, sf_dir), [], "family", "x", "y", 7)


@query(f"""WITH {_S}, c AS (SELECT corr(x, y) xy, corr(x, z1) x1, corr(y, z1) y1, corr(x, z2) x2, corr(y, z2) y2, corr(z1, z2) zz, count(*) AS n FROM s),
p AS (SELECT n, (xy - x1 * y1) / sqrt((1 - x1 * x1) * (1 - y1 * y1)) AS xy, (x2 - x1 * zz) / sqrt((1 - x1 * x1) * (1 - zz * zz)) AS x2, (y2 - y1 * zz) / sqrt((1 - y1 * y1) * (1 - zz * zz)) AS y2 FROM c)
SELECT n, round((xy - x2 * y2) / sqrt((1 - x2 * x2) * (1 - y2 * y2)), 7) AS rho FROM p""")
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return st.partial_correlation(_suppliers(spark, sf_dir), [], "x", "y", ["z1", "z2"], 7)


@query(f"""WITH {_S}, f AS (SELECT family, row_number() OVER (ORDER BY CAST(family AS VARCHAR)) - 1 AS i FROM (SELECT DISTINCT family FROM s)), g AS (SELECT count(*) AS g FROM f),
d AS (SELECT b.b AS draw, CAST(('0x' || substr(md5(b.b || '-' || p.p), 1, 8)) AS BIGINT) % g AS i FROM g, unnest(range(0, 20)) AS b(b), unnest(range(0, g)) AS p(p)),
v AS (SELECT draw, x, y FROM d JOIN f USING (i) JOIN s USING (family)), r AS (SELECT draw, {_ranked('x', 'draw')} AS a, {_ranked('y', 'draw')} AS b FROM v)
SELECT CAST(draw AS INT) AS draw, round(corr(a, b), 7) AS value FROM r GROUP BY draw""")
def spearman_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are taken anew in each draw of families."""
    rows = _suppliers(spark, sf_dir)
    return st.spearman_draws(rows, st.hash_draws(rows, "family", 20), "family", "x", "y").select("draw", F.round("value", 7).alias("value"))


@query(f"WITH {_S} SELECT family, count(*) AS n, round(sum(x), 4) AS sx, round(sum(y), 6) AS sy, round(sum(x * x), 2) AS sxx, round(sum(y * y), 5) AS syy, round(sum(x * y), 3) AS sxy FROM s GROUP BY family")
def sufficient_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    out = agg.group_statistics(_suppliers(spark, sf_dir), ["family"], "x", "y")
    return out.withColumns({c: F.round(c, d) for c, d in (("sx", 4), ("sy", 6), ("sxx", 2), ("syy", 5), ("sxy", 3))})
