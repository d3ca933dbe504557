"""Protocol building over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import protocol
from ..session import load
from .catalog import query
from .summaries import _RESULTS, _results


@query("""WITH j AS (SELECT s_suppkey, unnest(['nl_only', 'tests_a', 'tests_b']) AS condition FROM supplier), r AS (SELECT *, unnest([0, 1, 2]) AS repeat FROM j)
SELECT s_suppkey, condition, CAST(repeat AS INT) AS repeat, CAST(repeat + 7 AS INT) AS order_seed, md5('job-' || (repeat + 7) || '-' || s_suppkey || '-' || condition) AS order_key FROM r""")
def build_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of tasks, conditions and repeats."""
    return protocol.jobs(load(spark, sf_dir, "supplier"), "s_suppkey", ["nl_only", "tests_a", "tests_b"], 3, 7)


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 'too small' WHEN o_orderpriority LIKE '5%' THEN 'low priority' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'open' END AS reason FROM orders""")
def staged_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that a row fails."""
    checks = [("too small", F.col("o_totalprice") > 1000), ("low priority", ~F.col("o_orderpriority").startswith("5")), ("open", F.col("o_orderstatus").isin("F", "O"))]
    return protocol.staged(load(spark, sf_dir, "orders"), checks).select("o_orderkey", "reason")


@query(f"""WITH {_RESULTS}, k AS (SELECT task, test, test + 5 AS size, list_sort(coalesce(list(DISTINCT program) FILTER (NOT passed), [])) AS c FROM r GROUP BY 1, 2),
n AS (SELECT task, count(DISTINCT program) FILTER (NOT passed) AS caught, count(DISTINCT test) AS tests FROM r GROUP BY 1), g AS (SELECT k.*, row_number() OVER (PARTITION BY task ORDER BY test) AS r FROM k JOIN n USING (task) WHERE caught >= 3 AND tests >= 3),
t AS (SELECT a.task, [a.r - 1, b.r - 1, c.r - 1] AS ix, [a.test, b.test, c.test] AS tests, a.size + b.size + c.size AS total, len(list_distinct(a.c || b.c || c.c)) AS cov FROM g a JOIN g b ON a.task = b.task AND a.r < b.r JOIN g c ON b.task = c.task AND b.r < c.r),
m AS (SELECT task, list_sort(list(total))[CAST(count(*) // 2 AS INT) + 1] AS mid FROM t GROUP BY task), f AS (SELECT t.* FROM t JOIN m USING (task) WHERE abs(total - mid) <= greatest(1, 0.15 * mid)),
z AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY cov DESC, ix) AS hi, row_number() OVER (PARTITION BY task ORDER BY cov, ix) AS lo FROM f)
SELECT task, 'high' AS suite, array_to_string(tests, ',') AS tests, CAST(cov AS INT) AS n_covered, NULL AS reason FROM z WHERE hi = 1 UNION ALL SELECT task, 'low', array_to_string(tests, ','), CAST(cov AS INT), NULL FROM z WHERE lo = 1
UNION ALL SELECT task, NULL, NULL, NULL, CASE WHEN caught < 3 THEN 'too few programs' ELSE 'too few tests' END FROM n WHERE caught < 3 OR tests < 3""")
def quality_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites of three tests that catch most and fewest programs."""
    rows = _results(spark, sf_dir).withColumn("size", F.col("test") + 5)
    return protocol.quality_suites(rows, "task", "test", "size", "program", "passed").withColumn("tests", F.array_join("tests", ","))


@query("""SELECT count(*) AS rows, count_if(regexp_replace(text, '[ ]+', ' ', 'g') = text) AS unchanged, count_if(regexp_replace(text, '[ ]+', ' ', 'g') <> text) AS changed, count_if(length(regexp_replace(text, '[ ]+', ' ', 'g')) <> length(text)) AS interface_mismatches FROM documents""")
def transform_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13."""
    rows = load(spark, sf_dir, "documents").withColumn("after", F.regexp_replace("text", "[ ]+", " "))
    return protocol.transform_audit(rows, "text", "after", F.length("text"), F.length("after"))


@query("""WITH t AS (SELECT user_id, event_type || event_id AS test, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS h, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS l FROM events), c AS (SELECT unnest([2, 4]) AS n)
SELECT user_id, 'high' AS selector, CAST(n AS INT) AS n, string_agg(test, ',' ORDER BY h) AS tests FROM t JOIN c ON h <= n GROUP BY ALL UNION ALL SELECT user_id, 'low', CAST(n AS INT), string_agg(test, ',' ORDER BY l) FROM t JOIN c ON l <= n GROUP BY ALL""")
def dataset_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors by counts."""
    rows = load(spark, sf_dir, "events").withColumn("test", F.concat("event_type", F.col("event_id").cast("string")))
    out = protocol.variants(rows, "user_id", {"high": [F.col("value").desc(), F.col("event_id")], "low": [F.col("value"), F.col("event_id")]}, [2, 4])
    return out.withColumn("tests", F.array_join("tests", ","))
