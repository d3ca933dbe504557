"""Constraints, joins of unlike kinds, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ids_hash, squeezed
from ..operators import constraints as con
from ..operators import joins, matching, predicates, selection
from ..session import load
from .catalog import query
from .tables import OBSERVATIONS, observations


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1."""
    return con.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""WITH own AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 40), u AS (SELECT DISTINCT user_id FROM events WHERE value > 40),
grid AS (SELECT user_id, unnest(['click', 'view', 'purchase', 'error']) AS event_type FROM u)
SELECT user_id, event_type, 'missing' AS problem FROM (SELECT * FROM grid EXCEPT SELECT * FROM own) UNION ALL SELECT user_id, event_type, 'unexpected' FROM (SELECT * FROM own EXCEPT SELECT * FROM grid)""")
def coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grid that are missing, and cells outside it."""
    rows = load(spark, sf_dir, "events").where("value > 40")
    return con.coverage(rows, con.grid(rows, ["user_id"], {"event_type": ["click", "view", "purchase", "error"]}), ["user_id", "event_type"])


@query("""WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS f FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(['F', 'O'], lambda x: NOT list_contains(f, x))), ',') AS missing, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(['F', 'O'], x))), ',') AS extra FROM g WHERE f <> ['F', 'O']""")
def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, V6: customers whose statuses aren't exactly F and O."""
    out = con.incomplete_groups(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"])
    return out.select("o_custkey", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("""WITH c AS (SELECT l_suppkey AS task, count(*) AS n FROM lineitem GROUP BY 1) SELECT task, n, (SELECT min(n) FROM c) AS least FROM c WHERE n <> (SELECT min(n) FROM c)""")
def uneven_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5."""
    return con.uneven_repeats(load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "task"), "task")


@query("SELECT DISTINCT lang, (SELECT count(DISTINCT lang) FROM documents) AS n FROM documents WHERE (SELECT count(DISTINCT lang) FROM documents) > 1")
def several_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7, V12."""
    return con.several_values(load(spark, sf_dir, "documents"), "lang")


@query("""WITH a AS (SELECT o_custkey AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT k, CAST(a.v AS BIGINT) AS left_v, CAST(b.v AS BIGINT) AS right_v FROM a JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def cross_source_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8, V9, J14."""
    from .tables import hundredths

    rows = load(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    total = lambda df: df.groupBy("k").agg(F.sum(hundredths("o_totalprice")).alias("v"))
    return con.differing(total(rows), total(rows.where("o_orderstatus <> 'P'")), ["k"], ["v"])


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000")
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10."""
    return con.out_of_range(load(spark, sf_dir, "supplier"), "s_acctbal", 0, 9000).select("s_suppkey", "s_acctbal")


@query("SELECT count(*) AS observed, CAST(100 AS BIGINT) AS expected FROM lineitem HAVING count(*) <> 100")
def total_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V14."""
    return con.total_differs(load(spark, sf_dir, "lineitem"), 100)


@query("""WITH r AS (SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS expected FROM orders GROUP BY 1),
f AS (SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS found FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') GROUP BY 1)
SELECT o_custkey, found, expected FROM r LEFT JOIN f USING (o_custkey) WHERE found IS DISTINCT FROM expected""")
def unlike_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose ids by one source are not the ones whose hash another recorded."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    ids = lambda df, name: df.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias(name))
    open_lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    recorded = ids(orders, "_ids").select("o_custkey", ids_hash(F.col("_ids")).alias("recorded"))
    both = recorded.join(ids(orders.join(open_lines, "o_orderkey", "left_semi"), "_ids"), "o_custkey", "left")
    return con.unlike_hashes(both, ["o_custkey"], F.when(F.col("_ids").isNotNull(), ids_hash(F.col("_ids"))), "recorded")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN value IS NOT NULL THEN greatest(10.0, least(40.0, value)) END AS clipped FROM events")
def clipped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values within bounds; those that are no numbers (of one type of event) stay so, and are null in the result."""
    value = F.when(F.col("event_type") == "click", float("nan")).otherwise(F.col("value"))
    bounded = con.clipped(value, 10, 40)
    return load(spark, sf_dir, "events").select("event_id", F.when(~F.isnan(bounded), bounded).alias("clipped"))


@query("""SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no good label yet."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return joins.without(docs, load(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query(r"""WITH b AS (SELECT DISTINCT regexp_replace(text, '\s+', '', 'g') AS k FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, line FROM l WHERE length(line) > 40 AND regexp_replace(line, '\s+', '', 'g') NOT IN (SELECT k FROM b)""")
def leakage_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no benchmark passage, compared without white space."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 40)
    held_out = load(spark, sf_dir, "benchmark").select(squeezed(F.col("text")).alias("k"))
    return joins.without(lines.withColumn("own", squeezed(F.col("line"))), held_out, {"own": "k"}).select("doc_id", "line")


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.only_in(load(spark, sf_dir, "customer"), orders, ["c_custkey"])


@query("""SELECT o_orderkey, o_custkey, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order must find its one customer."""
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return joins.checked_join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"])


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    return joins.with_default(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], {"quality": -1})


@query("""WITH n AS (SELECT s_nationkey AS m, row_number() OVER (ORDER BY s_nationkey) AS o, count(*) AS c FROM supplier GROUP BY 1) SELECT a.m AS left_m, a.c AS left_c, b.m AS right_m, b.c AS right_c FROM n a JOIN n b ON a.o < b.o""")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    rows = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("m")).agg(F.count("*").alias("c")).withColumn("o", F.col("m"))
    return joins.ordered_pairs(rows, "m", "o", ["c"])


@query("""WITH w AS (SELECT item_id, string_split(text, ' ')[1:3] AS a, string_split(text, ' ')[4:6] AS b FROM benchmark), z AS (SELECT item_id, unnest(range(0, least(len(a), len(b)))) AS pos, a, b FROM w)
SELECT item_id, CAST(pos AS INT) AS pos, a[pos + 1] AS a, b[pos + 1] AS b FROM z""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    words = load(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    return joins.zipped(words.select("item_id", F.slice("w", 1, 3).alias("a"), F.slice("w", 4, 3).alias("b")), "a", "b", strict=False)


@query("SELECT c_nationkey, c_custkey, coalesce(lead(c_mktsegment) OVER w, first_value(c_mktsegment) OVER w) AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def cyclic_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    return load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", joins.next_in_cycle(None, ["c_nationkey"], "c_custkey", "c_mktsegment").alias("next"))


@query(f"""WITH {OBSERVATIONS} SELECT task, repeat, condition, passed, 'own' AS source FROM obs WHERE condition <> 'F' UNION ALL SELECT task, repeat, condition, rule_b, 'other' FROM obs WHERE condition = 'F'""")
def baseline_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One condition's rows come from another run."""
    rows = observations(spark, sf_dir)
    own = rows.select("task", "repeat", "condition", "passed", F.lit("own").alias("source"))
    other = rows.select("task", "repeat", "condition", F.col("rule_b").alias("passed"), F.lit("other").alias("source"))
    return joins.override(own, other, F.col("condition") == "F")


@query("""WITH p AS (SELECT p_partkey, p_type AS mode, p_size, p_name, p_retailprice FROM part), q AS (SELECT p_partkey AS donor, p_type AS mode, p_size AS d_size, p_name AS d_name, p_retailprice AS d_price FROM part),
j AS (SELECT p_partkey, donor, row_number() OVER (PARTITION BY p_partkey ORDER BY CAST(p_size <> d_size AS INT), CAST(p_name <> d_name AS INT), round(abs(ln(p_retailprice / d_price)), 9), donor) AS n FROM p JOIN q USING (mode) WHERE p_partkey <> donor)
SELECT p_partkey, donor, CAST(n AS INT) AS position FROM j WHERE n <= 2""")
def donor_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the two donors of its type of least score, no donor twice for a part: of its size, then of its name, then nearest in price."""
    ratio = lambda p, d: F.round(F.abs(F.log(p / d)), 9)
    return matching.alike(load(spark, sf_dir, "part"), "p_partkey", "donor", ["p_type"], ["p_size", "p_name"], "p_retailprice", ratio)


@query("""WITH r AS (SELECT p_brand AS task, CAST(l_suppkey % 7 AS INT) AS program, l_linenumber AS t, max(l_discount) < 0.1 AS ok FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
f AS (SELECT task, program, list(ok ORDER BY t) AS flags FROM r GROUP BY ALL), e AS (SELECT task, program, unnest(range(0, len(flags))) AS test, flags FROM f)
SELECT task, CAST(test AS INT) AS test, program FROM e WHERE NOT flags[test + 1]""")
def kill_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test catches which program."""
    from .summaries import _results

    rows = _results(spark, sf_dir).groupBy("task", "program").agg(F.transform(F.array_sort(F.collect_list(F.struct("test", "passed"))), lambda x: x["passed"]).alias("flags"))
    return joins.incidence(rows, rows, "task", "flags")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority ILIKE '1-urgent' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1997-12-31'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, F40."""
    rows = load(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return predicates.optional_filters(rows, {"o_orderstatus": None}, {"o_orderpriority": "1-Urgent"}, {"day": "1996-01-01"}, {"day": "1997-12-31"}).select("o_orderkey", "o_custkey", "o_orderdate")


@query("""SELECT o_orderkey, replace(replace(o_orderstatus, 'F', 'final'), 'P', 'pending') AS status, CASE WHEN o_totalprice < 0 THEN 'refund' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_totalprice > 300000 THEN 'large' ELSE 'usual' END AS diagnosis,
CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice ELSE -o_totalprice END AS directed, CASE WHEN o_orderstatus = 'F' THEN 'target' WHEN o_orderstatus = 'O' THEN 'alternative' ELSE 'neither' END AS outcome FROM orders""")
def case_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, P10, P13-P15."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", predicates.remap(status, {"F": "final", "P": "pending"}).alias("status"),
        predicates.first_of([(price < 0, "refund"), (F.col("o_orderpriority") == "1-URGENT", "urgent"), (price > 300000, "large")], "usual").alias("diagnosis"),
        predicates.by_direction(status, ["F", "O"], price, -price).alias("directed"), predicates.exclusive_outcome(status == "F", status == "O").alias("outcome"),
    )


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount > 0.05 END, l_tax > 0.02) AS passed FROM lineitem")
def measure_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first measure that is known."""
    rows = load(spark, sf_dir, "lineitem").withColumn("hidden", F.when(F.col("l_returnflag") != "N", F.col("l_discount") > 0.05)).withColumn("visible", F.col("l_tax") > 0.02)
    return rows.select("l_orderkey", "l_linenumber", predicates.measure(rows, ["absent", "hidden", "visible"]).alias("passed"))


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) SELECT o_orderkey FROM n WHERE place % 7 = 3")
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard of seven by global place, found without a single task that sees all rows."""
    return predicates.shard(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7, 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19, O1, O2."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down"))
    return predicates.page(rows, ["down", "o_orderkey"], 10, 25).drop("down")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of duplicates the last one counts."""
    return predicates.latest(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > 5")
def union_reject_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10, O11, R5."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return selection.union_unique([rows.where("l_linenumber <= 2"), rows.where("l_linenumber > 5")], ["l_orderkey", "l_linenumber"], allow_duplicates=True)


@query("""WITH a AS (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R')
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O13, O14."""
    rows = load(spark, sf_dir, "lineitem")
    side = lambda f: rows.where(F.col("l_returnflag") == f).select("l_suppkey", "l_quantity")
    return selection.multiset_difference(side("A"), side("R"))


@query("""SELECT e.user_id, e.event_type, e.value AS before, coalesce(c.value, e.value) AS value FROM (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL) e
LEFT JOIN (SELECT user_id, event_type, max(value) + 1 AS value FROM events WHERE user_id % 4 = 0 GROUP BY ALL) c USING (user_id, event_type)""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6."""
    from ..streaming.keyed import corrected

    rows = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value")).withColumn("before", F.col("value"))
    new = rows.where("user_id % 4 = 0").select("user_id", "event_type", (F.col("value") + 1).alias("value"))
    return corrected(rows, new, ["user_id", "event_type"], ["value"]).select("user_id", "event_type", "before", "value")


@query("""SELECT e.user_id, e.event_type FROM (SELECT DISTINCT user_id, event_type, CAST(user_id % 3 AS INT) AS version FROM events) e
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, event_type, CAST(user_id % 2 AS INT) AS version FROM events WHERE event_type <> 'click') c WHERE c.user_id = e.user_id AND c.event_type = e.event_type AND c.version = e.version)""")
def cache_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: rows whose cached result is missing or of another version."""
    from ..streaming.keyed import pending

    rows = load(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    cache = rows.where("event_type <> 'click'").withColumn("version", F.pmod("user_id", F.lit(2)).cast("int"))
    return pending(rows.withColumn("version", F.pmod("user_id", F.lit(3)).cast("int")), cache, ["user_id", "event_type"], ["version"]).select("user_id", "event_type")
