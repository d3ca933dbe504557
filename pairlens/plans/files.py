"""Queries over sources and sinks: a table is written in a format, read back, and must be the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, scratch
from ..sources import readers, sinks
from .catalog import query

ORDERS = "o_orderkey BIGINT, o_orderpriority STRING, o_orderstatus STRING"
NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, appended to, read with its schema."""
    rows, path = _orders(spark, sf_dir), scratch(spark, "lines")
    sinks.write_json_lines(rows.where("o_orderstatus = 'F'"), path)
    sinks.write_json_lines(rows.where("o_orderstatus <> 'F'"), path, append=True)
    return readers.json_lines(spark, path, ORDERS)


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def growing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of several writers, each of which is in the middle of a line."""
    path = scratch(spark, "log")
    line = F.to_json(F.struct(*_orders(spark, sf_dir).columns))
    whole = _orders(spark, sf_dir).select(F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("writer"), F.lit(False).alias("torn"), F.concat(line, F.lit("\n")).alias("value"))
    torn = whole.select("writer").distinct().select("writer", F.lit(True).alias("torn"), F.lit('{"o_orderkey": 77, "o_or').alias("value"))
    # the writer's separator is a space, so a line feed stands only where a line ends
    logs = whole.unionAll(torn).repartition(8, "writer").sortWithinPartitions("torn").select("value")
    logs.write.option("lineSep", " ").text(path)
    return readers.growing_json_lines(spark, path, ORDERS)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 0 WHEN o_orderpriority < '5' THEN 2 END AS place FROM orders")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which folder has the file that each order names: files of the first that has one go first, a folder that is missing is passed over. Files are known by their
    priority's folder, as Spark names its own files."""
    rows, path = _orders(spark, sf_dir), scratch(spark, "index")
    for place, below in ((0, "3"), (2, "5")):
        kept = rows.where(F.col("o_orderpriority") < below).withColumn("priority", F.substr("o_orderpriority", F.lit(1), F.lit(1)))
        kept.repartition("priority").write.partitionBy("priority").json(f"{path}/{place}")
    files = readers.listed_files(spark, [f"{path}/{i}" for i in range(3)], "part-*", part=-2)
    named = rows.withColumn("old", F.concat(F.lit("/gone/priority="), F.substr("o_orderpriority", F.lit(1), F.lit(1)), F.lit("/part-0")))
    return readers.resolved(named, "old", files, part=-2).select("o_orderkey", F.col("found_place").alias("place"))


@query("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey, true AS named FROM nation")
def json_folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder that fit a pattern, each row with its file's name; others are left alone."""
    path = scratch(spark, "folder")
    sinks.write_json_lines(_nations(spark, sf_dir).repartition(3, "n_regionkey"), path)
    spark.createDataFrame([("no json",)], "value string").write.mode("append").text(path)
    return readers.json_folder(spark, path, NATION, "part-*.json").select("n_nationkey", "n_name", "n_regionkey", F.col("file").rlike(r"^part-.*\.json$").alias("named"))


@query("""
SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS n_nationkey, NULL AS r_regionkey FROM nation
UNION ALL SELECT r_name, NULL, CAST(r_regionkey AS VARCHAR) FROM region
""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of unlike columns in one file; what one lacks is empty, and null again when read."""
    parts = [load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), load(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey")]
    path = scratch(spark, "csv")
    both = sinks.csv_columns(parts, ["name"])
    sinks.write_csv(both, path, both.columns)
    return readers.csv_table(spark, path, "name STRING, n_nationkey STRING, r_regionkey STRING")


@query("""
SELECT CAST(n_regionkey AS INT) AS n_regionkey, count(*) AS nations, min(n_name) AS first, CASE WHEN n_regionkey > 0 THEN round(avg(CAST(n_nationkey AS DOUBLE)), 6) END AS mean
FROM nation GROUP BY n_regionkey
""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results as one JSON document; what is not finite becomes null."""
    mean = F.when(F.col("n_regionkey") > 0, F.round(F.avg(F.col("n_nationkey").cast("double")), 6)).otherwise(float("nan"))
    rows = _nations(spark, sf_dir).groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.min("n_name").alias("first"), mean.alias("mean"))
    found = sinks.without_nan(rows).select("n_regionkey", "nations", F.struct("first", "mean").alias("detail"))
    path = scratch(spark, "report")
    sinks.write_report(found, path)
    document = scratch(spark, "document")
    lines = spark.read.text(path)
    lines.agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("value")), ",\n"), F.lit("]")).alias("value")).write.text(document)
    back = readers.json_document(spark, document, "n_regionkey INT, nations BIGINT, detail STRUCT<first: STRING, mean: DOUBLE>")
    return back.select("n_regionkey", "nations", "detail.first", "detail.mean")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squares FROM embeddings")
def vectors_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a Parquet column."""
    path = scratch(spark, "vectors")
    sinks.write_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dims"), F.round(squares, 6).alias("squares"))


@query("SELECT c_mktsegment, c_custkey FROM customer")
def variants_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each value, read as one table."""
    path = scratch(spark, "variants")
    sinks.write_variants(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path, ["c_mktsegment"])
    return spark.read.schema("c_custkey BIGINT, c_mktsegment STRING").json(path)


_KINDS = [("protocol_version", "protocol"), ("public_test_cases", "livecodebench"), ("base_input", "evalplus"), ("plus_input", "evalplus"), ("test_list", "plain"), ("test", "plain"), ("other", "skipped")]


@query(f"""WITH k AS (SELECT event_id, event_type, ({[k for k, _ in _KINDS]})[CAST(event_id % 7 + 1 AS INT)] AS k, ({[k for _, k in _KINDS]})[CAST(event_id % 7 + 1 AS INT)] AS kind, event_id // 7 % 2 = 0 AS more FROM events)
SELECT event_id, CASE WHEN more AND kind = 'skipped' THEN 'plain' ELSE kind END AS kind FROM k""")
def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of records by the keys they have, the first that fits; every other record has a second key, which only decides where the first says nothing."""
    key = F.element_at(F.array(*(F.lit(k) for k, _ in _KINDS)), (F.col("event_id") % 7 + 1).cast("int"))
    more = F.when((F.floor(F.col("event_id") / 7) % 2 == 0) & (key != "test"), F.concat(F.lit(', "test": "'), "event_type", F.lit('"'))).otherwise("")
    rows = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"'), key, F.when(key == "protocol_version", F.lit('": "semantic-tests-1"')).otherwise(F.concat(F.lit('": ["'), "event_type", F.lit('"]'))), more, F.lit("}")).alias("value"))
    return readers.record_kind(rows).select("event_id", "kind")


@query("""
SELECT n_nationkey, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS tests FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey
""")
def side_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with the tests of a second table, an empty array where it has none."""
    tests = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_name")).alias("tests"))
    tasks = load(spark, sf_dir, "nation").select("n_nationkey", F.lit(None).cast("array<string>").alias("tests"))
    return readers.with_side_tests(tasks, tests, "n_nationkey", "tests").select("n_nationkey", F.array_join("tests", ",").alias("tests"))


@query("SELECT p_partkey, p_name AS completion, 'dry_run' AS finish_reason FROM part")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference solutions in place of answers."""
    return readers.dry_run(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "completion", "finish_reason")
