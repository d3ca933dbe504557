"""Prepares a protocol from texts: which are fit for it and why others are not, folds, and what each condition shows.

    python -m jobs.prepare_protocol --documents PATH --labels PATH --benchmark PATH --output FOLDER [--config jobs/prepare_protocol.json]

A text (documents: doc_id, text, lang, source) is a task; its lines are the tests. Rejected are, by the first reason that holds: empty, short, bad
(labels: quality 0), toxic (labels), leaked (a line of the benchmark, compared without white space) and repeated (the same text, without white
space, as one of smaller doc_id among all texts). The others' families (language and source) are dealt whole to folds with like shares of labels; the
first lines are visible, the rest hidden (all, if there is no rest).

Written are ``tasks/fold=<n>/condition=<c>`` (doc_id, lang, source, label, prompt, tests, hidden), ``rejected/reason=<r>`` (doc_id) and
``summary`` (rows by fold and label), each in place of what stood there, so a run may be repeated. Before that, doc_ids must be unique; after it, the
written tasks must cover every task and condition once, and hold no line of the benchmark.

Settings: least_chars and least_line (shorter lines are no leak), folds, visible, conditions and seed.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command
from pairlens.functions import conditions
from pairlens.functions import text as tx
from pairlens.operators import constraints, joins, models, selection
from pairlens.operators.protocol import staged

log = logging.getLogger("jobs.prepare_protocol")

SETTINGS = {"least_chars": 200, "least_line": 40, "folds": 5, "visible": 2, "conditions": ["nl_only", "nl_tests", "nl_tests_1"], "seed": "0"}
DATASET = "livecodebench_texts"


def line_keys(df: DataFrame, key: str, lines: str, least: int) -> DataFrame:
    """key, line: the longer lines without white space. They are squeezed within the array and exploded as outer, as else filters that Spark derives compute them again."""
    long = F.transform(F.filter(lines, lambda x: F.length(x) > least), tx.squeezed)
    return df.select(key, F.explode_outer(long).alias("line")).where("line IS NOT NULL")


def benchmark_lines(benchmark: DataFrame, settings: dict) -> DataFrame:
    return line_keys(benchmark.select("item_id", tx.lines(F.col("text")).alias("_l")), "item_id", "_l", settings["least_line"]).select("line").distinct()


def read_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, lines, quality, toxic, label."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source").withColumn("lines", F.filter(tx.lines(F.col("text")), lambda x: x != ""))
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = joins.with_default(docs, known, ["doc_id"], {"quality": F.lit(None).cast("int"), "toxic": 0})
    return rows.withColumn("label", F.when(F.col("quality").isNull(), "unknown").otherwise("good"))


def judged(texts: DataFrame, benchmark: DataFrame, settings: dict) -> DataFrame:
    """doc_id, reason. Copies meet in an aggregation that keeps one id for each text, and joins go by doc_id, which is unique, so a text with very many
    copies or a common line gathers nowhere."""
    firsts = texts.groupBy(F.md5(tx.squeezed(F.col("text"))).alias("_key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("_first"))
    held_out = benchmark_lines(benchmark, settings)
    leaked = joins.only_in(line_keys(texts, "doc_id", "lines", settings["least_line"]), held_out, ["line"]).select("doc_id").distinct().withColumn("_leaked", F.lit(True))
    facts = texts.select("doc_id", F.size("lines").alias("n_lines"), F.length("text").alias("n_chars"), "quality", "toxic")
    rows = joins.with_default(joins.with_default(facts, firsts, ["doc_id"], {"_first": False}), leaked, ["doc_id"], {"_leaked": False})
    checks = [
        ("empty", F.col("n_lines") > 0), ("short", F.col("n_chars") >= settings["least_chars"]), ("bad", F.coalesce("quality", F.lit(1)) == 1), ("toxic", F.col("toxic") == 0), ("leaked", ~F.col("_leaked")), ("repeated", F.col("_first")),
    ]
    return staged(rows, checks).select("doc_id", "reason")


def tasks_of(kept: DataFrame, settings: dict) -> DataFrame:
    """doc_id, fold, lang, source, label, hidden, condition, tests, prompt. One pass over the texts."""
    kept = kept.withColumn("family", F.concat_ws("-", "lang", "source"))
    fold = models.stratified_group_folds(kept, "family", "label", settings["folds"], settings["seed"])
    visible, hidden = selection.visible_hidden(F.col("lines"), settings["visible"])
    none = lambda kind: F.lit(None).cast(kind)
    about = ["doc_id", "fold", "lang", "source", "label", "hidden"]
    tasks = kept.join(fold, "family").withColumn("hidden", hidden).select(
        *about, F.col("doc_id").cast("string").alias("task_id"), F.concat(F.lit("Continue this text ("), F.coalesce("lang", F.lit("?")), F.lit(").\n\n### Answer\n")).alias("prompt"), F.lit(DATASET).alias("dataset"), F.lit("text").alias("entry_point"),
        F.lit("").alias("imports"), F.lit("").alias("signature"), visible.alias("visible"), none("array<string>").alias("irrelevant"), none("map<string, array<string>>").alias("condition_tests"), none("map<string, string>").alias("condition_prompts"),
    )
    return conditions.for_conditions(tasks, settings["conditions"], keep=about).drop("task_id")


def rejected(spark: SparkSession, output: str) -> DataFrame:
    """doc_id, reason; no rows where none was rejected."""
    return spark.read.schema("doc_id long, reason string").parquet(f"{output}/rejected")


def run(spark: SparkSession, documents: str, labels: str, benchmark: str, output: str, settings: dict | None = None) -> dict[str, int]:
    """Reads, judges, writes and checks; rows read and written."""
    s = SETTINGS | (settings or {})
    docs, known, held_out = spark.read.parquet(documents), spark.read.parquet(labels), spark.read.parquet(benchmark)
    constraints.require(constraints.duplicate_keys(docs, ["doc_id"]), "doc_id stands more than once")
    texts = read_texts(docs, known)
    judged(texts, held_out, s).where("reason IS NOT NULL").write.mode("overwrite").partitionBy("reason").parquet(f"{output}/rejected")
    gone = rejected(spark, output)
    tasks_of(joins.without(texts, gone, ["doc_id"]), s).write.mode("overwrite").partitionBy("fold", "condition").parquet(f"{output}/tasks")
    tasks = spark.read.parquet(f"{output}/tasks")
    summary = tasks.groupBy("fold", "condition", "label").agg(F.count("*").alias("rows"), F.sum(F.size("hidden")).alias("hidden"))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")
    counts = {"documents": docs.count(), "rejected": gone.count(), "tasks": tasks.count()}
    log.info("read %d documents of %s, %d labels, %d benchmark items", counts["documents"], documents, known.count(), held_out.count())
    for r in gone.groupBy("reason").count().orderBy("reason").collect():  # a row for each reason
        log.info("rejected %d: %s", r["count"], r["reason"])
    log.info("wrote %d tasks to %s", counts["tasks"], output)
    verified(spark, docs, held_out, output, s)
    return counts


def verified(spark: SparkSession, docs: DataFrame, held_out: DataFrame, output: str, settings: dict) -> None:
    """Raises unless each document is rejected once, or is a task of each condition once, in one fold, and no task shows or hides a line of the benchmark."""
    tasks, gone = spark.read.parquet(f"{output}/tasks"), rejected(spark, output)
    constraints.require(constraints.duplicate_keys(tasks, ["doc_id", "condition"]), "a task stands more than once")
    constraints.require(constraints.incomplete_groups(tasks, ["doc_id"], "condition", settings["conditions"]), "conditions are missing")
    both = tasks.select("doc_id").distinct().unionByName(gone.select("doc_id"))
    constraints.require(constraints.duplicate_keys(both, ["doc_id"]), "a document is both kept and rejected")
    constraints.require(docs.join(both, "doc_id", "left_anti").select("doc_id"), "documents are lost")
    constraints.require(constraints.several_values_by(tasks, ["lang", "source"], "fold"), "a family is in several folds")
    # what is hidden is the same in all conditions, so it is looked through in one
    constraints.require(constraints.several_values_by(tasks.select("doc_id", F.xxhash64("hidden").alias("_h")), ["doc_id"], "_h"), "conditions of a task hide different lines")
    once = F.when(F.col("condition") == settings["conditions"][0], F.col("hidden")).otherwise(F.array().cast("array<string>"))
    shown = line_keys(tasks.select("doc_id", F.concat("tests", once).alias("_l")), "doc_id", "_l", settings["least_line"])
    constraints.require(joins.only_in(shown, benchmark_lines(held_out, settings), ["line"]), "a line of the benchmark is left")


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """All that stands in the output: rows of kind task, rejected and summary; texts by their digests."""
    tasks = spark.read.parquet(f"{output}/tasks").select(
        F.lit("task").alias("kind"), "doc_id", "fold", "condition", "label", F.md5("prompt").alias("prompt_md5"), F.size("tests").cast("long").alias("n_tests"), F.size("hidden").cast("long").alias("hidden"), F.md5(F.array_join("hidden", "\n")).alias("hidden_md5"),
    )
    gone = rejected(spark, output).select(F.lit("rejected").alias("kind"), "doc_id", "reason")
    summary = spark.read.parquet(f"{output}/summary").withColumn("kind", F.lit("summary"))
    return tasks.unionByName(gone, allowMissingColumns=True).unionByName(summary, allowMissingColumns=True)


if __name__ == "__main__":
    command("prepare_protocol", {"documents": "table of texts", "labels": "table of their labels", "benchmark": "table of held-out texts", "output": "folder of the protocol"}, SETTINGS, run)
