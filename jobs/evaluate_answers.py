"""Evaluates recorded answers as they arrive, and publishes partial and final summaries.

    python -m jobs.evaluate_answers --answers FOLDER --output FOLDER --checkpoint FOLDER [--config jobs/evaluate_answers.json]

Reads Parquet files of conversations (conv_id, turn, role, text) as a stream: each run takes the files that are new since the last one by its
checkpoint, then ends. An answer (a turn of role assistant, by conv_id and turn) is evaluated once; its condition is its place in its
conversation. Written are ``results/batch=<n>/condition=<c>``, ``sums/batch=<n>``, ``summary/state=<partial|final>`` and, once as many answers as
expected are evaluated, ``contrast``: first against second answers. A run that failed, or one without new files, may simply be run
again: batches overwrite what they wrote before.

Settings: least_chars, the length below which an answer counts as short; every, the new answers that make a new partial summary; expected, the
number of answers planned, null if it is not known (then no summary is final); files_per_batch.

Null roles and texts: a row of null role is no answer; a null text is an empty one. Rows of a known key are counted, and raise at the end of the
run; the answer seen first stays.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command
from pairlens.functions import text as tx
from pairlens.operators import aggregates, joins, statistics
from pairlens.operators.protocol import staged
from pairlens.streaming import keyed

log = logging.getLogger("jobs.evaluate_answers")

SETTINGS = {"least_chars": 300, "every": 256, "expected": None, "files_per_batch": 100}
SCHEMA = "conv_id long, turn long, role string, text string"
PLACES = ["first", "second"]
SUMS = {"n_passed": "count_if(passed)", "n_chars": "sum(n_chars)", "n_lines": "sum(n_lines)"}


def evaluated(rows: DataFrame, least_chars: int) -> DataFrame:
    """conv_id, turn, condition, n_chars, n_lines, reason (the first check that fails, null if none), passed."""
    candidate = tx.truncated(tx.strip_thinking(F.coalesce("text", F.lit(""))))
    place = F.floor((F.col("turn") + 1) / 2)
    condition = F.when(place == 1, PLACES[0]).when(place == 2, PLACES[1]).otherwise("further")
    rows = rows.select("conv_id", "turn", condition.alias("condition"), candidate.alias("candidate"))
    rows = rows.withColumns({"n_chars": F.length("candidate").cast("long"), "n_lines": F.when(F.col("candidate") == "", 0).otherwise(F.size(tx.lines(F.col("candidate")))).cast("long")})
    ended = F.right(tx.strip(F.col("candidate")), F.lit(1)).isin(".", "!", "?")
    checks = [("empty", F.col("n_chars") > 0), ("stub", ~tx.is_placeholder(F.col("candidate"))), ("short", F.col("n_chars") >= least_chars), ("unfinished", ended)]
    return staged(rows, checks).select("conv_id", "turn", "condition", "n_chars", "n_lines", "reason", F.col("reason").isNull().alias("passed"))


def contrast(results: DataFrame) -> DataFrame:
    """Conversations with a first and a second answer: gains, losses and exact p of the second against the first."""
    pairs = joins.self_pairs(results.where(F.col("condition").isin(PLACES)), ["conv_id"], "condition", *PLACES, ["passed"])
    counts = aggregates.flips(pairs, [], "passed")
    return counts.select("n", "base_passed", "target_passed", "gains", "losses", statistics.mcnemar(F.col("gains"), F.col("losses"), 8).alias("p"))


def run(spark: SparkSession, answers: str, output: str, checkpoint: str, settings: dict | None = None) -> list[dict]:
    """One run over what is new; batch, rows and repeated keys of each batch."""
    s = SETTINGS | (settings or {})
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(answers)
    stream = stream.where("role = 'assistant'")
    query = keyed.start(stream, ["conv_id", "turn"], lambda batch: evaluated(batch, s["least_chars"]), output, checkpoint, "condition", SUMS, s["expected"], s["every"])
    done = keyed.finish(query)
    for x in done:
        log.info("batch %(batch)d: read %(rows)d rows of %(repeated)d known keys", x)
    keyed.publish(spark, output, "condition", list(SUMS), s["expected"], s["every"])
    last = keyed.published(spark, output)
    if last is not None:
        rows = last.collect()  # a row for each condition
        log.info("published %s: %d answers of %s in %s", rows[0]["state"], sum(r["rows"] for r in rows), s["expected"], output)
        if rows[0]["state"] == "final" and (done or keyed.found(lambda: spark.read.parquet(f"{output}/contrast")) is None):
            complete = keyed.results(spark, output)
            both = complete.where(F.col("condition").isin(PLACES)).groupBy("conv_id").agg(F.count_distinct("condition").alias("_n")).where("_n = 2")
            contrast(complete.join(both, "conv_id", "left_semi")).coalesce(1).write.mode("overwrite").parquet(f"{output}/contrast")
            log.info("wrote %s/contrast", output)
    return done


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """All that stands in the output: rows of kind answer, summary and contrast."""
    answers = keyed.results(spark, output).drop("batch").withColumn("kind", F.lit("answer"))
    summary = keyed.published(spark, output).drop("through").withColumn("kind", F.lit("summary"))
    paired = spark.read.parquet(f"{output}/contrast").withColumn("kind", F.lit("contrast"))
    return answers.unionByName(summary, allowMissingColumns=True).unionByName(paired, allowMissingColumns=True)


if __name__ == "__main__":
    command("evaluate_answers", {"answers": "folder of Parquet files that grows, or a pattern that a single file matches", "output": "folder of the results", "checkpoint": "folder of the stream's checkpoint"}, SETTINGS, run)
