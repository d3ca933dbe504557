"""Records and tables that come as text: task records of unlike shapes (S16), typed rows of a typeset table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import case_list, case_text
from ..operators.selection import filled_down

# Headings and closing lines of a problem's prompt, the name of a problem without one, and a number of a table.
QUESTION, STARTER = "### Question: ", "### Starter Code\n```python\n"
COMPLETE = "### Answer\nComplete the starter code in Python. Return only the code inside a Python markdown block.\n```python\n"
WRITE = "### Answer\nWrite a complete Python solution. Return only the code inside a Python markdown block.\n```python\n"
UNTITLED = "Programming problem"
TABLE_NUMBER = r"^[+-]?\d+\.\d$"


def _filled(record: Column, *keys: str) -> Column:
    """The first of a record's values, as text, that is there and not empty; '' if none is."""
    return F.coalesce(*(F.nullif(F.try_variant_get(record, f"$.{k}", "string"), F.lit("")) for k in keys), F.lit(""))


def _case_texts(record: Column, key: str) -> Column:
    """The cases of a record, given as JSON text or as JSON itself, as they are shown."""
    own = F.coalesce(F.try_variant_get(record, f"$.{key}", "string"), F.to_json(F.try_variant_get(record, f"$.{key}", "variant")))
    return case_list(own)


def problem_tasks(raw: DataFrame, dataset: str) -> DataFrame:
    """Of JSON texts in column value: task_id, prompt, tests (public, then private), n_public, entry_point, signature, canonical_code, platform, difficulty, contest_date,
    metadata (JSON text; '{}' without any) and dataset. A record that is no JSON has no task.

    Cases keep their order and become rows of their own only to be shown; they are gathered again by the record, whose cases one row held before.
    """
    v = F.col("_v")
    rows = raw.select(F.try_parse_json("value").alias("_v")).where("_v IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    title, content, starter = F.nullif(_filled(v, "question_title", "question_id"), F.lit("")), _filled(v, "question_content_no_public_tests", "question_content"), _filled(v, "starter_code")
    head = F.concat(F.lit(QUESTION), F.coalesce(title, F.lit(UNTITLED)), F.lit("\n\n"), tx.strip(content), F.lit("\n\n"))
    prompt = F.concat(head, F.when(starter == "", WRITE).otherwise(F.concat(F.lit(STARTER), F.rtrim(starter, F.lit(tx.WHITE_SPACE)), F.lit("\n```\n\n" + COMPLETE))))
    heads = F.filter(F.transform(tx.lines(starter), lambda x: tx.strip(x)), lambda x: x.startswith("def ") & F.contains(x, F.lit("(")))
    name = tx.strip(F.split_part(F.substr(F.get(heads, F.lit(0)), F.lit(5)), F.lit("("), F.lit(1)))
    public, private = _case_texts(v, "public_test_cases"), _case_texts(v, "private_test_cases")
    extra = F.coalesce(F.try_variant_get(v, "$.metadata", "string"), F.to_json(F.try_variant_get(v, "$.metadata", "variant")))
    tasks = rows.select(
        "_row", _filled(v, "question_id", "task_id", "question_title").alias("task_id"), prompt.alias("prompt"), F.concat(public, private).alias("_cases"), F.size(public).alias("n_public"), F.coalesce(name, F.lit("")).alias("entry_point"),
        starter.alias("signature"), _filled(v, "code").alias("canonical_code"), *(_filled(v, k).alias(k) for k in ("platform", "difficulty", "contest_date")), F.coalesce(F.to_json(F.try_parse_json(F.nullif(tx.strip(extra), F.lit("")))), F.lit("{}")).alias("metadata"),
    )
    shown = tasks.select("*", F.posexplode_outer("_cases").alias("_at", "_case")).withColumn("_case", case_text(F.col("_case")))
    keep = [c for c in tasks.columns if c not in ("_row", "_cases")]
    gathered = shown.groupBy("_row").agg(*(F.first(c).alias(c) for c in keep), F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_case")))).alias("_shown"))
    return gathered.select(*keep, F.transform("_shown", lambda s: s["_case"]).alias("tests"), F.lit(dataset).alias("dataset"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and _order: the lines of text files, by file, then place; a file may be read by many tasks."""
    lines = spark.read.text(path)
    return lines.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_order"))


def table_rows(spark: SparkSession, path: str, names: list[str], numbers: list[str], groups: list[str]) -> DataFrame:
    """The rows of a typeset table (cells parted by &, ended by two backslashes), as columns ``names``, those of ``numbers`` as doubles.

    A line counts if it has as many cells and its numbers are numbers. An empty cell of ``groups`` takes what stands above it.
    """
    lines = ordered_lines(spark, path)
    cells = F.transform(F.split(F.regexp_replace("value", r"\\\\\s*$", ""), "&"), lambda x: tx.strip(x))
    rows = lines.select("_order", cells.alias("_c")).where(F.size("_c") == len(names)).select("_order", *(F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names)))
    for n in numbers:
        rows = rows.where(F.col(n).rlike(TABLE_NUMBER)).withColumn(n, F.col(n).cast("double"))
    for g in groups:
        rows = filled_down(rows.withColumn(g, F.nullif(F.col(g), F.lit(""))), "_order", g)
    return rows.select(*names)
