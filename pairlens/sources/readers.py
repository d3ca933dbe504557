"""Sources (S1-S17): JSON lines, JSON documents, CSV, tensors, file sets."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import GENERATION, OBSERVATION, TASK

SCHEMAS = {"observation": OBSERVATION, "task": TASK, "generation": GENERATION}


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line (gzip by extension); blank lines are skipped, a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def growing_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are being written (not compressed): what stands after the last line feed is left out, a malformed whole line raises.

    A file is read by lines, in as many tasks as it has blocks. Its last line is whole if the lines' bytes, with a line feed for each, come to the size that was
    listed (a byte-order mark, which the reader leaves out, is 3 bytes); what is written after the listing counts as torn. No file, no lines: no rows.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_at"))
    ends = lines.groupBy("_file").agg(F.sum(F.octet_length("value") + 1).alias("_read"), F.max("_size").alias("_size"), F.max("_at").alias("_at"))
    torn = ends.where((F.col("_read") != F.col("_size")) & (F.col("_read") + 3 != F.col("_size"))).select("_file", "_at")
    whole = lines.join(torn, ["_file", "_at"], "left_anti").where(F.btrim("value", F.lit(" \t\r")) != "")
    return whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def json_folder(spark: SparkSession, path: str, schema: str, pattern: str = "*_eval_all.jsonl") -> DataFrame:
    """All files of a folder that fit a pattern, with their name as column file."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(path)
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a heading, '' as null, a byte-order mark allowed."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").option("mode", "FAILFAST").csv(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one object, or an array with a row for each element."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def listed_files(spark: SparkSession, folders: list[str], pattern: str = "*.npz", part: int = -1) -> DataFrame:
    """Name, path, place of each file in the folders, or of each that is one itself, without its content. ``place`` is the folder's position in the list; one
    that is missing is passed over. ``part``: which part of the path is the name."""
    out = spark.createDataFrame([], "name string, path string, place int")
    for place, folder in enumerate(folders):  # a short list, by the user
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
            out = out.unionAll(files.select(F.element_at(F.split("path", "/"), part).alias("name"), "path", F.lit(place).alias("place")))
    return out


def first_by_name(files: DataFrame) -> DataFrame:
    """Of each name the file in the first folder that has it, there the one of least path."""
    return files.groupBy("name").agg(F.min(F.struct("place", "path")).alias("_first")).select("name", "_first.path", "_first.place")


def resolved(rows: DataFrame, column: str, files: DataFrame, part: int = -1) -> DataFrame:
    """Rows with found_path and found_place: the file that a path names if it is among the files, else the first one of its name; null if there is neither, or no
    path. Two joins of names; no file is opened."""
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    exact = files.groupBy(plain(F.col("path")).alias("_plain")).agg(F.min(F.struct("place", "path")).alias("_exact"))
    named = first_by_name(files).select(F.col("name").alias("_name"), F.struct("place", "path").alias("_named"))
    keyed = rows.withColumn("_plain", plain(F.nullif(F.col(column), F.lit("")))).withColumn("_name", F.try_element_at(F.split("_plain", "/"), F.lit(part)))
    found = keyed.join(exact, "_plain", "left").join(named, "_name", "left").withColumn("_found", F.coalesce("_exact", "_named"))
    return found.withColumn("found_path", F.col("_found.path")).withColumn("found_place", F.col("_found.place")).drop("_plain", "_name", "_exact", "_named", "_found")


def tensors(spark: SparkSession, path: str, member: str = "prompt_end_hidden") -> DataFrame:
    """Name, layer, vector (array of double) of each row of a matrix in NPZ files; values that aren't finite raise. Of files with the same
    name in several folders, the one of least path counts; the others are known by name and not opened by NumPy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"]):
                found = np.load(io.BytesIO(content))[member].astype(np.float64)
                if not np.isfinite(found).all():
                    raise ValueError(f"{name}: not finite")
                rows += [(name, i, row.tolist()) for i, row in enumerate(found)]
            yield pd.DataFrame(rows, columns=["name", "layer", "vector"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    names = listed_files(spark, [path])
    others = names.select("path").subtract(first_by_name(names).select("path"))
    return files.join(others, "path", "left_anti").select("name", "content").mapInPandas(run, "name string, layer int, vector array<double>")


def released_between(files: dict[str, list[str]], old: str | None, new: str) -> list[str]:
    """Files of a release that an earlier one doesn't have."""
    before = set(files.get(old, [])) if old else set()
    return [f for f in files[new] if f not in before]


def record_kind(raw: DataFrame) -> DataFrame:
    """Of JSON texts in column value, which kind each is, by the keys it has, in fixed order."""
    v = F.try_parse_json("value")
    has = lambda key: F.is_variant_null(F.try_variant_get(v, f"$.{key}", "variant")).isNotNull() & F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    kind = F.when(F.try_variant_get(v, "$.protocol_version", "string") == "semantic-tests-1", "protocol").when(has("public_test_cases"), "livecodebench").when(has("base_input") | has("plus_input"), "evalplus").when(has("test") | has("test_list"), "plain").otherwise("skipped")
    return raw.withColumn("kind", kind)


def with_side_tests(tasks: DataFrame, tests: DataFrame, key: str, column: str) -> DataFrame:
    """Tasks with tests from a second table, an empty array where it has none."""
    return tasks.join(tests.select(key, F.col(column).alias("_side")), key, "left").withColumn(column, F.coalesce("_side", F.array().cast("array<string>"))).drop("_side")


def source_tree(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """Path, folder, name and text of each program file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("value").alias("text"))


def dry_run(tasks: DataFrame, solution: str = "reference_code") -> DataFrame:
    """Tasks with their reference solution in place of a model's answer."""
    return tasks.withColumn("completion", F.col(solution)).withColumn("finish_reason", F.lit("dry_run"))
