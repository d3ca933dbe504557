"""Sinks (S21-S28): JSON lines, CSV, nested reports, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """S21, S22."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def csv_columns(parts: list[DataFrame], preferred: list[str]) -> DataFrame:
    """The union of tables of unlike columns: preferred ones first, the others by name; what a table lacks is ''."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    order = [c for c in preferred if c in out.columns] + sorted(c for c in out.columns if c not in preferred)
    return out.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in order))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """With a heading; only the named fields if there are any."""
    (df.select(*fields) if fields else df).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def without_nan(df: DataFrame) -> DataFrame:
    """Doubles that aren't finite as null, so that a JSON report stays valid."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({f.name: F.when(~bad(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_report(df: DataFrame, path: str) -> None:
    """Nested columns as JSON."""
    without_nan(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors as a Parquet column."""
    df.write.mode("overwrite").parquet(path)


def write_variants(df: DataFrame, path: str, by: list[str]) -> None:
    """A folder for each combination of the named columns."""
    df.write.mode("overwrite").partitionBy(*by).json(path)
