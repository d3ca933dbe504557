import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import aggregates, constraints
from pairlens.sources import readers


@pytest.mark.parametrize("end, want", [("", 3000), ("\n", 3000), ('\n{"a": 3', 3000), ('\n{"a": 9999}', 3000), ('\n\n \r\n{"a": 9999}\r\n', 3001)])
def test_growing_files_in_many_blocks(spark, tmp_path, end, want):
    """What no line feed ends is left out, valid or not, in whichever block it lies; a file without that keeps all."""
    lines = "\n".join(f'{{"a": {i}}}' for i in range(3000))
    (tmp_path / "log.jsonl").write_text(lines + end)
    (tmp_path / "torn.jsonl").write_text('{"a": -1}')
    (tmp_path / "none.jsonl").write_text("")
    (tmp_path / "marked.jsonl").write_bytes(b'\xef\xbb\xbf{"a": -2}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = sorted(r.a for r in readers.growing_json_lines(spark, str(tmp_path), "a int").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [-2, *range(3000 - (end == "")), *([9999] if want > 3000 else [])]


def test_malformed_whole_line_raises(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.growing_json_lines(spark, str(tmp_path), "a int").collect()


def test_index_of_files(spark, tmp_path):
    for name in ("one/a.npz", "one/deep/b.npz", "two/b.npz", "two/c.npz", "two/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        np.savez(tmp_path / name, prompt_end_hidden=np.ones((2, 3))) if name.endswith("npz") else (tmp_path / name).write_text("")
    folders = [str(tmp_path / x) for x in ("none", "one", "two")]
    files = readers.listed_files(spark, folders)
    assert {(r.name, r.place) for r in readers.first_by_name(files).collect()} == {("a.npz", 1), ("b.npz", 1), ("c.npz", 2)}
    rows = [(0, str(tmp_path / "two/b.npz")), (1, "/gone/b.npz"), (2, "/gone/z.npz"), (3, None), (4, ""), (5, "c.npz"), (5, "c.npz")]
    got = sorted((r.i, r.found_place) for r in readers.resolved(spark.createDataFrame(rows, "i int, p string"), "p", files).collect())
    assert got == [(0, 2), (1, 1), (2, None), (3, None), (4, None), (5, 2), (5, 2)]
    single = readers.listed_files(spark, [str(tmp_path / "two/c.npz")])
    assert [r.name for r in single.collect()] == ["c.npz"]
    assert readers.tensors(spark, str(tmp_path)).groupBy("name").count().where(F.col("count") == 2).count() == 3


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (3, 1, 2, 2)] + [("b", x) for x in (5, 4, 6)] + [("c", None), ("d", 7), ("d", None)], "k string, v int")
    got = {r.k: (r.n, r.upper_median) for r in aggregates.quartiles(df, ["k"], "v").collect()}
    assert got == {"a": (4, 2), "b": (3, 5), "c": (0, None), "d": (1, 7)}


def test_clip_and_hashes(spark):
    df = spark.createDataFrame([(1, -3.0, "a"), (2, 0.5, "b"), (3, float("inf"), None), (4, float("nan"), "x"), (5, None, "y")], "i int, v double, h string")
    got = {r.i: r.c for r in df.select("i", constraints.clipped(F.col("v"), 0, 1).alias("c")).collect()}
    assert (got[1], got[2], got[3], got[5]) == (0.0, 0.5, 1.0, None) and np.isnan(got[4])
    found = F.when(F.col("i") < 3, F.lit("a"))
    assert [r.i for r in constraints.unlike_hashes(df, ["i"], found, "h").orderBy("i").collect()] == [2, 4, 5]
    with pytest.raises(constraints.ConstraintError):
        constraints.require(constraints.unlike_hashes(df, ["i"], found, "h"), "hashes")
    assert constraints.unlike_hashes(df.limit(0), ["i"], found, "h").count() == 0
