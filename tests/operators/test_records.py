"""Records and tables that come as text."""

import json

from pyspark.sql import functions as F

from pairlens.operators import selection
from pairlens.sources import records


def test_problem_records_of_all_shapes(spark):
    rows = [
        {"question_id": 7, "question_title": "T", "question_content": " c \n", "public_test_cases": json.dumps([{"input": "1", "output": [1, None]}, "no case"]), "private_test_cases": {"test_cases": [{"stdin": "a", "stdout": "b"}]}, "metadata": '{"a": 1}', "code": "x"},
        {"question_id": "", "task_id": "t/2", "question_content": "c", "starter_code": "import a\n\n  def  go (x):\n", "public_test_cases": "broken [", "private_test_cases": json.dumps({"input": "1"}), "metadata": "broken"},
        {"question_title": None, "platform": "p", "difficulty": "d", "contest_date": "2024"},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("no json",), (None,)], "value string").withColumn("_row", F.lit("clash"))
    got = {r["task_id"]: r.asDict() for r in records.problem_tasks(raw, "lcb").collect()}
    assert set(got) == {"7", "t/2", ""} and {r["dataset"] for r in got.values()} == {"lcb"}
    assert got["7"]["tests"] == ["input: 1\nexpected output: [1, None]", "stdin: a\nexpected stdout: b"] and got["7"]["n_public"] == 1
    assert got["7"]["prompt"].startswith("### Question: T\n\nc\n\n### Answer\nWrite") and got["7"]["metadata"] == '{"a":1}' and got["7"]["canonical_code"] == "x"
    assert got["t/2"]["tests"] == ['{"input": "1"}'] and got["t/2"]["n_public"] == 0 and got["t/2"]["entry_point"] == "go" and got["t/2"]["metadata"] == "{}"
    assert got["t/2"]["prompt"].startswith("### Question: Programming problem\n\nc\n\n### Starter Code\n```python\nimport a\n\n  def  go (x):\n```\n\n### Answer\nComplete")
    assert got[""]["tests"] == [] and got[""]["platform"] == "p" and got[""]["contest_date"] == "2024"


def test_filled_down_over_ranges(spark):
    values = [None, None, "a", None, None, "b", *[None] * 300, "c", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(7)
    got = [r["v"] for r in selection.filled_down(df, "i", "v").orderBy("i").collect()]
    want, now = [], None
    for v in values:
        now = v if v is not None else now
        want.append(now)
    assert got == want


def test_table_of_two_files(spark, tmp_path):
    (tmp_path / "a.tex").write_text("\\toprule\nModel & n & x \\\\\n\\midrule\nM1 & 1 & 1.5 \\\\\n & 2 & -2.0\\\\\n & 3 & n/a \\\\\n & 4 & +3.25 \\\\\n")
    (tmp_path / "b.tex").write_text(" & 5 & 0.5 \\\\\nM2 & 6 & 7.0\n & too & few & many \\\\\n & 8 & 9.0 \\\\  \n")
    got = sorted(map(tuple, records.table_rows(spark, str(tmp_path), ["model", "n", "x"], ["x"], ["model"]).collect()), key=lambda r: r[1])
    assert got == [("M1", "1", 1.5), ("M1", "2", -2.0), ("M1", "5", 0.5), ("M2", "6", 7.0), ("M2", "8", 9.0)]
