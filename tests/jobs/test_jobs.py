"""The jobs: their SQL, growing input, repeated runs, failed runs, command lines."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import common, evaluate_answers, prepare_protocol, queries
from pairlens.operators.constraints import ConstraintError
from pairlens.streaming import keyed

DIR = "/root/testdata/sf0.001"


def rows_of(df):
    columns = sorted(df.columns)
    plain = lambda x: round(x, 7) if isinstance(x, float) else x
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    before = dict(spark.conf.getAll)
    got = entry.queries()[name](spark, DIR)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in sorted(got.columns)]
    plain = lambda x: round(x, 7) if isinstance(x, float) else x
    assert rows_of(got) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert before == dict(spark.conf.getAll)


def conversations(spark, first, last):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where(F.col("conv_id").between(first, last))


def test_answers_over_growing_input(spark, tmp_path):
    """Each run takes only the new files; the end is the same as of one run over all; the parts are copies."""
    source, parts = str(tmp_path / "in"), [(0, 29), (30, 44), (45, 99)]
    go = lambda: evaluate_answers.run(spark, source, str(tmp_path / "out"), str(tmp_path / "check"), {"expected": total, "every": 40})
    total = conversations(spark, 0, 99).where("role = 'assistant'").count()
    states, seen = [], 0
    for a, b in parts:
        part = conversations(spark, a, b)
        part.coalesce(1).write.mode("append").parquet(source)
        done = go()
        assert sum(x["rows"] for x in done) == part.count()  # as many rows as came, however much came before
        seen += part.where("role = 'assistant'").count()
        last = keyed.published(spark, str(tmp_path / "out"))
        states.append(None if last is None else (last.first()["state"], sum(r["rows"] for r in last.collect()) <= seen))
        assert go() == []
    assert states[0] == ("partial", True) and states[-1] == ("final", True)
    one = str(tmp_path / "one")
    conversations(spark, 0, 99).coalesce(1).write.parquet(one)
    evaluate_answers.run(spark, one, str(tmp_path / "out1"), str(tmp_path / "check1"), {"expected": total})
    assert rows_of(evaluate_answers.output_of(spark, str(tmp_path / "out"))) == rows_of(evaluate_answers.output_of(spark, str(tmp_path / "out1")))
    # an answer that comes again is counted, and changes nothing
    before = rows_of(evaluate_answers.output_of(spark, str(tmp_path / "out")))
    conversations(spark, 0, 3).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(ConstraintError, match="seen twice"):
        go()
    assert rows_of(evaluate_answers.output_of(spark, str(tmp_path / "out"))) == before and go() == []


def test_answers_after_a_failed_run(spark, tmp_path, monkeypatch):
    """A batch that fails after it wrote its results is done again, and leaves the same."""
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]
    conversations(spark, 0, 49).repartition(2).write.parquet(paths[0])
    total = conversations(spark, 0, 49).where("role = 'assistant'").count()
    publish = keyed.publish

    def failing(*args, **kwargs):
        publish(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(keyed, "publish", failing)
    with pytest.raises(Exception, match="lost"):
        evaluate_answers.run(spark, *paths, {"expected": total, "files_per_batch": 1})
    monkeypatch.setattr(keyed, "publish", publish)
    evaluate_answers.run(spark, *paths, {"expected": total, "files_per_batch": 1})
    other = [paths[0], str(tmp_path / "out1"), str(tmp_path / "check1")]
    evaluate_answers.run(spark, *other, {"expected": total})
    assert rows_of(evaluate_answers.output_of(spark, paths[1])) == rows_of(evaluate_answers.output_of(spark, other[1]))


def test_answers_edges(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]
    rows = [(1, 1, "assistant", None), (1, 3, "assistant", ""), (2, 1, "assistant", "pass"), (3, 2, None, "x"), (3, 3, "assistant", "word " * 100), (4, 1, "assistant", "long line. " * 5000), (5, 1, "assistant", "cut here\n### more" * 50)]
    spark.createDataFrame(rows, evaluate_answers.SCHEMA).withColumns({"condition": F.lit("clash"), "batch": F.lit(9)}).coalesce(1).write.parquet(paths[0])
    evaluate_answers.run(spark, *paths)
    got = {(r["conv_id"], r["turn"]): (r["condition"], r["reason"], r["n_lines"]) for r in keyed.results(spark, paths[1]).collect()}
    assert got == {(1, 1): ("first", "empty", 0), (1, 3): ("second", "empty", 0), (2, 1): ("first", "stub", 1), (3, 3): ("second", "unfinished", 1), (4, 1): ("first", None, 1), (5, 1): ("first", "short", 1)}
    assert keyed.published(spark, paths[1]) is None  # too few, and no number is expected


def texts(spark, path, rows, labels=(), benchmark=()):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark")
    return [f"{path}/{t}" for t in ("documents", "labels", "benchmark")]


def test_protocol_twice_and_over_more(spark, tmp_path):
    passage = "this passage of the benchmark is held out of all tasks"
    line = lambda i: f"a line of text {i} that is long enough to be kept by the job, as it has many words"
    rows = [(i, "\n".join(line(i * 10 + j) for j in range(4)), "en" if i % 3 else None, f"s{i % 7}") for i in range(60)]
    rows += [(100, None, "en", "s1"), (101, "\n\n", "en", "s1"), (102, "short", "en", "s1"), (103, line(1) * 3 + "\n  this passage of the benchmark is held   out of all tasks", "de", "s1"), (104, rows[5][1] + "\n", "fr", "s9"), (105, line(8) * 9, "en", "s2"), (106, line(9) * 9, "en", "s2")]
    paths = texts(spark, str(tmp_path / "in"), rows, [(105, 0, 0), (106, 1, 1), (5, 1, 0), (6, 1, 0), (7, 1, 0)], [(1, passage + "\nx"), (2, None)])
    out = str(tmp_path / "out")
    counts = prepare_protocol.run(spark, *paths, out)
    assert counts == {"documents": 67, "rejected": 7, "tasks": 180}
    gone = {r["doc_id"]: r["reason"] for r in prepare_protocol.rejected(spark, out).collect()}
    assert gone == {100: "empty", 101: "empty", 102: "short", 103: "leaked", 104: "repeated", 105: "bad", 106: "toxic"}
    first = rows_of(prepare_protocol.output_of(spark, out))
    assert prepare_protocol.run(spark, *paths, out) == counts and rows_of(prepare_protocol.output_of(spark, out)) == first
    prepare_protocol.run(spark, *paths, out, {"folds": 3, "conditions": ["nl_only"]})  # no partition of the other run stays
    tasks = spark.read.parquet(f"{out}/tasks")
    assert tasks.count() == 60 and {r[0] for r in tasks.select("fold").distinct().collect()} == {0, 1, 2}


def test_protocol_refuses_repeated_ids_and_holds_nothing_back(spark, tmp_path):
    long = "a line that is long enough " * 20
    paths = texts(spark, str(tmp_path / "in"), [(1, long, "en", "a"), (1, long + "x", "en", "a")])
    with pytest.raises(ConstraintError, match="more than once"):
        prepare_protocol.run(spark, *paths, str(tmp_path / "out"))
    paths = texts(spark, str(tmp_path / "in2"), [(1, long, "en", "a"), (2, long + "x", "en", "b")])
    assert prepare_protocol.run(spark, *paths, str(tmp_path / "out2")) == {"documents": 2, "rejected": 0, "tasks": 6}


def test_settings(spark, tmp_path):
    for name, job in (("evaluate_answers", evaluate_answers), ("prepare_protocol", prepare_protocol)):
        assert common.configured(spark, f"file://{os.path.dirname(common.__file__)}/{name}.json", job.SETTINGS) == job.SETTINGS
    (tmp_path / "x.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(ValueError, match="unknown settings"):
        common.configured(spark, str(tmp_path / "x.json"), {"known": 1})


def test_command_line(spark, tmp_path):
    conversations(spark, 0, 9).coalesce(1).write.parquet(str(tmp_path / "in"))
    given = ["--answers", tmp_path / "in", "--output", tmp_path / "out", "--checkpoint", tmp_path / "check", "--config", "jobs/evaluate_answers.json"]
    root = os.path.dirname(entry.__file__)
    done = subprocess.run([sys.executable, "-m", "jobs.evaluate_answers", *map(str, given)], cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read" in done.stderr
    assert keyed.results(spark, str(tmp_path / "out")).count() == conversations(spark, 0, 9).where("role = 'assistant'").count()


def test_protocol_squeezes_by_no_pattern_and_joins_no_texts(spark, tmp_path, monkeypatch):
    """Tasks come from one pass: no exchange carries texts; the check of what is written finds a line that is shown, or hidden in any one condition."""
    rows = [(i, "\n".join(f"line {j} of text {i}, with as many words as it needs to be kept" for j in range(5)), "en", f"s{i % 3}") for i in range(12)]
    paths = texts(spark, str(tmp_path / "in"), rows, benchmark=[(1, "one line of the benchmark that no task may show or hide")])
    out, s = str(tmp_path / "out"), prepare_protocol.SETTINGS
    prepare_protocol.run(spark, *paths, out)
    docs, held_out = spark.read.parquet(paths[0]), spark.read.parquet(paths[2])
    kept = prepare_protocol.read_texts(docs, spark.read.parquet(paths[1]))
    monkeypatch.setattr(prepare_protocol.models, "stratified_group_folds", lambda *_: spark.createDataFrame([("en-s0", 0), ("en-s1", 1), ("en-s2", 2)], "family string, fold int"))
    tasks = prepare_protocol.tasks_of(kept.where("label = 'unknown'").hint("broadcast"), s)
    plan = tasks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and tasks.count() == 36  # of labels and of folds
    for bad, column in (("nl_only", "hidden"), ("nl_tests_1", "hidden"), ("nl_tests", "tests")):
        leak = F.when((F.col("doc_id") == 4) & (F.col("condition") == bad), F.array(F.lit("one line of the  benchmark that no task may show or hide"))).otherwise(F.col(column))
        other = str(tmp_path / f"{bad}-{column}")
        spark.read.parquet(f"{out}/tasks").withColumn(column, leak).write.partitionBy("fold", "condition").parquet(f"{other}/tasks")
        prepare_protocol.rejected(spark, out).withColumn("reason", F.lit("x")).write.parquet(f"{other}/rejected")
        with pytest.raises(ConstraintError, match="different lines|is left"):
            prepare_protocol.verified(spark, docs, held_out, other, s)
