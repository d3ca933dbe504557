import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import arrays as arr
from pairlens.functions import code, rules
from pairlens.functions import text as tx
from pairlens.operators import constraints as con
from pairlens.operators import execution, joins, models, mutations, predicates, selection
from pairlens.sources import readers, sinks
from pairlens.operators.constraints import ConstraintError
from pairlens.streaming import keyed


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())] if row else [(1,)], list(row) or ["_one"])
    return df.select(column).collect()[0][0]


def test_fences(spark):
    t = F.col("t")
    assert value(spark, tx.strip_fences(t), t="no code") == "no code"
    assert value(spark, tx.strip_fences(t), t="<think>x</think> hi\n```py\ndef f():\n  return 1\n```\nend") == "def f():\n  return 1\n"
    assert value(spark, tx.strip_fences(t), t="say\n```\nnothing\n```") == "say\n"
    assert value(spark, tx.strip_fences(t), t="```python\nreturn 1\n# todo\n```\n```\nreturn 2\n```") == "return 2\n"
    assert value(spark, tx.truncated(t), t="a\n### b\nExplanation: c") == "a"
    assert value(spark, tx.entry_point(t), t="x\n  def foo (a):") == "foo"
    assert value(spark, tx.without_problem_examples(t), t="a\nExample 1:\nx\nConstraints: y\n") == "a\nConstraints: y\n"
    assert value(spark, tx.stable_seed(t), t="abc") == 1677554 and value(spark, tx.stable_seed(t), t="") == 0
    assert value(spark, tx.token_distance(t, F.lit("a b 1")), t="b 1 c") == 0.5


def test_arrays(spark):
    assert value(spark, arr.all_true(F.col("a")), a=[True, True]) is True
    assert value(spark, arr.all_true(F.array().cast("array<boolean>"))) is True
    assert value(spark, arr.fenced_json(F.col("t")), t='so ```json\n{"a": 1}\n``` ok') == '{"a": 1}'
    assert value(spark, arr.fenced_json(F.col("t")), t='x [1, 2] y') == "[1, 2]"
    assert [tuple(x)[:2] for x in value(spark, arr.cases(F.col("t")), t='{"inputs": ["1"], "outputs": ["2"]}')] == [("1", "2")]
    assert [tuple(x)[:2] for x in value(spark, arr.cases(F.col("t")), t='[{"input": "1", "output": "2", "testtype": "stdin"}]')] == [("1", "2")]
    assert value(spark, arr.case_text(F.col("t")), t='{"input": "1", "output": "2"}') == "input: 1\nexpected output: 2"
    assert value(spark, arr.case_text(F.col("t")), t='{"stdin": "1", "stdout": "2"}') == "stdin: 1\nexpected stdout: 2"
    assert value(spark, arr.case_text(F.col("t")), t='{"q": 1}') == '{"q": 1}'
    assert value(spark, arr.canonical_lines(F.col("t")), t='[1,  2]\n x ') == "[1,2]\nx"


def test_code_functions():
    assert code.test_key("assert f( 1 )") == code.test_key("assert f(1)") and code.test_key(" (x ") == "(x"
    for v in (True, 3, 2.5, "a", [1], (1,), {"k": 1}, {1}, [], ""):
        new = code.corrupted(v)
        assert type(new) is type(v) and new != v
    with pytest.raises(ValueError):
        code.corrupted(None)
    assert code.type_profile((1, [2.0])) != code.type_profile([1, [2.0]])


def test_mutants_are_disjoint():
    text = "def f(xs, n):\n    return sum(x for x in xs if x > n + 1) if n else max(xs, key=abs)\n"
    a, b = mutations.mutants(text, "selection", limit=99), mutations.mutants(text, "validation", limit=99)
    assert a and b and not {o for o, _ in a} & {o for o, _ in b} and not {s for _, s in a} & {s for _, s in b}
    assert mutations.mutants(text, "selection", 3) == mutations.mutants(text, "selection", 3)
    assert len(mutations.mutants(text, "validation", limit=2)) == 2


def test_execution(spark):
    df = spark.createDataFrame([("a", "def f(): return 1", ["assert f() == 1", "assert f() == 2"]), ("b", "1/0", ["pass"]), ("c", "while True: pass", ["pass"])], "key string, code string, tests array<string>")
    with pytest.raises(PermissionError):
        execution.execute(df, "key", "code", "tests")
    got = {r.key: r for r in execution.execute(df, "key", "code", "tests", timeout=2, allow=True).collect()}
    assert got["a"].passed == [True, False] and got["b"].status == "initialization_error" and got["c"].status == "timeout"


def test_rules(spark):
    xs = F.col("xs")
    v = lambda c, x: value(spark, c, xs=x)
    assert v(rules.only_unique(xs), [1, 2, 1]) == [2]
    assert v(rules.chunks(xs, 2), [1, 2, 3]) == [[1, 2], [3]] and v(rules.chunks(xs, 2, False), [1, 2, 3]) == [[1, 2]]
    assert [tuple(x) for x in v(rules.run_lengths(xs), [1, 1, 2, 1])] == [(1, 2), (2, 1), (1, 1)]
    assert [tuple(x) for x in v(rules.group_counts(xs), [1, 1, 2, 1])] == [(1, 3), (2, 1)]
    df = spark.createDataFrame([([(1, 2), (2, 3), (5, 6)],)], "xs array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(rules.merged_intervals(xs)).collect()[0][0]] == [(1, 3), (5, 6)]
    assert len(df.select(rules.merged_intervals(xs, False)).collect()[0][0]) == 3
    assert value(spark, rules.overlapping_count(F.col("s"), F.lit("aa")), s="aaa") == 2 and value(spark, rules.separate_count(F.col("s"), F.lit("aa")), s="aaa") == 1


def test_order_and_joins(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "a int, g int").repartition(5)
    assert [r.place for r in selection.placed(df, ["a"]).orderBy("a").collect()] == list(range(50))
    assert sum(predicates.shard(df, ["a"], 4, k).count() for k in range(4)) == 50
    with pytest.raises(con.ConstraintError):
        joins.checked_join(df, df.where("a > 3"), ["a"])
    with pytest.raises(con.ConstraintError):
        selection.union_unique([df, df], ["a"])
    assert joins.without(df, df.where("a < 10"), ["a"]).count() == 40
    assert con.close(F.lit(1.0), F.lit(1.0)) is not None
    assert value(spark, predicates.percent(F.col("x"), signed=True), x=-0.0000001) == "+0.0"


def test_ridge_is_primal_ridge():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 4)), rng.random(20)
    k = x @ x.T
    got = models.ridge_predictions(k[:15, :15], y[:15], k[15:, :15], 0.5)
    a, mean = x[:15] - x[:15].mean(axis=0), y[:15].mean()
    scale = np.trace(a @ a.T) / 15
    w = np.linalg.solve(a.T @ a / scale + 0.5 * np.eye(4), a.T @ (y[:15] - mean) / scale)
    assert np.allclose(got, np.clip(mean + (x[15:] - x[:15].mean(axis=0)) @ w, 0, 1), atol=1e-10)


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in readers.growing_json_lines(spark, str(path), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.json_lines(spark, str(path), "a int").collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x_eval_all.jsonl").write_text('{"a": 5}\n')
    (tmp_path / "d" / "other.jsonl").write_text('{"a": 6}\n')
    assert [tuple(r) for r in readers.json_folder(spark, str(tmp_path / "d"), "a int").collect()] == [(5, "x_eval_all.jsonl")]
    (tmp_path / "t.csv").write_text("﻿k,v\n1,\n2,x\n")
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "t.csv"), "k int, v string").collect()] == [(1, None), (2, "x")]
    (tmp_path / "s.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.json_document(spark, str(tmp_path / "s.json"), "a int").count() == 2
    np.savez(tmp_path / "one.npz", prompt_end_hidden=np.ones((3, 4), np.float32))
    assert readers.tensors(spark, str(tmp_path)).count() == 3
    df = sinks.csv_columns([spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(3,)], "c int")], ["c"])
    assert df.columns == ["c", "a", "b"] and df.where("c = ''").count() == 1
    sinks.write_report(spark.createDataFrame([(float("nan"), 1)], "x double, y int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).collect()[0].x is None
    assert readers.released_between({"v1": ["a"], "v2": ["a", "b"]}, "v1", "v2") == ["b"]
    kinds = readers.record_kind(spark.createDataFrame([('{"protocol_version": "semantic-tests-1"}',), ('{"public_test_cases": "x"}',), ('{"z": 1}',)], "value string"))
    assert [r.kind for r in kinds.collect()] == ["protocol", "livecodebench", "skipped"]


def test_stream(spark, tmp_path):
    """Three runs over growing input: each takes only the new files, sums are published at steps, a repeated key raises."""
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    os.makedirs(source)

    def put(name, ids):
        with open(f"{source}/{name}", "w") as f:
            f.writelines(json.dumps({"id": i, "code": f"c{i}", "kind": "ab"[i % 2]}) + "\n" for i in ids)

    def go(repeated_ok=False):
        stream = spark.readStream.schema("id int, code string, kind string").option("maxFilesPerTrigger", 1).json(source)
        found = keyed.finish(keyed.start(stream, ["id"], lambda b: b.withColumn("passed", F.col("id") % 2 == 0), store, check, "kind", {"passed": "count_if(passed)"}, expected=6, every=3), repeated_ok)
        last = keyed.published(spark, store)
        return found, None if last is None else sorted((r["state"], r["kind"], r["rows"], r["passed"]) for r in last.collect())

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert go() == ([], None) and keyed.results(spark, store) is None
    put("1.json", [1, 2])
    assert go() == ([{"batch": 0, "rows": 2, "repeated": 0}], None)  # too few to publish
    put("2.json", [3, 4])
    assert go() == ([{"batch": 1, "rows": 2, "repeated": 0}], [("partial", "a", 2, 2), ("partial", "b", 2, 0)])
    assert go()[0] == []
    put("3.json", [4, 4, 5])
    with pytest.raises(ConstraintError, match="seen twice"):
        go()
    done = keyed.results(spark, store)
    assert sorted(r.id for r in done.collect()) == [1, 2, 3, 4, 5] and done.select("batch").distinct().count() == 3
    put("4.json", [5, 6])
    found, last = go(repeated_ok=True)
    assert found == [{"batch": 3, "rows": 2, "repeated": 1}] and last == [("final", "a", 3, 3), ("final", "b", 3, 0)]
    assert go()[1] == last and keyed.publish(spark, store, "kind", ["passed"], 6) is None
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    wanted = spark.createDataFrame([(1, "c1"), (2, "new"), (9, "c9")], "id int, code string")
    assert {r.id for r in keyed.pending(wanted, keyed.results(spark, store), ["id"], ["code"]).collect()} == {2, 9}
    assert keyed.state_of(3, 4) == "partial" and keyed.batches_until([1, 2, 3, 4], 2, 2, len) == 2
