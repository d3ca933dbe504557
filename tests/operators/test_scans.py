"""Scans over lines and characters against plain Python."""

import json
import random

from pyspark.sql import functions as F

from pairlens.functions import scans


def mapped(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", column(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(rows.collect())]


LINES = [">>> f(1)", "    >>> g('a', 2)", ">>> ", ">>>", "2", "  'x y'", "", "   ", "text", '    """', "'''", '    done"""', '>>> h("""q""")', "def f(x):", '    """Say it.']


def sections(text):
    """(lines before, [(expression, lines below)]) with examples that end before the next one or a text's end."""
    out, now = [], None
    for x in text.splitlines():
        s = x.strip()
        if s.startswith(">>> "):
            now = (s[4:].strip(), [])
            out.append(now)
        elif s.endswith(('"""', "'''")):
            now = None
        elif now and s:
            now[1].append(s)
    return [f"assert {e} == {' '.join(w)}" for e, w in out if e and w]


def outside(text, ends):
    kept, inside = [], False
    for x in text.splitlines():
        s = x.strip()
        if s.startswith(">>> "):
            inside = True
        elif inside and ends and s.endswith(('"""', "'''")):
            inside = False
            kept.append(x)
        elif inside and not ends and not s:
            inside = False
        elif not inside:
            kept.append(x)
    return "\n".join(kept)


def test_examples(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [">>> f(1)\r\n1\r\n"]
    assert mapped(spark, texts, scans.example_assertions) == list(map(sections, texts))
    assert mapped(spark, texts, scans.prompt_without_examples) == [outside(t, True).rstrip() + "\n" for t in texts]
    assert mapped(spark, texts, scans.docstring_without_examples) == [outside(t, False).strip() for t in texts]


def test_blocks_and_lists(spark):
    texts = ["", "- assert a", "12. assert b\n* - assert c == 1\nassert", " 3) assert d", "so {1} and [2", "] [", "}{", "x{", "{}", "a [b] c } d", "no"]
    assert mapped(spark, texts, scans.listed_assertions) == [[s for x in t.splitlines() if (s := x.strip().lstrip("-*0123456789. ")).startswith("assert ")] for t in texts]

    def block(t):
        starts, ends = [t.find(c) for c in "{[" if c in t], max(t.rfind("}"), t.rfind("]"))
        return t[min(starts) : ends + 1] if starts and ends > min(starts) else ""

    assert mapped(spark, texts, scans.braced_block) == list(map(block, texts))


def decoded(text):
    out = []
    for i, c in enumerate(text):
        if c in "[{":
            try:
                _, end = json.JSONDecoder().raw_decode(text[i:])
            except ValueError:
                continue
            out.append(text[i : i + end])
    return out


def cases(text):
    for piece in reversed(decoded(text)):
        value = json.loads(piece)
        value = value.get("tests") if isinstance(value, dict) else value
        found = [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []
        if found:
            return found
    return []


PIECES = ['[1, 2]', '{"a": "x]"}', '"', "\\", '\\"', "[", "]", "{", "}", '{"tests": [', '{"input": "1"}', ", ", "word ", '"k": ', '["q\\"[", {}]', "{'a': 1}", "[1,]", "\n", "é[]", '"tests": []}', "[[[]]]", '"a [1] b"']


def test_every_piece_of_json_is_found(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    texts += ["", "none", json.dumps({"tests": [{"input": '"[{', "output": "\\"}] * 3}), 'first {"tests": [{"a": 1}]} then {"tests": []} and [3]', "[" * 500 + "]" * 500, 'x "quoted {"tests": [{"b": 2}]}']
    # repeated keys are no JSON to Spark; leave such out
    texts = [t for t in texts if all(_unique(p) for p in decoded(t))]
    assert mapped(spark, texts, scans.json_candidates) == list(map(decoded, texts))
    assert [[json.loads(x) for x in found] for found in mapped(spark, texts, scans.reply_cases)] == list(map(cases, texts))


def _unique(piece):
    def hook(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    try:
        json.loads(piece, object_pairs_hook=hook)
    except ValueError:
        return False
    return True


def test_scans_of_a_small_file_use_all_cores(spark, tmp_path):
    """A small file is read in one task; each of its rows costs much."""
    from pairlens.plans import registry

    parts = spark.range(400).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'B' AS p_brand", "CAST(id % 50 AS INT) AS p_size")
    events = spark.range(400).selectExpr("id AS event_id", "'click' AS event_type", "'{\"k\": 1}' AS props")
    for name, df in (("part", parts), ("events", events)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("example_scan", "reply_scan"):
        found = registry.QUERIES[name](spark, str(tmp_path))
        assert found.count() == 400 and found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_cases_of_pieces(spark):
    """The last piece that has cases counts, and pieces without any behind it don't."""
    df = spark.createDataFrame([(['[{"a": 1}]', '{"tests": [{"b": 2}, 3]}', "[4]"],), (["[1]", "{}"],), ([],), (None,)], "pieces array<string>")
    assert [r[0] for r in df.select(scans.cases_of(F.col("pieces"))).collect()] == [['{"b":2}'], [], [], []]
