"""Tasks of an experiment: prompts for conditions, programs of replies, cases, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as arr
from ..functions import conditions, programs, rules, scans
from ..functions import text as tx
from ..operators import matching, models, sampling
from ..operators.selection import top_k
from ..session import load, scratch, spread_out
from ..sources import records
from .catalog import query

_CONDITIONS = ["nl_only", "nl_tests_2", "shuffled_tests", "irrelevant_tests_k1", "test_names_only_3", "asserts_only", "nl_tests_all"]


@query(f"""WITH t AS (SELECT o_custkey AS k, list(['input: ' || o_orderkey || chr(10) || 'expected output: ', o_orderstatus] ORDER BY o_orderkey)[1:4] AS p FROM orders GROUP BY 1),
d AS (SELECT k, list_transform(p, lambda x: x[1]) AS g, list_transform(p, lambda x: x[2]) AS o, list_transform(p, lambda x: x[1] || x[2]) AS tests FROM t WHERE len(list_distinct(list_transform(p, lambda x: x[2]))) > 1),
s AS (SELECT *, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split('t' || k, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda t, c: (t * 131 + c) % 2147483647) AS VARCHAR) AS seed FROM d),
m AS (SELECT *, list_transform(list_sort(list_transform(range(len(o)), lambda i: [md5(seed || '-' || i), o[i + 1]])), lambda x: x[2]) AS mixed FROM s),
z AS (SELECT *, CASE WHEN mixed = o THEN list_append(o[2:], o[1]) ELSE mixed END AS turned, k % 2 = 0 AS structured, 'Solve ' || k || '.' || chr(10) || chr(10) AS head, '### Answer' || chr(10) || 'go' AS tail FROM m),
c AS (SELECT *, unnest({_CONDITIONS}) AS condition FROM z),
x AS (SELECT *, CASE condition WHEN 'nl_only' THEN [] WHEN 'nl_tests_2' THEN tests[1:2] WHEN 'shuffled_tests' THEN list_transform(range(1, len(o) + 1), lambda i: g[i] || turned[i]) WHEN 'irrelevant_tests_k1' THEN ['odd ' || k] WHEN 'test_names_only_3' THEN tests[1:3] ELSE tests END AS ts FROM c),
y AS (SELECT *, array_to_string(list_transform(range(1, len(ts) + 1), lambda i: 'Test ' || i || chr(10) || ts[i]), chr(10) || chr(10)) AS numbered, array_to_string(list_transform(ts, lambda t: '# ' || t), chr(10)) AS commented,
  list_transform(range(1, len(ts) + 1), lambda i: 'test_' || i || ': go') AS names FROM x)
SELECT 't' || k AS task_id, condition, array_to_string(ts, '|') AS tests, CASE
  WHEN condition = 'nl_only' THEN head || tail
  WHEN condition = 'asserts_only' AND structured THEN '### Function Signature' || chr(10) || '```python' || chr(10) || 'import re' || chr(10) || chr(10) || 'def go(x):' || chr(10) || '```' || chr(10) || chr(10) || '### Visible Test Cases' || chr(10) || numbered || chr(10) || chr(10) || '### Answer' || chr(10) || 'Write a complete Python solution. Return only the code inside a Python markdown block.' || chr(10) || '```python' || chr(10)
  WHEN condition = 'asserts_only' THEN 'import re' || chr(10) || chr(10) || '# Implement the function so that the assertions pass.' || chr(10) || commented || chr(10) || chr(10) || 'def go(x):' || chr(10)
  WHEN condition = 'test_names_only_3' AND structured THEN head || '### Visible Test Names' || chr(10) || array_to_string(list_transform(names, lambda n: '- ' || n), chr(10)) || chr(10) || chr(10) || tail
  WHEN condition = 'test_names_only_3' THEN head || tail || chr(10) || '# Tests:' || chr(10) || array_to_string(list_transform(names, lambda n: '# ' || n), chr(10)) || chr(10) || chr(10)
  WHEN structured THEN head || '### Visible Test Cases' || chr(10) || numbered || chr(10) || chr(10) || tail
  ELSE head || tail || chr(10) || chr(10) || '# The implementation should satisfy these tests:' || chr(10) || commented || chr(10) || chr(10) END AS prompt FROM y""")
def condition_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a customer is a task, with its first four orders as tests: what each condition shows of them."""
    test = F.struct("o_orderkey", F.concat(F.lit("input: "), F.col("o_orderkey").cast("string"), F.lit("\nexpected output: "), "o_orderstatus").alias("t"), F.col("o_orderstatus").alias("s"))
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.slice(F.array_sort(F.collect_list(test)), 1, 4).alias("p"))
    rows = rows.where(F.size(F.array_distinct(F.transform("p", lambda x: x["s"]))) > 1)
    key = F.col("k").cast("string")
    tasks = rows.select(
        F.concat(F.lit("t"), key).alias("task_id"), F.concat(F.lit("Solve "), key, F.lit(".\n\n### Answer\ngo")).alias("prompt"), F.when(F.col("k") % 2 == 0, "LiveCodeBench_v6").otherwise("custom").alias("dataset"), F.lit("go").alias("entry_point"),
        F.lit(" import re\n").alias("imports"), F.lit("def go(x):").alias("signature"), F.transform("p", lambda x: x["t"]).alias("visible"), F.array(F.concat(F.lit("odd "), key), F.lit("even")).alias("irrelevant"),
        F.lit(None).cast("map<string, array<string>>").alias("condition_tests"), F.lit(None).cast("map<string, string>").alias("condition_prompts"),
    )
    return conditions.for_conditions(tasks, _CONDITIONS).withColumn("tests", F.array_join("tests", "|"))


@query(r"""SELECT conv_id, turn, regexp_replace('def answer(x):' || chr(10) || '    return ' || text, '[\s\x{85}\x{a0}]+$', '') || chr(10) AS program, regexp_replace(text, '[\s\x{85}\x{a0}]+$', '') || chr(10) AS alone
FROM conversations WHERE role = 'assistant' AND NOT contains(text, '```') AND NOT contains(text, '<think>')""")
def assembled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each answer as a function's body, cut from what a reply puts behind it, and as a program of its own."""
    rows = load(spark, sf_dir, "conversations").where((F.col("role") == "assistant") & ~F.col("text").contains("```") & ~F.col("text").contains("<think>"))
    prompt = F.lit("def answer(x):\n")
    reply = F.concat(F.lit("```python\n"), prompt, F.lit("    return "), "text", F.lit("\n\ndef helper():\n    pass\n\nprint(answer(1))\n```\nThis solution works."))
    return rows.select("conv_id", "turn", programs.assembled(prompt, reply, F.lit("answer")).alias("program"), programs.assembled(prompt, F.col("text"), code_prefix=False).alias("alone"))


@query("""SELECT event_id, 'input: ' || CASE event_id % 3 WHEN 0 THEN 'None' WHEN 1 THEN replace(props, '"', '''') ELSE event_type END || chr(10) || 'expected output: [''' || event_type || ''', None, True, ' || event_id || ']' AS shown,
  CASE WHEN event_id % 2 = 0 THEN '{"only": "' || event_type || '"}' ELSE 'stdin: ' || event_type || chr(10) || 'expected stdout: False' END AS other, CAST(CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INT) AS n FROM events""")
def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cases as they are shown, with nulls and nested values; lists of cases in each of their forms."""
    rows, own = load(spark, sf_dir, "events"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    given = F.when(F.col("event_id") % 3 == 0, "null").when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(own)
    case = F.concat(F.lit('{"input":'), given, F.lit(',"output":['), own, F.lit(",null,true,"), F.col("event_id").cast("string"), F.lit("]}"))
    other = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"only":'), own, F.lit("}"))).otherwise(F.concat(F.lit('{"stdin":'), own, F.lit(',"stdout":false}')))
    kind = F.col("event_id") % 4
    listed = F.when(kind == 0, F.concat(F.lit("["), case, F.lit(", 3, "), other, F.lit("]"))).when(kind == 1, F.concat(F.lit('{"test_cases": ['), case, F.lit(","), case, F.lit("]}"))).when(kind == 2, case).otherwise(own)
    return rows.select("event_id", arr.case_text(case).alias("shown"), arr.case_text(other).alias("other"), F.size(arr.case_list(listed)).alias("n"))


@query("""WITH RECURSIVE g AS (SELECT l_suppkey AS grp, CAST(count_if(l_returnflag = 'A') AS HUGEINT) AS a, CAST(count_if(l_returnflag = 'N') AS HUGEINT) AS n, CAST(count_if(l_returnflag = 'R') AS HUGEINT) AS r, count(*) AS c FROM lineitem GROUP BY 1),
t AS (SELECT CAST(sum(a) AS HUGEINT) AS ta, CAST(sum(n) AS HUGEINT) AS tn, CAST(sum(r) AS HUGEINT) AS tr FROM g),
o AS (SELECT g.*, t.*, row_number() OVER (ORDER BY c DESC, md5('0-' || grp), grp) AS i FROM g, t),
f AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS grp, CAST(NULL AS BIGINT) AS p, CAST([0, 0, 0, 0] AS HUGEINT[]) AS la, CAST([0, 0, 0, 0] AS HUGEINT[]) AS ln, CAST([0, 0, 0, 0] AS HUGEINT[]) AS lr
  UNION ALL
  SELECT i, grp, p, list_transform(la, lambda x, j: x + CASE WHEN j = p THEN a ELSE 0 END), list_transform(ln, lambda x, j: x + CASE WHEN j = p THEN n ELSE 0 END), list_transform(lr, lambda x, j: x + CASE WHEN j = p THEN r ELSE 0 END)
  FROM (SELECT o.i, o.grp, o.a, o.n, o.r, la, ln, lr, list_sort(list_transform(range(1, 5), lambda j: {'c': o.a * la[j] * tn * tn * tr * tr + o.n * ln[j] * ta * ta * tr * tr + o.r * lr[j] * ta * ta * tn * tn, 'n': la[j] + ln[j] + lr[j], 'j': j}))[1].j AS p FROM f JOIN o ON o.i = f.i + 1)
)
SELECT grp AS l_suppkey, CAST(p - 1 AS INT) AS fold FROM f WHERE i > 0""")
def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers dealt to four folds, each with about the same shares of the return flags."""
    return models.stratified_group_folds(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", 4)


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, md5('7-' || event_id), event_id) - 1 AS p FROM events) SELECT event_id, CAST(p % 5 AS INT) AS fold FROM r""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to five folds by their type."""
    return models.stratified_folds(load(spark, sf_dir, "events"), "event_id", "event_type", 5, "7")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS mode, o_orderstatus AS profile, CAST(round(ln(o_totalprice) * 1000000) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), t AS (SELECT * FROM o WHERE p <= 3),
j AS (SELECT a.o_custkey AS k, a.p, b.o_orderkey AS donor, a.profile = b.profile AS alike, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY a.profile <> b.profile, abs(a.size - b.size) + abs(a.o_custkey % 10 - b.o_custkey % 10) * 50, b.o_orderkey) AS r
  FROM t a JOIN t b ON a.mode = b.mode AND a.o_custkey <> b.o_custkey),
l AS (SELECT k, p, list({'d': donor, 'a': alike} ORDER BY r) AS c FROM j WHERE r <= p GROUP BY k, p),
x AS (SELECT a.k, a.c[1] AS c1, list_filter(b.c, lambda v: a.c IS NULL OR v.d <> a.c[1].d)[1] AS c2, c.c AS c3 FROM (SELECT DISTINCT k FROM l) z LEFT JOIN l a ON a.k = z.k AND a.p = 1 LEFT JOIN l b ON b.k = z.k AND b.p = 2 LEFT JOIN l c ON c.k = z.k AND c.p = 3),
y AS (SELECT k, 1 AS p, c1 AS c FROM x UNION ALL SELECT k, 2, c2 FROM x UNION ALL SELECT k, 3, list_filter(c3, lambda v: v.d <> c1.d AND (c2 IS NULL OR v.d <> c2.d))[1] FROM x)
SELECT k AS o_custkey, CAST(p AS INT) AS position, c.d AS donor, CASE WHEN c.a THEN 0 ELSE 1 END AS level FROM y WHERE c.d IS NOT NULL""")
def donors_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first three orders take donors among other customers' orders: of the same priority, rather of the same status, then nearest in price;
    no donor twice for a customer, though two of its orders may want the same one."""
    rows = top_k(load(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], 3, "position")
    size = F.round(F.log("o_totalprice") * 1000000).cast("long")
    left = rows.select("o_orderkey", "o_custkey", "position", F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("profile"), size.alias("size"))
    right = left.select(F.col("o_orderkey").alias("donor"), F.col("o_custkey").alias("d_custkey"), "mode", "profile", F.col("size").alias("d_size"))
    extra = F.abs(F.col("o_custkey") % 10 - F.col("d_custkey") % 10) * 50
    found = matching.nearest(left, right, "o_orderkey", "donor", "size", "d_size", F.col("position"), [["mode", "profile"], ["mode"]], extra=extra, allowed=F.col("o_custkey") != F.col("d_custkey"))
    return matching.chosen(found.join(left.select("o_orderkey", "o_custkey", "position"), "o_orderkey"), "o_custkey", "position", "rank", "donor", ["level"])


@query(r"""SELECT event_id, '{"a":"' || event_type || ']["}' || CASE WHEN event_id % 2 = 0 THEN '|[' || event_id || ']' ELSE '' END AS cases, len(event_type) > 0 AS found,
  CASE WHEN event_id % 2 = 0 THEN '[1] or ' || props || ' "' || event_type || '"}]' ELSE '{"x": 2' || props || '}' END AS block FROM events""")
def reply_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last cases of a reply, behind pieces of JSON without any; pieces within quotes; the block from its first brace on."""
    own, number = F.col("event_type"), F.col("event_id").cast("string")
    case = F.concat(F.lit('{"a": "'), own, F.lit(']["}'))
    reply = F.concat(F.lit('Is [1] or {"tests": []}? "Quoted [{'), F.lit('\\" '), F.lit('", then {"tests": ['), case, F.lit(', 5]} and '), F.col("props"), F.lit(" and [[3], {"))
    both = F.when(F.col("event_id") % 2 == 0, F.concat(reply, F.lit(" ["), number, F.lit("]"))).otherwise(reply)
    block = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so [1] or "), "props", F.lit(' "'), own, F.lit('"}] end'))).otherwise(F.concat(F.lit('so {"x": 2'), "props", F.lit("} end")))
    rows = spread_out(load(spark, sf_dir, "events").select("event_id", "event_type", "props")).select("event_id", "props", both.alias("reply"), block.alias("block"))

    def read(pieces: Column) -> Column:
        last = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("|"), F.element_at(pieces, -1))).otherwise("")
        return F.struct(F.concat(F.array_join(scans.cases_of(pieces), ";"), last).alias("cases"), F.array_contains(pieces, F.col("props")).alias("found"))

    # a reply's pieces are read in three ways
    return rows.select("event_id", tx.bound(scans.json_candidates(F.col("reply")), read).alias("_x"), scans.braced_block(F.col("block")).alias("block")).select("event_id", "_x.cases", "_x.found", "block")


@query("""SELECT p_partkey, 'assert f(' || p_size || ') == ' || p_brand || ' ' || p_name || ';assert g() == ' || p_size AS examples, 'def f(x):' || chr(10) || '    \"\"\"' || p_name || '.' || chr(10) || '    \"\"\"' || chr(10) || '    return x' || chr(10) AS prompt,
  p_name || '.' || chr(10) || '    more' || chr(10) || '    \"\"\"' || chr(10) || '    return x' AS text, 'assert ' || p_size || ' == f(1)' AS listed FROM part""")
def example_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """examples of a docstring as assertions, a head and a docstring without them, listed assertions."""
    size = F.col("p_size").cast("string")
    examples = F.concat(F.lit("    >>> f("), size, F.lit(")\n    "), "p_brand", F.lit("\n\n    "), "p_name", F.lit("\n    >>> h()\n    >>> g()\n    "), size, F.lit("\n"))
    doc = F.concat("p_name", F.lit(".\n"), examples)
    head = F.concat(F.lit('def f(x):\n    """'), doc, F.lit('    """\n    return x\n\n'))
    text = F.concat("p_name", F.lit(".\n    >>> f("), size, F.lit(")\n    1\n\n    more\n"), F.lit('    """\n    return x\n'))
    listed = F.concat(F.lit("Tests:\n - 1. assert "), size, F.lit(" == f(1)\nno assert\n"))
    rows = spread_out(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    return rows.select(
        "p_partkey", F.array_join(scans.example_assertions(head), ";").alias("examples"), scans.prompt_without_examples(head).alias("prompt"), scans.docstring_without_examples(text).alias("text"), F.array_join(scans.listed_assertions(listed), ";").alias("listed"),
    )


@query("""WITH t AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS o, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY 1),
c AS (SELECT *, list_transform(range(1, len(o) + 1), lambda i: 'input: ' || o[i] || chr(10) || 'expected output: ' || s[i]) AS shown FROM t)
SELECT CASE WHEN k % 3 = 0 THEN 'title ' || k ELSE CAST(k AS VARCHAR) END AS task_id, array_to_string(shown[1:1] || shown, '|') AS tests, 1 AS n_public, CASE WHEN k % 2 = 0 THEN 'solve' || k ELSE '' END AS entry_point,
  '### Question: title ' || k || chr(10) || chr(10) || CASE WHEN k % 5 = 0 THEN 'Short.' ELSE 'Say ' || k || '.' END || chr(10) || chr(10) || CASE WHEN k % 2 = 0 THEN '### Starter Code' || chr(10) || '```python' || chr(10) || 'class S:' || chr(10) || '    def solve' || k || '(self):' || chr(10) || '```' || chr(10) || chr(10)
    || '### Answer' || chr(10) || 'Complete the starter code in Python.' ELSE '### Answer' || chr(10) || 'Write a complete Python solution.' END || ' Return only the code inside a Python markdown block.' || chr(10) || '```python' || chr(10) AS prompt,
  CASE WHEN k % 2 = 0 THEN '{"func":"solve' || k || '"}' ELSE '{}' END AS metadata FROM c""")
def problem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each customer, with its first order as public case and all as private ones, written as lines of JSON and read into tasks."""
    key, even = F.col("k").cast("string"), F.col("k") % 2 == 0
    case = F.struct(F.col("o_orderkey").alias("input"), F.col("o_orderstatus").alias("output"))
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(case)).alias("c"))
    record = F.struct(
        F.when(F.col("k") % 3 != 0, F.col("k")).alias("question_id"), F.concat(F.lit("title "), key).alias("question_title"), F.concat(F.lit("\nSay "), key, F.lit(". ")).alias("question_content"), F.when(F.col("k") % 5 == 0, "Short.").otherwise("").alias("question_content_no_public_tests"),
        F.when(even, F.concat(F.lit("class S:\n    def solve"), key, F.lit("(self):\n\n"))).alias("starter_code"), F.to_json(F.slice("c", 1, 1)).alias("public_test_cases"), F.struct(F.col("c").alias("test_cases")).alias("private_test_cases"), F.when(even, F.concat(F.lit('{"func": "solve'), key, F.lit('"}'))).alias("metadata"),
    )
    path = scratch(spark, "problems")
    rows.select(F.to_json(record).alias("value")).write.text(path)
    tasks = records.problem_tasks(spark.read.text(path), "livecodebench")
    return tasks.select("task_id", F.array_join("tests", "|").alias("tests"), "n_public", "entry_point", "prompt", "metadata")


@query("""SELECT n_name AS nation, s_suppkey AS supplier, round(s_acctbal, 1) AS balance, CAST(s_nationkey AS DOUBLE) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def typeset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a typeset table that names each nation once, in its first row; read back with the names filled down."""
    suppliers = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    first = suppliers.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("_first"))
    rows = suppliers.join(first, "s_nationkey")
    line = F.concat(F.when(F.col("s_suppkey") == F.col("_first"), F.col("n_name")).otherwise(""), F.lit(" & "), F.col("s_suppkey").cast("string"), F.lit(" & "), F.round("s_acctbal", 1).cast("string"), F.lit("&"), F.col("s_nationkey").cast("double").cast("string"), F.lit(r" \\"))
    path = scratch(spark, "table")
    notes = spark.range(1).select(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.explode(F.array(F.lit(r"\toprule Nation & Supplier & Balance & Place \\"), F.lit(r"\midrule"))).alias("value"))
    rows.select(F.col("s_nationkey").alias("a"), F.col("s_suppkey").alias("b"), line.alias("value")).unionByName(notes).orderBy("a", "b").select("value").write.text(path)
    back = records.table_rows(spark, path, ["nation", "supplier", "balance", "place"], ["balance", "place"], ["nation"])
    return back.withColumn("supplier", F.col("supplier").cast("long"))


def _drawn(place: str, low: str, high: str) -> str:
    return f"({low} + CAST('0x' || left(md5(key || '-' || {place}), 8) AS BIGINT) % ({high} - ({low}) + 1))"


_SAMPLED = f"""WITH f AS (SELECT DISTINCT p_brand AS family FROM part), t AS (SELECT family, CAST(v AS INT) AS variant, n AS attempt, family || '-' || v || '-' || n AS key FROM f, unnest(range(0, 3)) AS v(v), unnest(range(0, 64)) AS n(n)),
x AS (SELECT *, list_transform(range(1, {_drawn("'size'", "3", "8 + variant")} + 1), lambda i: {_drawn("i", "-(3 + 2 * variant)", "3 + 2 * variant")}) AS input FROM t),
y AS (SELECT family, variant, min(attempt) AS attempt, input, list_sort(input) AS s FROM x GROUP BY family, variant, input), z AS (SELECT *, s[(len(s) - 1) // 2 + 1] AS a, s[len(s) // 2 + 1] AS b FROM y), k AS (SELECT *, CASE WHEN a = b THEN 'common' ELSE 'case' END AS kind FROM z)""" + "".join(
    f""",
u{v} AS (SELECT family, variant, kind, row_number() OVER (PARTITION BY family, kind ORDER BY attempt) AS place, input, a, b FROM k WHERE variant = {v}{"".join(f" AND NOT EXISTS (SELECT 1 FROM r{w} WHERE r{w}.family = k.family AND r{w}.input = k.input)" for w in range(v))}),
r{v} AS (SELECT * FROM u{v} WHERE place <= CASE kind WHEN 'case' THEN 6 ELSE 4 END)""" for v in range(3))  # fmt: skip


@query(_SAMPLED + """ SELECT family, variant, kind, CAST(place AS INT) AS place, array_to_string(input, ',') AS input, a, b FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)""")
def distinguishing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand as a family, in three variants, lists whose lower and upper medians differ, and some whose medians agree; none twice in a family."""

    def inputs(key, variant):
        size = sampling.drawn(key, "size", F.lit(3).cast("long"), 8 + variant.cast("long"))
        return sampling.drawn_list(key, size, -(3 + 2 * variant.cast("long")), 3 + 2 * variant.cast("long"))

    families = load(spark, sf_dir, "part").select(F.col("p_brand").alias("family"))
    found = sampling.distinguishing(families, "family", 3, inputs, (rules.lower_median, rules.upper_median), cases=6, common=4)
    return found.withColumn("input", F.array_join(F.col("input").cast("array<string>"), ","))
