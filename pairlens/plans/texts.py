"""Text, code, JSON and rule functions over documents, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as arr
from ..functions import code, programs, rules
from ..functions import text as tx
from ..operators.mutations import mutate
from ..session import load
from .catalog import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


@query(r"SELECT doc_id, length(regexp_replace(concat('<think>', left(text, 20), '</think>  ', text), '(?s)<think>.*?</think>\s*', '', 'g')) AS size, md5(regexp_replace(text, '\s+', '', 'g')) AS squeezed FROM documents")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F16."""
    marked = F.concat(F.lit("<think>"), F.left("text", F.lit(20)), F.lit("</think>  "), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(tx.strip_thinking(marked)).cast("long").alias("size"), F.md5(tx.squeezed(F.col("text"))).alias("squeezed"))


@query(r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents), l AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l FROM p)
SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: starts_with(trim(x), 'for ') OR starts_with(trim(x), 'with ') OR starts_with(trim(x), 'from ') OR starts_with(trim(x), 'if ') OR regexp_matches(trim(x), '^[A-Za-z_][A-Za-z0-9_,\s\[\]]*\s*='))) AS code_lines FROM l""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines, of which a final line end opens none, and those that look like code."""
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.lines(F.col("text"))).cast("long").alias("lines"), tx.code_score(F.col("text")).cast("long").alias("code_lines"))


@query()
def fence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the code out of each turn, as a reply with two fenced segments, of which one is a stub and one returns the whole text. No SQL:
    texts may hold fences, stubs or code of their own."""
    reply = F.concat(F.lit("Here:\n```python\n# todo\nreturn 1\n```\nor\n```python\nreturn "), "text", F.lit("\n```\nThanks."))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip_fences(reply).alias("kept"))


_STOPS = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in tx.STOPS) + "]"


@query(f"""WITH t AS (SELECT doc_id, text || chr(10) || '### ' || text AS a, left(text, length(text) // 2) || chr(10) || 'The solution' || substr(text, length(text) // 2 + 1) AS w FROM documents),
p AS (SELECT *, list_min(list_filter(list_transform({_STOPS}, lambda s: strpos(a, s)), lambda p: p > 0)) AS x, list_min(list_filter(list_transform({_STOPS}, lambda s: strpos(w, s)), lambda p: p > 0)) AS y FROM t)
SELECT doc_id, left(a, x - 1) AS kept, left(w, y - 1) AS half FROM p""")
def truncate_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: up to the first stop string, which stands after the whole text, or in its middle, if the text has none before."""
    middle = F.floor(F.length("text") / 2).cast("int")
    after = F.concat("text", F.lit("\n### "), "text")
    within = F.concat(F.substr("text", F.lit(1), middle), F.lit("\nThe solution"), F.substr("text", middle + 1))
    return _docs(spark, sf_dir).select("doc_id", tx.truncated(after).alias("kept"), tx.truncated(within).alias("half"))


@query(r"""SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS first, regexp_replace(text, '^\s+|\s+$', '', 'g') AS second FROM benchmark""")
def strip_public_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the statement is left when its examples go, in two layouts."""
    rows = load(spark, sf_dir, "benchmark")
    one, two = F.concat("text", F.lit("\nSample Input 1\n1 2\nSample Output 1\n3\n")), F.concat(F.lit(" "), "text", F.lit("\n\nExamples\ninput\n1\n"))
    return rows.select("item_id", tx.without_public_examples(one).alias("first"), tx.without_public_examples(two).alias("second"))


@query("SELECT item_id, regexp_replace(text, chr(10) || '$', '') || chr(10) || 'Note: x' || chr(10) AS kept FROM benchmark")
def strip_problem_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from an example's heading to the next section."""
    rows = load(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", "\n\\z", ""))
    return rows.select("item_id", tx.without_problem_examples(F.concat("text", F.lit("\nExample 1:\n 1 2\n3\nNote: x\n"))).alias("kept"))


@query(r"SELECT item_id, 'P' || chr(10) || chr(10) || '### Visible Test Cases' || chr(10) || 'Test 1' || chr(10) || text || chr(10) || chr(10) || 'Test 2' || chr(10) || 'x' || chr(10) || chr(10) || '### Answer' || chr(10) || 'go' AS prompt, regexp_replace(text, '^\s+|\s+$', '', 'g') || '|x' AS back FROM benchmark")
def prompt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tests of whole texts into a prompt and out of it again."""
    rows = load(spark, sf_dir, "benchmark")
    prompt = tx.with_tests(F.lit("P\n### Answer\ngo"), F.array("text", F.lit("x")))
    return rows.select("item_id", prompt.alias("prompt"), F.array_join(tx.tests_of(prompt), "|").alias("back"))


@query("""WITH t AS (SELECT item_id, text, list_distinct(regexp_extract_all(text, '[A-Za-z_]+|-?[0-9]+')) AS t FROM benchmark)
SELECT a.item_id AS "left", b.item_id AS "right", round(1 - len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 9) AS distance FROM t a JOIN t b ON a.item_id < b.item_id""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token distance of all pairs of the benchmark, which is bounded."""
    rows = load(spark, sf_dir, "benchmark")
    pairs = rows.alias("a").join(rows.alias("b"), F.col("a.item_id") < F.col("b.item_id"))
    return pairs.select(F.col("a.item_id").alias("left"), F.col("b.item_id").alias("right"), F.round(tx.token_distance(F.col("a.text"), F.col("b.text")), 9).alias("distance"))


BASES = ["nl_only", "nl_tests", "shuffled_tests", "irrelevant_tests", "asserts_only", "test_names_only", "asserts", ""]
SUFFIXES = ["", "_#", "_k#", "_all", "_high#", "_lowall", "_diverse0#", "_#\n", "_-#", "_300000000#", "_k99999999999999999999999999999#", "_high"]


@query(f"""
WITH c AS (SELECT p_partkey, ({BASES})[CAST(p_partkey % 8 + 1 AS INT)] || replace(({[x.strip() for x in SUFFIXES]})[CAST(p_partkey // 8 % 12 + 1 AS INT)], '#', CAST(p_size AS VARCHAR)) || CASE WHEN p_partkey // 8 % 12 = 7 THEN chr(10) ELSE '' END AS c FROM part), m AS (
  SELECT p_partkey, c, regexp_extract(c, '^(nl_tests|asserts_only|test_names_only|shuffled_tests|irrelevant_tests)_k?([0-9]+|all)\n?$', ['base', 'n']) AS x,
    regexp_extract(c, '^(nl_tests|asserts_only|test_names_only)_(high|low|diverse)([0-9]+|all)\n?$', ['base', 'quality', 'n']) AS y FROM c
)
SELECT p_partkey, c AS condition, CASE WHEN list_contains({BASES[:6]}, c) THEN c WHEN x.base <> '' THEN x.base WHEN y.base <> '' THEN y.base END AS base,
  CASE WHEN list_contains({BASES[:6]}, c) OR x.base <> '' THEN 'original' WHEN y.base <> '' THEN y.quality END AS quality,
  CAST(CASE WHEN v > 2147483647 THEN 2147483647 ELSE v END AS INT) AS n FROM (SELECT *, TRY_CAST(CASE WHEN x.base <> '' THEN x.n WHEN y.base <> '' THEN y.n END AS HUGEINT) AS v FROM m)
""")
def condition_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names made of each part's key and size: with counts beyond any type, and line feeds behind them."""
    base = F.element_at(F.array(*map(F.lit, BASES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.floor(F.col("p_partkey") / 8) % 12 + 1).cast("int"))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat(base, F.replace(suffix, F.lit("#"), F.col("p_size").cast("string"))).alias("condition"))
    return rows.select("*", tx.condition_spec(F.col("condition")).alias("spec")).select("p_partkey", "condition", "spec.*")


@query("SELECT n_name AS name, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda t, c: (t * 131 + c) % 2147483647) AS BIGINT) AS seed FROM nation")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24."""
    return load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), tx.stable_seed(F.col("n_name")).alias("seed"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, split_part(event_type || ': ' || props, ':', 1) AS error_class, right(props, 4) AS tail, left(props, 3) AS head, replace(replace(event_type || '/x y', '/', '_'), ' ', '_') AS safe FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22, F26, F27, F37."""
    rows = load(spark, sf_dir, "events")
    return rows.select("event_id", arr.json_or_null(F.col("props"), "k BIGINT")["k"].alias("k"), tx.error_class(F.concat("event_type", F.lit(": "), "props")).alias("error_class"), tx.tail(F.col("props"), 4).alias("tail"), tx.head(F.col("props"), 3).alias("head"), tx.safe_id(F.concat("event_type", F.lit("/x y"))).alias("safe"))


@query(r"""WITH n AS (SELECT event_id, props AS t, regexp_extract_all(props, '-?[0-9]+')[1:100] AS x FROM events)
SELECT event_id, round(least(length(t), 1000) / 200 + least(len(x), 20) * 0.2 + len(list_filter(x, lambda v: abs(CAST(v AS DOUBLE)) <= 1)) * 0.2 + len(list_filter(x, lambda v: abs(CAST(v AS DOUBLE)) >= 100)) * 0.1
  + CAST(contains(t, '[]') AS INT) + CAST(contains(t, '{}') AS INT) + CAST(contains(t, '""') AS INT) + CAST(contains(t, '''''') AS INT) + CAST(contains(t, 'true') AS INT) + CAST(contains(t, 'false') AS INT) + CAST(contains(t, 'null') AS INT), 9) AS score,
  round(least(length(t), 300) / 100 + len(x) * 0.25, 9) AS fallback FROM n""")
def quality_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29, F30."""
    return load(spark, sf_dir, "events").select("event_id", F.round(tx.case_score(F.col("props")), 9).alias("score"), F.round(tx.fallback_score(F.col("props")), 9).alias("fallback"))


@query("SELECT conv_id, sha256(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25."""
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"))
    return rows.select("conv_id", tx.ids_hash(F.col("ids")).alias("hash"))


@query("""WITH f AS (SELECT o_custkey, list(o_totalprice > 100000 ORDER BY o_orderkey) AS f FROM orders GROUP BY 1)
SELECT o_custkey, len(list_filter(f, lambda x: NOT x)) = 0 AS every, len(list_filter(f[1:2], lambda x: NOT x)) = 0 AS first_two, len(list_filter(f[3:], lambda x: NOT x)) = 0 AS rest FROM f""")
def flags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all flags, those of the first section and of the rest; an empty section holds."""
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") > 100000).alias("f")))), lambda x: x["f"]).alias("f"))
    n = F.size("f")
    first, rest = arr.sections(F.col("f"), [F.least(n, F.lit(2)), F.greatest(n - 2, F.lit(0))])
    return rows.select("o_custkey", arr.all_true(F.col("f")).alias("every"), arr.all_true(first).alias("first_two"), arr.all_true(rest).alias("rest"))


@query("SELECT doc_id, source || '::' || doc_id AS id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE lang END), ''), source) AS first_id, CAST(doc_id % 2 = 0 AS BOOLEAN) AS flag, round(abs(ln(greatest(1, length(text)) / greatest(1, length(source)))), 9) AS ratio FROM documents")
def ids_and_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F34, F48, F49, booleans from text."""
    even = F.col("doc_id") % 2 == 0
    rows = load(spark, sf_dir, "documents")
    return rows.select("doc_id", tx.namespaced(F.col("source"), F.col("doc_id").cast("string")).alias("id"), tx.first_id(F.when(even, "  ").otherwise(F.col("lang")), F.col("source")).alias("first_id"), tx.to_bool(F.when(even, "True").otherwise("0")).alias("flag"), F.round(tx.log_length_ratio(F.col("text"), F.col("source")), 9).alias("ratio"))


@query("""WITH x AS (SELECT o_custkey AS k, list(o_orderkey % 7 ORDER BY o_orderkey) AS xs FROM orders GROUP BY 1), y AS (SELECT k, xs, list_sort(xs) AS s FROM x)
SELECT k, array_to_string(list_sort(list_distinct(xs)), ',') AS distinct_sorted, s[(len(s) - 1) // 2 + 1] AS lower_median, s[len(s) // 2 + 1] AS upper_median, array_to_string(list_filter(xs, lambda v: v >= 3), ',') AS at_least, array_to_string(list_filter(xs, lambda v: v > 3), ',') AS above,
  CAST(list_position(xs, list_max(xs)) - 1 AS INT) AS first_argmax, CAST(len(xs) - list_position(list_reverse(xs), list_max(xs)) AS INT) AS last_argmax, array_to_string(list_reverse(s)[1:2], ',') AS top, array_to_string(list_filter(list_reverse(s), lambda v: v >= list_reverse(s)[least(2, len(s))]), ',') AS top_ties FROM y""")
def authored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs of readings over lists."""
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x % 7).alias("xs"))
    xs, text = F.col("xs"), lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select(
        "k", text(rules.distinct_sorted(xs)).alias("distinct_sorted"), rules.lower_median(xs).alias("lower_median"), rules.upper_median(xs).alias("upper_median"), text(rules.at_least(xs, F.lit(3))).alias("at_least"), text(rules.above(xs, F.lit(3))).alias("above"),
        rules.first_argmax(xs).alias("first_argmax"), rules.last_argmax(xs).alias("last_argmax"), text(rules.top_values(xs, 2)).alias("top"), text(rules.top_values(xs, 2, ties=True)).alias("top_ties"),
    )


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 31 - 15 AS a, CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE -4 END AS b FROM orders)
SELECT o_orderkey, CAST(floor(a / b) AS BIGINT) AS floor_q, CAST(trunc(a / b) AS BIGINT) AS trunc_q, CAST(a - b * floor(a / b) AS BIGINT) AS floor_r, CAST(a - b * trunc(a / b) AS BIGINT) AS signed_r FROM d""")
def division_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quotients and remainders, with negative numbers on both sides."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 31 - 15).alias("a"), F.when(F.col("o_custkey") % 2 == 0, 3).otherwise(-4).cast("long").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("o_orderkey", rules.floor_quotient(a, b).alias("floor_q"), rules.truncated_quotient(a, b).alias("trunc_q"), rules.floor_remainder(a, b).alias("floor_r"), rules.signed_remainder(a, b).alias("signed_r"))


@query("SELECT p_partkey, (length(p_name) - length(replace(p_name, 'r', ''))) AS separate, (length(p_name) - length(replace(lower(p_name), 'r', ''))) AS any_case, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS fields, regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g') AS alnum, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS alpha FROM part")
def string_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counting, splitting and normalising text."""
    name, r = F.col("p_name"), F.lit("r")
    return load(spark, sf_dir, "part").select("p_partkey", rules.separate_count(name, r).cast("long").alias("separate"), rules.separate_count_any_case(name, r).cast("long").alias("any_case"), F.array_join(rules.full_fields(name), "|").alias("fields"), rules.alphanumeric(F.col("p_brand")).alias("alnum"), rules.alphabetic(F.col("p_brand")).alias("alpha"))


@query()
def mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-edit mutants, in both families, of a program for each part, with its size and words."""
    code = F.format_string("def f(xs, s):\n    for i in range(%d):\n        if xs[i] > %d and s.startswith('%s'):\n            return sum(xs)\n    return sorted(s.split(), key=len)\n", F.col("p_size"), F.col("p_size") + 1, F.regexp_replace("p_name", "[^a-z]", ""))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), code.alias("code"))
    return mutate(rows, "key", "code", "selection").unionAll(mutate(rows, "key", "code", "validation"))


@query()
def test_keys_and_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, F28, F32, F42, and F18's reasons: functions that need Python's parser."""
    number = F.pmod("event_id", F.lit(50)).cast("string")
    rows = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("assert  f([1,2, "), number, F.lit("]) == 'x'")).alias("test"), F.concat(F.lit("["), number, F.lit(", 'a']")).alias("literal"))
    name = F.lit("f")
    return rows.select("event_id", code.normalized_test(F.col("test")).alias("key"), F.round(code.quality_score(F.col("test")), 9).alias("quality"), code.wrong_literal(F.col("literal")).alias("wrong"), code.arguments(F.col("test"), name).alias("arguments"), programs.reason(F.col("test"), name).alias("reason"))
