"""The jobs as queries: each runs twice over the whole tables into one new folder, and gives what stands there then. With the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import evaluate_answers, prepare_protocol
from pairlens.functions.text import STOPS
from pairlens.session import scratch


def job1_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new."""
    folder = scratch(spark, "job1", kept=True)
    expected = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").count()
    for _ in range(2):
        # a pattern, as a stream reads no single file by its plain name
        evaluate_answers.run(spark, f"{sf_dir}/conversations.parque[t]", f"{folder}/output", f"{folder}/checkpoint", {"expected": expected})
    return evaluate_answers.output_of(spark, f"{folder}/output")


def job2_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run writes the same in place of the first one's."""
    folder = scratch(spark, "job2", kept=True)
    for _ in range(2):
        prepare_protocol.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "benchmark")), folder)
    return prepare_protocol.output_of(spark, folder)


QUERIES = {"job1_answers": job1_answers, "job2_protocol": job2_protocol}

_STOPS = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in STOPS) + "]"
_LINES = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
_WHITE = r"'[\s\x{1c}-\x{1f}\x{85}\x{a0}]+'"

ORACLE = {
    "job1_answers": rf"""
WITH t AS (
  SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '(?s)<think>.*?</think>\s*', '', 'g') AS t FROM conversations WHERE role = 'assistant'
), c AS (
  SELECT *, list_min(list_filter(list_transform({_STOPS}, lambda s: strpos(t, s)), lambda p: p > 0)) AS stop FROM t
), k AS (
  SELECT conv_id, turn, CASE WHEN (turn + 1) // 2 = 1 THEN 'first' WHEN (turn + 1) // 2 = 2 THEN 'second' ELSE 'further' END AS condition, CASE WHEN stop IS NULL THEN t ELSE left(t, stop - 1) END AS k FROM c
), l AS (
  SELECT *, regexp_split_to_array(k, {_LINES}) AS l, regexp_replace(regexp_replace(k, '^' || {_WHITE}, ''), {_WHITE} || '$', '') AS bare FROM k
), m AS (
  SELECT *, CASE WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END AS n_lines FROM l
), a AS (
  SELECT conv_id, turn, condition, length(k) AS n_chars, n_lines, CASE
    WHEN k = '' THEN 'empty' WHEN contains(lower(k), 'your implementation here') OR contains(lower(k), 'todo') OR lower(bare) = 'pass' THEN 'stub'
    WHEN length(k) < 300 THEN 'short' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'unfinished' END AS reason FROM m
), p AS (
  SELECT conv_id, bool_or(reason IS NULL) FILTER (condition = 'first') AS b, bool_or(reason IS NULL) FILTER (condition = 'second') AS t FROM a GROUP BY conv_id HAVING count(DISTINCT condition) FILTER (condition <> 'further') = 2
), f AS (
  SELECT count(*) AS n, CAST(count_if(b) AS BIGINT) AS bp, CAST(count_if(t) AS BIGINT) AS tp, CAST(count_if(NOT b AND t) AS BIGINT) AS g, CAST(count_if(b AND NOT t) AS BIGINT) AS l FROM p
), x AS (
  SELECT sum(exp(lgamma(CAST(g + l + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(g + l - i + 1 AS DOUBLE)) - (g + l) * ln(2))) AS s FROM (SELECT g, l, unnest(range(0, CAST(least(g, l) + 1 AS BIGINT))) AS i FROM f)
)
SELECT 'answer' AS kind, conv_id, turn, condition, n_chars, n_lines, reason, reason IS NULL AS passed, NULL AS state, CAST(NULL AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS n_passed,
  CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS base_passed, CAST(NULL AS BIGINT) AS target_passed, CAST(NULL AS BIGINT) AS gains, CAST(NULL AS BIGINT) AS losses, CAST(NULL AS DOUBLE) AS p FROM a
UNION ALL SELECT 'summary', NULL, NULL, condition, CAST(sum(n_chars) AS BIGINT), CAST(sum(n_lines) AS BIGINT), NULL, NULL, 'final', count(*), CAST(count_if(reason IS NULL) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL FROM a GROUP BY condition
UNION ALL SELECT 'contrast', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, bp, tp, g, l, CASE WHEN g + l = 0 THEN 1.0 ELSE round(least(1.0, 2 * s), 8) END FROM f, x
""",
    "job2_protocol": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, lang, source, list_filter(regexp_split_to_array(coalesce(text, ''), {_LINES}), lambda x: x <> '') AS lines, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS key FROM documents
), b AS (
  SELECT DISTINCT regexp_replace(l, '\s+', '', 'g') AS line FROM (SELECT unnest(regexp_split_to_array(text, {_LINES})) AS l FROM benchmark) WHERE length(l) > 40
), leaked AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(lines) AS l FROM d) JOIN b ON line = regexp_replace(l, '\s+', '', 'g') WHERE length(l) > 40
), firsts AS (
  SELECT min(doc_id) AS doc_id FROM d GROUP BY key
), known AS (
  SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), j AS (
  SELECT d.*, CASE WHEN quality IS NULL THEN 'unknown' ELSE 'good' END AS label, CASE
    WHEN len(lines) = 0 THEN 'empty' WHEN length(text) < 200 THEN 'short' WHEN quality <> 1 THEN 'bad' WHEN toxic <> 0 THEN 'toxic'
    WHEN EXISTS (SELECT 1 FROM leaked WHERE leaked.doc_id = d.doc_id) THEN 'leaked' WHEN NOT EXISTS (SELECT 1 FROM firsts WHERE firsts.doc_id = d.doc_id) THEN 'repeated' END AS reason
  FROM d LEFT JOIN known USING (doc_id)
), k AS (
  SELECT *, concat_ws('-', lang, source) AS family FROM j WHERE reason IS NULL
), g AS (
  SELECT family, CAST(count_if(label = 'good') AS HUGEINT) AS a, CAST(count_if(label = 'unknown') AS HUGEINT) AS u, count(*) AS c FROM k GROUP BY family
), o AS (
  SELECT g.*, ta, tu, row_number() OVER (ORDER BY c DESC, md5('0-' || family), family) AS i FROM g, (SELECT CAST(sum(a) AS HUGEINT) AS ta, CAST(sum(u) AS HUGEINT) AS tu FROM g)
), f AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS family, CAST(NULL AS BIGINT) AS p, CAST([0, 0, 0, 0, 0] AS HUGEINT[]) AS la, CAST([0, 0, 0, 0, 0] AS HUGEINT[]) AS lu
  UNION ALL
  SELECT i, family, p, list_transform(la, lambda x, n: x + CASE WHEN n = p THEN a ELSE 0 END), list_transform(lu, lambda x, n: x + CASE WHEN n = p THEN u ELSE 0 END)
  FROM (SELECT o.i, o.family, o.a, o.u, la, lu, list_sort(list_transform(range(1, 6), lambda n: {{'c': o.a * la[n] * tu * tu + o.u * lu[n] * ta * ta, 'n': la[n] + lu[n], 'j': n}}))[1].j AS p FROM f JOIN o ON o.i = f.i + 1)
), r AS (
  SELECT k.*, CAST(f.p - 1 AS INT) AS fold, lines[1:2] AS visible, CASE WHEN len(lines) > 2 THEN lines[3:] ELSE lines END AS hidden FROM k JOIN f USING (family)
), t AS (
  SELECT *, CASE condition WHEN 'nl_only' THEN [] WHEN 'nl_tests_1' THEN visible[1:1] ELSE visible END AS tests FROM (SELECT *, unnest(['nl_only', 'nl_tests', 'nl_tests_1']) AS condition FROM r)
), s AS (
  SELECT *, 'Continue this text (' || coalesce(lang, '?') || ').' || chr(10) || chr(10) || CASE WHEN condition = 'nl_only' THEN '' ELSE '### Visible Test Cases' || chr(10)
    || array_to_string(list_transform(range(1, len(tests) + 1), lambda n: 'Test ' || n || chr(10) || tests[n]), chr(10) || chr(10)) || chr(10) || chr(10) END || '### Answer' || chr(10) AS prompt FROM t
)
SELECT 'task' AS kind, doc_id, fold, condition, label, md5(prompt) AS prompt_md5, len(tests) AS n_tests, CAST(len(hidden) AS BIGINT) AS hidden, md5(array_to_string(hidden, chr(10))) AS hidden_md5, NULL AS reason, CAST(NULL AS BIGINT) AS rows FROM s
UNION ALL SELECT 'rejected', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason, NULL FROM j WHERE reason IS NOT NULL
UNION ALL SELECT 'summary', NULL, fold, condition, label, NULL, NULL, CAST(sum(len(hidden)) AS BIGINT), NULL, NULL, count(*) FROM s GROUP BY fold, condition, label
""",
}
