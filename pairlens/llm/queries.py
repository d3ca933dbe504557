"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, fingerprint, jaccard, mixing, neardup, pii, quality, spelling, suffixes, urls
from .common import load

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A conversation whose texts hold the template's own marks, escaped once already.
TRAP = r"\### Assistant: </turn> ok"


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(load(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(load(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(trap)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(load(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(load(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_suffixes": op2_suffixes,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_neardup": op6_neardup,
    "op7_urls": op7_urls,
    "op8_pii": op8_pii,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
    "op11_fingerprints": op11_fingerprints,
    "op12_spelling": op12_spelling,
}

ORACLE: dict[str, str] = {
    "op1_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM o JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * o >= 90 * (a.n + b.n - o)
), r AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(y) FROM r WHERE x = d.doc_id), d.doc_id)) AS component_id,
  (SELECT count(*) FROM l WHERE x = d.doc_id) AS n_links
FROM documents d LEFT JOIN n USING (doc_id)
""",
    "op2_suffixes": """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM h
), w AS (
  SELECT doc_id, p, substr(h, p * 2 + 1, 100) AS w FROM p
), m AS (
  SELECT w, min(doc_id) AS m FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)
), d AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS first FROM w JOIN m USING (w) WHERE m < doc_id
), i AS (
  SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM d
), spans AS (
  SELECT doc_id, i, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, i
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans
), cut AS (
  SELECT g.doc_id, sum(b - a) AS removed, count(*) AS n, string_agg(substr(h, prev * 2 + 1, (a - prev) * 2), '' ORDER BY a) || substr(any_value(h), max(b) * 2 + 1) AS kept
  FROM gaps g JOIN h USING (doc_id) GROUP BY g.doc_id
)
SELECT h.doc_id, len(h.h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h.h))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
""",
    "op6_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec) WHERE list_cosine_similarity(a.vec, b.vec) >= 0.9
), r AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT vec_id, least(vec_id, coalesce((SELECT min(y) FROM r WHERE x = vec_id), vec_id)) AS component_id, (SELECT count(*) FROM l WHERE x = vec_id) AS n_links FROM embeddings
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c
""",
    "op3_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS escapes
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(text) + escapes + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_ann": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
    sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.vec, c.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
""",
    "op12_spelling": """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM each
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), results AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), d AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word
), best AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS r FROM p JOIN w ON w.word = p.near
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word AND r = 1
), up AS (
  SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN roots USING (word)
""",
}
