"""The queries of the corpus operators, one opN_<name> each, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classify, decontaminate, fingerprint, langid, neardup, pieces, pii, urls
from .frames import bucket, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), classify.TOXICITY, 0.5)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), n=4, percent=80)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(own)))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), classify.QUALITY, 0.3)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, bucket("doc_id", 4) != 2)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM shingled
), flat AS (SELECT doc_id, n, unnest(s) AS x FROM sized
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM sized JOIN least ON doc_id = a
"""

_ESC = "replace(replace(replace({0}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"

_OP3 = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), led AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER o AND row_number() OVER o > 1 AS same,
    row_number() OVER o AS k FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
), parts AS (
  SELECT *, CASE WHEN same THEN '<br/>' ELSE CASE WHEN k > 1 THEN '</turn>' || chr(10) ELSE '' END || '### '
    || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
       ELSE coalesce('[' || replace(replace({_ESC.format("role")}, ']', '\r'), ':', '\c') || ']', '[\n]') END || ': ' END || {_ESC.format("text")} AS part FROM led
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(part)) + 8 AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
"""

_OP9 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS x FROM (
    SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows
), spots AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, sizes WHERE len(w) >= k)
), met AS (SELECT DISTINCT doc_id, item, spots.k, s FROM spots JOIN windows USING (k, x)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM met) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)

#: Every combination of up to three tokens is counted; the rest follows the definitions of ``urls``.
_OP6 = rf"""
WITH split AS (
  SELECT page_id, url, row_number() OVER () AS k, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, url, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules AS (SELECT * FROM (VALUES {_RULES}) AS r(h, p, verdict)
), base AS (
  SELECT *, (SELECT arg_max([h || p, verdict], length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit,
    CASE WHEN host = '' THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
      CASE WHEN regexp_extract(path, '^/([^/]+)', 1) <> '' THEN ['first:' || regexp_extract(path, '^/([^/]+)', 1)] ELSE CAST([] AS VARCHAR[]) END,
      list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query:' || split_part(x, '=', 1))))) END AS tokens
  FROM named
), labelled AS (SELECT k, tokens, fit[2] = 'block' AS block, md5(url)[1] >= '{urls.PRUNING}' AS mining FROM base WHERE fit IS NOT NULL AND len(tokens) > 0
), flat AS (SELECT k, block, unnest(tokens) AS t FROM labelled WHERE mining
), combos AS (
  SELECT k, block, [t] AS ant FROM flat
  UNION ALL SELECT a.k, a.block, [a.t, b.t] FROM flat a JOIN flat b ON a.k = b.k AND a.t < b.t
  UNION ALL SELECT a.k, a.block, [a.t, b.t, c.t] FROM flat a JOIN flat b ON a.k = b.k AND a.t < b.t JOIN flat c ON b.k = c.k AND b.t < c.t
), frequent AS (
  SELECT ant, count(*) FILTER (WHERE block) / count(*) AS confidence FROM combos GROUP BY ant
  HAVING count(*) FILTER (WHERE block) >= ceil(0.005e0 * (SELECT count(*) FROM labelled WHERE mining)) AND count(*) FILTER (WHERE block) / count(*) >= 0.9e0
), firm AS (
  SELECT ant, confidence FROM frequent JOIN labelled ON NOT mining AND list_has_all(tokens, ant) GROUP BY ant, confidence
  HAVING count(*) FILTER (WHERE block) / count(*) >= 0.9e0
), mined AS (
  SELECT * FROM firm f WHERE NOT EXISTS (SELECT 1 FROM firm g WHERE len(g.ant) < len(f.ant) AND list_has_all(f.ant, g.ant) AND g.confidence >= f.confidence)
), fired AS (SELECT k, max(confidence) AS confidence FROM base JOIN mined ON fit IS NULL AND list_has_all(tokens, ant) GROUP BY k
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, fit[1] AS rule, coalesce(fit[2], CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, confidence
FROM base LEFT JOIN fired USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": _OP2, "op3_chat": _OP3, "op6_urls": _OP6, "op9_decontaminate": _OP9}
