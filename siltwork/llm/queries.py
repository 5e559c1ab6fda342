"""The queries of this subpackage, thin over its operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import decontaminate, html, language, minhash, packing, pii, sharding, substring, suffixes, vectors
from siltwork.llm.common import table

#: For the queries here; a deployment brings its own secret.
PII_KEY = "siltwork-demo-key"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", F.size("pii_types").cast("long").alias("n_replaced"), F.array_join("pii_types", ",").alias("types"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    out = language.identify(docs.select("doc_id", "text"), model, score="score")
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13, 20)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_pii, op3_substring, op4_html, op5_vectors, op6_suffixes, op7_language, op8_minhash, op9_decontamination, op10_packing)
}

_SPLIT = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH w AS (SELECT doc_id, {_SPLIT.format(text="coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p WHERE i + 49 <= len(w)),
m AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN m USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM p),
kept AS (SELECT x.doc_id, count(g.i) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.i) FILTER (g.i IS NULL), '') AS kept
  FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = v.vec_id
"""

_OP6 = """
WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM b WHERE len(h) >= 400),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM p),
twice AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM k SEMI JOIN twice USING (k)),
marked AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER w, -1000) + 200 THEN 1 ELSE 0 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM spans),
kept AS (SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM gaps g JOIN b USING (doc_id) GROUP BY g.doc_id)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
"""

_OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda t: md5(t))) AS t FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
half AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""

_WORDS9 = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS9.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
t AS (SELECT item_id::VARCHAR AS item_id, {_WORDS9.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM benchmark),
p AS (SELECT item_id, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM t WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, len(w[i:i + 12]) AS size, array_to_string(w[i:i + 12], ' ') AS k FROM p),
sizes AS (SELECT DISTINCT size FROM windows),
q AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
k AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM q, sizes WHERE i + size - 1 <= len(w)),
hits AS (SELECT doc_id, i, size, item_id FROM k JOIN windows USING (size, k)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op3_substring": _OP3, "op5_vectors": _OP5, "op6_suffixes": _OP6, "op8_minhash": _OP8, "op9_decontamination": _OP9}
