"""Thin registered queries over the operators, each with its SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilink.llm.common import table
from lexilink.llm.decontaminate import decontaminate
from lexilink.llm.htmltext import extract_text
from lexilink.llm.jaccard import jaccard_classes
from lexilink.llm.licenses import scan_licenses
from lexilink.llm.linededup import dedup_lines
from lexilink.llm.minhash import near_duplicates
from lexilink.llm.packing import pack_documents
from lexilink.llm.quality import quality_rules
from lexilink.llm.rolling import rolling_features
from lexilink.llm.tokenfiles import tokenize_round_trip
from lexilink.llm.urlfilter import RULES, filter_urls
from lexilink.llm.warc import warc_round_trip
from lexilink.llm.whitening import whitened_components


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_round_trip(table(spark, sf_dir, "documents"), _tokenizer())


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", F.col("llm_n_lines").alias("n_lines"), F.col("llm_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE holder <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer())


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, action DESC) AS k,
         count(rhost) OVER (PARTITION BY page_id) AS n
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict, n AS n_rules_fitting FROM m WHERE k = 1
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = OP8_SQL.replace("w[i:i + 3]", "w[i:i + 2]").replace("greatest(len(w) - 3, 1)", "greatest(len(w) - 2, 1)").replace("AS component_id\n", "AS component_id, least(d.doc_id, coalesce(m.least, d.doc_id)) = d.doc_id AS kept\n")


def op13_rolling_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten minutes and twelve hours before each document, by source."""
    place = F.col("doc_id") + F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10_000
    docs = table(spark, sf_dir, "documents").withColumn("place", place)
    event_s = F.expr("60 * ((place - pmod(place, 6)) div 6)")
    found = rolling_features(docs, ["doc_id"], F.col("source"), event_s, F.char_length("text"), F.col("lang"))
    names = {"n_rows": "n_events", "total": "sum_chars", "n_labels": "n_langs", "q0": "median_chars", "q1": "high_chars"}
    return found.withColumnsRenamed(names)


OP13_SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
h AS (SELECT doc_id, source, lang, length(text) AS chars,
             xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1)))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS h
      FROM documents, crc),
e AS (SELECT *, CAST(60 * floor((doc_id + h % 10000) / 6) AS BIGINT) AS event_s FROM h),
w AS (SELECT doc_id, event_s, 600::BIGINT AS window_s, count(*) OVER s AS n_events, coalesce(sum(chars) OVER s, 0)::BIGINT AS sum_chars, count(DISTINCT lang) OVER s AS n_langs, list_sort(list(chars) FILTER (chars IS NOT NULL) OVER s) AS l FROM e
      WINDOW s AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 600 PRECEDING AND 1 PRECEDING)
      UNION ALL
      SELECT doc_id, event_s, 43200, count(*) OVER s, coalesce(sum(chars) OVER s, 0)::BIGINT, count(DISTINCT lang) OVER s, list_sort(list(chars) FILTER (chars IS NOT NULL) OVER s) FROM e
      WINDOW s AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 43200 PRECEDING AND 1 PRECEDING))
SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, CASE WHEN len(l) > 0 THEN l[(len(l) + 1) // 2] END AS median_chars, CASE WHEN len(l) > 0 THEN l[(90 * len(l) + 99) // 100] END AS high_chars FROM w
"""


def queries() -> dict:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_token_ids": op2_token_ids,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_warc": op4_warc,
        "op5_html_extraction": op5_html_extraction,
        "op6_line_dedup": op6_line_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_quality_rules": op9_quality_rules,
        "op10_url_filters": op10_url_filters,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_minhash_near_dedup": op12_minhash_near_dedup,
        "op13_rolling_window_features": op13_rolling_window_features,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op4_warc": OP4_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op6_line_dedup": OP6_SQL, "op10_url_filters": OP10_SQL, "op12_minhash_near_dedup": OP12_SQL, "op13_rolling_window_features": OP13_SQL}
