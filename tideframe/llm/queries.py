"""The registered queries of this package: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import ans, bpe, common, hard_negatives, media, mixing, ngram_join, pii, quality_rules, setsketch, suffix_dedup, url_model, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.archive_pages(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.written(media.store(table(spark, sf_dir, "documents")))
    found = media.feature(media.describe(stored))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe.encode(docs, path, pattern, decoded="decoded")
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return got.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sizes_and_takes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents"))
    base = pii.written_spans(F.col("base"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(base, 256).alias("base_sha256"), pii.written_spans(F.concat("base", "more")).alias("spans"))


def op8_ans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, counts = ans.write_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    read = ans.read_files(manifest, counts)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the constant 1000000 in x moves every row and the mean alike, so it changes no column
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), scale=64)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_media": op2_media,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_join": op4_ngram_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_ans_files": op8_ans_files,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_model": op10_url_model,
    "op11_whitening": op11_whitening,
    "op12_setsketch": op12_setsketch,
    "op13_hard_negatives": op13_hard_negatives,
}

OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST(concat('0x', substr(hex, 1 + CAST(i // 8 AS INTEGER) * 10, 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN CAST(keeper AS BIGINT) END AS refers_to
FROM g
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS g FROM d),
k AS (SELECT md5(array_to_string(list_sort(g), chr(10))) AS k, min(doc_id) AS rep, any_value(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY 1),
t AS (SELECT rep, n, unnest(g) AS x FROM k),
f AS (SELECT t.*, row_number() OVER (PARTITION BY rep ORDER BY c, t.x) AS pos FROM t JOIN (SELECT x, count(*) AS c FROM t GROUP BY x) USING (x)),
p AS (SELECT rep, n, x FROM f WHERE pos <= n - (90 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN k x ON x.rep = c.a JOIN k y ON y.rep = c.b
  WHERE 190 * len(list_intersect(x.g, y.g)) >= 90 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
o AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a),
m AS (SELECT s.doc_id, len(s.g) AS n, o.component FROM s LEFT JOIN k ON md5(array_to_string(list_sort(s.g), chr(10))) = k.k AND len(s.g) > 0 LEFT JOIN o USING (rep))
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM m
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))) END AS g FROM d),
k AS (SELECT md5(array_to_string(list_sort(g), chr(10))) AS k, min(doc_id) AS rep, any_value(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY 1),
t AS (SELECT rep, n, unnest(g) AS x FROM k),
f AS (SELECT t.*, row_number() OVER (PARTITION BY rep ORDER BY c, t.x) AS pos FROM t JOIN (SELECT x, count(*) AS c FROM t GROUP BY x) USING (x)),
p AS (SELECT rep, n, x FROM f WHERE pos <= n - (85 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN k x ON x.rep = c.a JOIN k y ON y.rep = c.b
  WHERE 185 * len(list_intersect(x.g, y.g)) >= 85 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
o AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a),
m AS (SELECT s.doc_id, len(s.g) AS n, o.component FROM s LEFT JOIN k ON md5(array_to_string(list_sort(s.g), chr(10))) = k.k AND len(s.g) > 0 LEFT JOIN o USING (rep))
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(component, doc_id) AS kept FROM m
"""

OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, CAST(len(a.v) + 1 AS BIGINT)), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_ngram_join": OP4_SQL,
    "op10_url_model": url_model.ORACLE_SQL,
    "op12_setsketch": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
