"""The queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_crf, jpeg, language, lm, mixing, packing, quality, simhash, suffixes, topk
from .common import hash_mod, read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(hash_mod("doc_id", 5) != 0))
    return language.identify(docs, *model).select("doc_id", (hash_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read(spark, sf_dir, "pages"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = hash_mod("doc_id", 4) == 2
    out = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted_fair_mix(read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ord FROM s),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM w),
f AS (SELECT *, row_number() OVER (ORDER BY ratio, ord) AS k, sum(source_size) OVER () AS total,
  sum(cap) OVER (ORDER BY ratio, ord) - cap AS filled, sum(w) OVER (ORDER BY ratio, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM r),
l AS (SELECT *, (total - filled)::DOUBLE / open_w AS level FROM f),
m AS (SELECT k AS mk, level AS ml FROM l WHERE level <= ratio ORDER BY k LIMIT 1),
t AS (SELECT l.source, l.source_size, coalesce(CASE WHEN l.k < m.mk THEN l.cap::DOUBLE ELSE least(l.cap::DOUBLE, m.ml * l.w) END, 0.0) AS target FROM l LEFT JOIN m ON true),
q AS (SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start_of FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - start_of)) + greatest(0, least(size, floor(target)::BIGINT - start_of - source_size)) + greatest(0, least(size, floor(target)::BIGINT - start_of - 2 * source_size)))::BIGINT AS taken FROM q
"""


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_texts(read(spark, sf_dir, "documents"), hash_mod("doc_id", 5) != 1, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.read_back(jpeg.store_texts(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_suffix_dedup": op1_suffix_dedup, "op2_packing": op2_packing, "op3_language_id": op3_language_id, "op4_html": op4_html, "op5_top_k": op5_top_k, "op6_quality": op6_quality, "op7_mixing": op7_mixing, "op8_lm_score": op8_lm_score, "op9_simhash": op9_simhash, "op10_media": op10_media}
ORACLE_SQL: dict[str, str] = {"op5_top_k": OP5_SQL, "op7_mixing": OP7_SQL}
