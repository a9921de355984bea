"""A corpus pipeline of five stages over `documents`: language, near and exact duplicates, mixture, packing.

What a stage found is joined to the texts by sorting and merging at every size: such tables grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.llm import language, mixing, packing, simhash, suffixes
from lingmill.llm.common import hash_mod, read, table
from lingmill.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: a text with letters whose best language has a posterior of LEAST_SCORE or more."""
    docs = docs.select(*COLUMNS)
    model = language.train(docs.where(hash_mod("doc_id", 5) != 0))
    named = docs.select(F.struct(*COLUMNS).alias("d"), "text")
    found = language.identify(named, *model, keep="d")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("d.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of texts whose five-word shingles have a Jaccard index of SIMILARITY or more (see simhash.similar_rows).

    Rows are told apart by a number of their own: equal or null doc_ids alone make no copies. The row with the smallest
    doc_id stays (null comes last), of several the one whose columns have the smallest hash.
    """
    rows, roots = simhash.similar_rows(docs.select(*COLUMNS), SIMILARITY, words=5)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("h"), "row")).alias("first")
    firsts = rows.groupBy("fp").agg(first).join(roots.hint("merge"), F.col("fp") == F.col("node"), "left")
    kept = firsts.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    return rows.join(table(kept, "kept").hint("merge"), F.col("row") == F.col("_row"), "left_semi").select(*COLUMNS)


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what stands elsewhere too out of each text (see suffixes.remove_repeats); a document of which no word is left goes.

    A cut that falls inside a character drops the rest of that character.
    """
    docs = docs.select(*COLUMNS)
    return suffixes.without_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: once for every whole pass and once more for a last part of half or more."""
    docs = docs.select(*COLUMNS)
    taken = mixing.weighted_fair_mix(docs)[0].where("taken > 0").groupBy("doc_id").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("times"))
    taken = table(taken.where("times > 0").select(F.col("doc_id").alias("_id"), "times"), "taken")
    found = docs.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens (see packing)."""
    return packing.pack(packing.cut(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("exact_repeats", exact_repeats), ("mix", mix), ("pack", pack)]
#: The stages' models and searches have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
