"""Acceptance checks of answers, and self-checks of prompts and tables, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import budget as B
from ..functions import text as X


def _count(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def budget_buckets(rows: DataFrame, lang: str, measured: Column, band: Column, slack: float = 0.15) -> DataFrame:
    """Over all rows with a band (null language) and by language: n, ok, over, under, and the mean excess of those over it.

    The band is widened by `slack` and cut to whole units first.
    """
    lo, hi = (band["lo"] * F.lit(1 - slack)).cast("int"), (band["hi"] * F.lit(1 + slack)).cast("int")
    x = rows.where(band.isNotNull()).select(F.col(lang).alias("lang"), measured.alias("m"), lo.alias("lo"), hi.alias("hi"))
    over, under = F.col("m") > F.col("hi"), F.col("m") < F.col("lo")
    return x.groupingSets([[], ["lang"]], "lang").agg(F.count(F.lit(1)).alias("n"), _count(~over & ~under, "ok"), _count(over, "over"), _count(under, "under"), F.avg(F.when(over, F.col("m") - F.col("hi"))).alias("excess"))


def label_counts(rows: DataFrame, text: str, label: Column) -> DataFrame:
    """Rows by label; texts of white space alone count as 'empty', null labels as 'abstain'."""
    return rows.groupBy(F.when(F.coalesce(X.is_blank(F.col(text)), F.lit(True)), "empty").otherwise(F.coalesce(label, F.lit("abstain"))).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def context_checks(rows: DataFrame, context_lang: str, output: str, refusal: Column, contrasts: list[tuple[str, str, str]] | None = None, sides: tuple[str, str] = ("bho", "hin")) -> DataFrame:
    """Over all rows (null context language) and by context language: n, empty, refused, answered, and of the answered ones how
    they lean and whether they have one sentence, two or many.

    An answer that holds the refusal phrase says nothing about how it was worded; it isn't counted further.
    """
    t = X.strip(F.coalesce(F.col(output), F.lit("")))
    x = rows.select(F.col(context_lang).alias("context_lang"), t.alias("t"), refusal.alias("r"))
    x = x.select("context_lang", "t", F.when(F.col("t") == "", "empty").when(F.coalesce(F.contains("t", F.col("r")), F.lit(False)), "refused").otherwise("answered").alias("kind"))
    answered = F.col("kind") == "answered"
    x = x.withColumn("lean", F.when(answered, F.coalesce(X.lean(F.col("t"), contrasts or X.CONTRASTS, *sides), F.lit("undecidable")))).withColumn("bucket", F.when(answered, X.sentence_bucket(F.col("t"))))
    counts = [_count(F.col(c) == v, v) for c, values in (("kind", ("empty", "refused", "answered")), ("lean", (*sides, "undecidable")), ("bucket", ("one", "two", "many"))) for v in values]
    return x.groupingSets([[], ["context_lang"]], "context_lang").agg(F.count(F.lit(1)).alias("n"), *counts)


def script_histogram(rows: DataFrame, context_lang: str, output: str) -> DataFrame:
    """(context_lang, script, n) of answers that aren't blank."""
    return rows.where(~X.is_blank(F.col(output))).groupBy(F.col(context_lang).alias("context_lang"), X.script_of(F.col(output)).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def digit_families(prompts: DataFrame, lang: str, text: str, dims: DataFrame) -> DataFrame:
    """(lang, attested, claimed, ok, unit_attested) of languages whose prompts have digits: the family they use most (the first of
    equal ones) against the table's, and whether the unit word stands in any of them."""
    joined = prompts.select(F.col(lang).alias("lang"), F.col(text).alias("t")).join(F.broadcast(dims.select("lang", "family", "unit_word")), "lang")  # a row a language
    n = {k: F.sum(F.length("t") - F.length(F.translate("t", g, ""))) for k, g in B.GLYPHS.items()}
    sums = joined.groupBy("lang", "family", "unit_word").agg(*(v.alias(k) for k, v in n.items()), F.max(F.contains("t", F.col("unit_word"))).alias("unit_attested"))
    best = F.greatest(*n)
    attested = F.coalesce(*(F.when(F.col(k) == best, k) for k in n))
    return sums.where(best > 0).select("lang", attested.alias("attested"), F.col("family").alias("claimed"), (attested == F.col("family")).alias("ok"), "unit_attested")


def rendering(dims: DataFrame, lo: int = 110, hi: int = 160, n: int = 140) -> DataFrame:
    """(lang, exact, range, ok): both clauses rendered; ok if one holds the language's unit word and no brace is left."""
    render = lambda first, last: B.render(F.col("exact"), F.col("range"), F.col("family"), F.lit(first), F.lit(last).cast("int"))
    out = dims.select("lang", render(n, None).alias("e"), render(lo, hi).alias("r"), "unit_word")
    held = F.contains("e", F.col("unit_word")) | F.contains("r", F.col("unit_word"))
    return out.select("lang", F.col("e").alias("exact"), F.col("r").alias("range"), (held & ~F.concat("e", "r").rlike("[{}]")).alias("ok"))


def anchors(rows: DataFrame, alignment: DataFrame, expected: DataFrame) -> DataFrame:
    """(lang, item, number, ok) for rows(lang, row_index, input), alignment(lang, row_index, item), expected(item, number): whether the
    aligned row names the number in any digit family. An item without a row counts as not ok."""
    want = alignment.join(F.broadcast(expected), "item")  # a few items
    found = want.join(rows.select("lang", "row_index", F.col("input").alias("_t")), ["lang", "row_index"], "left")
    number = F.col("number").cast("string")
    forms = [F.translate(number, B.GLYPHS["ascii"], g) for g in B.GLYPHS.values()]
    hit = F.greatest(*(F.coalesce(F.contains("_t", f), F.lit(False)).cast("int") for f in forms)) == 1
    return found.groupBy("lang", "item", "number").agg(F.max(hit).alias("ok"))
