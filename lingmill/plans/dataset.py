"""Dataset plans: leak-free splits, context questions, mining of boilerplate, augmentation, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import budget as B
from ..functions import text as X
from ..functions.hashing import digest, half_even_share, side, top_per_group, uniform
from ..operators.relational import common_prefix, keep_first, other_item


def split_by_group(df: DataFrame, group: Column, name: str = "_side") -> DataFrame:
    """`item_group`, and `_side` unless a row has one."""
    out = df.withColumn("item_group", group)
    given = F.col(name) if name in df.columns else F.lit(None).cast("string")
    return out.withColumn(name, F.coalesce(given, side(F.col("item_group"))))


def leaks(df: DataFrame, group: str = "item_group", name: str = "_side") -> DataFrame:
    """Groups on more than one side; must be empty."""
    return df.groupBy(group).agg(F.countDistinct(name).alias("sides")).where("sides > 1")


def side_counts(df: DataFrame, *by: str, name: str = "_side") -> DataFrame:
    return df.groupBy(*by).pivot(name, ["dev", "train"]).count().na.fill(0, ["dev", "train"])


def draw_groups(df: DataFrame, group: str, share: float = 0.2, strata: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """An explicit number of distinct groups per stratum: share x n, half to even, first by hash."""
    groups = df.select(group, *strata).distinct()
    w = W.partitionBy(*(strata or [F.lit(0)]))
    return groups.select("*", F.row_number().over(w.orderBy(digest(group, seed=seed), group)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_r") <= half_even_share(F.col("_n"), share)).select(group, *strata)


def complete_items(df: DataFrame, keys: list[str], lang: str, n_langs: int) -> DataFrame:
    """Items that aren't there in all languages; must be empty."""
    return df.groupBy(*keys).agg(F.countDistinct(lang).alias("n")).where(F.col("n") != n_langs)


def context_questions(items: DataFrame, pairs: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """items(link, number, lang, question, passage, a1..a4, correct) x pairs(link, number, question_lang, context_lang): wrapped questions and gold answers.

    Two equi-joins: the passage in the context's language, question and answer in the question's.
    """
    q = items.select("link", "number", F.col("lang").alias("question_lang"), "question", F.element_at(F.array("a1", "a2", "a3", "a4"), F.col("correct")).alias("output"))
    p = items.select("link", "number", F.col("lang").alias("context_lang"), "passage")
    rows = pairs.join(q, ["link", "number", "question_lang"]).join(p, ["link", "number", "context_lang"]).join(boilerplate.withColumnRenamed("lang", "question_lang"), "question_lang")
    text = X.wrap_context(F.col("lead"), F.col("passage"), F.col("intro"), F.col("question"), F.col("tail"))
    return rows.select(F.lit("qa-context").alias("task"), "question_lang", "context_lang", text.alias("input"), "output", F.concat(F.lit("belebele:"), "link").alias("item_group"))


def unanswerable(rows: DataFrame, links: DataFrame, rate: float = 0.07, seed: int = 42) -> DataFrame:
    """rows(link, side, ...) with `passage_link`: for about `rate` of them another link of the same side, whose passage can't answer."""
    ring = other_item(links, "side", "link", seed).withColumnRenamed("link", "_l")
    joined = rows.join(ring.select("_l", "other"), F.col("link") == F.col("_l"), "left").drop("_l")
    swap = (uniform("link", "question_lang", seed=seed) < rate) & F.col("other").isNotNull()
    return joined.withColumn("unanswerable", swap).withColumn("passage_link", F.when(swap, F.col("other")).otherwise(F.col("link"))).drop("other")


def option_free(df: DataFrame, keys: list[str], lang: str, question: str) -> DataFrame:
    """Drop items whose English question points at its options; all languages of the item go."""
    bad = df.where((F.col(lang) == "eng") & F.col(question).rlike("(?i)of the following|of these|following is|below")).select(*keys).distinct()
    return df.join(bad, keys, "left_anti")


def length_band(text: Column, lang: Column) -> Column:
    chars = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(lang == "jpn", chars.between(40, 500)).otherwise(F.size(X.words(text)).between(20, 200))


def mine_boilerplate(tests: DataFrame) -> DataFrame:
    """(lang, lead, intro, tail, one_sentence, refusal, answer_in, phrase) of tests(question_lang, prompt, task); fails where a language's prompts disagree."""
    parts = tests.where((F.col("task") == "qa-context") & (X.strip(F.col("prompt")) != "")).select("question_lang", X.sections(F.col("prompt")).alias("s"))
    parts = parts.withColumn("s", F.when(F.size("s") == 4, F.col("s")).otherwise(F.raise_error(F.lit("a prompt hasn't four sections"))))
    g = parts.groupBy(F.col("question_lang").alias("lang")).agg(F.countDistinct(F.col("s")[0]).alias("leads"), F.countDistinct(X.strip(F.col("s")[3])).alias("tails"), F.min(F.col("s")[0]).alias("lead"), F.min(X.strip(F.col("s")[3])).alias("tail"), common_prefix(F.min(F.col("s")[2]), F.max(F.col("s")[2])).alias("intro"))
    sound = (F.col("leads") == 1) & (F.col("tails") == 1) & X.rstrip(F.col("intro")).rlike("[:：]$")
    g = g.withColumn("lead", F.when(sound, F.col("lead")).otherwise(F.raise_error(F.concat(F.col("lang"), F.lit(": prompts of one language differ in lead, tail or intro")))))
    s = X.sentences(F.col("tail"))
    return g.select("lang", "lead", "intro", "tail", s[0].alias("one_sentence"), s[1].alias("refusal"), s[2].alias("answer_in"), X.quoted(s[1]).alias("phrase"))


def augment(rows: DataFrame, dims: DataFrame, fraction: float = 0.5, exact: float = 0.5, least: int = 20, seed: int = 42) -> DataFrame:
    """rows(task, lang, input, output) with a length clause on a share of the open questions whose answers are long enough; `constraint` names its kind.

    Every row draws by its own hash, whether or not it could be changed. dims: budget.dimension().
    """
    n = B.measure(F.col("output"), F.col("lang"))
    j = rows.join(F.broadcast(dims.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang"), "left")  # a row a language
    take = (F.col("task") == "qa-oeg") & (n >= least) & F.col("_lang").isNotNull() & (uniform("input", "output", seed=seed) < fraction)
    is_exact = uniform("input", "output", seed=f"{seed}e") < exact
    band = B.bounds(n)
    clause = F.when(is_exact, B.render(F.col("exact"), F.col("range"), F.col("family"), B.clause_number(n), F.lit(None).cast("int"))).otherwise(B.render(F.col("exact"), F.col("range"), F.col("family"), band["lo"], band["hi"]))
    out = j.withColumn("constraint", F.when(take, F.when(is_exact, "budget-exact").otherwise("budget-range")))
    return out.withColumn("input", F.when(take, X.append_clause(F.col("input"), clause)).otherwise(F.col("input"))).select(*rows.columns, "constraint")


def shrink(rows: DataFrame, quotas: DataFrame, lo: int = 80, hi: int = 250, seed: int = 42) -> DataFrame:
    """Per source up to its quota: outputs of lo to hi words first, then others, each in hash order."""
    j = rows.join(quotas.select(F.col("source").alias("_s"), "quota"), F.col("source") == F.col("_s")).drop("_s")
    inside = F.size(X.words(F.col("output"))).between(lo, hi)
    return top_per_group(j, ["source"], F.col("quota"), F.when(inside, 0).otherwise(1), digest("input", "output", seed=seed)).drop("quota")


def reasons(df: DataFrame, *tests: tuple[str, Column]) -> DataFrame:
    """`reason`: the first test that holds; null for rows that pass."""
    return df.withColumn("reason", F.coalesce(*(F.when(c, n) for n, c in tests)))


def best_per_target(df: DataFrame, target: str, rank: Column, *order: Column) -> DataFrame:
    return keep_first(df, [target], rank, *order)


def surrogate(df: DataFrame, *order: Column) -> Column:
    """Negative keys -1, -2 ... in the given order; for small packs (one window)."""
    return -F.row_number().over(W.orderBy(*order))
