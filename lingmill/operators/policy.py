"""Quality gate: thresholds, per-source overrides, mixing of answers, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(chrf: Column, semantic: Column, c: float, b: float, both: bool = False) -> Column:
    return (chrf >= c) & (semantic >= b) if both else (chrf >= c) | (semantic >= b)


def policy(df: DataFrame, c: float, b: float, overrides: list[tuple[str, float, float]] = (), gold_only: list[str] = (), source: str = "source", chrf: str = "chrf", semantic: str = "semantic", answer: str = "answer", both: bool = False) -> DataFrame:
    """df plus `passed` and `policy`: global thresholds, then overrides by part of the source's name (any case; the last wins), then gold-only sources, then empty answers, which never pass.

    A name that matches no source raises an error.
    """
    sources = [r[0] or "" for r in df.select(source).distinct().limit(10_000).collect()]
    for s in [o[0] for o in overrides] + list(gold_only):
        if not any(s.lower() in x.lower() for x in sources):
            raise ValueError(f"no source matches {s!r}")
    inside = lambda s: F.contains(F.lower(F.col(source)), F.lit(s.lower()))
    passed, label = gate(F.col(chrf), F.col(semantic), c, b, both), F.lit("global")
    for s, c2, b2 in overrides:
        passed, label = F.when(inside(s), gate(F.col(chrf), F.col(semantic), c2, b2, both)).otherwise(passed), F.when(inside(s), f"{s}={c2:g},{b2:g}").otherwise(label)
    for s in gold_only:
        passed, label = F.when(inside(s), False).otherwise(passed), F.when(inside(s), "gold-only").otherwise(label)
    empty = F.coalesce(F.trim(F.col(answer)), F.lit("")) == ""
    return df.withColumn("passed", F.coalesce(passed & ~empty, F.lit(False))).withColumn("policy", label)


def mix(df: DataFrame, how: str, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """replace: the answer if it passed, else gold; both: gold and, if passed, the answer; teacher: answers that passed."""
    teacher = df.where("passed").withColumn("output", F.col(answer)).withColumn("origin", F.lit("teacher"))
    own = df.withColumn("output", F.col(gold)).withColumn("origin", F.lit("gold"))
    if how == "replace":
        return df.withColumn("output", F.when(F.col("passed"), F.col(answer)).otherwise(F.col(gold))).withColumn("origin", F.when(F.col("passed"), "teacher").otherwise("gold"))
    if how in ("both", "teacher"):
        return teacher if how == "teacher" else own.unionByName(teacher)
    raise ValueError(how)


def pass_rates(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("int")).alias("rate"), F.array_join(F.sort_array(F.collect_set("policy")), ",").alias("policies"))


def quantiles(df: DataFrame, by: list[str], c: str, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact, linearly interpolated, to one place; with `by` also over all rows (null group)."""
    p = F.percentile(c, F.array(*map(F.lit, at)))
    return df.groupingSets([[], by] if by else [[]], *by).agg(*(F.round(p[i], 1).alias(f"p{int(100 * q)}") for i, q in enumerate(at)))


def threshold_grid(df: DataFrame, chrf: str, semantic: str, cs: list[float], bs: list[float]) -> DataFrame:
    """Kept share for each pair of thresholds: conditional averages in one pass, then unpivoted."""
    names = {f"k{i}_{j}": (c, b) for i, c in enumerate(cs) for j, b in enumerate(bs)}
    one = df.agg(*(F.avg(gate(F.col(chrf), F.col(semantic), c, b).cast("int")).alias(n) for n, (c, b) in names.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("c"), F.lit(float(b)).alias("b"), F.col(n).alias("kept")) for n, (c, b) in names.items())))
    return one.select(rows.alias("r")).select("r.*")


def report(df: DataFrame, source: str, lang: str, *metrics: str) -> DataFrame:
    """Means overall, by source and by language in one pass."""
    return df.groupingSets([[], [source], [lang]], source, lang).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics))
