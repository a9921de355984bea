"""Joins, windows, sets and checks of the curation pipelines."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import digest
from .shared import shared_root

#: A weight is the number of these that 16 hashed bits reach: weights then follow Poisson's law with mean 1.
POISSON = [round(65536 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8)]
DRAWS_A_DIGEST = 8


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in an explicit order (dropDuplicates has none)."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def prefer(df: DataFrame, keys: list[str], source: str, substr: str, *order: Column) -> DataFrame:
    """Collisions go to the source that holds substr (case matters), else to the first in order."""
    return keep_first(df, keys, F.when(F.contains(F.col(source), F.lit(substr)), 0).otherwise(1), *order)


def collisions(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Keys with several rows: how many, and in how many sources."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("n_sources")).where("n > 1")


def check_collisions(df: DataFrame, keys: list[str], source: str, substr: str | None) -> None:
    """Refuse colliding sources without a preference, and a preference that matches none or several of them."""
    clash = collisions(df, keys, source).where("n_sources > 1").select(*keys)
    names = [r[0] for r in df.join(clash, keys, "left_semi").select(source).distinct().limit(1000).collect()]
    if names and substr is None:
        raise ValueError(f"sources collide, state which one to prefer: {sorted(names)}")
    if names and len(hits := [n for n in names if substr in n]) != 1:
        raise ValueError(f"{substr!r} matches {len(hits)} of the colliding sources")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def align(frames: dict[str, DataFrame], key: str, same: str) -> DataFrame:
    """One row a key with each system's other columns as <name>_<column>; fails on repeated keys, differing keys or differing `same`."""
    out = None
    for name, df in frames.items():
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: repeated keys")
        side = df.select(F.col(key).alias("_key"), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key))
        out = side if out is None else out.join(side.withColumnRenamed("_key", "_other"), F.col("_key") == F.col("_other"), "full_outer")
        if "_other" in out.columns:
            if out.where("_key IS NULL OR _other IS NULL").limit(1).count():
                raise ValueError(f"{name}: other rows than the systems before")
            out = out.drop("_other")
    first, *rest = [F.col(f"{n}_{same}") for n in frames]
    for c in rest:
        if out.where(~first.eqNullSafe(c)).limit(1).count():
            raise ValueError(f"systems differ in {same}")
    return out.withColumnRenamed("_key", key)


def lookup(df: DataFrame, column: str, *dims: DataFrame, name: str) -> DataFrame:
    """First hit of `column` in dimension tables (key, value), in turn; else the raw code. The tables are broadcast: rows aren't
    moved to a task a code."""
    found = []
    for i, d in enumerate(dims):
        k, v = d.columns[:2]
        df = df.join(F.broadcast(d.select(F.col(k).alias(f"_k{i}"), F.col(v).alias(f"_v{i}"))), F.col(column) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return df.withColumn(name, F.coalesce(*found, F.col(column))).drop(*(f"_{x}{i}" for i in range(len(dims)) for x in "kv"))


def reject_unknown(df: DataFrame, column: str, allowed: list[str]) -> None:
    bad = [r[0] for r in df.where(~F.col(column).isin(*allowed)).select(column).distinct().limit(20).collect()]
    if bad:
        raise ValueError(f"unknown {column}: {bad}")


def other_item(items: DataFrame, side: str, item: str, seed: int = 42) -> DataFrame:
    """(item, other): another item of the same side, the next in hash order around a ring; an item alone on its side has none.

    The window needs the items of a side in one task: use it on dimension-sized tables of items, not on rows.
    """
    order = W.partitionBy(side).orderBy(digest(item, seed=seed), item)
    rows = items.select(side, item).distinct()
    rows = rows.select(side, item, F.coalesce(F.lead(item).over(order), F.first(item).over(order)).alias("other"))
    return rows.where(F.col("other") != F.col(item))


def few_shot(rows: DataFrame, pool: DataFrame, key: str, tiers: list[list[str]], k: int, text: str, seed: int = 42) -> DataFrame:
    """(key, tier, shots): for each row k pool texts of the narrowest tier (columns that must agree) with k others than the row's own text.

    The pool is ranked once a tier by hash and only its first k + 1 distinct texts are joined, so a row meets k + 1 candidates
    and not its whole stratum; the spare one stands in for a copy of the row itself. Ranking and the choice of a tier go by the
    texts' hashes: a text is moved once at most, to find those of the first k + 1, and rows meet texts only at the end.
    """
    columns = list(dict.fromkeys(c for t in tiers for c in t))
    # the hash that ranks a text, told from a missing text's, which is no shot and has none
    name = F.concat(digest(text, seed=seed), F.col(text).isNull().cast("int").cast("string"))
    distinct = pool.select(*columns, name.alias("_h")).distinct()
    heads = []
    for tier in tiers:
        own = distinct if set(tier) == set(columns) else distinct.select(*tier, "_h").distinct()
        ranked = own.withColumn("_r", F.row_number().over(W.partitionBy(*(tier or [F.lit(0)])).orderBy("_h")))
        heads.append(ranked.where(F.col("_r") <= k + 1).where(F.col("_h").endswith("0")).drop("_r"))

    def joined(left: DataFrame, tier: list[str], right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_{c}" for c in tier})
        if not tier:
            return left.join(F.broadcast(right), F.lit(True), "left")  # one row
        return left.join(right, [F.col(c) == F.col(f"_{c}") for c in tier], "left").drop(*(f"_{c}" for c in tier))

    chosen = rows.select(key, *columns, F.when(F.col(text).isNotNull(), name).alias("_h"))
    for n, tier in enumerate(tiers):
        chosen = joined(chosen, tier, heads[n].groupBy(*tier).agg(F.array_sort(F.collect_list("_h")).alias("_heads")))
        others = F.filter("_heads", lambda h: h != F.col("_h"))
        chosen = chosen.withColumn(f"_n{n}", F.coalesce(F.size(others), F.lit(0)) >= k).drop("_heads")
    chosen = chosen.withColumn("tier", F.coalesce(*(F.when(F.col(f"_n{n}"), n + 1) for n in range(len(tiers))))).where("tier IS NOT NULL")
    chosen = keep_first(chosen.select(key, *columns, "_h", "tier"), [key], F.col("tier"))

    wanted = reduce(DataFrame.unionAll, (h.select("_h") for h in heads)).distinct()
    texts = pool.select(name.alias("_h"), text).join(wanted, "_h", "left_semi").groupBy("_h").agg(F.min(text).alias("_text"))
    shot = F.array_sort(F.collect_list(F.struct("_h", "_text"))).alias("_shots")
    # one table of the tiers with columns, in which those that a tier hasn't are null; a tier without columns is one row
    narrow = [n for n, tier in enumerate(tiers) if tier]
    out = chosen
    if narrow:
        found = reduce(DataFrame.unionAll, (heads[n].select(F.lit(n + 1).alias("_t"), *((F.col(c) if c in tiers[n] else F.lit(None).cast(pool.schema[c].dataType)).alias(f"_{c}") for c in columns), "_h") for n in narrow))
        found = found.join(texts, "_h").groupBy("_t", *(f"_{c}" for c in columns)).agg(shot)
        has = {c: F.col("tier").isin(*(n + 1 for n in narrow if c in tiers[n])) for c in columns}
        out = out.join(found, (F.col("tier") == F.col("_t")) & reduce(and_, (F.when(has[c], F.col(c)).eqNullSafe(F.col(f"_{c}")) for c in columns)), "left").withColumnRenamed("_shots", "_narrow")
    picks = [F.col("_narrow")] if narrow else []
    for n, tier in enumerate(tiers):
        if not tier:
            out = out.join(F.broadcast(heads[n].join(texts, "_h").agg(shot.alias(f"_wide{n}"))), F.lit(True), "left")
            picks.insert(0, F.when(F.col("tier") == n + 1, F.col(f"_wide{n}")))
    others = F.filter(F.coalesce(*picks), lambda s: s["_h"] != F.col("_h"))
    return out.select(key, "tier", F.slice(F.transform(others, lambda s: s["_text"]), 1, k).alias("shots"))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def common_prefix(a: Column, b: Column) -> Column:
    """Of two strings; that of a set is that of its least and greatest."""
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.substring(a, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))))


def prefix_by(df: DataFrame, by: list[str], c: str, name: str = "prefix") -> DataFrame:
    return df.groupBy(*by).agg(common_prefix(F.min(c), F.max(c)).alias(name))


def determined(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Groups where c isn't single-valued."""
    return df.groupBy(*by).agg(F.countDistinct(c).alias("n_values")).where("n_values != 1")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of links(a, b): roots are the least nodes. Labels halve their way by pointer jumping; each round is checkpointed."""
    shared_root(links.sparkSession)
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")).checkpoint()
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        low = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = low.join(low.select(F.col("node").alias("root"), F.col("root").alias("r")), "root").select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        new = jump.select("node", "root").checkpoint()
        if not new.join(labels.withColumnRenamed("root", "old"), "node").where("root != old").limit(1).count():
            return new
        labels = new
    raise RuntimeError(f"components aren't settled after {rounds} rounds")


def bootstrap(df: DataFrame, key: str, a: str, b: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of mean(a) - mean(b): delta, 95 % interval, two-sided p, verdict. Rows without a or b are left out.

    A draw gives every row a weight by the hash of its key and the draw, by Poisson's law with mean 1, the form of
    resampling that needs no count of rows and no row numbers. Sums by draw are made where the rows are; only
    three numbers a draw are shuffled.
    """
    rows = df.select(F.col(key).alias("k"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 8))  # few bytes a row, but work for thousands
    blocks = -(-draws // DRAWS_A_DIGEST)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("h", digest("k", "block", seed=seed))
    parts = range(DRAWS_A_DIGEST)
    bits = [F.conv(F.substring("h", 4 * i + 1, 4), 16, 10).cast("int") for i in parts]
    rows = rows.select("a", "b", "block", *(reduce(add, ((u >= t).cast("int") for t in POISSON)).alias(f"w{i}") for i, u in enumerate(bits)))
    sums = rows.groupBy("block").agg(*(F.sum(F.col(f"w{i}") * c).alias(f"s{n}{i}") for i in parts for n, c in (("n", F.lit(1)), ("a", F.col("a")), ("b", F.col("b")))))
    means = sums.select(F.explode(F.array(*(F.struct((F.col("block") * DRAWS_A_DIGEST + i).alias("draw"), ((F.col(f"sa{i}") - F.col(f"sb{i}")) / F.nullif(F.col(f"sn{i}"), F.lit(0))).alias("d")) for i in parts))).alias("x"))
    means = means.select("x.d").where((F.col("x.draw") < draws) & F.col("x.d").isNotNull())
    out = means.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int")))).alias("p"))
    delta = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg((F.avg(a) - F.avg(b)).alias("delta"))
    return delta.crossJoin(out).select("delta", "low", "high", "p", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("no difference").alias("verdict"))  # one row each
