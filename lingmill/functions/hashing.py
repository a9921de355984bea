"""Keyed hashes in place of random numbers: the same draw for a key under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: md5 values below this are the lowest fifth.
FIFTH = "33333333333334"


def digest(*parts: Column | str, seed: int | str = 42) -> Column:
    """md5 of the seed and the parts; null parts count as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)).cast("binary"))


def uniform(*parts: Column | str, seed: int | str = 42) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(*parts, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def side(group: Column, cut: str = FIFTH) -> Column:
    """'dev' for about a fifth of the groups, 'train' for the rest; one group is never on both sides."""
    return F.when(F.md5(group.cast("binary")) < cut, "dev").otherwise("train")


def half_even_share(n: Column, share: float) -> Column:
    """n x share, rounded half to even."""
    return F.bround(n * F.lit(share), 0).cast("int")


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top_per_group(df: DataFrame, by: list[str], n: int | Column, *order: Column) -> DataFrame:
    """At most n rows of each group, the first in the given order."""
    return ranked(df, by, *order, name="_rn").where(F.col("_rn") <= n).drop("_rn")


def ordinal(df: DataFrame, bucket: Column, *order: Column, name: str = "ordinal") -> DataFrame:
    """A global row number from 0 without a global sort in one task.

    `bucket` must not fall along the order: rows are numbered inside buckets, and each bucket starts where the
    buckets before it end. Only one row a bucket meets in one task.
    """
    rows = df.withColumn("_b", bucket)
    starts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col("_b").alias("_b2"), (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_start"), F.sum("_n").over(W.partitionBy(F.lit(1))).alias("_all"))
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy("_b").orderBy(*order)))
    return rows.join(starts, F.col("_b") == F.col("_b2")).withColumn(name, F.col("_start") + F.col("_i") - 1).withColumnRenamed("_all", "n_rows").drop("_b", "_b2", "_i", "_start")


def shard(df: DataFrame, i: int, n: int, bucket: Column, *order: Column) -> DataFrame:
    """Contiguous shard i of n (from 1): rows N(i-1)//n up to N i//n."""
    if not 1 <= i <= n:
        raise ValueError(f"shard {i} of {n}: shards count from 1 to their number")
    rows = ordinal(df, bucket, *order, name="_o")
    lo, hi = F.floor(F.col("n_rows") * (i - 1) / n), F.floor(F.col("n_rows") * i / n)
    return rows.where((F.col("_o") >= lo) & (F.col("_o") < hi)).drop("_o", "n_rows")
