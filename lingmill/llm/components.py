"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def _clean(edges: DataFrame) -> DataFrame:
    """Distinct (hi, lo) with hi > lo."""
    return edges.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("lo").alias("node"), F.col("lo").alias("m")).union(edges.select("hi", "lo"))
    least = table(ends.groupBy("node").agg(F.min("m").alias("m")), "least")  # alone, the join can split the links of one node
    return _clean(edges.join(least.hint("merge"), F.col("lo") == F.col("node")).select("hi", F.col("m").alias("lo")))


def _small(edges: DataFrame) -> DataFrame:
    least = table(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "least")
    pulled = edges.join(least.hint("merge"), F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return _clean(pulled.union(least.select(F.col("node").alias("hi"), F.col("m").alias("lo"))))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of links(hi, lo: long) that isn't the smallest of its component.

    Every step writes its links, which never outgrow those it got, to the shared folder; steps go on until
    nothing changes. No task and no driver holds a component.
    """
    edges = table(_clean(links), "links")
    mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("s")
    last = edges.agg(*mark).first()
    for _ in range(most):
        edges = table(_small(table(_large(edges), "large")), "small")
        now = edges.agg(*mark).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components aren't settled after {most} steps")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
