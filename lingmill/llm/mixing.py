"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, table


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n, target) of sizes(source, size).

    Sources by code point, null last, weigh `weights` in turn and share 100 % of all sizes. A target stops at
    cap x its source's size; the excess is shared by weight among the others until none is above. That is the
    water level L with sum(min(cap * size, weight * L)) = total, found by prefix sums over the sources in the
    order of cap * size / weight: one row a source, whatever the number of documents.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    src = src.select("*", weight.cast("long").alias("w"), (cap * F.col("source_size")).alias("cap"), F.row_number().over(order).alias("at"))
    src = src.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    rising = W.orderBy("ratio", "at")
    every = rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = src.select("*", F.row_number().over(rising).alias("k"), F.sum("source_size").over(every).alias("total"), F.sum("n").over(every).alias("n_all"), (F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")).alias("filled"), F.sum("w").over(rising.rowsBetween(0, W.unboundedFollowing)).alias("open_w"))
    src = src.withColumn("level", (F.col("total") - F.col("filled")).cast("double") / F.col("open_w"))
    src = src.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(every))
    target = F.when(F.col("k") < F.col("found.k"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("found.level") * F.col("w")))
    return src.select("source", "source_size", "n", "total", "n_all", F.coalesce(target, F.lit(0.0)).alias("target"))


def weighted_fair_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """Mix docs(doc_id, text, source, ...): returns (documents, packets).

    documents: doc_id, source, start_of (its place in its source's queue), size, source_size, target, taken,
    one row per input row. packets: doc_id, source, start_of, size, pass, finish, start (the place in the mix,
    in words), served; those that the mix takes, whole or in part.

    Size: words of the text. Each source is a queue of its shuffled documents (order: md5 of doc_id), gone
    through up to `cap` times. A packet is one document in one pass; its virtual finish time is the source's
    cumulative words divided by the source's share, the target. All packets are range-sorted by finish time
    and cut at the total budget; the packet that a source is serving at the cut is served in part, so a
    source's taken words differ from its target by less than one word, and no document is taken more than
    `cap` times.

    Running sums go by buckets, as many as the square root of the rows (a source's hash ranges, then ranges of
    finish time), so a source with a third of all rows is spread like any other. Null or empty text: size 0, taken 0.
    Null source: a source of its own, the last. Rows that repeat a doc_id are documents of their own. Empty
    tables give empty tables. Other columns are not looked at.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle"))
    sized = table(sized, "sized")
    src = table(source_targets(sized, weights, cap), "sources")
    place = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / 2.0**32
    rows = sized.alias("d").join(src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.total", "s.n_all", F.floor(place * F.ceil(F.sqrt("s.n"))).alias("b"))
    before = rows.groupBy("source", "b").agg(F.sum("size").alias("words"))
    before = before.select(F.col("source").alias("s"), F.col("b").alias("at"), (F.sum("words").over(W.partitionBy("source").orderBy("b")) - F.col("words")).alias("before"))
    inside = F.sum("size").over(W.partitionBy("source", "b").orderBy("shuffle", "size", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("upto", inside).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("at"))).withColumn("start_of", F.col("before") + F.col("upto") - F.col("size"))
    queued = table(rows.select("doc_id", "source", "size", "shuffle", "source_size", "target", "total", "n_all", "start_of"), "queued")

    packets = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("pass")).withColumn("first", F.col("start_of") + F.col("pass") * F.col("source_size"))
    served = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("first")))
    packets = packets.withColumn("served", served).where("served > 0").withColumn("finish", (F.col("first") + F.col("size")).cast("double") / F.col("target"))
    packets = packets.withColumn("range", F.floor(F.least(F.col("finish"), F.lit(1.0)) * F.ceil(F.sqrt("n_all"))))
    ahead = packets.groupBy("range").agg(F.sum("served").alias("words")).select(F.col("range").alias("r"), (F.sum("words").over(W.orderBy("range")) - F.col("words")).alias("ahead"))
    inside = F.sum("served").over(W.partitionBy("range").orderBy("finish", "shuffle", "pass", "source", "start_of").rowsBetween(W.unboundedPreceding, 0))
    packets = packets.withColumn("upto", inside).join(ahead, F.col("range") == F.col("r")).withColumn("start", F.col("ahead") + F.col("upto") - F.col("served"))
    packets = packets.withColumn("served", F.least(F.col("served"), F.col("total") - F.col("start"))).where("served > 0")
    packets = packets.select("doc_id", "source", "start_of", "size", "pass", "finish", "start", "served")

    taken = packets.groupBy(F.col("source").alias("s"), F.col("start_of").alias("at")).agg(F.sum("served").alias("taken"))
    out = queued.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("start_of") == F.col("at")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "start_of", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), packets
