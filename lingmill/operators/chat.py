"""Chat transcripts, templates, label masks and batches of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKED = -100


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(text: Column, system: Column | None = None, shots: Column | None = None) -> Column:
    """[system], (user, assistant) of each shot(input, output), user."""
    parts = [F.array(turn("system", system))] if system is not None else []
    if shots is not None:
        parts.append(F.flatten(F.transform(shots, lambda s: F.array(turn("user", s["input"]), turn("assistant", s["output"])))))
    return F.concat(*parts, F.array(turn("user", text)))


def system_text(language: Column) -> Column:
    return F.concat(F.lit("You are a helpful assistant. Reply in "), language, F.lit("."))


def render(msgs: Column, generate: bool = True) -> Column:
    """ChatML; with the start of the assistant's turn if it is to be generated."""
    body = F.array_join(F.transform(msgs, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generate else body


def mask_labels(prefix: Column, answer: Column, most: int) -> list[Column]:
    """ids, labels, truncated: the prefix is masked, and cut from the left so that the answer stays."""
    ids = F.concat(prefix, answer)
    labels = F.concat(F.array_repeat(F.lit(MASKED), F.size(prefix)), answer)
    cut = lambda c: F.when(F.size(c) > most, F.slice(c, -most, most)).otherwise(c)
    return [cut(ids).alias("ids"), cut(labels).alias("labels"), (F.size(ids) > most).alias("truncated")]


def pad(df: DataFrame, batch: str, ids: str, fill: int) -> DataFrame:
    """df with `ids` padded to its batch's longest and an attention mask."""
    longest = df.groupBy(F.col(batch).alias("_b")).agg(F.max(F.size(ids)).alias("_n"))
    rows = df.join(longest, F.col(batch) == F.col("_b"))
    more = F.col("_n") - F.size(ids)
    return rows.withColumn("mask", F.concat(F.transform(F.col(ids), lambda x: F.lit(1)), F.array_repeat(F.lit(0), more))).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(fill), more))).drop("_b", "_n")


def is_permutation(a: Column, n: int) -> Column:
    return F.sort_array(a) == F.sequence(F.lit(0), F.lit(n - 1))
