"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_arrow, pieces, small_batches, to_batch

BITS, ORDERS, CHUNK = 16, (1, 2, 3), 500_000
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point (below 65536) to its lower-case letter, or to a space."""
    if not _FOLD:
        _FOLD.append(np.array([ord(x[0]) if (x := chr(c).lower()) and chr(c).isalpha() else 32 for c in range(65536)], np.uint32))
    return _FOLD[0]


def letters(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = fold_table()[np.minimum(cp, 65535)]
    if len(far := np.flatnonzero(cp > 65535)):
        out = out.copy()
        kinds, at = np.unique(cp[far], return_inverse=True)
        out[far] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in kinds.tolist()], np.uint32)[at]
    return out


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that starts at each place; starts of the texts' places; whether a letter stands at each."""
    pad = " " * max(ORDERS)
    cp = letters("".join(f" {t}{pad}" for t in texts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1 + len(pad))[:-1]])
    h, out = np.zeros(len(cp), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        nxt = np.zeros(len(cp), np.uint32)
        nxt[: len(cp) - n + 1] = cp[n - 1 :]
        h = (h + nxt + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
    return out, starts, cp != 32


def _split(texts: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Cut very long texts into parts of CHUNK characters that overlap by the longest n-gram: parts, their texts, places counted."""
    parts, owner, counted = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(len(t), 1), CHUNK):
            parts.append(t[a : a + CHUNK + max(ORDERS) - 1])
            owner.append(i)
            counted.append(min(len(t) - a, CHUNK) + 1)
    return parts, owner, counted


def features(texts: list[str]):
    """Yield (buckets by order, starts, ends, owners, letters) for runs of texts of bounded length."""
    parts, owner, counted = _split(texts)
    for a, b in pieces(parts, CHUNK):
        grams, starts, is_letter = ngrams(parts[a:b])
        yield grams, starts, starts + np.array(counted[a:b]), np.array(owner[a:b]), is_letter


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (buckets + 1, languages); the last row is the log prior.

    Counts cover every row with a non-null lang. Executors sum them by task and Spark by (lang, bucket), so the
    driver gets one number for each language and bucket, whatever the rows.
    """
    small_batches(labelled.sparkSession)
    schema = "lang string, bucket int, n long"
    arrow = arrow_schema(schema)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), [x or "" for x in batch.column(0).to_pylist()]
            for k in set(langs):
                s = sums.setdefault(k, np.zeros((1 << BITS) + 1, np.int64))
                own = [t for t, x in zip(texts, langs) if x == k]
                s[-1] += len(own)
                for grams, starts, ends, _, _ in features(own):
                    inside = np.zeros(len(grams[0]) + 1, np.int8)
                    inside[starts] += 1
                    inside[ends] -= 1
                    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
                    for g in grams:
                        s[:-1] += np.bincount(g[inside], minlength=1 << BITS)
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield to_batch({"lang": [k] * len(at), "bucket": at.astype(np.int32), "n": s[at]}, arrow)

    rows = labelled.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros(((1 << BITS) + 1, len(langs)))
    index = {x: i for i, x in enumerate(langs)}
    counts[rows.column("bucket").to_numpy(), [index[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    logp = np.log(counts[:-1] + 0.5) - np.log(counts[:-1].sum(0) + 0.5 * (1 << BITS)) if langs else counts[:-1]
    prior = np.log(counts[-1:] + 1) - np.log((counts[-1] + 1).sum()) if langs else counts[-1:]
    return langs, np.concatenate([logp, prior]).astype(np.float32)


def score(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    texts = [t or "" for t in texts]
    total = np.zeros((len(texts), len(langs)))
    letter = np.zeros(len(texts), bool)
    total[:] = logp[-1]
    for grams, starts, ends, owner, is_letter in features(texts):
        edges = np.stack([starts, ends], 1).ravel()
        np.logical_or.at(letter, owner, np.logical_or.reduceat(np.append(is_letter, False), edges)[::2])
        for g in grams:
            part = np.zeros((len(g) + 1, len(langs)), np.float32)
            np.take(logp, g, axis=0, out=part[:-1])
            np.add.at(total, owner, np.add.reduceat(part, edges, axis=0)[::2])
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    p = np.exp(total - total.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [langs[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist())], np.where(letter, p[np.arange(len(p)), best], 0.0)


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: str = "doc_id") -> DataFrame:
    """`keep` columns of docs plus lang_pred and score (the posterior of lang_pred).

    lang_pred is a learned language, or `und` with score 0 where the text is null, has no letter, or nothing was
    learned. Every text is read whole; very long ones in overlapping parts. The model has a fixed number of
    buckets for each language, so its broadcast doesn't grow with the data.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((langs, logp))
    names = [x.strip() for x in keep.split(",")]
    base = docs.select(*names, F.col("text").alias("_text"))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def each(b: pa.RecordBatch) -> dict:
        pred, p = score(b.column(len(names)).to_pylist(), *model.value)
        return {x: b.column(i) for i, x in enumerate(names)} | {"lang_pred": pred, "score": p}

    return map_arrow(base, each, schema)
