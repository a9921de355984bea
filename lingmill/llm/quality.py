"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, small_batches, to_batch, utf8

N_STATS = 20
D_FOURIER, RIDGE, SEED, BINS = 256, 1e-3, 7, 2000
_CLASSES = np.zeros((256, 8))
for _c in range(256):
    _x = chr(_c)
    _CLASSES[_c, 0 if _c >= 128 else 1 if _x.islower() else 2 if _x.isupper() else 3 if _x.isdigit() else 4 if _x in " \t\r\v\f" else 5 if _x == "\n" else 6 if _x in ".,;:'\"-!?()" else 7] = 1


def statistics(text: bytes) -> list[float]:
    """N_STATS numbers about the whole text; an empty text gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    hist = np.zeros(256)
    for a in range(0, n, 1 << 22):
        hist += np.bincount(np.frombuffer(text, np.uint8, min(1 << 22, n - a), a), minlength=256)
    share = (hist @ _CLASSES / n).tolist()
    p = hist[hist > 0] / n
    words = text.split()
    k = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    return share + [
        np.log1p(n), np.log1p(len(words)), (n - hist[32]) / k, len(seen) / k, max(seen.values(), default=0) / k, sum(map(eq, words, words[1:])) / k,
        np.log1p(len(lines)), len(set(lines)) / m, n / m / 1000, float(-(p * np.log2(p)).sum()), sum(1 for x in seen if len(x) > 20) / k, hist[33] / k,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats array<float>, one row per row of docs; null text counts as empty."""
    small_batches(docs.sparkSession)
    return map_arrow(docs.select("doc_id", "text"), lambda b: {"doc_id": b.column(0), "stats": [statistics(t) for t in utf8(b.column(1))]}, "doc_id long, stats array<float>")


def fourier(stats: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """cos features of a Gaussian kernel whose width is the square root of the number of statistics; a constant comes last."""
    rng = np.random.default_rng(SEED)
    w, b = rng.standard_normal((N_STATS, D_FOURIER)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, D_FOURIER)
    x = np.clip((stats - mean) / std, -8, 8)
    return np.concatenate([np.sqrt(2 / D_FOURIER) * np.cos(x @ w + b), np.ones((len(x), 1))], 1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to sums y of n rows each (n > 0)."""
    blocks: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist()):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    return np.concatenate([np.full(int(c), a / b) for a, b, c in blocks]) if blocks else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(labelled: DataFrame) -> dict:
    """Model from labelled(stats, y): all rows are used. Sums of the normal equations are made by partition, then by 16 tasks.

    With no labelled rows the model says 0.5 for every text.
    """
    d = D_FOURIER + 1
    moments = labelled.select(*(f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("a", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([moments[f"a{i}"] or 0.0 for i in range(N_STATS)])
    std = np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(N_STATS)])
    arrow = arrow_schema("part int, sums binary")

    def equations(batches):
        s = np.zeros((d, d + 1))
        for b in batches:
            if b.num_rows:
                z = fourier(_matrix(b.column(0)), mean, std)
                s += z.T @ np.concatenate([z, b.column(1).to_numpy(zero_copy_only=False)[:, None].astype(float)], 1)
        if s[-1, -2]:
            yield to_batch({"part": [TaskContext.get().partitionId() % 16], "sums": [s.tobytes()]}, arrow)

    def add(batches):
        s = np.zeros(d * (d + 1))
        for b in batches:
            for x in b.column(1).to_pylist():
                s += np.frombuffer(x)
        if s.any():
            yield to_batch({"part": [0], "sums": [s.tobytes()]}, arrow)

    found = labelled.select("stats", "y").mapInArrow(equations, "part int, sums binary").repartition(16, "part").mapInArrow(add, "part int, sums binary").collect()
    s = sum((np.frombuffer(r.sums) for r in found), np.zeros(d * (d + 1))).reshape(d, d + 1)
    n = s[-1, -2]
    weights = np.linalg.solve(s[:, :-1] + RIDGE * max(n, 1) * np.diag([*[1.0] * D_FOURIER, 1e-9 if n else 1.0]), s[:, -1])
    model = {"mean": mean, "std": std, "weights": weights, "x": np.array([0.0]), "p": np.array([0.5])}
    if n:
        raw = map_arrow(labelled.select("stats", "y"), lambda b: {"bin": bin_of(_matrix(b.column(0)), model), "y": b.column(1)}, "bin int, y double")
        bins = sorted(tuple(r) for r in raw.groupBy("bin").agg(F.sum("y").alias("y"), F.count("y").alias("n")).collect())
        k, y, c = (np.array(v, float) for v in zip(*bins))
        model |= {"x": k, "p": isotonic(y, c)}
    return model


def bin_of(stats: np.ndarray, model: dict) -> np.ndarray:
    """Ridge scores from -0.5 to 1.5 in BINS steps; the bins bound what calibration sends to the driver."""
    return np.clip((fourier(stats, model["mean"], model["std"]) @ model["weights"] + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)


def scores(stats: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated scores; a thousandth of the raw score keeps the order inside a level of the isotonic fit."""
    k = bin_of(stats, model)
    return 0.999 * np.interp(k, model["x"], model["p"]) + 0.001 * k / BINS


def score_quality(docs: DataFrame, labels: DataFrame, learn: F.Column, cut: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs, learnt from labels(doc_id, quality) of the rows where `learn` holds.

    Null or empty texts have statistics of zero and get a score too. Labels that are null or of unknown
    documents teach nothing; a document with several labels teaches each. Rows that repeat a doc_id are scored
    one by one. Empty tables give empty results.
    """
    from .common import table

    stats = table(document_statistics(docs), "stats")
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    model = fit(table(stats.where(learn).join(known, F.col("doc_id") == F.col("_id")).select("stats", "y"), "labelled"))

    def each(b: pa.RecordBatch) -> dict:
        p = scores(_matrix(b.column(1)), model)
        return {"doc_id": b.column(0), "score": p, "predicted": (p >= cut).astype(np.int32)}

    return map_arrow(stats, each, "doc_id long, score double, predicted int")
