"""Answer metrics: chrF from summable counts, ROUGE-L, exact match, token F1, combined score, pluggable scorers."""

from __future__ import annotations

import string
import unicodedata
from collections import Counter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS, BETA2 = 6, 4
#: Sufficient statistics of chrF: for each order the n-grams of hypothesis and reference, and those they share.
STATS = [f"{k}{n}" for n in range(1, ORDERS + 1) for k in ("h", "r", "m")]
_PUNCTUATION = set(string.punctuation)


def chrf_counts(hyp: str, ref: str) -> list[int]:
    """For each order the n-grams of both sides and the sum of the lesser counts of each: n-grams are numbers, sorted once a side."""
    h, r = "".join(hyp.split()), "".join(ref.split())
    points = np.frombuffer((h + r).encode("utf-32-le", "surrogatepass"), "<u4")
    letters, codes = np.unique(points, return_inverse=True)
    bits, codes = max(len(letters) - 1, 1).bit_length(), codes.astype(np.int64)
    a, b, out = codes[: len(h)], codes[len(h) :], []
    wide = bits * ORDERS > 62  # over a thousand letters: pairs of an n-gram's number and a letter are numbered anew
    x, y = a, b
    for n in range(1, ORDERS + 1):
        if n > 1:
            x, y = (v[:-1] << bits | c[n - 1 :] if len(v) else v for v, c in ((x, a), (y, b)))
            if wide and len(x) + len(y):
                both = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
                x, y = both[: len(x)], both[len(x) :]
        (p, i), (q, j) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        at = np.searchsorted(q, p)
        at[at == len(q)] = 0
        same = (q[at] == p if len(q) else np.zeros(len(p), bool))
        out += [len(x), len(y), int(np.minimum(i[same], j[at[same]]).sum())]
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def chrf_stats(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """18 counts a row; sums over rows give the corpus score. Null counts as empty."""
    return pd.Series([chrf_counts(h or "", r or "") for h, r in zip(hyp, ref)])


def ngram_rows(df: DataFrame, key: str, c: Column, name: str, n: int) -> DataFrame:
    """(key, gram, name): n-grams of a text without white space, as rows; the set form of chrf_stats for any length of text."""
    rows = df.select(F.col(key), F.regexp_replace(c, r"(?U)\s", "").alias("_t")).where(F.length("_t") >= n)
    grams = rows.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("_t") - (n - 1)), lambda i: F.substring(F.col("_t"), i, F.lit(n)))).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias(name))


def chrf_score(stats: list[Column]) -> Column:
    """Score of 0 to 100 from 18 summed counts: precision and recall averaged over the orders that both sides have, F with beta 2."""
    used = [(stats[3 * i] > 0) & (stats[3 * i + 1] > 0) for i in range(ORDERS)]
    n = sum((u.cast("int") for u in used[1:]), used[0].cast("int"))
    p = sum((F.when(used[i], stats[3 * i + 2] / stats[3 * i]).otherwise(0.0) for i in range(1, ORDERS)), F.when(used[0], stats[2] / stats[0]).otherwise(0.0)) / n
    r = sum((F.when(used[i], stats[3 * i + 2] / stats[3 * i + 1]).otherwise(0.0) for i in range(1, ORDERS)), F.when(used[0], stats[2] / stats[1]).otherwise(0.0)) / n
    return F.when((n == 0) | (p + r == 0), 0.0).otherwise(100 * (1 + BETA2) * p * r / (BETA2 * p + r))


def chrf_of(stats: Column) -> Column:
    return chrf_score([stats[i] for i in range(3 * ORDERS)])


def corpus_chrf(df: DataFrame, by: list[str], stats: str = "stats") -> DataFrame:
    """Pooled score of each group: 18 partial sums, then one formula."""
    sums = df.groupBy(*by).agg(*(F.sum(F.col(stats)[i]).alias(s) for i, s in enumerate(STATS)))
    return sums.select(*by, chrf_score([F.col(s) for s in STATS]).alias("chrf"))


def normal_tokens(text: str) -> list[str]:
    """NFKC, case folded, punctuation to spaces, split."""
    x = unicodedata.normalize("NFKC", text).casefold()
    return "".join(" " if c in _PUNCTUATION or unicodedata.category(c)[0] == "P" else c for c in x).split()


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalise(text: pd.Series) -> pd.Series:
    return pd.Series([normal_tokens(t or "") for t in text])


def simple_tokens(c: Column) -> Column:
    """normalise() for plain text, in the JVM: lower case, ASCII and Unicode punctuation to spaces."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[\p{P}$+<=>^`|~]", " "), r"\s+"), lambda w: w != "")


def token_f1(a: Column, b: Column) -> Column:
    """Multiset overlap of two token arrays, 0 to 100; both empty: 100, one: 0."""
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 100.0).when(same == 0, 0.0).otherwise(200.0 * same / (F.size(a) + F.size(b)))


def exact_match(a: Column, b: Column) -> Column:
    return F.when(a == b, 100.0).otherwise(0.0)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number (Hyyrö, 2004)."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        same = row & at.get(y, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """F of the longest common subsequence of runs of a-z and 0-9 in lower case, 0 to 100; other scripts have none."""
    import re

    out = []
    for h, r in zip(hyp, ref):
        a, b = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (h, r))
        n = lcs(a, b)
        out.append(200.0 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def combined(chrf: Column, semantic: Column, rouge: Column) -> Column:
    return (chrf + semantic + rouge) / 3


def open_ended(oeg: Column, aya: Column) -> Column:
    """Weighted aggregate of the two open-ended sources."""
    return 0.87 * oeg + 0.13 * aya


class Scorer(Protocol):
    """A model's similarity of answers and references, 0 to 100; an empty answer scores 0."""

    def __call__(self, hyp: pd.Series, ref: pd.Series) -> pd.Series: ...


def hashed_cosine(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """The offline Scorer: cosine of token counts."""
    out = []
    for h, r in zip(hyp, ref):
        a, b = Counter(normal_tokens(h or "")), Counter(normal_tokens(r or ""))
        dot = sum(a[w] * b[w] for w in a)
        out.append(100.0 * dot / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5 if dot else 0.0)
    return pd.Series(out, dtype="float64")


def semantic(hyp: Column, ref: Column, scorer: Scorer = hashed_cosine) -> Column:
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        return scorer(h, r)

    return F.pandas_udf(score, T.DoubleType())(hyp, ref)
