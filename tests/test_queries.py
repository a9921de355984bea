"""Every registered base query against its SQL in DuckDB, on the smallest tables."""

import hashlib
import math
import os
import random

import numpy as np
import pytest

import __spark_entry__
from lingmill.functions.metrics import lcs
from lingmill.operators import relational as R
from lingmill.plans.queries import QUERIES, SQL

#: Interpolated values that lie between two rounded ones may go to either side: how far apart these are.
ROUNDED = {"score_quantiles": 0.1001}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        got, right = rows(df.columns, found), rows(want.columns, want.fetchall())
        if name in ROUNDED:
            assert len(got) == len(right) and all(a == b or abs(float(a) - float(b)) <= ROUNDED[name] for x, y in zip(got, right) for a, b in zip(x, y))
        else:
            assert got == right
    else:
        assert found


def test_contract(spark):
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns


def test_rouge_of_whole_texts(spark, tmp_path):
    gold = " ".join(f"w{i}" for i in range(300))
    other = " ".join(gold.split()[:100] + [f"v{i}" for i in range(200)])
    spark.createDataFrame([(1, 0, "user", gold), (1, 1, "assistant", other)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    [row] = QUERIES["rouge_and_semantic"](spark, str(tmp_path)).collect()
    assert row.rouge_l == pytest.approx(100 / 3, abs=1e-4) and row.semantic == pytest.approx(100 / 3, abs=1e-4)


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        assert lcs(a, b) == row[-1]


def test_bootstrap_draws(spark, tmp_path):
    """10,000 draws, by brute force."""
    rows = [(i, i % 3 % 2, i % 4 % 2) for i in range(7)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    [got] = QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()
    poisson = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 65536 for k in range(8)]

    def mean(draw):
        h = [hashlib.md5(f"42:{i}:{draw // 8}".encode()).hexdigest()[4 * (draw % 8) :][:4] for i, _, _ in rows]
        w = [sum(int(x, 16) >= round(t) for t in poisson) for x in h]
        return sum(x * (r[1] - r[2]) for x, r in zip(w, rows)) / sum(w) if sum(w) else None

    means = [m for m in map(mean, range(10_000)) if m is not None]
    assert got.p == pytest.approx(min(1, 2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / len(means)), abs=1e-6)
    assert got.low == pytest.approx(np.quantile(means, 0.025), abs=1e-6) and got.high == pytest.approx(np.quantile(means, 0.975), abs=1e-6)


def test_anchors_of_first_rows(spark, tmp_path):
    """Only the texts of a language's first rows leave their tasks; before, all of them met in one."""
    rows = [(i, "1" if i in (9, 91) else "x", "a" if i < 90 else "b") for i in range(6, 200)] + [(300, "1", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["aligned_anchors"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("a", 7, 1, True), ("b", 7, 1, False)}
    plan = got._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "LeftSemi" in plan


@pytest.mark.parametrize("name", ["augment_budgets", "dimension_fallback"])
def test_dimensions_move_no_rows(spark, tmp_path, name):
    """Rows stay in their tasks; a join of them by language put a language in one."""
    rows = [(i, "w " * (15 + i), lang) for i, lang in enumerate(["en", "de", "fr", "xx", None] * 20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert got.count() == (40 if name == "augment_budgets" else 100)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_shot_by_brute_force(spark):
    """Copies of the row's own text, empty and missing texts, missing groups, a pool of other rows."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["s1", "s2", "s3", None]), rng.choice(["a", "b", None]), rng.choice(["", None, *(f"t{j}" for j in range(14))])) for i in range(80)]
    pool = [(rng.choice(["s1", "s2", None]), rng.choice(["a", "b"]), rng.choice(["", None, *(f"t{j}" for j in range(14))])) for _ in range(60)]
    rank = lambda t: (hashlib.md5(f"42:{t or ''}".encode()).hexdigest(), t is None)
    for tiers in ([(0, 1), (0,), ()], [(0, 1), (1,)], [()]):
        want = {}
        for i, *group, text in rows:
            for n, tier in enumerate(tiers, 1):
                heads = sorted({p[2] for p in pool if all(p[c] == group[c] and p[c] is not None for c in tier)}, key=rank)[:4]
                shots = [t for t in heads if t is not None and text is not None and t != text]
                if len(shots) >= 3 and i not in want:
                    want[i] = (n, shots[:3])
        frames = spark.createDataFrame(rows, "id int, source string, lang string, text string"), spark.createDataFrame(pool, "source string, lang string, text string")
        got = R.few_shot(*frames, "id", [[("source", "lang")[c] for c in t] for t in tiers], 3, "text").collect()
        assert {r.id: (r.tier, r.shots) for r in got} == want and len(got) == len(want) > 0


def test_few_shot_moves_texts_once(spark, tmp_path):
    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    rng = random.Random(4)
    rows = [(i, f"s{i % 5}", "ab"[i % 2], rng.randbytes(2000).hex()) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled()
    assert QUERIES["fewshot_tiers"](spark, str(tmp_path)).where("length(shots) = 12002").count() == 2000
    assert shuffled() - before < 1.5 * 2000 * 4000
