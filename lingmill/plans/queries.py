"""Queries over the driver's tables, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import budget as B
from ..functions import lid as L
from ..functions import metrics as M
from ..functions import text as X
from ..functions.hashing import digest, ordinal, shard, side, top_per_group, uniform
from ..operators import chat, policy
from ..operators import relational as R
from . import dataset as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


#: SQL for the digest and the uniform number of functions.hashing, with the default seed.
def _digest(*parts: str, seed: str = "42") -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'coalesce(({p})::VARCHAR, {chr(39)*2})' for p in parts)}))"


def _uniform(*parts: str, seed: str = "42") -> str:
    return f"(('0x' || substr({_digest(*parts, seed=seed)}, 1, 8))::BIGINT / 4294967296.0)"


STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_strip = STRIP.format
_words = r"list_filter(regexp_split_to_array({}, '[\s\p{{Z}}]+'), lambda w: w <> '')".format
GROUP = f"substr(md5({_strip('text')}), 1, 16)"
SIDE = f"CASE WHEN md5({GROUP}) < '33333333333334' THEN 'dev' ELSE 'train' END"


# --- splits and sampling


def _split(spark: SparkSession, d: str) -> DataFrame:
    return D.split_by_group(docs(spark, d).select("doc_id", "text", "source", "lang"), X.digest16(X.strip(F.col("text"))))


@query(f"SELECT source, lang, count(*) FILTER (s = 'dev') AS dev, count(*) FILTER (s = 'train') AS train FROM (SELECT *, {SIDE} AS s FROM documents) GROUP BY source, lang")
def item_split_report(spark, d):
    return D.side_counts(_split(spark, d), "source", "lang")


@query(f"SELECT count(*) AS n_groups, count(*) FILTER (sides > 1) AS leaks FROM (SELECT {GROUP} AS g, count(DISTINCT {SIDE}) AS sides FROM documents GROUP BY g)")
def leak_check(spark, d):
    rows = _split(spark, d).groupBy("item_group").agg(F.countDistinct("_side").alias("sides"))
    return rows.agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(F.col("sides") > 1, 1)).alias("leaks"))


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_digest('doc_id')}, doc_id) <= 5")
def stratified_quota(spark, d):
    return top_per_group(docs(spark, d).select("doc_id", "source"), ["source"], 5, digest("doc_id"), F.col("doc_id"))


@query(f"SELECT source, lang FROM (SELECT DISTINCT source, lang FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_digest('source', 'lang')}, lang) <= 2")
def k_of_n_langs(spark, d):
    return top_per_group(docs(spark, d).select("source", "lang").distinct(), ["source"], 2, digest("source", "lang"), F.col("lang"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE o >= n * 1 // 3 AND o < n * 2 // 3")
def shard_2_of_3(spark, d):
    return shard(docs(spark, d).select("doc_id"), 2, 3, F.floor(F.col("doc_id") / 1024), F.col("doc_id"))


@query(f"SELECT doc_id FROM documents WHERE {_uniform('doc_id')} < 0.3")
def bernoulli_fraction(spark, d):
    return docs(spark, d).where(uniform("doc_id") < 0.3).select("doc_id")


@query(f"""WITH m AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
c AS (SELECT a.lang AS own, b.lang, sum(b.n) OVER (PARTITION BY a.lang ORDER BY b.lang) AS hi, b.n, sum(b.n) OVER (PARTITION BY a.lang) AS total FROM m a JOIN m b ON a.lang <> b.lang)
SELECT d.doc_id, d.lang, c.lang AS chosen FROM documents d JOIN c ON d.lang = c.own AND {_uniform('d.doc_id')} * total >= hi - n AND {_uniform('d.doc_id')} * total < hi""")
def weighted_choice(spark, d):
    rows = docs(spark, d).select("doc_id", "lang")
    m = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    other = m.select(F.col("lang").alias("own"), F.lit(1).alias("one")).join(m.select(F.col("lang").alias("chosen"), "n", F.lit(1).alias("one")), "one").where("own != chosen")
    w = W.partitionBy("own")
    c = other.select("own", "chosen", "n", F.sum("n").over(w.orderBy("chosen")).alias("hi"), F.sum("n").over(w).alias("total"))
    u = uniform("doc_id") * F.col("total")
    return rows.join(c, (F.col("lang") == F.col("own")) & (u >= F.col("hi") - F.col("n")) & (u < F.col("hi"))).select("doc_id", "lang", "chosen")


@query(f"SELECT source FROM (SELECT source, row_number() OVER (ORDER BY {_digest('source')}, source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) WHERE r <= round_even(n * 0.2, 0)::INT")
def draw_dev_groups(spark, d):
    return D.draw_groups(docs(spark, d), "source")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_digest('doc_id')}, doc_id) - 1 AS qa_idx FROM documents")
def shuffled_key(spark, d):
    rows = docs(spark, d).select("doc_id").withColumn("h", digest("doc_id"))
    return ordinal(rows, F.substring("h", 1, 3), F.col("h"), F.col("doc_id"), name="qa_idx").select("doc_id", "qa_idx")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents) SELECT lang, (i // 32)::BIGINT AS chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM r GROUP BY lang, i // 32")
def fixed_chunks(spark, d):
    rows = ordinal(docs(spark, d).select("doc_id", "lang"), F.struct("lang", F.floor(F.col("doc_id") / 1024)), F.col("doc_id"), name="o")
    first = rows.groupBy(F.col("lang").alias("l")).agg(F.min("o").alias("base"))
    return rows.join(first, F.col("lang") == F.col("l")).groupBy("lang", F.floor((F.col("o") - F.col("base")) / 32).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN len({_words('text')}) BETWEEN 80 AND 250 THEN 0 ELSE 1 END, {_digest('doc_id')}, doc_id) <= 10")
def band_quota(spark, d):
    inside = F.size(X.words(F.col("text"))).between(80, 250)
    return top_per_group(docs(spark, d), ["source"], 10, F.when(inside, 0).otherwise(1), digest("doc_id"), F.col("doc_id")).select("doc_id", "source")


# --- duplicates, collisions, joins


@query("SELECT md5(text) AS h, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY CASE WHEN contains(source, 'src1') THEN 0 ELSE 1 END, source, doc_id) = 1")
def pref_dedupe(spark, d):
    rows = docs(spark, d).select(F.md5(F.col("text").cast("binary")).alias("h"), "doc_id", "source")
    return R.prefer(rows, ["h"], "source", "src1", F.col("source"), F.col("doc_id")).select("h", "doc_id")


@query("SELECT md5(text) AS h, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY h HAVING count(*) > 1")
def collision_report(spark, d):
    return R.collisions(docs(spark, d).select(F.md5(F.col("text").cast("binary")).alias("h"), "source"), ["h"], "source")


@query("SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY h")
def keep_first(spark, d):
    return R.keep_first(docs(spark, d).select(F.md5(F.col("text").cast("binary")).alias("h"), "doc_id"), ["h"], F.col("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark, d):
    return R.resume(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_filter(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT source FROM documents EXCEPT SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def except_sources(spark, d):
    toxic = docs(spark, d).join(table(spark, d, "labels").where("toxic = 1"), "doc_id")
    return docs(spark, d).select("source").subtract(toxic.select("source"))


@query("WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'de'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'es') (SELECT source, 'a' AS only_in FROM a WHERE source NOT IN (SELECT source FROM b)) UNION ALL (SELECT source, 'b' FROM b WHERE source NOT IN (SELECT source FROM a))")
def symmetric_difference(spark, d):
    a, b = (docs(spark, d).where(F.col("lang") == x).select("source").distinct() for x in ("de", "es"))
    return a.join(b, "source", "left_anti").withColumn("only_in", F.lit("a")).unionByName(b.join(a, "source", "left_anti").withColumn("only_in", F.lit("b")))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'")
def inner_on_id(spark, d):
    return docs(spark, d).where("lang = 'en'").select("doc_id").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French (bare)' ELSE lang END AS name FROM documents")
def dimension_fallback(spark, d):
    full = spark.createDataFrame([("en", "English"), ("de", "German")], "k string, v string")
    bare = spark.createDataFrame([("de", "German (bare)"), ("fr", "French (bare)")], "k string, v string")
    return R.lookup(docs(spark, d).select("doc_id", "lang"), "lang", full, bare, name="name").select("doc_id", "name")


@query(f"""WITH s AS (SELECT DISTINCT source, right(source, 1) AS side FROM documents)
SELECT source AS item, other FROM (SELECT source, coalesce(lead(source) OVER w, first_value(source) OVER w) AS other FROM s WINDOW w AS (PARTITION BY side ORDER BY {_digest('source')}, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE other <> source""")
def other_passage(spark, d):
    s = docs(spark, d).select("source", F.right("source", F.lit(1)).alias("side")).distinct()
    return R.other_item(s, "side", "source").select(F.col("source").alias("item"), "other")


@query("WITH p AS (SELECT DISTINCT source, length(source) AS n FROM documents), q(part, c) AS (VALUES ('SRC1', 1), ('src2', 2)) SELECT source, part, c FROM p JOIN q ON contains(lower(source), lower(part))")
def theta_policy_join(spark, d):
    q = spark.createDataFrame([("SRC1", 1), ("src2", 2)], "part string, c int")
    return docs(spark, d).select("source").distinct().join(F.broadcast(q), F.contains(F.lower("source"), F.lower("part"))).select("source", "part", "c")


_TIERS = [["source", "lang"], ["source"], []]


def _fewshot_sql(k: int = 3) -> str:
    parts = []
    for n, t in enumerate(_TIERS, 1):
        cols = "".join(f"{c}, " for c in t)
        part = f"PARTITION BY {', '.join(t)} " if t else ""
        on = " AND ".join(f"r.{c} = h.{c}" for c in t) or "true"
        parts.append(f"SELECT r.doc_id, {n} AS tier, array_to_string(list(h.text ORDER BY h.rn)[1:{k}], '|') AS shots FROM r JOIN (SELECT *, row_number() OVER ({part}ORDER BY {_digest('text')}, text) AS rn FROM (SELECT DISTINCT {cols}text FROM p) QUALIFY rn <= {k + 1}) h ON {on} AND h.text <> r.text GROUP BY r.doc_id HAVING count(*) >= {k}")
    return f"WITH p AS (SELECT source, lang, text FROM documents), r AS (SELECT doc_id, source, lang, text FROM documents), u AS ({' UNION ALL '.join(parts)}) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier) = 1"


@query(_fewshot_sql())
def fewshot_tiers(spark, d):
    rows = docs(spark, d).select("doc_id", "source", "lang", "text")
    out = R.few_shot(rows, rows, "doc_id", _TIERS, 3, "text")
    return out.select("doc_id", "tier", F.array_join("shots", "|").alias("shots"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || source AS a, 't' || md5(text) AS b FROM documents), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT a AS node, a AS root FROM n UNION SELECT w.node, n.b FROM w JOIN n ON w.root = n.a) SELECT node, min(root) AS root FROM w GROUP BY node""")
def connected_components(spark, d):
    rows = docs(spark, d)
    return R.components(rows.select(F.concat(F.lit("s"), "source").alias("a"), F.concat(F.lit("t"), F.md5(F.col("text").cast("binary"))).alias("b")))


# --- gates, quantiles, reports

_SCORED = "SELECT doc_id, source, lang, text AS answer, left(text, 20) AS gold, ((n_chars * 37) % 101)::DOUBLE AS chrf, ((doc_id * 53) % 101)::DOUBLE AS semantic FROM documents"
_PASSED = f"SELECT *, CASE WHEN contains(lower(source), 'src7') THEN false WHEN contains(lower(source), 'src1') THEN chrf >= 80 OR semantic >= 90 ELSE chrf >= 30 OR semantic >= 70 END AND trim(coalesce(answer, '')) <> '' AS passed, CASE WHEN contains(lower(source), 'src7') THEN 'gold-only' WHEN contains(lower(source), 'src1') THEN 'src1=80,90' ELSE 'global' END AS policy FROM ({_SCORED})"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "source", "lang", F.col("text").alias("answer"), F.left("text", F.lit(20)).alias("gold"), ((F.col("n_chars") * 37) % 101).cast("double").alias("chrf"), ((F.col("doc_id") * 53) % 101).cast("double").alias("semantic"))


def _passed(spark: SparkSession, d: str) -> DataFrame:
    return policy.policy(_scored(spark, d), 30, 70, [("SRC1", 80, 90)], ["src7"]).withColumn("policy", F.regexp_replace("policy", "^SRC1", "src1"))


@query(f"SELECT doc_id, passed, policy FROM ({_PASSED})")
def policy_gate(spark, d):
    return _passed(spark, d).select("doc_id", "passed", "policy")


@query(f"SELECT source, count(*) AS n, round(avg(passed::INT), 6) AS rate, array_to_string(list_sort(list(DISTINCT policy)), ',') AS policies FROM ({_PASSED}) GROUP BY source")
def pass_rates(spark, d):
    return policy.pass_rates(_passed(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"SELECT c, b, round(avg((chrf >= c OR semantic >= b)::INT), 6) AS kept FROM ({_SCORED}), (VALUES (20.0::DOUBLE), (30), (40), (50), (60)) x(c), (VALUES (50.0::DOUBLE), (60), (70), (80), (90)) y(b) GROUP BY c, b")
def threshold_grid(spark, d):
    return policy.threshold_grid(_scored(spark, d), "chrf", "semantic", [20, 30, 40, 50, 60], [50, 60, 70, 80, 90]).withColumn("kept", F.round("kept", 6))


@query(f"SELECT source, {', '.join(f'round(quantile_cont(chrf, {q}), 1) AS p{int(q * 100)}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM ({_SCORED}) GROUP BY GROUPING SETS ((), (source))")
def score_quantiles(spark, d):
    return policy.quantiles(_scored(spark, d), ["source"], "chrf")


@query(f"SELECT doc_id, CASE WHEN passed THEN answer ELSE gold END AS output, CASE WHEN passed THEN 'teacher' ELSE 'gold' END AS origin FROM ({_PASSED})")
def mix_replace(spark, d):
    return policy.mix(_passed(spark, d), "replace").select("doc_id", "output", "origin")


@query(f"SELECT origin, count(*) AS n FROM (SELECT 'gold' AS origin FROM ({_PASSED}) UNION ALL SELECT 'teacher' FROM ({_PASSED}) WHERE passed) GROUP BY origin")
def mix_both(spark, d):
    return policy.mix(_passed(spark, d), "both").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, answer AS output FROM ({_PASSED}) WHERE passed")
def mix_teacher(spark, d):
    return policy.mix(_passed(spark, d), "teacher").select("doc_id", "output")


@query(f"SELECT source, lang, count(*) AS n, round(avg(chrf), 6) AS chrf, round(avg(semantic), 6) AS semantic, round(avg((chrf + semantic + 50) / 3), 6) AS combined FROM ({_SCORED}) GROUP BY GROUPING SETS ((), (source), (lang))")
def combined_grouping_sets(spark, d):
    rows = _scored(spark, d).withColumn("combined", M.combined(F.col("chrf"), F.col("semantic"), F.lit(50)))
    return policy.report(rows, "source", "lang", "chrf", "semantic", "combined").select("source", "lang", "n", *(F.round(c, 6).alias(c) for c in ("chrf", "semantic", "combined")))


@query("SELECT lang, list_sort(list(n))[len(list(n)) // 2 + 1] AS upper_median, list_sort(list(n))[len(list(n)) // 10 + 1] AS p10, list_sort(list(n))[9 * len(list(n)) // 10 + 1] AS p90 FROM (SELECT lang, n_chars AS n FROM documents) GROUP BY lang")
def positional_quantiles(spark, d):
    w = W.partitionBy("lang")
    rows = docs(spark, d).groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))  # one row a value: no list of all rows
    rows = rows.withColumn("upto", F.sum("c").over(w.orderBy("n_chars"))).withColumn("all", F.sum("c").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("n_chars")))
    return rows.groupBy("lang").agg(at(F.floor(F.col("all") / 2)).alias("upper_median"), at(F.floor(F.col("all") / 10)).alias("p10"), at(F.floor(F.col("all") * 9 / 10)).alias("p90"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_counts(spark, d):
    return docs(spark, d).rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority LIKE '5%') AS low FROM orders GROUP BY o_orderstatus")
def pivot_counts(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderpriority").startswith("5"), "low").otherwise("other").alias("p"))
    return rows.groupBy("o_orderstatus").pivot("p", ["urgent", "low"]).count().na.fill(0)


@query("SELECT lang, max_by(source, struct_pack(n := n, s := source)) AS source, max(n) AS n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang")
def mode_per_lang(spark, d):
    c = docs(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang").agg(F.max_by("source", F.struct("n", "source")).alias("source"), F.max("n").alias("n"))


@query("SELECT source, round(100 * avg((n_chars > 2000)::INT), 6) AS share FROM documents GROUP BY source ORDER BY share DESC, source LIMIT 6")
def worst_sources(spark, d):
    return docs(spark, d).groupBy("source").agg(F.round(100 * F.avg((F.col("n_chars") > 2000).cast("int")), 6).alias("share")).orderBy(F.desc("share"), "source").limit(6)


@query("SELECT source, doc_id, left(text, 160) AS preview, right(text, 120) AS ending FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def first_per_source(spark, d):
    rows = docs(spark, d).select("source", "doc_id", X.preview(F.col("text")).alias("preview"), X.tail_of(F.col("text")).alias("ending"))
    return R.keep_first(rows, ["source"], F.col("doc_id"))


@query("SELECT h, doc_id, n_chars FROM (SELECT md5(text) AS h, doc_id, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1")
def argmin_per_target(spark, d):
    rows = docs(spark, d).select(F.md5(F.col("text").cast("binary")).alias("h"), "doc_id", "n_chars")
    return D.best_per_target(rows, "h", F.col("n_chars"), F.col("doc_id"))


@query(f"SELECT coalesce(CASE WHEN len({_words('text')}) < 5 THEN 'too short' WHEN lang <> 'en' THEN 'other language' WHEN n_chars > 5000 THEN 'too long' WHEN contains(text, '|') THEN 'table' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def reject_reasons(spark, d):
    t = F.col("text")
    rows = D.reasons(docs(spark, d), ("too short", F.size(X.words(t)) < 5), ("other language", F.col("lang") != "en"), ("too long", F.col("n_chars") > 5000), ("table", F.contains(t, F.lit("|"))))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages), m AS (SELECT host, min(url) AS a, max(url) AS b FROM p GROUP BY host) SELECT host, left(a, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i)))) AS prefix FROM m")
def lcp_by_key(spark, d):
    return R.prefix_by(table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url"), ["host"], "url")


@query("SELECT source, count(DISTINCT lang) AS n_values FROM documents GROUP BY source HAVING count(DISTINCT lang) <> 1")
def fd_check(spark, d):
    return R.determined(docs(spark, d), ["source"], "lang")


# --- text functions

_LETTERS = r"length(regexp_replace(text, '\P{L}', '', 'g'))"


@query(rf"SELECT doc_id, round(CASE WHEN {_LETTERS} = 0 THEN 1.0 ELSE length(regexp_replace(text, '\P{{Latin}}', '', 'g')) / {_LETTERS} END, 3) AS latin, round(CASE WHEN {_LETTERS} = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\x{{0600}}-\x{{06FF}}\x{{0900}}-\x{{097F}}\x{{0980}}-\x{{09FF}}\x{{0E00}}-\x{{0E7F}}\x{{0C00}}-\x{{0C7F}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}\x{{AC00}}-\x{{D7A3}}]', '', 'g')) / {_LETTERS} END, 3) AS non_latin FROM documents")
def script_share(spark, d):
    return docs(spark, d).select("doc_id", F.round(X.script_fraction(F.col("text"), "Latin"), 3).alias("latin"), F.round(X.non_latin_fraction(F.col("text")), 3).alias("non_latin"))


@query("SELECT lang, CASE WHEN length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) > 0 THEN 'latin' ELSE 'none' END AS script, count(*) AS n FROM documents GROUP BY ALL")
def script_majority(spark, d):
    return docs(spark, d).groupBy("lang", X.script_of(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT lang, text AS gold, lead(text) OVER (PARTITION BY lang, source ORDER BY doc_id) AS pred FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (length(pred) > 3 * length(gold) + 20) AS longer FROM p WHERE pred IS NOT NULL GROUP BY lang")
def length_mismatch(spark, d):
    p = docs(spark, d).select("lang", F.col("text").alias("gold"), F.lead("text").over(W.partitionBy("lang", "source").orderBy("doc_id")).alias("pred")).where("pred IS NOT NULL")
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(X.length_mismatch(F.col("gold"), F.col("pred")), 1)).alias("longer"))


_MARKS = X.BUCKET_MARKS


@query(f"WITH s AS (SELECT lang, {_strip('text')} AS t FROM documents), n AS (SELECT lang, length(t) - length(translate(t, '{_MARKS}', '')) - regexp_matches(t, '[{_MARKS}]$')::INT AS n FROM s) SELECT lang, CASE WHEN n <= 0 THEN 'one' WHEN n = 1 THEN 'two' ELSE 'many' END AS bucket, count(*) AS rows FROM n GROUP BY ALL")
def sentence_buckets(spark, d):
    return docs(spark, d).groupBy("lang", X.sentence_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


_T = X.TERMINATORS


@query(f"WITH s AS (SELECT doc_id, {_strip('text')} AS t FROM documents), n AS (SELECT *, length(t) - length(translate(t, '{_T}', '')) AS n FROM s) SELECT doc_id FROM n WHERE t <> '' AND (n = 0 OR (n = 1 AND regexp_matches(t, '[{_T}]$')))")
def one_sentence(spark, d):
    return docs(spark, d).where(X.one_sentence(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '(?s)[^{_T}]*[{_T}]|[^{_T}]+$'), lambda x: {_strip('x')}), lambda x: x <> '')) AS n_sentences FROM documents")
def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(r"SELECT doc_id, CASE WHEN lang = 'de' THEN length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) ELSE len(" + _words("text") + ")::BIGINT END AS n FROM documents")
def word_measure(spark, d):
    lang = F.when(F.col("lang") == "de", "jpn").otherwise(F.col("lang"))  # one language stands in for those that count characters
    return docs(spark, d).select("doc_id", B.measure(F.col("text"), lang).cast("long").alias("n"))


@query("SELECT substr(md5(substr(CASE WHEN contains(t, e'\\n\\n') THEN substr(t, instr(t, e'\\n\\n') + 2) ELSE t END, 1, 300)), 1, 16) AS key, doc_id FROM (SELECT doc_id, replace(text, e'.\\n', e'.\\n\\n') AS t FROM documents)")
def talk_key(spark, d):
    return docs(spark, d).select(X.talk_key(F.replace("text", F.lit(".\n"), F.lit(".\n\n"))).alias("key"), "doc_id")


@query(f"SELECT item_id, 'Lead:\\n\\n' || {_strip('text')} || '\\n\\nQuestion: ' || 'what?' || '\\n\\nOne sentence.' AS prompt, 4 AS n_sections FROM benchmark")
def wrap_context(spark, d):
    p = X.wrap_context(F.lit("Lead:"), F.col("text"), F.lit("Question: "), F.lit(" what? "), F.lit("One sentence."))
    return table(spark, d, "benchmark").select("item_id", p.alias("prompt"), F.size(X.sections(p)).alias("n_sections"))


_RAN = "replace(replace(text, ' the ', e' the\\nuser\\n'), ' und ', ' <think>und ')"


@query(rf"WITH r AS (SELECT doc_id, {_RAN} AS t FROM documents) SELECT doc_id, md5(CASE WHEN regexp_matches(t, e'\nuser\n|\nassistant\n|<think>') THEN regexp_replace(regexp_extract(t, e'(?s)\\A(.*?)(?:\nuser\n|\nassistant\n|<think>)', 1), '[\s\p{{Z}}]+$', '') ELSE t END) AS h FROM r")
def runaway_truncate(spark, d):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" the\nuser\n")), F.lit(" und "), F.lit(" <think>und "))
    return docs(spark, d).select("doc_id", F.md5(X.truncate_runaway(t).cast("binary")).alias("h"))


@query("SELECT count(*) AS n, count(*) FILTER (contains(html, '<br>')) AS with_br FROM pages")
def br_share(spark, d):
    return table(spark, d, "pages").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.contains("html", F.lit("<br>")), 1)).alias("with_br"))


@query(f"SELECT doc_id, max(c) AS times FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({_words('text')}) AS w FROM documents) GROUP BY doc_id, w) GROUP BY doc_id HAVING max(c) >= 4")
def degenerate_repetition(spark, d):
    w = docs(spark, d).select("doc_id", F.explode(X.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("c"))
    return w.groupBy("doc_id").agg(F.max("c").alias("times")).where("times >= 4")


_PAIRS = [("copula", "ist", "the"), ("article", "der|die|das", "a|an")]


@query(r"WITH t AS (SELECT doc_id, ' ' || text || ' ' AS t FROM documents), n AS (SELECT doc_id, regexp_matches(t, '(?:^|[,\s।])(?:ist)(?:[\s,।]|$)')::INT + regexp_matches(t, '(?:^|[,\s।])(?:der|die|das)(?:[\s,।]|$)')::INT AS a, regexp_matches(t, '(?:^|[,\s।])(?:the)(?:[\s,।]|$)')::INT + regexp_matches(t, '(?:^|[,\s।])(?:a|an)(?:[\s,।]|$)')::INT AS b FROM t) SELECT doc_id, CASE WHEN a > b THEN 'de' WHEN b > a THEN 'en' END AS lean FROM n")
def contrastive_lean(spark, d):
    return docs(spark, d).select("doc_id", X.lean(F.col("text"), _PAIRS, "de", "en").alias("lean"))


@query("SELECT doc_id, contains(text, 'not answerable') OR contains(text, 'the of') AS refused FROM documents")
def refusal_contains(spark, d):
    return docs(spark, d).select("doc_id", (F.contains("text", F.lit("not answerable")) | F.contains("text", F.lit("the of"))).alias("refused"))


@query("WITH c AS (SELECT lang, unnest(regexp_extract_all(text, '[0-9]')) AS g FROM documents) SELECT lang, max_by(g, struct_pack(n := n, g := g)) AS digit, sum(n)::BIGINT AS n FROM (SELECT lang, g, count(*) AS n FROM c GROUP BY lang, g) GROUP BY lang")
def digit_frequency(spark, d):
    c = docs(spark, d).select("lang", F.explode(F.regexp_extract_all("text", F.lit("[0-9]"), F.lit(0))).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang").agg(F.max_by("g", F.struct("n", "g")).alias("digit"), F.sum("n").alias("n"))


# --- budgets

_LO = "greatest(10, floor((n * 0.85::DOUBLE)::BIGINT / 10)::INT * 10)"
_NWORDS = f"(SELECT doc_id, lang, text, len({_words('text')})::INT AS n FROM documents)"
_BOUNDS = f"SELECT doc_id, n, greatest(10, (floor(floor(n * 0.85::DOUBLE) / 10) * 10)::INT) AS lo, greatest(greatest(10, (floor(floor(n * 0.85::DOUBLE) / 10) * 10)::INT) + 10, (ceil(floor(n * 1.15::DOUBLE) / 10) * 10)::INT) AS hi FROM {_NWORDS}"


@query(f"SELECT doc_id, n, lo, hi, greatest(10, (round_even(n / 10, 0) * 10)::INT) AS exact FROM ({_BOUNDS})")
def budget_bounds(spark, d):
    n = F.size(X.words(F.col("text")))
    b = B.bounds(n)
    return docs(spark, d).select("doc_id", n.alias("n"), b["lo"].alias("lo"), b["hi"].alias("hi"), B.clause_number(n).alias("exact"))


@query(f"SELECT doc_id, 'Bitte antworte mit ' || lo || '–' || hi || ' Wörtern.' AS range_clause, translate(lo::VARCHAR, '0123456789', '०१२३४५६७८९') AS deva FROM ({_BOUNDS})")
def budget_render(spark, d):
    b = B.bounds(F.size(X.words(F.col("text"))))
    rows = docs(spark, d).select("doc_id", b["lo"].alias("lo"), b["hi"].alias("hi"), F.lit("deu").alias("k")).join(F.broadcast(B.dimension(spark)), F.col("k") == F.col("lang"))
    return rows.select("doc_id", B.render(F.col("exact"), F.col("range"), F.col("family"), F.col("lo"), F.col("hi")).alias("range_clause"), B.render_number(F.col("lo"), F.lit("deva")).alias("deva"))


@query(f"SELECT doc_id, lo, hi FROM ({_BOUNDS}) WHERE lo <> hi AND hi <= 3 * lo")
def budget_parse(spark, d):
    """What is rendered reads back: Hindi ranges in Devanagari digits are parsed to their bounds."""
    b = B.bounds(F.size(X.words(F.col("text"))))
    rows = docs(spark, d).select("doc_id", b["lo"].alias("lo"), b["hi"].alias("hi"))  # a band's hi is never over 3 * lo
    clause = F.concat(F.lit("कृपया "), B.render_number(F.col("lo"), F.lit("deva")), F.lit("-"), B.render_number(F.col("hi"), F.lit("deva")), F.lit(" शब्दों में जवाब दें।"))
    return rows.select("doc_id", clause.alias("clause")).select("doc_id", B.parse(F.col("clause"), "hin").alias("band")).select("doc_id", "band.lo", "band.hi")


@query(f"WITH b AS (SELECT a.doc_id, d.lang, a.lo, a.hi, b.n FROM ({_BOUNDS}) a JOIN documents d USING (doc_id) JOIN ({_BOUNDS}) b ON b.doc_id = a.doc_id + 1) SELECT lang, count(*) AS n, round(100 * avg((n BETWEEN lo AND hi)::INT), 4) AS in_band, round(100 * avg((n - (lo + hi) / 2) / ((lo + hi) / 2)), 4) AS overshoot FROM b GROUP BY lang")
def budget_compliance(spark, d):
    n = F.size(X.words(F.col("text")))
    a = docs(spark, d).select("doc_id", "lang", B.bounds(n).alias("band"))
    b = docs(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), n.alias("m"))
    out = a.join(b, "doc_id").groupBy("lang").agg(*B.compliance(F.col("m"), F.col("band")))
    return out.select("lang", F.col("n"), F.round("in_band", 4).alias("in_band"), F.round("overshoot", 4).alias("overshoot"))


# --- language identification


def _lid_sql() -> str:
    n = "len(t)"
    d = {k: f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in m)}))) / {n}" for k, m in L.LATIN.items()}
    cols = ", ".join(f"{v} AS {k}" for k, v in d.items())
    best = f"greatest({', '.join(d)})"
    pick = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in d)
    return f"WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS t FROM documents), s AS (SELECT doc_id, lang, len(t) AS n, {cols} FROM w WHERE len(t) > 0) SELECT doc_id, lang AS true, CASE WHEN n >= 12 AND {best} >= 0.015 AND {best} >= 1.25 * list_sort([{', '.join(d)}], 'DESC')[2] THEN CASE {pick} END END AS pred FROM s"


def _lid(spark: SparkSession, d: str) -> DataFrame:
    t = L.tokens(F.lower("text"), "a-zà-ÿ")
    rows = docs(spark, d).select("doc_id", F.col("lang").alias("true"), t.alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", "true", L.classify(F.col("t"), L.LATIN).alias("pred"))


@query(_lid_sql())
def lid_classify(spark, d):
    return _lid(spark, d)


@query(f"SELECT \"true\", count(*) AS n, {', '.join(f'count(*) FILTER (pred = {chr(39)}{k}{chr(39)}) AS {k}' for k in L.LATIN)}, count(*) FILTER (pred IS NULL) AS abstain FROM ({_lid_sql()}) GROUP BY \"true\"")
def lid_confusion(spark, d):
    return _lid(spark, d).groupBy("true").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("pred") == k, 1)).alias(k) for k in L.LATIN), F.count(F.when(F.col("pred").isNull(), 1)).alias("abstain"))


# --- metrics

_ANSWERS = "SELECT c.conv_id, c.turn, c.text AS gold, a.text AS pred FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user' AND a.role = 'assistant'"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold")).join(a, ["conv_id", "turn"])


def _chrf_sql() -> str:
    text = lambda c: rf"regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}]', '', 'g')"
    grams = lambda c: f"SELECT conv_id, turn, n, substr({c}, i, n) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length({c}) - n + 2)) AS i FROM x) GROUP BY ALL"
    return f"""WITH x AS (SELECT conv_id, turn, {text('pred')} AS h, {text('gold')} AS r, n::INT AS n FROM ({_ANSWERS}), range(1, 7) t(n)),
a AS ({grams('h')}), b AS ({grams('r')}), s AS (SELECT k.conv_id, k.turn, k.n, greatest(0, length(k.h) - k.n + 1) AS h, greatest(0, length(k.r) - k.n + 1) AS r, coalesce(m.m, 0) AS m FROM x k
LEFT JOIN (SELECT a.conv_id, a.turn, a.n, sum(least(a.c, b.c)) AS m FROM a JOIN b USING (conv_id, turn, n, g) GROUP BY ALL) m USING (conv_id, turn, n))"""


_F = "CASE WHEN count(*) FILTER (h > 0 AND r > 0) = 0 OR p + q = 0 THEN 0 ELSE 500 * p * q / (4 * p + q) END"


@query(_chrf_sql() + " SELECT conv_id, turn, sum(h)::BIGINT AS h, sum(r)::BIGINT AS r, sum(m)::BIGINT AS m FROM s GROUP BY conv_id, turn")
def chrf_stats(spark, d):
    rows = _answers(spark, d).withColumn("s", M.chrf_stats("pred", "gold"))
    total = lambda k: F.aggregate(F.filter(F.col("s"), lambda x, i: i % 3 == k), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("conv_id", "turn", total(0).alias("h"), total(1).alias("r"), total(2).alias("m"))


@query(_chrf_sql() + ", p AS (SELECT conv_id % 10 AS grp, n, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM s GROUP BY ALL), q AS (SELECT grp, avg(m / h) AS p, avg(m / r) AS q FROM p WHERE h > 0 AND r > 0 GROUP BY grp) SELECT grp, round(CASE WHEN p + q = 0 THEN 0 ELSE 500 * p * q / (4 * p + q) END, 4) AS chrf FROM q")
def chrf_corpus_by_group(spark, d):
    rows = _answers(spark, d).select((F.col("conv_id") % 10).alias("grp"), M.chrf_stats("pred", "gold").alias("stats"))
    return M.corpus_chrf(rows, ["grp"]).select("grp", F.round("chrf", 4).alias("chrf"))


_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[\p{{P}}$+<=>^`|~]', ' ', 'g'), '\s+'), lambda w: w <> '')".format


@query(f"WITH t AS (SELECT conv_id, turn, {_TOK('pred')} AS a, {_TOK('gold')} AS b FROM ({_ANSWERS})), s AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w)))))::INT AS same FROM t) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 100 WHEN coalesce(same, 0) = 0 THEN 0 ELSE 200.0 * same / (len(a) + len(b)) END, 4) AS f1, CASE WHEN a = b THEN 100.0 ELSE 0.0 END AS em FROM s")
def token_f1(spark, d):
    rows = _answers(spark, d).select("conv_id", "turn", M.simple_tokens(F.col("pred")).alias("a"), M.simple_tokens(F.col("gold")).alias("b"))
    return rows.select("conv_id", "turn", F.round(M.token_f1(F.col("a"), F.col("b")), 4).alias("f1"), M.exact_match(F.col("a"), F.col("b")).alias("em"))


@query()
def rouge_and_semantic(spark, d):
    rows = sft_pairs(spark, d).withColumnsRenamed({"input": "gold", "output": "pred"})
    return rows.select("conv_id", "turn", F.round(M.rouge_l("pred", "gold"), 4).alias("rouge_l"), F.round(M.semantic(F.col("pred"), F.col("gold")), 4).alias("semantic"))


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_score(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col("x"), F.col("y")
    return j.select("vec_id", F.round(dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)), 4).alias("cosine"))


_POISSON = " + ".join(f"(u >= {t})::INT" for t in R.POISSON)


@query(f"""WITH r AS (SELECT doc_id, quality::DOUBLE AS a, toxic::DOUBLE AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT a, b, k, {_digest('doc_id', 'k')} AS h FROM (SELECT *, unnest(range(0, 1250)) AS k FROM r)), u AS (SELECT a, b, 8 * k + i AS draw, ('0x' || substr(h, 4 * i::INT + 1, 4))::INT AS u FROM (SELECT *, unnest(range(0, 8)) AS i FROM h)),
w AS (SELECT draw, a, b, {_POISSON} AS w FROM u), m AS (SELECT (sum(w * a) - sum(w * b)) / nullif(sum(w), 0) AS d FROM w GROUP BY draw),
q AS (SELECT quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, least(1.0::DOUBLE, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))) AS p FROM m WHERE d IS NOT NULL)
SELECT round((SELECT avg(a) - avg(b) FROM r), 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'no difference' END AS verdict FROM q""")
def bootstrap_ci(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))
    return R.bootstrap(rows, "doc_id", "a", "b", draws=10_000).select(*(F.round(c, 6).alias(c) for c in ("delta", "low", "high", "p")), "verdict")


@query("SELECT count(*) AS n, round(100 * avg((quality = 0 AND toxic = 0)::INT), 4) AS false_refusal, round(100 * avg(quality) FILTER (toxic = 1), 4) AS refusal_hit FROM labels")
def refusal_rates(spark, d):
    quality, toxic = F.col("quality"), F.col("toxic")
    return table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(((quality == 0) & (toxic == 0)).cast("int")), 4).alias("false_refusal"), F.round(100 * F.avg(F.when(toxic == 1, quality)), 4).alias("refusal_hit"))


# --- chat


@query(_ANSWERS.replace("AS gold", "AS input").replace("AS pred", "AS output"))
def sft_pairs(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")).join(a, ["conv_id", "turn"])


@query("SELECT conv_id, string_agg('<|im_start|>' || role || e'\\n' || text || e'<|im_end|>\\n', '' ORDER BY turn) AS rendered, count(*) AS turns FROM conversations GROUP BY conv_id")
def chat_render(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    msgs = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return m.select("conv_id", chat.render(msgs, generate=False).alias("rendered"), F.size("t").cast("long").alias("turns"))


@query("SELECT item_id, '<|im_start|>system' || e'\\n' || 'You are a helpful assistant. Reply in English.' || e'<|im_end|>\\n' || '<|im_start|>user' || e'\\n' || 'a' || e'<|im_end|>\\n' || '<|im_start|>assistant' || e'\\n' || 'b' || e'<|im_end|>\\n' || '<|im_start|>user' || e'\\n' || text || e'<|im_end|>\\n' || '<|im_start|>assistant' || e'\\n' AS prompt FROM benchmark")
def chat_messages(spark, d):
    shots = F.array(F.struct(F.lit("a").alias("input"), F.lit("b").alias("output")))
    return table(spark, d, "benchmark").select("item_id", chat.render(chat.messages(F.col("text"), chat.system_text(F.lit("English")), shots)).alias("prompt"))


def _ids(c: str) -> str:
    return f"list_transform({_words(c)}, lambda w: length(w)::INT)"


@query(f"WITH p AS (SELECT conv_id, turn, {_ids('gold')} AS x, {_ids('pred')} AS y FROM ({_ANSWERS})), f AS (SELECT *, list_concat(x, y) AS i, list_concat(list_transform(x, lambda v: -100), y) AS l FROM p) SELECT conv_id, turn, array_to_string(i[greatest(1, len(i) - 31):], ',') AS ids, array_to_string(l[greatest(1, len(l) - 31):], ',') AS labels, len(i) > 32 AS truncated FROM f")
def label_mask(spark, d):
    ids = lambda c: F.transform(X.words(F.col(c)), lambda w: F.length(w))
    rows = _answers(spark, d).select("conv_id", "turn", *chat.mask_labels(ids("gold"), ids("pred"), 32))
    return rows.select("conv_id", "turn", F.array_join("ids", ",").alias("ids"), F.array_join("labels", ",").alias("labels"), "truncated")


@query("WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations), m AS (SELECT conv_id, max(n) AS most FROM t GROUP BY conv_id) SELECT conv_id, turn, most::INT AS padded, n::INT AS attended FROM t JOIN m USING (conv_id)")
def pad_batch(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array_repeat(F.lit(7), F.length("text")).alias("ids"))
    return chat.pad(rows, "conv_id", "ids", 0).select("conv_id", "turn", F.size("ids").alias("padded"), F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("attended"))
