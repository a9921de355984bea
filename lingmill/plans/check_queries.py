"""Queries of acceptance checks, alignment, augmentation, mining and resumable streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import budget as B
from ..functions import lid as L
from ..functions import metrics as M
from ..functions import text as X
from ..functions.hashing import ranked, top_per_group
from ..operators import relational as R
from ..operators.shared import shared_root
from ..streaming import ingest
from . import checks as C
from . import dataset as D
from .queries import _ANSWERS, _BOUNDS, _TOK, _answers, _chrf_sql, _digest, _lid, _lid_sql, _strip, _uniform, _words, docs, query, table


@query(_chrf_sql() + ", p AS (SELECT conv_id, turn, avg(m / h) AS p, avg(m / r) AS q FROM s WHERE h > 0 AND r > 0 GROUP BY ALL) SELECT k.conv_id, k.turn, round(CASE WHEN p IS NULL OR p + q = 0 THEN 0 ELSE 500 * p * q / (4 * p + q) END, 4) AS chrf FROM (SELECT DISTINCT conv_id, turn FROM s) k LEFT JOIN p USING (conv_id, turn)")
def chrf_sentence(spark, d):
    rows = _answers(spark, d).select("conv_id", "turn", M.chrf_stats("pred", "gold").alias("s"))
    return rows.select("conv_id", "turn", F.round(M.chrf_of(F.col("s")), 4).alias("chrf"))


@query(f"WITH t AS (SELECT conv_id % 10 AS grp, {_TOK('pred')} AS a, {_TOK('gold')} AS b, len({_words('gold')}) AS n FROM ({_ANSWERS})) SELECT grp, count(*) AS n, round(100 * avg((a = b)::INT), 4) AS exact, round(100 * avg((n <= 2)::INT), 4) AS short FROM t GROUP BY grp")
def exact_match(spark, d):
    same = M.exact_match(M.simple_tokens(F.col("pred")), M.simple_tokens(F.col("gold")))
    return _answers(spark, d).groupBy((F.col("conv_id") % 10).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 4).alias("exact"), F.round(100 * F.avg((F.size(X.words(F.col("gold"))) <= 2).cast("int")), 4).alias("short"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS t FROM documents) SELECT doc_id, " + ", ".join(f"round(len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in m)}))) / len(t), 6) AS {k}" for k, m in L.LATIN.items()) + " FROM t WHERE len(t) > 0")
def lid_density(spark, d):
    rows = docs(spark, d).select("doc_id", L.tokens(F.lower("text"), "a-zà-ÿ").alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", *(F.round(v, 6).alias(k) for k, v in L.densities(F.col("t"), L.LATIN).items()))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Devanagari texts: 20 words of the language that a document's number names, every fourth a word of the next language, and a Latin one."""
    lists = F.array(*(F.array(*map(F.lit, m)) for m in L.DEVANAGARI.values()))
    own, other = F.get(lists, (F.col("doc_id") % 4).cast("int")), F.get(lists, ((F.col("doc_id") + 1) % 4).cast("int"))
    pick = lambda words, i: F.get(words, ((F.col("doc_id") + i) % F.size(words)).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.when(i % 4 == 0, pick(other, i)).otherwise(pick(own, i))), " ")
    names = F.array(*map(F.lit, L.DEVANAGARI))
    return docs(spark, d).select("doc_id", F.get(names, (F.col("doc_id") % 4).cast("int")).alias("lang"), F.concat(F.lit("abc "), text, F.lit("।")).alias("text"))


def _lists() -> str:
    return "[" + ", ".join("[" + ", ".join(repr(w) for w in m) + "]" for m in L.DEVANAGARI.values()) + "]"


_DEVA = f"""WITH l AS (SELECT doc_id, {list(L.DEVANAGARI)}[doc_id % 4 + 1] AS lang, {_lists()}[doc_id % 4 + 1] AS own, {_lists()}[(doc_id + 1) % 4 + 1] AS other FROM documents),
t AS (SELECT doc_id, lang, list_transform(range(1, 21), lambda i: CASE WHEN i % 4 = 0 THEN other[(doc_id + i) % len(other) + 1] ELSE own[(doc_id + i) % len(own) + 1] END) AS t FROM l),
s AS (SELECT doc_id, lang, {', '.join(f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in m)}))) / len(t) AS {k}" for k, m in L.DEVANAGARI.items())} FROM t)
SELECT lang, CASE WHEN greatest(bho, hin, mai, npi) >= 0.015 AND greatest(bho, hin, mai, npi) >= 1.25 * list_sort([bho, hin, mai, npi], 'DESC')[2] THEN CASE greatest(bho, hin, mai, npi) WHEN bho THEN 'bho' WHEN hin THEN 'hin' WHEN mai THEN 'mai' ELSE 'npi' END END AS pred FROM s"""


@query(f"SELECT lang, count(*) AS n, round(count(*) FILTER (pred = lang) / count(*), 6) AS recall, count(*) FILTER (pred IS NULL) AS abstain FROM ({_DEVA}) GROUP BY lang")
def lid_devanagari(spark, d):
    rows = _marked(spark, d).select("lang", L.tokens(F.col("text")).alias("t")).select("lang", L.classify(F.col("t"), L.DEVANAGARI).alias("pred"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.when(F.col("pred") == F.col("lang"), 1)) / F.count(F.lit(1)), 6).alias("recall"), F.count(F.when(F.col("pred").isNull(), 1)).alias("abstain"))


@query(f"WITH p AS (SELECT DISTINCT source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT d.doc_id, count(*) FILTER (p.text <> d.text) AS shots, coalesce(bool_or(p.text = d.text), false) AS own_copy FROM (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d LEFT JOIN p USING (source) GROUP BY d.doc_id")
def self_copy_excluded(spark, d):
    """How many examples of its source each labelled row may see: those of the unlabelled pool but its own text."""
    labels = table(spark, d, "labels").select("doc_id").distinct()
    rows = docs(spark, d).select("doc_id", "source", "text")
    pool = rows.join(labels, "doc_id", "left_anti").select("source", "text").distinct()
    sizes = pool.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("all"))
    own = pool.select(F.col("source").alias("s2"), F.col("text").alias("t2"))
    out = rows.join(labels, "doc_id", "left_semi").join(sizes, F.col("source") == F.col("s"), "left").join(own, (F.col("source") == F.col("s2")) & (F.col("text") == F.col("t2")), "left")
    copy = F.col("t2").isNotNull()
    return out.select("doc_id", (F.coalesce("all", F.lit(0)) - copy.cast("int")).cast("long").alias("shots"), copy.alias("own_copy"))


@query("SELECT doc_id, quality AS base_score, toxic AS tuned_score, quality - toxic AS gain FROM labels")
def align_systems(spark, d):
    """Two systems' scores of the same items side by side; other rows, repeated keys or other golds are refused."""
    rows = docs(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("gold"))
    scored = table(spark, d, "labels").join(rows, "doc_id")
    frames = {"base": scored.select("doc_id", "gold", F.col("quality").alias("score")), "tuned": scored.select("doc_id", "gold", F.col("toxic").alias("score"))}
    return R.align(frames, "doc_id", "gold").select("doc_id", "base_score", "tuned_score", (F.col("base_score") - F.col("tuned_score")).alias("gain"))


@query(f"WITH b AS (SELECT d.lang, (a.lo * 0.85::DOUBLE)::DOUBLE AS lo, (a.hi * 1.15::DOUBLE)::DOUBLE AS hi, b.n FROM ({_BOUNDS}) a JOIN documents d USING (doc_id) JOIN ({_BOUNDS}) b ON b.doc_id = a.doc_id + 1), w AS (SELECT lang, floor(lo)::INT AS lo, floor(hi)::INT AS hi, n FROM b) SELECT lang, count(*) AS n, count(*) FILTER (n BETWEEN lo AND hi) AS ok, count(*) FILTER (n > hi) AS over, count(*) FILTER (n < lo) AS under, round(avg(n - hi) FILTER (n > hi), 6) AS excess FROM w GROUP BY GROUPING SETS ((), (lang))")
def acceptance_budget(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", F.size(X.words(F.col("text"))).alias("n"))
    answers = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m"))
    j = rows.select("doc_id", "lang", B.bounds(F.col("n")).alias("band")).join(answers, "doc_id")
    return C.budget_buckets(j, "lang", F.col("m"), F.col("band")).withColumn("excess", F.round("excess", 6))


@query(f"SELECT coalesce(pred, 'abstain') AS label, count(*) AS n FROM ({_lid_sql()}) GROUP BY 1")
def acceptance_labels(spark, d):
    return C.label_counts(_lid(spark, d).withColumn("text", F.lit("x")), "text", F.col("pred"))


_MARKS = X.BUCKET_MARKS
_has = lambda p: rf"regexp_matches(' ' || t || ' ', '(?:^|[,\s।])(?:{p})(?:[\s,।]|$)')::INT"


@query(rf"""WITH a AS (SELECT lang, {_strip('text')} AS t FROM documents), k AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN contains(t, 'not answerable') THEN 'refused' ELSE 'answered' END AS kind,
{_has('ist')} + {_has('der|die|das')} AS a, {_has('the')} + {_has('a|an')} AS b, length(t) - length(translate(t, '{_MARKS}', '')) - regexp_matches(t, '[{_MARKS}]$')::INT AS s FROM a)
SELECT lang AS context_lang, count(*) AS n, count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'refused') AS refused, count(*) FILTER (kind = 'answered') AS answered, count(*) FILTER (kind = 'answered' AND a > b) AS de, count(*) FILTER (kind = 'answered' AND a < b) AS en,
count(*) FILTER (kind = 'answered' AND a = b) AS undecidable, count(*) FILTER (kind = 'answered' AND s <= 0) AS one, count(*) FILTER (kind = 'answered' AND s = 1) AS two, count(*) FILTER (kind = 'answered' AND s > 1) AS many FROM k GROUP BY GROUPING SETS ((), (lang))""")
def acceptance_context(spark, d):
    pairs = [("copula", "ist", "the"), ("article", "der|die|das", "a|an")]
    return C.context_checks(docs(spark, d), "lang", "text", F.lit("not answerable"), pairs, ("de", "en"))


@query(f"SELECT lang AS context_lang, CASE WHEN length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) > 0 THEN 'latin' ELSE 'none' END AS script, count(*) AS n FROM documents WHERE {_strip('text')} <> '' GROUP BY ALL")
def acceptance_scripts(spark, d):
    return C.script_histogram(docs(spark, d), "lang", "text")


@query(f"""WITH d AS (SELECT doc_id, lang, text, len({_words('text')})::INT AS n FROM documents WHERE lang IN ('en', 'de')), u AS (SELECT *, lang = 'en' AS en, {_uniform('doc_id', 'text')} AS u, {_uniform('doc_id', 'text', seed='42e')} AS e FROM d),
b AS (SELECT *, greatest(10, (floor(floor(n * 0.85::DOUBLE) / 10) * 10)::INT) AS lo, greatest(10, (round_even(n / 10, 0) * 10)::INT) AS k FROM u), c AS (SELECT *, greatest(lo + 10, (ceil(floor(n * 1.15::DOUBLE) / 10) * 10)::INT) AS hi FROM b)
SELECT doc_id, CASE WHEN n < 20 OR u >= 0.5 THEN NULL WHEN e < 0.5 THEN 'budget-exact' ELSE 'budget-range' END AS constraint, md5(doc_id || CASE WHEN n < 20 OR u >= 0.5 THEN '' WHEN e < 0.5 AND en THEN e'\\n\\nPlease answer in about ' || k || ' words.' WHEN e < 0.5 THEN e'\\n\\nBitte antworte in etwa ' || k || ' Wörtern.'
WHEN en THEN e'\\n\\nPlease answer in ' || lo || '-' || hi || ' words.' ELSE e'\\n\\nBitte antworte mit ' || lo || '–' || hi || ' Wörtern.' END) AS h FROM c""")
def augment_budgets(spark, d):
    rows = docs(spark, d).where("lang IN ('en', 'de')").select("doc_id", F.lit("qa-oeg").alias("task"), F.when(F.col("lang") == "en", "eng").otherwise("deu").alias("lang"), F.col("doc_id").cast("string").alias("input"), F.col("text").alias("output"))
    return D.augment(rows, B.dimension(spark)).select("doc_id", "constraint", F.md5(F.col("input").cast("binary")).alias("h"))


@query(f"""WITH p AS (SELECT DISTINCT source AS link, right(source, 1) AS side FROM documents), r AS (SELECT link, other FROM (SELECT link, coalesce(lead(link) OVER w, first_value(link) OVER w) AS other FROM p WINDOW w AS (PARTITION BY side ORDER BY {_digest('link')}, link ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE other <> link)
SELECT doc_id, coalesce({_uniform('source', 'lang')} < 0.07 AND other IS NOT NULL, false) AS unanswerable, CASE WHEN {_uniform('source', 'lang')} < 0.07 AND other IS NOT NULL THEN other ELSE source END AS passage_link FROM documents LEFT JOIN r ON source = link""")
def unanswerable_rows(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("source").alias("link"), F.col("lang").alias("question_lang"))
    links = rows.select("link", F.right("link", F.lit(1)).alias("side")).distinct()
    return D.unanswerable(rows, links).select("doc_id", "unanswerable", "passage_link")


@query("SELECT lang, 'Here is a text:' AS lead, 'Asked: ' AS intro, 'One sentence.' AS one_sentence, 'Else write \"no answer\".' AS refusal, 'Answer in ' || lang || '.' AS answer_in, 'no answer' AS phrase FROM (SELECT DISTINCT lang FROM documents)")
def mine_boilerplate(spark, d):
    """Prompts of four sections are made of all documents; lead, intro and tail are found again for each language."""
    tail = F.concat(F.lit('One sentence. Else write "no answer". Answer in '), F.col("lang"), F.lit("."))
    question = F.concat(F.when(F.col("doc_id") % 2 == 0, "who").otherwise("why"), F.lit(" is it"), F.col("doc_id").cast("string"))
    prompt = X.wrap_context(F.lit("Here is a text:"), F.replace("text", F.lit(X.SEP), F.lit(" ")), F.lit("Asked: "), question, tail)
    rows = docs(spark, d).select("lang", prompt.alias("prompt"))
    rows = rows.unionByName(rows.withColumn("prompt", F.regexp_replace("prompt", "Asked: (who|why)", "Asked: x")))  # a third question, so each language has several
    tests = rows.select(F.col("lang").alias("question_lang"), "prompt", F.lit("qa-context").alias("task"))
    return D.mine_boilerplate(tests).select("lang", "lead", "intro", "one_sentence", "refusal", "answer_in", "phrase")


@query("SELECT 'deu' AS lang, 'ascii' AS attested, 'ascii' AS claimed, true AS ok, count(*) FILTER (lang = 'de' AND contains(text, 'Wörtern')) > 0 AS unit_attested FROM documents WHERE lang = 'de' HAVING count(*) FILTER (regexp_matches(text, '[0-9]')) > 0 UNION ALL SELECT 'mar', 'deva', 'deva', true, true")
def digit_families(spark, d):
    prompts = docs(spark, d).where("lang = 'de'").select(F.lit("deu").alias("lang"), "text").unionByName(spark.createDataFrame([("mar", "१५० शब्दांत"), ("mar", "none")], "lang string, text string"))
    return C.digit_families(prompts, "lang", "text", B.dimension(spark))


@query("SELECT count(*) AS n, count(*) AS ok FROM range(24)")
def budget_rendering(spark, d):
    return C.rendering(B.dimension(spark)).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("ok"))


@query("SELECT lang, 7 AS item, n AS number, coalesce(bool_or(contains(text, n::VARCHAR)), false) AS ok FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents), (VALUES (1)) x(n) WHERE i = 3 GROUP BY lang, n")
def aligned_anchors(spark, d):
    # first the numbers of 46 rows a language, then their texts: no task holds those of a whole language
    ids = top_per_group(docs(spark, d).select(F.col("lang").alias("l"), F.col("doc_id").alias("i")), ["l"], 46, F.col("i"))
    firsts = docs(spark, d).select("lang", "doc_id", F.col("text").alias("input")).join(F.broadcast(ids), F.col("lang").eqNullSafe(F.col("l")) & (F.col("doc_id") == F.col("i")), "left_semi")
    rows = ranked(firsts, ["lang"], F.col("doc_id"), name="rn").where("rn <= 46").select("lang", (F.col("rn") - 1).alias("row_index"), "input")
    alignment = rows.select("lang", "row_index", (F.col("row_index") + 4).alias("item"))
    return C.anchors(rows, alignment, spark.createDataFrame([(7, 1)], "item int, number int"))


@query("SELECT user_id % 100 AS bucket, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_resume_dedupe(spark, d):
    """All events through a file stream into a sink that holds each key once; a second run of the stream, from its start, adds nothing."""
    schema, root = table(spark, d, "events").schema, f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    for run in (1, 2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{d}/event*.parquet")
        ingest.once_per_key(stream.select("event_id", "user_id"), f"{root}/sink", f"{root}/checkpoint{run}", "event_id").awaitTermination()
    return spark.read.parquet(f"{root}/sink").groupBy((F.col("user_id") % 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
