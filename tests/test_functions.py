"""Literal cases of text, budget and metric functions, sources and sinks."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lingmill.functions import budget as B
from lingmill.functions import text as X
from lingmill.functions.hashing import shard, side
from lingmill.functions.metrics import exact_match, simple_tokens, token_f1
from lingmill.operators import relational as R
from lingmill.plans import checks as C
from lingmill.plans import dataset as D
from lingmill.sources import pages, tables
from lingmill.streaming import ingest


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_text(spark):
    assert one(spark, X.strip, "  a b　\n", "") == ["a b", ""]
    assert one(spark, X.truncate_runaway, "clean ", "a\nuser\nb", "a  <think>x", "a<|im_start|>b") == ["clean ", "a", "a", "a<|im_start|>b"]
    assert one(spark, X.one_sentence, "", "abc", "abc.", "a. b.", "क।", "何？") == [False, True, True, False, True, True]
    assert one(spark, X.script_of, "abc", "कख", "ابت", "123", "")[:3] == ["latin", "devanagari", "arabic"]
    assert one(spark, X.sections, "a\\n\\nb", "a\n\nb") == [["a", "b"], ["a\n\nb"]]


def test_scripts(spark, capfd):
    texts = ["abc", "कख", "ab кл", "aкл", "カナ漢字", "漢字x", "한글 ab", "123", "", None, "😀aé 😀", "😀😀क", "ab " + "১" * 9, "a😀ब", "aक"]
    assert one(spark, X.script_of, *texts) == ["latin", "devanagari", "cyrillic", "cyrillic", "kana", "han", "hangul", "none", "none", "none", "latin", "devanagari", "bengali", "devanagari", "devanagari"]
    assert one(spark, lambda c: X.script_fraction(c, "Latin"), "aé к1", "😀", "漢") == [2 / 3, 1.0, 0.0]
    assert one(spark, lambda c: X.script_fraction(c, "Japanese"), "漢カa", "か") == [2 / 3, 1.0]
    assert one(spark, X.is_blank, "", " \u3000\n", " a ", None) == [True, True, False, None]
    spark.range(1).select(F.lit("x").alias("x")).select(X.script_of(F.col("x"))).explain()
    assert capfd.readouterr().out.count("regexp_replace(") <= 9 and "[^" not in spark.range(1).select(X.script_of(F.col("id").cast("string")))._jdf.queryExecution().toString()


def test_budget(spark):
    n = spark.createDataFrame([(0,), (5,), (40,), (137,), (999,), (25,), (35,)], "n int")
    got = {r.n: (r.b["lo"], r.b["hi"], r.c) for r in n.select("n", B.bounds(F.col("n")).alias("b"), B.clause_number(F.col("n")).alias("c")).collect()}
    assert got[0][:2] == (10, 20) and got[40][:2] == (30, 50) and got[137][:2] == (110, 160) and got[999][:2] == (840, 1150)
    assert got[25][2] == 20 and got[35][2] == 40


def test_metrics(spark):
    rows = spark.createDataFrame([("", ""), ("", "a"), ("in 399", "399"), ("a a b", "a b b")], "p string, g string")
    p, g = simple_tokens(F.col("p")), simple_tokens(F.col("g"))
    got = [(round(r[0], 2), r[1]) for r in rows.select(token_f1(p, g), exact_match(p, g)).collect()]
    assert got == [(100.0, 100.0), (0.0, 0.0), (66.67, 0.0), (66.67, 0.0)]


def test_split_and_shards(spark):
    groups = spark.range(10_000).select(F.col("id").cast("string").alias("g")).select(side(F.col("g")).alias("s"))
    assert 1800 < groups.where("s = 'dev'").count() < 2200
    ten = spark.range(10)
    parts = [sorted(r.id for r in shard(ten, i, 3, F.floor(F.col("id") / 4), F.col("id")).collect()) for i in (1, 2, 3)]
    assert [len(x) for x in parts] == [3, 3, 4] and sum(parts, []) == list(range(10))
    for bad in (0, 4):
        with pytest.raises(ValueError):
            shard(ten, bad, 3, F.col("id"), F.col("id"))


def test_refusals(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, source string")
    with pytest.raises(ValueError):
        R.check_collisions(rows, ["k"], "source", None)
    with pytest.raises(ValueError):
        R.reject_unknown(rows, "source", ["a"])
    assert {(r.k, r.source) for r in R.prefer(rows, ["k"], "source", "b", F.col("source")).collect()} == {(1, "b"), (2, "a")}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ä\n\"x\""), (2, None)], "id long, output string")
    tables.write_jsonl(rows, f"{tmp_path}/a")
    assert {(r.id, r.output) for r in tables.read_jsonl(spark, f"{tmp_path}/a", schema="id long, output string").collect()} == {(1, "ä\n\"x\""), (2, None)}
    assert tables.append_missing(rows, f"{tmp_path}/b", "id", "id long, output string") == 2
    assert tables.append_missing(rows, f"{tmp_path}/b", "id", "id long, output string") == 0
    assert D.leaks(D.split_by_group(rows, F.lit("g"))).count() == 0


def test_non_latin(spark):
    assert one(spark, X.non_latin_fraction, "abc", "abक", "ไทยa", "", "12") == [0.0, 1 / 3, 0.75, 0.0, 0.0]
    assert one(spark, lambda c: X.lean(c, X.CONTRASTS, "bho", "hin"), "ई बा", "यह है", "राम के लिए", "abc", None) == ["bho", "hin", None, None, None]


def test_parse(spark):
    for lang, text, want in [("eng", "write 150 words", (120, 180)), ("eng", "in 2020, write 150 words", (120, 180)), ("eng", "120-150 words", (120, 150)), ("arb", "أجب في ١٢٠ إلى ١٥٠ كلمة.", (120, 150)), ("jpn", "120〜150字で", (120, 150)), ("zho", "150个字", (120, 180)), ("mar", "१५० शब्दांचे", (120, 180)), ("yor", "ọ̀rọ̀ 120-150", (120, 150)), ("eng", "none", None), ("eng", None, None)]:
        [got] = one(spark, lambda c, lang=lang: B.parse(c, lang), text)
        assert (got and tuple(got)) == want, text


def test_parse_of_long_numbers(spark):
    for text, want in [("9000-10000 words", (9000, 10000)), ("12340–16700 words", (12340, 16700)), ("123456789-200000000 words", (123456789, 200000000)), ("900000000-999999999 words", (900000000, 999999999)), ("12000 words", (10200, 13800)), ("words 12000-15000", (12000, 15000)), ("1234567890 words", None), ("20000-90000 words", (76500, 103500))]:
        [got] = one(spark, lambda c: B.parse(c, "eng"), text)
        assert (got and tuple(got)) == want, text


def test_clauses_read_back(spark):
    dims = B.dimension(spark)
    for lang in B.LANGS:
        clause = B.render(F.col("exact"), F.col("range"), F.col("family"), F.lit(130), F.lit(150))
        [row] = dims.where(F.col("lang") == lang).select(clause.alias("c")).select(B.parse(F.col("c"), lang).alias("b")).collect()
        assert tuple(row.b) == (130, 150), lang
    assert C.rendering(dims).where("NOT ok").count() == 0


def test_csv_and_newest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffsource,lang_code,input,gold,prediction\ns,en,"two\nlines, ""q""",g,\n', encoding="utf-8")
    [row] = tables.read_any(spark, f"{tmp_path}/a.csv", tables.ANSWERS).collect()
    assert tuple(row) == ("s", "en", 'two\nlines, "q"', "g", "")
    assert tables.newest(spark, str(tmp_path)).endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        tables.newest(spark, str(tmp_path), "*.none")
    with pytest.raises(ValueError):
        tables.require(spark.range(1), "x")


def test_jsonl_reads(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task": "sum-sum", "question_lang": "hin_Deva"}\n\n{"task": "qa", "question_lang": "eng"}\n', encoding="utf-8")
    rows = tables.read_jsonl(spark, f"{tmp_path}/a.jsonl", schema="task string, question_lang string", lineage=True)
    assert rows.count() == 2 and rows.first().src_file.endswith("a.jsonl")
    assert [tuple(r) for r in tables.normalise_rows(rows.drop("src_file")).collect()] == [("qa", "eng", "eng")]
    (tmp_path / "bad.jsonl").write_text("{", encoding="utf-8")
    with pytest.raises((PySparkException, Py4JJavaError)):
        tables.read_jsonl(spark, f"{tmp_path}/bad.jsonl", schema="task string").collect()


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(i, "dev" if i % 3 else "train", f"t{i}") for i in range(20)], "qa_idx int, _side string, x string")
    tables.write_sides(rows, f"{tmp_path}/sides")
    assert spark.read.json(f"{tmp_path}/sides/_side=dev").columns == ["qa_idx", "x"]
    tables.write_sorted(rows, f"{tmp_path}/sorted", "qa_idx")
    files = sorted((tmp_path / "sorted").glob("part*"))
    import json

    assert [json.loads(line)["qa_idx"] for f in files for line in f.read_text().splitlines()] == list(range(20))
    tables.write_csv(rows, f"{tmp_path}/csv")
    assert tables.read_csv(spark, f"{tmp_path}/csv", schema="qa_idx int, _side string, x string").count() == 20
    rows.write.parquet(f"{tmp_path}/p")
    assert tables.read_parquets(spark, f"{tmp_path}/p", f"{tmp_path}/p").count() == 40


def test_paged_source(spark):
    spark.dataSource.register(pages.paged_source("numbers", "n int", lambda offset, length: [(i,) for i in range(offset, min(offset + length, 250))], 5))
    assert sorted(r.n for r in spark.read.format("numbers").load().collect()) == list(range(250))


def test_streams(spark, tmp_path):
    source, sink = tmp_path / "in", f"{tmp_path}/sink"
    source.mkdir()
    schema = "id string, output string, t timestamp"
    for k in range(3):  # the files share keys
        (source / f"{k}.json").write_text("".join(f'{{"id": "{i}", "output": "o", "t": "2020-01-01T00:{i:02d}:00"}}\n' for i in range(5 * k, 5 * k + 10)))
        for run in range(2):
            ingest.once_per_key(ingest.stream_jsonl(spark, str(source), schema, 1), sink, f"{tmp_path}/c{k if run else 'same'}", "id").awaitTermination()
    assert sorted(int(r.id) for r in spark.read.parquet(sink).collect()) == list(range(20))
    counts = ingest.windowed_counts(ingest.stream_jsonl(spark, str(source), schema), "t", "output").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").first().n == 30


def test_generate_isolates_errors(spark):
    def model(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, " ")], "id long, prompt string")
    got = {r.id: (r.output, r.error) for r in ingest.generate(rows, "id", "prompt", model).collect()}
    assert got == {1: ("A", None), 2: ("", "ValueError: no"), 3: ("", None), 4: ("", None)}


def test_align_refuses(spark):
    make = lambda *rows: spark.createDataFrame(rows, "input string, gold string, prediction string")
    a, b = make(("q1", "g", "x"), ("q2", "h", "y")), make(("q2", "h", "w"), ("q1", "g", "z"))
    assert {tuple(r) for r in R.align({"a": a, "b": b}, "input", "gold").select("input", "a_prediction", "b_prediction").collect()} == {("q1", "x", "z"), ("q2", "y", "w")}
    for bad in (make(("q1", "g", "x"), ("q1", "g", "x")), make(("q1", "g", "x")), make(("q1", "other", "x"), ("q2", "h", "y")), make(("q1", "g", "x"), ("q3", "h", "y"))):
        with pytest.raises(ValueError):
            R.align({"a": a, "b": bad}, "input", "gold")


def test_mining_refuses_differing_prompts(spark):
    prompt = lambda tail: X.SEP.join(["Lead", "p", "Question: w", tail])
    rows = spark.createDataFrame([("en", prompt('A. B "no". C.'), "qa-context"), ("en", prompt("Other. B. C."), "qa-context")], "question_lang string, prompt string, task string")
    with pytest.raises(PySparkException):
        D.mine_boilerplate(rows).collect()


def test_context_questions(spark):
    items = spark.createDataFrame([("l", 1, x, f"q {x}", f"p {x}", "a", "b", "c", "d", 2) for x in ("en", "de")], "link string, number int, lang string, question string, passage string, a1 string, a2 string, a3 string, a4 string, correct int")
    pairs = spark.createDataFrame([("l", 1, "en", "de")], "link string, number int, question_lang string, context_lang string")
    plate = spark.createDataFrame([("en", "Lead:", "Q: ", "Tail.")], "lang string, lead string, intro string, tail string")
    [row] = D.context_questions(items, pairs, plate).collect()
    assert row.input == X.SEP.join(["Lead:", "p de", "Q: q en", "Tail."]) and row.output == "b"
    assert D.complete_items(items, ["link", "number"], "lang", 2).count() == 0
    assert D.option_free(items.withColumn("question", F.lit("Which of the following?")).withColumn("lang", F.lit("eng")), ["link"], "lang", "question").count() == 0


def test_checks(spark):
    dims = B.dimension(spark)
    prompts = spark.createDataFrame([("deu", "in 100 Wörtern"), ("mar", "150 शब्दांत"), ("eng", "no number"), ("xxx", "1")], "lang string, text string")
    assert {r.lang: (r.attested, r.ok, r.unit_attested) for r in C.digit_families(prompts, "lang", "text", dims).collect()} == {"deu": ("ascii", True, True), "mar": ("ascii", False, True)}
    rows = spark.createDataFrame([("en", 0, "in 300 words"), ("bn", 1, "৩০০"), ("de", 0, "none")], "lang string, row_index int, input string")
    alignment = spark.createDataFrame([("en", 0, 32), ("bn", 1, 32), ("de", 0, 32), ("fr", 5, 32)], "lang string, row_index int, item int")
    got = {r.lang: r.ok for r in C.anchors(rows, alignment, spark.createDataFrame([(32, 300)], "item int, number int")).collect()}
    assert got == {"en": True, "bn": True, "de": False, "fr": False}
    answers = spark.createDataFrame([("en", "यह है।"), ("en", " "), ("de", "no answer. x. y."), ("de", "ई बा। आ। त।"), ("de", None)], "ctx string, out string")
    got = {r.context_lang: r for r in C.context_checks(answers, "ctx", "out", F.lit("no answer")).collect()}
    assert (got[None].n, got[None].empty, got[None].refused, got[None].answered) == (5, 2, 1, 2) and (got["en"].hin, got["en"].one, got["de"].bho, got["de"].many) == (1, 1, 1, 1)
    bands = spark.createDataFrame([("en", 90, 100, 120), ("en", 200, 100, 120), ("en", 50, 100, 120), ("en", 5, None, None)], "lang string, n int, lo int, hi int")
    band = F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))
    got = {r.lang: tuple(r)[1:] for r in C.budget_buckets(bands, "lang", F.col("n"), band).collect()}
    assert got == {None: (3, 1, 1, 1, 62.0), "en": (3, 1, 1, 1, 62.0)}
    assert C.budget_buckets(bands.limit(0), "lang", F.col("n"), band).where("n > 0").count() == 0


def test_script_histogram(spark):
    answers = spark.createDataFrame([("en", "abc 12"), ("en", " \u3000\n"), ("en", "42"), ("de", "कख a"), ("de", None), ("de", "")], "ctx string, out string")
    found = C.script_histogram(answers, "ctx", "out")
    assert sorted(map(tuple, found.collect())) == [("de", "devanagari", 1), ("en", "latin", 1), ("en", "none", 1)]
    assert "\\s+$" not in found._jdf.queryExecution().toString()  # blank texts are told without a copy of the text
    labels = C.label_counts(answers, "out", F.when(F.col("out") != "42", "x"))
    assert sorted(map(tuple, labels.collect())) == [("abstain", 1), ("empty", 3), ("x", 2)] and "\\s+$" not in labels._jdf.queryExecution().toString()


def test_devanagari(spark):
    from lingmill.functions import lid

    text = lambda lang, n: " ".join((lid.DEVANAGARI[lang] * 3)[:n])
    got = one(spark, lambda c: lid.classify(lid.tokens(c), lid.DEVANAGARI), text("bho", 12), text("hin", 11), text("npi", 12), text("hin", 12) + " " + text("mai", 12), "", "कमल " * 70 + text("mai", 1), "कमल " * 60 + text("mai", 1))
    assert got == ["bho", None, "npi", None, None, None, "mai"]


def test_augment_and_shrink(spark):
    rows = spark.createDataFrame([("qa-oeg" if i % 4 else "qa", "eng", f"q{i}", "w " * (5 + i)) for i in range(200)], "task string, lang string, input string, output string")
    out = D.augment(rows, B.dimension(spark)).collect()
    assert len(out) == 200 and all((r.constraint is None) == ("Please answer" not in r.input) for r in out)
    assert all(r.task == "qa-oeg" and len(r.output.split()) >= 20 for r in out if r.constraint) and 40 < sum(r.constraint is not None for r in out) < 100
    pack = spark.createDataFrame([("s", f"i{i}", "w " * n) for i, n in enumerate([5] * 10 + [100] * 10)], "source string, input string, output string")
    kept = D.shrink(pack, spark.createDataFrame([("s", 12)], "source string, quota int")).collect()
    assert len(kept) == 12 and sum(len(r.output.split()) == 100 for r in kept) == 10
