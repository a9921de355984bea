"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lingmill.llm import html_crf, jpeg, language, lm, mixing, packing, quality, queries, simhash, subwords, suffixes, topk
from lingmill.llm.common import hash_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, k string, fp long"


def documents(spark, texts, lang="en"):
    """Extra columns clash with names used inside the operators."""
    rows = [(i, t, lang, f"s{i % 3}" if i % 7 else None, len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(70), make(120)
    out = [make(rng.randint(1, 200)) for _ in range(30)]
    out += [None, "", " ", "a", base, base, base.upper(), base + " end", make(20) + " " + passage + " " + make(9), passage + make(40), make(5) + passage]
    out += ["zz " * 300, make(6000), "あ" * 500, " ".join(base.split()[:-3] + ["x", "y", "z"])]
    return out


def save(df, path, name):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def passages_in_contexts():
    """Passages of 60 to 260 bytes, each in many contexts, some of which it shares in part with others."""
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    out = []
    for size in (60, 150, 199, 200, 260):
        passage, near = line(size), [line(60) for _ in range(3)]
        out += [line(rng.randint(0, 200)) + rng.choice(near)[rng.randint(0, 60) :] + passage + rng.choice(near)[: rng.randint(0, 60)] + line(rng.randint(0, 200)) for _ in range(12)]
    return [*out, out[-1], out[-1] + "x", "ab" * 300, None, ""]


@pytest.mark.parametrize("make, largest", [(texts, None), (texts, 250), (passages_in_contexts, 1500), (passages_in_contexts, 250)])
def test_op1(spark, monkeypatch, make, largest):
    """Also where every key of more than `largest` bytes is split."""
    if largest:
        monkeypatch.setattr(suffixes, "SHARD_BYTES", largest)
    docs = make()
    at = defaultdict(set)
    raw = [(t or "").encode() for t in docs]
    for i, b in enumerate(raw):
        for p in range(len(b) - 199):
            at[b[p : p + 200]].add((i, p))
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + 200] = True
    got = {r.doc_id: r for r in suffixes.remove_repeats(documents(spark, docs)).collect()}
    assert len(got) == len(docs)
    for i, (b, g) in enumerate(zip(raw, gone)):
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        spans = int((np.diff(np.append(0, g.astype(int))) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_op1_merge_equals_sorting():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    parts[3] = parts[5] = b"abcab" * 50
    count = Counter(p[i : i + 40] for p in parts for i in range(len(p) - 39))
    want = [[i for i in range(len(p) - 39) if count[p[i : i + 40]] > 1] for p in parts]
    assert [x.tolist() for x in suffixes.repeats(parts, 40, 8, shard_bytes=400)] == want


def test_op2(spark):
    from tokenizers import Tokenizer

    path, docs = queries.tokenizer_path("word_bpe_49k.json"), texts()
    tok = Tokenizer.from_file(path)
    rows = packing.pack(packing.cut(documents(spark, docs), path, 256), 256).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(by) == len(docs)
    for i, t in enumerate(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(a // 256, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for a in range(0, len(ids), 256)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    for x in bins.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 256 + 1


def test_op3(spark):
    words = {"en": "the of and to in is was for that with", "de": "der die und ist nicht mit ein auf das zu", "fr": "le la et est dans pour que une sur avec"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(30)), x) for i in range(120) for x in [rng.choice(list(words))]]
    rows += [(500, None, "en"), (501, "123 !!", "de"), (502, "", None), (503, "the of and", None), (503, "der und", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where(hash_mod("doc_id", 5) != 0).where("lang <> 'xx'"))
    got = language.identify(docs, *model).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: r for r in got if r.doc_id != 503}
    assert all(pred[i].lang_pred == x for i, _, x in rows[:120]) and all(0 <= r.score <= 1 for r in got)
    assert [pred[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    empty = docs.limit(0)
    assert language.identify(docs, *language.train(empty)).where("lang_pred = 'und' AND score = 0").count() == len(rows)
    marks = [chr(c) for c in range(0x100, 0x3000, 7) if chr(c).isalpha()]  # every letter is one, whatever its bucket
    assert "und" not in language.score(marks, *model)[0] and language.score(["1", "\u0660", "\u3002", " \n", None], *model)[0] == ["und"] * 5
    long = "der und ist " * 100_000
    assert language.score([long, "the"], *model)[0] == ["de", "en"]


def test_op4(spark):
    page = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=#>Home</a></li></ul></nav><article><h1>A title</h1>{}</article><div class='comments'><p>I like this a lot.</p></div><footer>&copy; 2020 Some company</footer></body></html>"
    body = "<p>First   paragraph &amp; more of it, which says\nquite enough to be read.</p><p>Second <b>paragraph</b> stands here too, and it is long enough.</p>"
    want = "A title First paragraph & more of it, which says quite enough to be read. Second paragraph stands here too, and it is long enough."
    rows = [(1, "u", page.format(body)), (2, None, None), (3, "u", ""), (3, "u", "<<<>>"), (4, "u", "<div>" * 3000), (5, "u", page.format("<p>" + "Long text here. " * 20_000 + "</p>"))]
    got = {r.page_id: r for r in html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == "" and got[4].text == "" and got[5].n_chars > 319_000
    field, held = html_crf.trained(), html_crf.labelled_pages(60, seed=99)
    right = [(field.decode(html_crf.features(b)) == y).mean() for b, y in held if b]
    assert np.mean(right) > 0.95


def test_op5(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.standard_normal(8) * (1 + i % 5)]) for i in range(400)]
    rows += [(401, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [0.0] * 8), (402, rows[3][1]), (403, rows[3][1]), (600, [2.0, -1.0, 3.0]), (601, []), (602, [1.0] * 11), (650, [0.5] * 9), (700, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    folder = save(vectors, tmp_path, "embeddings")
    got = sorted(map(tuple, queries.op5_top_k(spark, folder).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP5_SQL).fetchall())
    assert topk.top_k(vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.where("vec_id = 50")).count() == 0


def test_op3_by_brute_force(spark):
    """Posterior of each text from counts of its lower-cased letters' n-grams, with no hashing: the buckets here don't collide enough to matter."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(("alba mons", "terra nova")[i % 2].split() + ["ex"]) for _ in range(rng.randint(1, 5))), ("x", "y")[i % 2]) for i in range(60)]

    def grams(text):
        t = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + "   "
        return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(text) + 1))

    counts = {k: sum((grams(t) for _, t, x in rows if x == k), Counter()) for k in "xy"}
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = ["alba ex", "nova", "Ex ex", "mons, nova!", "q"]
    for text, lang, p in zip(asked, *language.score(asked, *model)):
        logs = {k: np.log(31 / 62) + sum(n * np.log((c[g] + 0.5) / (c.total() + 0.5 * 2**16)) for g, n in grams(text).items()) for k, c in counts.items()}
        best = max(logs, key=logs.get)
        assert lang == best and p == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-3), text


def test_op6(spark):
    rng = random.Random(4)
    good = lambda: ". ".join(" ".join(rng.choice(["market", "river", "people", "house", "walked", "under", "bright"]) for _ in range(9)).capitalize() for _ in range(8))
    bad = lambda: " ".join(rng.choice(["$$$", "buy", "BUY!!!", "###", "0x00", "!!"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)] + [(300, None), (301, ""), (302, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(999, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, hash_mod("doc_id", 4) != 2).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([(got[i].score > 0.5) == i % 2 for i in held]) > 0.95
    assert quality.score_quality(docs, labels.limit(0), F.lit(True)).count() == len(rows)


def test_op7(spark, tmp_path):
    folder = save(documents(spark, texts() + texts()).repartition(3), tmp_path, "documents")
    got = sorted(map(tuple, queries.op7_mixing(spark, folder).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP7_SQL).fetchall())
    assert mixing.weighted_fair_mix(documents(spark, ["a"]).limit(0))[0].count() == 0


def test_op8(spark):
    docs = texts() + ["é" * 70_000]
    learn = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(docs))]
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = [[*(t or "").encode().translate(lower).split(), None] for t in docs]
    count = Counter(w for t, on in zip(tokens, learn) if on for w in t)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score_texts(documents(spark, docs), hash_mod("doc_id", 5) != 1, queries.tokenizer_path("byte_bpe_50k.json")).collect()}
    assert len(got) == len(docs)
    for i, t in enumerate(tokens):
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (got[i].learn, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (learn[i], len(t), sum(count[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(base, abs=1e-6) and np.isfinite(got[i].score) and got[i].score <= 0


def brute_fingerprint(text, words=4):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    w = (text or "").encode().translate(lower).split()
    s = [b" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            m = min(root[i], root[j])
            if root[i] != m or root[j] != m:
                root[i] = root[j] = m
                changed = True
    return root


def test_op9(spark):
    docs = texts() + [None, "a b", "A  b"]
    f = [brute_fingerprint(t) for t in docs]
    want = roots(len(docs), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, docs)).collect()}
    assert [(got[i].fp % 2**64, got[i].component_id) for i in range(len(docs))] == list(zip(f, want))


def test_op9_trees():
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = list({x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for x in seeds for _ in range(8)})
    values = [x for x in values if 0 <= x < 2**64]
    root = roots(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    want = {frozenset(v for v, r in zip(values, root) if r == k) for k in set(root)}
    assert {frozenset(x) for x in simhash.group(values, 4)} == {x for x in want if len(x) > 1}


def test_op9_similarity(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(400)]
        near, far = base[:], base[:]
        for p in rng.sample(range(0, 400, 10), 4):  # 20 of about 396 shingles: similarity 0.9
            near[p] = "new"
        for p in range(0, 400, 12):  # most shingles differ
            far[p] = f"f{k}"
        docs += [" ".join(x) for x in (base, near, far)]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(documents(spark, docs)).collect()}
    assert all(got[3 * k + 1] == 3 * k and got[3 * k + 2] == 3 * k + 2 for k in range(30))


def test_op10(spark):
    docs = texts() + ["\xff" * 3, "q" * 2_000_000]
    got = {r.doc_id: r for r in jpeg.read_back(jpeg.store_texts(documents(spark, docs))).collect()}
    for i, t in enumerate(docs):
        b = (t or "").encode()
        payload = b + b"\xff" * (-len(b) % 576 if b else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no jpeg")), (3, bytearray(jpeg.encode_payload(bytes(576))))], "doc_id long, media binary")
    rows = {r.doc_id: r for r in jpeg.decode_column(bad, "doc_id", "media").collect()}
    assert rows[1].rgb is None and rows[2].rgb is None and (rows[3].height, rows[3].width, len(rows[3].rgb)) == (32, 16, 1536)


def test_op10_stored_tensors(spark, tmp_path):
    """Tensors of stored files, against a plain inverse transform, upsampling and colour conversion of the payload's blocks."""
    payload = np.random.default_rng(13).integers(0, 256, 576 * 2, np.uint8)
    x = np.where(np.arange(64) > 0, 256, 0) + payload.reshape(-1, 64).astype(float)  # luma 12, chroma 3 and 3 blocks
    table = np.zeros((len(x), 64))
    table[:, jpeg.ZIGZAG] = x
    basis = np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * i + 1) * u * np.pi / 16) for i in range(8)] for u in range(8)])
    blocks = np.clip(np.rint(np.einsum("ui,nuv,vj->nij", basis, table.reshape(-1, 8, 8), basis) + 128), 0, 255)
    luma = np.block([[blocks[2 * r], blocks[2 * r + 1]] for r in range(6)])
    cb, cr = (np.vstack(list(blocks[a : a + 3])).repeat(2, 0).repeat(2, 1) - 128 for a in (12, 15))
    want = np.clip(np.rint(np.stack([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], -1)), 0, 255)
    files = spark.createDataFrame([(7, bytearray(jpeg.encode_payload(payload.tobytes())))], "doc_id long, media binary")
    [row] = jpeg.store_tensors(files, "doc_id", "media", f"{tmp_path}/tensors").collect()
    got = np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3)
    assert got.shape == want.shape and np.abs(got - want).max() <= 2 and (cb != cb[0, 0]).any()


def test_op10_bit_serial_decoder_agrees(monkeypatch):
    payload = np.random.default_rng(7).integers(0, 256, 576 * 3, np.uint8).tobytes()
    fast = jpeg.decode(jpeg.encode_payload(payload))
    monkeypatch.setattr(jpeg, "_whole", lambda *a: False)
    monkeypatch.setattr(jpeg, "_whole_column", lambda *a: False)
    assert (jpeg.decode(jpeg.encode_payload(payload)) == fast).all()


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, texts()).select(*pipeline.COLUMNS)
    doubled = docs.unionByName(docs.limit(3))
    kept = pipeline.near_duplicates(spark, doubled, "")
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == pipeline.COLUMNS and len(ids) == len(set(ids)) and not {35, 37} & set(ids) and {0, 1, 2, 34} <= set(ids)
    cut = {r.doc_id: r.text for r in pipeline.exact_repeats(spark, docs, "").collect()}
    assert cut[0] == texts()[0] and 34 not in cut
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        assert stage(spark, docs, "").count() > 0, name


def jaccard(a, b, words=5):
    a, b = ({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def near_pairs():
    """Pairs around similarity 0.8, copies with a repeated line, chains and short texts."""
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for extra in range(92, 110):  # 404 words are 400 shingles: similarity 400 / (400 + extra), 0.786 to 0.813
        base = make(404)
        out += [base, base + make(extra)]
    for _ in range(20):
        base = make(404)
        out += [base, base + make(5) * 10]
    a = make(104)
    out += [a, a + make(20), a[20:] + make(1), make(3), make(3) * 2, make(8), out[0], *(a[:k] for k in (5, 6, 7, 8, 9, 30, 60, 84, 90))]
    out += [a[:9] + make(1), a[1:9], a[:4]]
    return [" ".join(x) for x in out] + [None, "", "x"]


def test_similar_texts_are_exact(spark):
    docs = near_pairs()
    want = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(docs[i], docs[j]) >= 0.8])
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(documents(spark, docs)).collect()}
    assert [got[i] for i in range(len(docs))] == want


def test_exact_groups():
    rng = np.random.default_rng(9)
    for n in (1, 2, 40, 200):
        base = [rng.integers(0, 60, 30) for _ in range(max(n // 8, 1))]
        sets = [np.unique(np.append(base[rng.integers(len(base))][rng.random(30) < 0.95], rng.integers(0, 60, rng.integers(0, 4)))).astype(np.uint64) for _ in range(n)]
        near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
        assert simhash.exact_groups(sets, 0.8) == roots(n, [(i, j) for i in range(n) for j in range(i) if near(sets[i], sets[j])])


def test_pipeline_keeps_rows_of_equal_and_null_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    t = [" ".join(f"t{k}x{i}" for i in range(50)) for k in range(5)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (3, t[4].upper()), (None, t[3] + " end"), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (3, t[4].upper()), (9, None)], key=str)


def test_op8_counts_of_rare_words(spark, monkeypatch):
    """However few words count as common, scores are the same; classes of ids are held, as they follow the common words."""
    monkeypatch.setattr(lm.Model, "set_classes", lambda self, counts, f=lm.Model.set_classes: f(self, np.arange(lm.IDS)[::-1]))
    score = lambda: {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score_texts(documents(spark, texts()), hash_mod("doc_id", 5) != 1, queries.tokenizer_path("byte_bpe_50k.json")).collect()}
    whole = score()
    monkeypatch.setattr(lm, "COMMON_WORDS", 60)
    few = score()
    assert len(few) == len(whole) and all(few[i] == pytest.approx(whole[i], rel=1e-4, abs=1e-3) for i in whole)


def test_op8_windows():
    """Every place is scored in one window, with the 16 places before it, or all there are."""
    place = np.arange(1000)
    start = lm.window_of(place)
    assert (start <= np.maximum(place - lm.CONTEXT, 0)).all() and (place < start + lm.WINDOW).all() and (np.diff(start) >= 0).all()
    assert set(start) == set(range(0, 1000 - lm.CONTEXT, lm.WINDOW - lm.CONTEXT))


def test_op8_score_is_the_forward_pass(spark):
    """Scores against a plain forward pass, a place at a time: attention over the ids before a word, then the mixture of what each topic gives its ids."""
    docs, path = [t for t in texts() if len(t or "") < 3000], queries.tokenizer_path("byte_bpe_50k.json")
    rows = documents(spark, docs).select("doc_id", "text", (F.col("doc_id") % 3 != 0).alias("learn"))
    model, counts, n = lm.train(rows.where("learn"), path)
    got = {r.doc_id: r.score for r in lm.score_rows(rows, model, counts, n, path).collect()}
    by_word = {r.word: np.array([r[f"c{k}"] for k in range(lm.TOPICS)], float) for r in counts.collect()}
    ids_of, p = subwords.Ids(path, subwords.BYTE_LEVEL), {k: v.astype(float) for k, v in model.gate.p.items()}
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()

    def weights(before):
        """Of the topics, from the ids' classes up to a place."""
        at = len(before) - 1
        start = 0 if at < 48 else (at - 16) // 32 * 32
        e = p["emb"][before[start:]] + p["pos"][: at + 1 - start]
        a = softmax((e[-1] @ p["q"]) @ (e @ p["k"]).T / 4)
        return softmax(4 * (a @ (e @ p["v"])) @ p["out"] + p["b"])

    def chances(word, ids):
        """Logarithms for a word's ids by each topic: by its count, or else id by id."""
        c = by_word.get(word, np.zeros(lm.TOPICS))
        share = (c + 2 * c.sum() / model.total) / (model.totals + 2) * np.exp(model.counted)
        k, before = model.class_of[ids], np.append(lm.CLASSES, model.class_of[ids][:-1])
        with np.errstate(divide="ignore"):
            share = np.log(share)
        return share if word == lm.END_WORD else np.logaddexp(share, model.spare + (model.pairs.astype(float)[before * lm.CLASSES + k] + model.log_rest[ids][:, None]).sum(0))

    for i, t in enumerate(docs):
        before, total = [lm.CLASSES], 0.0
        for w in lm.text_words([(t or "").encode()])[0]:
            ids = ids_of.of_words([w])[1]
            total += np.logaddexp.reduce(np.log(weights(before)) + chances(w, ids)) / np.log(10)
            before += model.class_of[ids].tolist()
        total += np.logaddexp.reduce(np.log(weights(before)) + chances(lm.END_WORD, None)) / np.log(10)
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-3), i


def test_op8_next_ids_are_a_distribution(spark):
    """What a topic gives the next id, whatever stands before it in the word, adds up to one."""
    rows = documents(spark, texts()).select("doc_id", "text", F.lit(True).alias("learn"))
    model, _, _ = lm.train(rows, queries.tokenizer_path("byte_bpe_50k.json"))
    table = np.exp(model.pairs.astype(float)).reshape(lm.CLASSES + 1, lm.CLASSES, lm.TOPICS)
    assert np.allclose(table.sum(1), 1, atol=1e-3)
    assert np.exp(model.log_rest.astype(float))[model.class_of == lm.CLASSES - 1].sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_merges_by_rank(name):
    """What merges_by_rank rests on: ids follow the merges, and the merges of each token's own characters end in that token."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, rank = model.get("end_of_word_suffix") or "", {tuple(x): i for i, x in enumerate(model["merges"])}
    ids = [model["vocab"][a + b] for a, b in model["merges"]]
    assert ids == sorted(set(ids))
    for a, b in model["merges"]:
        token = a + b
        parts = list(token.removesuffix(suffix) if suffix else token)
        if suffix and token.endswith(suffix):
            parts[-1] += suffix
        while len(parts) > 1:
            i = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            assert (parts[i], parts[i + 1]) in rank
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    kind = subwords.LOWER_WORDS if suffix else subwords.BYTE_LEVEL
    rng = random.Random(10)
    letters = [chr(i) for i in range(1, 0x24F) if chr(i) not in "\x1c\x1d\x1e\x1f"] + ["\u0301", "\u212a", "あ", "<|startoftext|>", "'s", *"etaoin"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)] + [" ".join(t.split()) for t in map(str, [*texts_of_words()])]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not suffix
    found = subwords.Ids(path, kind)
    if suffix:
        assert [x.tolist() for x in found(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    else:
        runs = sorted({r for t in texts for r in t.split()})
        n, flat = found.of_words(runs)
        want = [tokenizer.encode(" " + r, add_special_tokens=False).ids for r in runs]
        assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def texts_of_words():
    rng = random.Random(11)
    return (" ".join("".join(rng.choice("abcdefghijklmnop'.,-0é") for _ in range(rng.randint(1, 14))) for _ in range(20)) for _ in range(200))


def test_op8_trains_on_all_texts(spark):
    """Every window of every text trains the gate, and every text its topic's mean, also of more texts than the 2,048 that a sample had."""
    rng = random.Random(11)
    docs = [" ".join([chr(97 + i % 8) * 40, "z" * (i % 7 + 1), *(f"w{rng.randrange(50)}" for _ in range(rng.randrange(3)))]) for i in range(2600)]
    docs += [" ".join(f"x{rng.randrange(300)}" for _ in range(4000)), "é" * 3000, None, " "]
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = documents(spark, docs).select("doc_id", "text", F.lit(True).alias("learn"))
    model, _, n = lm.train(rows, path)
    ids_of, windows = subwords.Ids(path, subwords.BYTE_LEVEL), 0
    for words in lm.text_words([(t or "").encode() for t in docs]):
        sizes = ids_of.of_words(words)[0]
        windows += len(set(((np.cumsum(sizes) - sizes) // lm.WINDOW).tolist()))
    assert n == len(docs) and model.gate.trained == windows > len(docs)
    means, points = lm.topic_centres(rows), np.array([lm.histogram((t or "").encode()) for t in docs])
    near = lm.topics_of(points, means)
    assert len(set(near.tolist())) == lm.TOPICS
    for k in range(lm.TOPICS):
        assert np.abs(points[near == k].mean(0) - means[k]).max() < 1e-4


def test_op8_gradient():
    """Against differences, in windows with different numbers of words."""
    rng, gate = np.random.default_rng(12), lm.Gate()
    gate.p = {k: v.astype(float) for k, v in gate.p.items()}
    x, many = rng.integers(0, lm.CLASSES + 1, (6, lm.WINDOW)).astype(np.int16), np.array([1, 3, 5, 9, 20, 30])
    place = np.stack([np.sort(rng.permutation(lm.WINDOW)[:30]) for _ in many])
    share, experts = (np.arange(30) < many[:, None]) / many.sum(), rng.standard_normal((6, 30, lm.TOPICS)) * 3
    log_sum = lambda v: np.log(np.exp(v).sum(-1))

    def loss():
        gate.made = None
        w = gate.seen(x, place) @ (4 * gate.p["out"]) + gate.p["b"]
        return ((log_sum(w) - log_sum(w + experts)) * share).sum()

    for name, g in gate.gradient(x, place, experts, share).items():
        v, i = gate.p[name], np.unravel_index(np.abs(g).argmax(), g.shape)
        around = []
        for step in (1e-4, -2e-4):
            v[i] += step
            around.append(loss())
        v[i] += 1e-4
        assert (around[0] - around[1]) / 2e-4 == pytest.approx(g[i], rel=1e-3), name


def test_op8_deals_stay_whole_in_more_tasks(spark, monkeypatch):
    """A cluster that deals keys to more partitions than asked for still gets each deal in one task, in a row, and so as few parts to train as there are deals."""
    monkeypatch.setattr(lm, "LEAST_WINDOWS", 5)
    frame, path = type(spark.range(1)), queries.tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c, f=frame.repartition: f(self, max(n, 11) if c and isinstance(n, int) else n, *c))
    rows = documents(spark, [" ".join(t.split()[:40]) for t in texts_of_words()]).select("doc_id", "text", F.lit(True).alias("learn"))
    model, counts, _ = lm.fitted(rows, path)
    held = lm.counted(rows, counts, model, spark.sparkContext.broadcast(model))
    tasks = [[r.deal for r in t] for t in held.select("deal").rdd.glom().collect()]
    runs = [d for t in tasks for i, d in enumerate(t) if i == 0 or t[i - 1] != d]
    assert sorted(runs) == list(range(lm.LEAST_PARTS)) and sum(map(len, tasks)) == 200


def test_op8_numbers_tell_the_words():
    """What is stored of a text between the steps is all of its words, in order."""
    docs = [*texts_of_words(), None, "", " \t\n", "The the THE\x0bend é\x00 zz zz yy zz", "é" * 5000, "yy  q " * 3000]
    want = lm.text_words([(t or "").encode() for t in docs])
    common = {w: i for i, w in enumerate(sorted({w for t in want for w in t[::3]}))}
    column = pa.array([t and t.encode() for t in docs], pa.binary())
    for part in (column, column.slice(150), column.slice(200, 1), column.slice(0, 0)):
        numbers, rest = lm.numbered(part, common)
        for i, (x, r) in enumerate(zip(numbers, rest.to_pylist(), strict=True), len(column) - len(part) if len(part) > 1 else 200):
            own = [*common, *r.split()]
            assert [own[k] for k in np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()] == want[i]
    broken = lm.split_words(pa.array([b"a \xff\xfeB", b"c"], pa.binary()))
    assert (broken[0].to_pylist(), broken[1].tolist()) == (["a", "\ufffd\ufffdb", "c"], [2, 1])


def test_pipeline_links_by_fingerprints(spark, monkeypatch):
    """Without any min-hash key, BK-trees of SimHash fingerprints find what differs in 4 bits at most; the sets decide."""
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(simhash, "candidates", lambda rows: rows.select(F.col("fp").alias("hi"), F.col("fp").alias("lo")).limit(0))
    rng, docs = random.Random(13), []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        docs += [" ".join(base), " ".join([*base, "more"]), " ".join([*base[:200], *(f"v{rng.randrange(10**6)}" for _ in range(200))])]
    prints = [simhash.majority([simhash.shingle_set(t.encode())]) for t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4]
    want = roots(len(docs), [(i, j) for i, j in near if jaccard(docs[i], docs[j]) >= 0.8])
    kept = sorted(r.doc_id for r in pipeline.near_duplicates(spark, documents(spark, docs).select(*pipeline.COLUMNS), "").collect())
    assert kept == sorted(set(want)) and len(kept) <= 26
