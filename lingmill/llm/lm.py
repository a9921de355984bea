"""LM scoring: a causal self-attention model on subword ids, trained and run in numpy.

Attention reads the subword ids before a word, in overlapping windows, and gives a distribution over TOPICS experts;
an expert k gives a word the share (1 - e_k) of its count among the words of its topic and e_k times the
probability of its subword ids by the topic's counts of id pairs. A text's probability is the product over its
words and its end, each a mixture of the experts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_schema, map_arrow, small_batches, table, to_batch, utf8
from .subwords import BYTE_LEVEL, Ids

IDS, END_WORD = 50_257, "\n"  # byte-level ids; no word has a line feed, so it can stand for a text's end
TOPICS, CLASSES, WIDTH = 8, 384, 16
WINDOW, CONTEXT = 48, 16  # inputs of a window, of which all but the first CONTEXT are scored; in a text's first window all
#: Every window of every training text is in one of ROUNDS rounds. Each part of about PART_WINDOWS of a round's windows (twice that at most) starts from the same weights and
#: goes through all of its own, again until it has made STEPS steps; the parts' means by windows start the next round. Corpora of few parts have up to LEAST_PARTS smaller ones.
PART_WINDOWS, ROUNDS, STEPS, BATCH, RATE, SEED = 16_384, 6, 50, 128, 0.01, 3
LEAST_PARTS, LEAST_WINDOWS = 8, 8192
COMMON_WORDS = 250_000  # words whose counts are broadcast; those of the rest come by a join, and count alike
AT_ONCE = 512


#: LOWER, and each byte of white space becomes a space.
SPACED = bytes(32 if 9 <= c <= 13 else c for c in LOWER)


def text_words(texts: list[bytes]) -> list[list[str]]:
    return [[w for w in t.translate(SPACED).decode(errors="replace").split(" ") if w] for t in texts]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """text_words() of a column: all words in a row, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    plain = (data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data else b"").translate(SPACED)
    spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain))
    try:
        spaced.validate(full=True)
    except pa.ArrowInvalid:
        spaced = pa.array([x.decode(errors="replace") for x in spaced.cast(pa.binary()).to_pylist()], pa.string())
    return parts_of(spaced)


def parts_of(joined: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What spaces separate, all in a row, and how many parts each value has; empty parts don't count."""
    parts = pc.split_pattern(joined, " ")
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    upto = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    stops = np.append(0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False)))
    return flat.filter(real), np.diff(upto[stops])


def histogram(text: bytes) -> np.ndarray:
    """Square roots of byte shares, a unit vector; zeros for an empty text."""
    h = np.zeros(256)
    for a in range(0, len(text), 1 << 22):
        h += np.bincount(np.frombuffer(text, np.uint8, min(1 << 22, len(text) - a), a), minlength=256)
    return np.sqrt(h / max(len(text), 1))


def centres(sums, rounds: int = 8) -> np.ndarray:
    """TOPICS means of the histograms of all texts (k-means): one at first; the one whose texts vary most is split along the direction they vary most in, until there are enough.

    sums: from centres, the number of texts that are nearest to each, the sums of their histograms and those of their products, two bytes' each (or None).
    """
    c = np.zeros((1, 256))
    while True:
        n, total, products = sums(c, len(c) < TOPICS)
        if not n.any():
            return np.zeros((TOPICS, 256))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if len(c) == TOPICS:
            break
        own = [np.linalg.eigh(x / max(m, 1) - np.outer(y, y)) if m else (np.zeros(1), np.zeros((256, 1))) for x, m, y in zip(products, n, c)]
        k = int(np.argmax([m * values[-1] for m, (values, _) in zip(n, own)]))
        step = np.sqrt(max(own[k][0][-1], 0)) * own[k][1][:, -1]
        c = np.concatenate([c, [c[k] + step]])
        c[k] -= step
    for _ in range(rounds - 1):
        n, total, _ = sums(c, False)
        last, c = c, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (c == last).all():
            break
    return c


def topics_of(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (points @ c.T - (c**2).sum(1) / 2).argmax(1)


def word_counts(docs: DataFrame, c: np.ndarray) -> DataFrame:
    """(word, c0 .. , c, h) of the whole texts of docs(text): counts by topic, in all, and the word's XXH64. Ends count as END_WORD."""
    names = [f"c{k}" for k in range(TOPICS)]
    schema = ", ".join(["word string", *(f"{k} long" for k in names)])
    arrow = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums, ends = [], [], np.zeros((1, TOPICS))

        def summed() -> tuple[pa.Array, np.ndarray]:
            x, n = pa.concat_arrays(words).dictionary_encode(), np.concatenate(sums)
            at = x.indices.to_numpy()
            return x.dictionary, np.stack([np.bincount(at, n[:, k], len(x.dictionary)) for k in range(TOPICS)], 1)

        def flush(x: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return to_batch({"word": x, **{k: v.astype(np.int64) for k, v in zip(names, n.T)}}, arrow)

        for b in batches:
            if b.num_rows:
                topics = topics_of(np.array([histogram(t) for t in utf8(b.column(0))]), c)
                flat, n = split_words(b.column(0))
                x = flat.dictionary_encode()
                words.append(x.dictionary)
                sums.append(np.bincount(x.indices.to_numpy() * np.int64(TOPICS) + np.repeat(topics, n), minlength=len(x.dictionary) * TOPICS).reshape(-1, TOPICS))
                ends += np.bincount(topics, minlength=TOPICS)
            if sum(map(len, words)) > 200_000:
                x, n = summed()
                words, sums = [x], [n]
                if len(x) > 100_000:
                    yield flush(x, n)
                    words, sums = [], []
        if words:
            yield flush(*summed())
        if ends.any():
            yield flush(pa.array([END_WORD]), ends)

    counts = docs.select("text").mapInArrow(each, schema).groupBy("word").agg(*(F.sum(k).alias(k) for k in names))
    return counts.withColumn("c", sum(F.col(k) for k in names)).withColumn("h", F.xxhash64("word"))


def window_of(place: np.ndarray) -> np.ndarray:
    """Start of the window that scores each place of a text: the first WINDOW places in the first, then steps of WINDOW - CONTEXT."""
    step = WINDOW - CONTEXT
    return np.where(place < WINDOW, 0, (place - CONTEXT) // step * step)


class Gate:
    """Causal self-attention over ids' classes: log weights of the experts at each place, from the ids up to it."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        shapes = {"emb": (CLASSES + 1, WIDTH), "pos": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "out": (WIDTH, TOPICS), "b": (TOPICS,)}
        self.p = {k: (rng.standard_normal(s) * 0.2).astype(np.float32) for k, s in shapes.items()}
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e4, np.float32), 1)
        self.made: tuple | None = None
        self.trained = 0  # windows

    def seen(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What attention gives at the places (n, k) of the windows x (n, WINDOW), by queries, keys and values of the classes and places made once."""
        if self.made is None:
            p = self.p
            keys, query = np.concatenate([p["k"], p["v"]], 1), p["q"] / np.float32(np.sqrt(WIDTH))
            one = np.ones((CLASSES + 1, 1), keys.dtype)  # sums come with the products
            self.made = p["emb"] @ query, p["pos"] @ query, np.concatenate([p["emb"] @ keys, one], 1), np.pad(p["pos"] @ keys, ((0, 0), (0, 1)))
        q = self.made[0][np.take_along_axis(x, place, 1)]
        q += self.made[1][place]
        y = self.made[2][x]
        y += self.made[3]
        a = q @ y[..., :WIDTH].transpose(0, 2, 1)
        a += self.mask[place]
        np.exp(a, out=a)
        h = a @ y[..., WIDTH:]
        return h[..., :WIDTH] / h[..., WIDTH:]

    def log_weights(self, h: np.ndarray) -> np.ndarray:
        """(TOPICS, places), but for what all topics of a place have in common."""
        return (4 * self.p["out"]).T @ h.T + self.p["b"][:, None]

    def train(self, x: np.ndarray, many: np.ndarray, place: np.ndarray, experts: np.ndarray, done: int = 0) -> None:
        """x: classes (n, WINDOW); many: how many words start in each window; place, experts: of these words in a row, the place before and the log probabilities (TOPICS).

        Adam over all windows, in random order, after `done` of ROUNDS rounds; over all again while that is less than STEPS steps.
        """
        n = len(x)
        size = min(BATCH, n)
        steps = max(-(-n // BATCH), STEPS)
        rng, first = np.random.default_rng(SEED + done), np.cumsum(many) - many
        order = np.concatenate([rng.permutation(n) for _ in range(-(-steps * size // n))])
        flat = np.concatenate([v.ravel() for v in self.p.values()])  # all weights in a row, so that a step is a few operations
        stops = np.cumsum([v.size for v in self.p.values()])
        self.p = {k: v.reshape(self.p[k].shape) for k, v in zip(self.p, np.split(flat, stops[:-1]))}
        m = u = np.zeros_like(flat)
        for step in range(1, steps + 1):
            r = order[(step - 1) * size : step * size]
            r = r[np.argsort(many[r], kind="stable")]  # windows with like numbers of words together
            g, words = 0, max(many[r].sum(), 1)
            for own in np.array_split(r, min(4, len(r))):
                k = np.arange(many[own[-1]])
                at = first[own, None] + np.minimum(k, many[own, None] - 1)
                of = self.gradient(x[own], place[at], experts[at], (k < many[own, None]) / np.float32(words))
                g = g + np.concatenate([of[c].ravel() for c in self.p])
            rate = RATE * (1 - 0.9 * (done + step / steps) / ROUNDS)
            m, u = 0.9 * m + 0.1 * g, 0.99 * u + 0.01 * g**2
            flat -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)).astype(flat.dtype)
        self.made = None

    def gradient(self, x: np.ndarray, place: np.ndarray, experts: np.ndarray, share: np.ndarray) -> dict:
        """Of the mean of -log of the mixtures, at the places (n, k) of the windows x (n, WINDOW); experts: (n, k, TOPICS); share: of each place in the mean."""
        p, root = self.p, np.float32(1 / np.sqrt(WIDTH))
        maps = np.concatenate([p["q"] * root, p["k"], p["v"]], 1)  # of a class or a place to its query, key and value
        inputs = p["emb"][x]
        inputs += p["pos"]
        flat = inputs.reshape(-1, WIDTH)
        y = np.empty((*x.shape, 3 * WIDTH + 1), flat.dtype)  # the last column is 1: sums come with the products
        np.matmul(flat, maps, out=y.reshape(len(flat), -1)[:, :-1])
        y[..., -1] = 1
        k, v = y[..., WIDTH : 2 * WIDTH], y[..., 2 * WIDTH :]
        at = (np.arange(len(x))[:, None] * WINDOW + place).ravel()
        q = flat[at] @ maps[:, :WIDTH]
        q = q.reshape(*place.shape, WIDTH)
        a = q @ k.transpose(0, 2, 1)
        a += self.mask[place]
        np.exp(a, out=a)
        h = (a @ v).reshape(-1, WIDTH + 1)
        real = np.flatnonzero(share.ravel() > 0)
        h, by = h[real, :WIDTH], 1 / h[real, WIDTH:]
        h *= by
        w = (4 * p["out"]).T @ h.T  # (TOPICS, places)
        w += p["b"][:, None]
        post = w + experts.reshape(-1, TOPICS)[real].T
        for z in (w, post):
            z -= z.max(0)
            np.exp(z, out=z)
            z /= z.sum(0)
        w -= post
        w *= share.ravel()[real]
        g = {"out": 4 * (h.T @ w.T), "b": w.sum(1)}
        dh = w.T @ (4 * p["out"]).T
        dh *= by
        of_a = np.zeros((len(at), WIDTH + 1), dh.dtype)
        of_a[real, :WIDTH], of_a[real, WIDTH] = dh, -np.einsum("ij,ij->i", dh, h)
        of_a = of_a.reshape(*place.shape, WIDTH + 1)
        ds = of_a @ v.transpose(0, 2, 1)
        ds *= a
        dy = np.empty((*x.shape, 3 * WIDTH), dh.dtype)
        dy[..., :WIDTH] = 0
        np.matmul(ds.transpose(0, 2, 1), q, out=dy[..., WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), of_a[..., :WIDTH], out=dy[..., 2 * WIDTH :])
        dy = dy.reshape(len(flat), -1)
        dy[at[real], :WIDTH] = (ds @ k).reshape(-1, WIDTH)[real]
        of_maps = flat.T @ dy
        back = dy @ maps.T
        cells = np.arange((CLASSES + 1) * WIDTH).reshape(-1, WIDTH)[x]
        emb = np.bincount(cells.ravel(), weights=back.ravel(), minlength=(CLASSES + 1) * WIDTH).reshape(-1, WIDTH).astype(back.dtype)
        return g | {"q": of_maps[:, :WIDTH] * root, "k": of_maps[:, WIDTH : 2 * WIDTH], "v": of_maps[:, 2 * WIDTH :], "emb": emb, "pos": back.reshape(inputs.shape).sum(0)}


class Model:
    """Counts, experts and gate. The size is fixed by COMMON_WORDS, TOPICS and CLASSES."""

    def __init__(self, words: pa.Array, by_topic: np.ndarray, totals: np.ndarray, distinct: int, once: int):
        """by_topic: counts (words, TOPICS) of the common words; totals: of all words, by topic; once: how many words have count 1."""
        self.words, self.total, self.distinct = words, float(totals.sum()), distinct
        self.totals = totals
        self.base = np.append(np.log10((by_topic.sum(1) + 0.5) / (self.total + 0.5 * (distinct + 1))), 0.0)
        # what the spelling gets: the share of unseen words (Good and Turing)
        spare = np.clip(np.full(TOPICS, once / max(self.total, 1)), 0.02, 0.98)
        self.counted = np.log(1 - spare)
        self.common = np.concatenate([self.count_rows(by_topic), np.full((1, TOPICS), -np.inf, np.float32)])
        self.spare, self.gate = np.log(spare).astype(np.float32), Gate()

    def count_rows(self, by_topic: np.ndarray) -> np.ndarray:
        """Log probabilities (words, TOPICS) by the words' counts alone, of common words or others; words without a count have none."""
        smooth = by_topic + 2.0 * by_topic.sum(1, keepdims=True) / max(self.total, 1)
        with np.errstate(divide="ignore"):
            return (np.log(smooth / (self.totals + 2)) + self.counted).astype(np.float32)

    def set_classes(self, counts: np.ndarray) -> None:
        """The commonest ids are classes of their own."""
        top = np.argsort(-counts, kind="stable")[: CLASSES - 1]
        self.class_of = np.full(IDS, CLASSES - 1, np.int16)
        self.class_of[top] = np.arange(len(top))

    def set_ids(self, counts: np.ndarray) -> None:
        """The other ids share the last class by their counts."""
        rest = np.where(self.class_of == CLASSES - 1, counts + 0.5, 0)
        self.log_rest = np.log(np.where(rest > 0, rest / rest.sum(), 1)).astype(np.float32)

    def set_pairs(self, pairs: np.ndarray) -> None:
        """pairs: (TOPICS, CLASSES + 1, CLASSES) counts of ids after the id before in a word; row CLASSES: at a word's start."""
        whole = pairs.sum(0)
        back = (whole.sum(0) + 0.5) / (whole.sum() + 0.5 * CLASSES)
        whole = (whole + 20 * back) / (whole.sum(1, keepdims=True) + 20)
        by_topic = (pairs + 20 * whole) / (pairs.sum(2, keepdims=True) + 20)
        self.pairs = np.ascontiguousarray(np.log(by_topic).reshape(TOPICS, -1).T).astype(np.float32)

    def experts(self, counted: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probabilities (words, TOPICS); counted: the words' count_rows; starts: of each word's ids."""
        c = self.class_of[ids].astype(np.int64)
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[starts] = CLASSES
        by_ids = np.add.reduceat(self.pairs[before * CLASSES + c] + self.log_rest[ids, None], starts, axis=0) + self.spare
        return np.logaddexp(counted, by_ids)

    def spell(self, words: list[str], counted: np.ndarray, ids_of: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the number of ids, all ids' classes in a row, and the experts (words, TOPICS): none of them depends on the context."""
        sizes, flat = ids_of.of_words(words)
        stops, rows = np.append(0, sizes.cumsum()), []
        for a in range(0, len(words), 4096):
            own = stops[a : a + 4097]
            rows.append(self.experts(counted[a : a + 4096], flat[own[0] : own[-1]], own[:-1] - own[0]))
        return sizes, self.class_of[flat], np.concatenate(rows) if rows else np.zeros((0, TOPICS), np.float32)

    def spell_common(self, ids_of: Ids) -> None:
        """What the common words' lookups give; the text's end comes last, with no ids."""
        is_end = pc.equal(self.words, END_WORD).to_numpy(zero_copy_only=False)
        self.index, self.words = np.flatnonzero(~is_end), self.words.filter(pa.array(~is_end))
        self.sizes, self.classes, self.rows = self.spell(self.words.to_pylist(), self.common[self.index], ids_of)
        self.end_row = self.common[np.flatnonzero(np.append(is_end, True))[0]]


def hashes(words: list[str]) -> np.ndarray:
    """XXH64 as in word_counts."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


def looked_up(found: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """From structs (h, c0 ..): the hashes in order, and their counts (words, TOPICS), whose last row is that of unseen words."""
    h, *c = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
    h, first = np.unique(h, return_index=True)
    return h, np.concatenate([np.stack(c, 1)[first], np.zeros((1, TOPICS))])


def numbered(texts: pa.Array, common: dict[str, int]) -> tuple[list[bytes], pa.Array]:
    """Each text as numbers, from which and the common words (and their places) its words can be told again: that of a common word is its place among them, those of
    a text's other words follow. Four bytes each, first all lowest bytes, which packs well; and the other words, joined by spaces."""
    flat, n = split_words(texts)
    x = flat.dictionary_encode()
    code, stops = x.indices.to_numpy(), np.append(0, np.cumsum(n))
    number = np.array([*map(common.get, x.dictionary.to_pylist(), repeat(-1))], np.int64)[code]
    other = np.flatnonzero(number < 0)
    owner = np.searchsorted(stops, other, "right") - 1
    key, at = np.unique(owner * max(len(x.dictionary), 1) + code[other], return_inverse=True)
    begin = np.searchsorted(key, np.arange(len(n) + 1) * max(len(x.dictionary), 1))  # of each text's other words
    number[other] = len(common) + at - begin[owner]
    names = x.dictionary.take(pa.array(key % max(len(x.dictionary), 1)))
    rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), names), " ")
    raw = number.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [raw[a:b].T.tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())], rest


class Scorer:
    """What a Python worker needs besides the model: the common words' numbers and the tokenizer."""

    def __init__(self, model: Model, tokenizer: str):
        self.model, self.ids_of = model, Ids.of(tokenizer, BYTE_LEVEL)
        self.begins = np.cumsum(model.sizes) - model.sizes

    def inputs(self, numbers: pa.Array, rest: pa.Array, found: pa.StructArray):
        """How many words each text has; number of each word (from that of the common ones on: others, as they come), those others' counts, ids of each word, all ids' classes, experts (words, TOPICS).

        numbers, rest: from numbered(); found: structs of all others that have counts.
        """
        m = self.model
        planes = [np.frombuffer(x, np.uint8).reshape(4, -1) for x in numbers.to_pylist()]
        n_words = np.array([x.shape[1] for x in planes], np.int64)
        number = np.ascontiguousarray(np.concatenate([*planes, np.zeros((4, 0), np.uint8)], 1).T).view("<u4").ravel().astype(np.int64)
        n, (others, n_others) = len(m.sizes), parts_of(rest)
        rare = number >= n
        number[rare] += np.repeat(np.cumsum(n_others) - n_others, n_words)[rare]
        others, (known, counts) = others.to_pylist(), looked_up(found)
        if len(known):
            h = hashes(others)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            counts = counts[np.where(known[at] == h, at, len(known))]
        else:
            counts = np.zeros((len(others), TOPICS))
        sizes, classes, rows = m.spell(others, m.count_rows(counts), self.ids_of)
        common, other = number[~rare], number[rare] - n
        size, begin, out = np.empty(len(number), np.int64), np.empty(len(number), np.int64), np.empty((len(number), TOPICS), np.float32)
        size[~rare], begin[~rare], out[~rare] = m.sizes[common], self.begins[common], m.rows[common]
        size[rare], begin[rare], out[rare] = sizes[other], len(m.classes) + (np.cumsum(sizes) - sizes)[other], rows[other]
        stops = np.cumsum(size)
        take = np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin - stops + size, size)
        return n_words, number, counts.sum(1), size, np.concatenate([m.classes, classes])[take], out

    def windows(self, numbers: pa.Array, rest: pa.Array, found: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What Gate.train() takes: the texts in windows one after the other, each word in that of the place before it. Windows where no word starts have nothing to learn from."""
        n_words, _, _, size, classes, rows = self.inputs(numbers, rest, found)
        owner, upto = np.repeat(np.arange(len(n_words)), n_words), np.append(0, np.cumsum(size))
        words_end = np.cumsum(n_words)
        ids = upto[words_end] - upto[words_end - n_words]
        begin = np.cumsum(ids + 1) - ids - 1  # of each text's start in a row of all
        seq = np.full(len(classes) + len(n_words) + WINDOW, CLASSES, np.int16)
        inside = np.ones(len(seq), bool)
        inside[begin] = False
        inside[len(seq) - WINDOW :] = False
        seq[inside] = classes
        place = upto[:-1] - (upto[words_end - n_words])[owner]
        start = begin[owner] + place // WINDOW * WINDOW
        first = np.flatnonzero(np.append(True, start[1:] != start[:-1])) if len(start) else start
        many = np.diff(np.append(first, len(start)))
        return seq[start[first, None] + np.arange(WINDOW)], many, place % WINDOW, rows

    def score(self, numbers: pa.Array, rest: pa.Array, found: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text, how many words it has, the words' numbers, and the counts behind numbers from that of the common ones on."""
        m = self.model
        n_words, number, others, size, classes, rows = self.inputs(numbers, rest, found)
        word_ends = np.cumsum(n_words)
        ids_upto = np.append(0, np.cumsum(size))
        sizes = ids_upto[word_ends] - ids_upto[word_ends - n_words] + 1
        # the ids of a text behind one start; place p of that sequence is the input before id p, or before the end
        begins = np.cumsum(sizes) - sizes
        seq = np.full(int(sizes.sum()) + WINDOW, CLASSES, np.int16)
        owner = np.repeat(np.arange(len(n_words)), n_words)
        starts = ids_upto[:-1] + owner  # the place before each word
        inside = np.ones(len(seq), bool)
        inside[begins] = False
        inside[len(seq) - WINDOW :] = False
        seq[inside] = classes
        asked = np.zeros(len(seq), bool)  # places before a word, or before an end
        asked[starts] = True
        asked[begins + sizes - 1] = True
        at = np.flatnonzero(asked)
        begin = np.repeat(begins, n_words + 1)
        start = window_of(at - begin) + begin
        seen = np.empty((len(at), WIDTH), np.float32)
        first = np.flatnonzero(np.append(True, start[1:] != start[:-1])) if len(at) else at  # of a window's places
        many = np.diff(np.append(first, len(at)))
        order = np.argsort(many, kind="stable")  # windows with like numbers of places together
        for b in range(0, len(order), AT_ONCE):
            w = order[b : b + AT_ONCE]
            k = np.arange(many[w[-1]])
            own = first[w, None] + np.minimum(k, many[w, None] - 1)  # the last place again fills up
            h = m.gate.seen(seq[start[first[w], None] + np.arange(WINDOW)], at[own] - start[own])
            take = k < many[w, None]
            seen[own[take]] = h[take]
        # a column of experts for each asked place: the words of a text, then its end
        total = len(number) + len(n_words)
        ends = np.cumsum(n_words + 1) - 1
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        own = np.empty((TOPICS, total), np.float32)
        own[:, ~is_end] = rows.T
        own[:, is_end] = m.end_row[:, None]
        weights = m.gate.log_weights(seen)
        logs = _lse(weights + own) - _lse(weights)
        logs = np.where(np.isfinite(logs), logs, np.log(0.5 / (m.total + 0.5 * (m.distinct + 1))))
        return np.add.reduceat(logs.astype(np.float64), ends - n_words) / np.log(10) if len(ends) else np.zeros(0), n_words, number, others


def _lse(x: np.ndarray) -> np.ndarray:
    """log of the sums of exponentials along the first axis."""
    top = x.max(0)
    top[~np.isfinite(top)] = 0
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(0))


def _sums(df: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all rows of f(batch), an array of `size` longs: by task, then by 16 tasks, then here."""
    schema = "sums binary"
    arrow = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                s += f(b)
        if s.any():
            yield to_batch({"sums": [zlib.compress(s.tobytes(), 1)]}, arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                s += np.frombuffer(zlib.decompress(x), np.int64)
        if s.any():
            yield to_batch({"sums": [zlib.compress(s.tobytes(), 1)]}, arrow)

    return sum((np.frombuffer(zlib.decompress(r.sums), np.int64) for r in df.mapInArrow(count, schema).repartition(16).mapInArrow(add, schema).collect()), np.zeros(size, np.int64))


def fit(learn: DataFrame, counts: DataFrame, tokenizer: str) -> Model:
    """The model but for its gate: word counts by topic, ids' counts and pairs (from each distinct word, times its count), of every training text."""
    names = [f"c{k}" for k in range(TOPICS)]
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    common = common_words(counts).select("word", "c", *names).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    by_topic = np.stack([common.column(c).to_numpy() for c in names], 1).astype(float)
    model = Model(common.column(0).combine_chunks(), by_topic, np.array([totals[c] for c in names], float), totals.v, totals.once)

    def spelled(b: pa.RecordBatch) -> dict:
        n, ids = Ids.of(tokenizer, BYTE_LEVEL).of_words(b.column(0).to_pylist())
        return {"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))} | {c: b.column(c) for c in names}

    def parts(b: pa.RecordBatch):
        n, ids = b.column(0).value_lengths().to_numpy(zero_copy_only=False), b.column(0).flatten().to_numpy(zero_copy_only=False)
        return ids, n, np.stack([b.column(i).to_numpy() for i in range(1, 1 + TOPICS)], 1)

    # every distinct word's ids; then classes by the counts of all ids, then pairs
    small_batches(learn.sparkSession, 20_000)
    own = counts.where(F.col("word") != END_WORD).select("word", *names)
    own = table(map_arrow(own, spelled, ", ".join(["ids array<int>", *(f"{c} long" for c in names)])), "spelled")
    size = (CLASSES + 1) * CLASSES

    def id_counts(b: pa.RecordBatch) -> np.ndarray:
        ids, n, c = parts(b)
        return np.bincount(ids, weights=np.repeat(c.sum(1), n), minlength=IDS).astype(np.int64)

    def pair_counts(b: pa.RecordBatch) -> np.ndarray:
        ids, n, c = parts(b)
        k = model.class_of[ids].astype(np.int64)
        before = np.empty_like(k)
        before[1:] = k[:-1]
        before[np.cumsum(n) - n] = CLASSES
        return np.concatenate([np.bincount(before * CLASSES + k, weights=np.repeat(c[:, t], n), minlength=size) for t in range(TOPICS)]).astype(np.int64)

    by_id = _sums(own, id_counts, IDS).astype(float)
    model.ids = int(by_id.sum())
    model.set_classes(by_id)
    pairs = _sums(own, pair_counts, TOPICS * size).astype(float)
    small_batches(learn.sparkSession)
    model.set_ids(by_id)
    model.set_pairs(pairs.reshape(TOPICS, CLASSES + 1, CLASSES))
    model.spell_common(Ids.of(tokenizer, BYTE_LEVEL))
    return model


def train_gate(held: DataFrame, shared, tokenizer: str) -> Gate:
    """The gate, from held(numbers, rest, found, turn, deal), see counted(): every window of every text.

    The texts are dealt to rounds and parts by a hash, whatever task reads them. In a round each task cuts its texts to windows and trains
    its parts, all from the same weights; the driver gets no more than their means, summed in 16 tasks first. How many parts there are grows with the corpus.
    """
    schema = "n double, w binary"
    arrow = arrow_schema(schema)
    small_batches(held.sparkSession, 200)  # a batch's words and windows are many times its size
    gate, empty = Gate(), {c: v.shape for c, v in Gate().p.items()}
    for done in range(ROUNDS):
        weights = gate.p

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, own, last, n, flat = Scorer(shared.value, tokenizer), [], None, 0, 0.0

            def part(most: int) -> None:
                """Train on the first `most` of the windows at hand; the rest stays."""
                nonlocal n, flat
                x, many, place, experts = (np.concatenate(v) for v in zip(*own))
                words, gate = many[:most].sum(), Gate()
                own[:] = [(x[most:], many[most:], place[words:], experts[words:])] if len(x) > most else []
                gate.p = weights
                gate.train(x[:most], many[:most], place[:words], experts[:words], done)
                n, flat = n + len(x[:most]), flat + len(x[:most]) * np.concatenate([v.ravel() for v in gate.p.values()]).astype(float)

            for b in batches:
                deal = b.column(3).to_numpy()
                cuts = np.flatnonzero(np.diff(deal)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(deal)]):
                    if hi > lo:
                        if own and deal[lo] != last:
                            part(2 * PART_WINDOWS)
                        last = deal[lo]
                        numbers, rest, found = (b.column(k)[lo:hi] for k in range(3))
                        if len((x := scorer.windows(numbers, rest, found.flatten()))[0]):
                            own.append(x)
                        while sum(len(x[0]) for x in own) >= 2 * PART_WINDOWS:
                            part(2 * PART_WINDOWS)
            if own:
                part(2 * PART_WINDOWS)
            if n:
                yield to_batch({"n": [float(n)], "w": [flat.tobytes()]}, arrow)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, w = 0.0, 0.0
            for b in batches:
                for m, x in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    n, w = n + m, w + np.frombuffer(x)
            if n:
                yield to_batch({"n": [n], "w": [w.tobytes()]}, arrow)

        turned = held.where(F.col("turn") == done).select("numbers", "rest", "found", "deal")
        sums = sorted((r.n, bytes(r.w)) for r in turned.mapInArrow(step, schema).repartition(16).mapInArrow(add, schema).collect())
        if not sums:
            continue
        windows = sum(n for n, _ in sums)
        flat, at = sum(np.frombuffer(w) for _, w in sums) / windows, 0
        gate.trained += int(windows)
        gate.p = {}
        for k, shape in empty.items():
            size = int(np.prod(shape))
            gate.p[k], at = flat[at : at + size].reshape(shape).astype(np.float32), at + size
    return gate


def counted(rows: DataFrame, counts: DataFrame, model: Model, shared) -> DataFrame:
    """rows(doc_id, learn, text) as doc_id, learn, the text's words as numbers and rest (see numbered()), found: the counts of the words that aren't common, structs (h, c0 ..); turn and deal.

    Rows meet them by a hash of doc_id and text; two that share one get each other's too, which change nothing. That hash deals
    the rows to rounds and parts, too: those with the same `deal` are in one task, one after the other, however many tasks there are;
    how many deals there are, the model's windows say.
    """
    windows = model.ids // WINDOW
    deals = max(1, -(-windows // (ROUNDS * PART_WINDOWS)), min(LEAST_PARTS, windows // LEAST_WINDOWS))
    names = [f"c{k}" for k in range(TOPICS)]
    texts = rows.select("doc_id", "learn", "text", F.xxhash64("doc_id", "text").alias("row"))

    common: dict[str, int] = {}  # made once a task

    def each(b: pa.RecordBatch) -> dict:
        if not common:
            common.update((w, i) for i, w in enumerate(shared.value.words.to_pylist()))
        numbers, rest = numbered(b.column(2), common)
        return {"doc_id": b.column(0), "learn": b.column(1), "row": b.column(3), "numbers": numbers, "rest": rest}

    texts = table(map_arrow(texts, each, "doc_id long, learn boolean, row long, numbers binary, rest string"), "numbered")
    pairs = texts.where("rest <> ''").select("row", F.explode(F.split("rest", " ")).alias("word")).select("row", F.xxhash64("word").alias("w"))
    found = pairs.join(counts.select("h", *names), F.col("w") == F.col("h")).select("row", F.struct("h", *names).alias("f"))
    both = texts.select("row", F.struct("doc_id", "learn", "numbers", "rest").alias("own")).unionByName(found, allowMissingColumns=True)
    both = both.withColumn("turn", F.pmod(F.xxhash64("row"), F.lit(ROUNDS)).cast("int")).withColumn("deal", F.pmod(F.hash("row"), F.lit(deals)).cast("int"))
    whole = both.repartitionById(deals, F.col("deal")).groupBy("deal", "turn", "row").agg(F.collect_list("own").alias("own"), F.collect_list("f").alias("found"))
    return whole.select("deal", "turn", "row", "found", F.inline("own")).sortWithinPartitions("deal", "turn", "row").drop("row")


def common_words(counts: DataFrame) -> DataFrame:
    """About COMMON_WORDS of the words, those of the highest counts, by levels of counts (64 to a doubling), so no task sorts them; of the last level a part, by hash."""
    level, room = F.floor(64 * F.log2("c")), COMMON_WORDS
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if r.n > room:
            return counts.where((level > r.level) | (level == r.level) & (F.col("h") < int(-(2**63) + room / r.n * 2**64)))
        room -= r.n
    return counts


def topic_centres(learn: DataFrame) -> np.ndarray:
    """centres() of all texts of learn(text); only sums come to the driver."""
    points = table(map_arrow(learn.select("text"), lambda b: {"p": [histogram(t).astype(np.float32).tobytes() for t in utf8(b.column(0))]}, "p binary"), "histograms")
    upper = np.triu_indices(256)

    def sums(c: np.ndarray, products: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        def one(b: pa.RecordBatch) -> np.ndarray:
            h = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, 256)
            topics = topics_of(h, c)
            own = np.eye(len(c))[topics]
            both = [(x.T @ x)[upper] for x in (h[topics == k] for k in range(len(c)))] if products else []
            return np.concatenate([own.sum(0), *(np.rint(x * (1 << 20)).ravel() for x in (own.T @ h, *both))]).astype(np.int64)

        k = len(c)
        x = _sums(points, one, k * (257 + products * len(upper[0]))).astype(float)
        n, total, rest = x[:k], x[k : 257 * k].reshape(k, 256) / (1 << 20), x[257 * k :].reshape(-1, len(upper[0])) / (1 << 20)
        if not products:
            return n, total, None
        full = np.zeros((k, 256, 256))
        full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = rest
        return n, total, full

    return centres(sums)


def fitted(learn: DataFrame, tokenizer: str) -> tuple[Model, DataFrame, int]:
    """As train(), without the gate."""
    n_texts = learn.count()
    counts = table(word_counts(learn.select("text"), topic_centres(learn)), "words")
    return fit(learn, counts, tokenizer), counts, n_texts


def train(learn: DataFrame, tokenizer: str) -> tuple[Model, DataFrame, int]:
    """From learn(doc_id, learn, text): the model with its gate, the table of word counts and the number of texts."""
    model, counts, n_texts = fitted(learn, tokenizer)
    shared = learn.sparkSession.sparkContext.broadcast(model)
    model.gate = train_gate(table(counted(learn, counts, model, shared), "held"), shared, tokenizer)
    shared.unpersist()
    return model, counts, n_texts


def score_texts(docs: DataFrame, learn: F.Column, tokenizer: str) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text, ...).

    Tokens are words (A-Z lower-cased, cut at 0x20 and 0x09-0x0D) and one end. base_score: log10 of their add-half
    unigram probabilities, with counts of the texts where `learn` holds. score: log10 probability of the text by
    the attention model. Null text is empty: its end alone. No training texts: counts of zero. Rows that repeat are
    scored one by one.

    Counts of the COMMON_WORDS commonest words are broadcast; other words meet their counts in a join on a 64-bit
    hash, and each text gets those of its own words before it is scored. Every text is read whole; its overlapping windows score each place once.
    """
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    model, counts, n_texts = fitted(base.where("learn"), tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = table(counted(base, counts, model, shared), "held")
    model.gate = train_gate(held.where("learn"), shared, tokenizer)
    shared.unpersist()
    return _scored(held, model, n_texts, tokenizer)


def score_rows(rows: DataFrame, model: Model, counts: DataFrame, n_texts: int, tokenizer: str) -> DataFrame:
    """As score_texts, for rows(doc_id, text, learn) and what train() gave."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return _scored(counted(rows, counts, model, shared), model, n_texts, tokenizer)


def _scored(held: DataFrame, model: Model, n_texts: int, tokenizer: str) -> DataFrame:
    """score_texts() of held(doc_id, learn, numbers, rest, found), see counted()."""
    small_batches(held.sparkSession, 200)
    shared = held.sparkSession.sparkContext.broadcast(model)
    scored = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored_arrow = arrow_schema(scored)
    end = float(np.log10((n_texts + 0.5) / (model.total + 0.5 * (model.distinct + 1))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, below = Scorer(m, tokenizer), np.log10(m.total + 0.5 * (m.distinct + 1))
        base_of = m.base[:-1][m.index]
        for b in batches:
            if not b.num_rows:
                continue
            score, n, number, counts = scorer.score(b.column(2), b.column(3), b.column(4).flatten())
            at = np.cumsum(n) - n
            known = np.append(np.concatenate([np.ones(len(base_of), bool), counts > 0])[number], False)
            sums = np.append(np.concatenate([base_of, np.log10(counts + 0.5) - below])[number], 0.0)
            edges = np.stack([at, at + n], 1).ravel()
            add = lambda x: np.where(n > 0, np.add.reduceat(x, edges)[::2], 0)
            yield to_batch({"doc_id": b.column(0), "learn": b.column(1), "n_tokens": n + 1, "n_known": add(known.astype(np.int64)) + int(n_texts > 0), "train_tokens": np.full(len(n), int(m.total)), "base_score": add(sums) + end, "score": score}, scored_arrow)

    return held.select("doc_id", "learn", "numbers", "rest", "found").mapInArrow(each, scored)
