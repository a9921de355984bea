"""Suffix-array dedup: repeated 200-byte strings from merged Burrows-Wheeler transforms of shards.

Every window of LENGTH bytes belongs to the run of windows around it that have the same smallest K-gram hash
(winnowing), so equal windows have equal keys, wherever they stand. Runs whose key occurs once can't hold a
repeat. The text of the other runs, equal ones once, goes to tasks by key; a task makes the transform of each of
its shards and merges them by interleave refinement (Holt and McMillan, 2014): the interleave of the shards'
suffixes, sorted to a depth of p symbols, gives that of depth p + 1 by reading the transforms in its order and
dealing each shard number to its symbol's bucket. Where a boundary between neighbours first shows is their
common prefix; blocks that are still undivided at LENGTH bytes are the repeated intervals. No suffix is sorted
again.

A key whose segments fill more than a shard is split first: the gram stands equally far behind the start of equal
windows, so a run's windows are dealt by that distance, WIDTHS[0] distances together, and what all windows of such a part
cover is hashed into the key of the part. Parts with a key of their own go; keys that are still too large are
split by the next width. At width 1 a part is one window and its key names its text, so every key ends small.

Symbols are SYMBOL bytes wide: a segment is read as SYMBOL interleaved strings, one for each residue, so the
merge takes LENGTH / SYMBOL rounds. Symbols are exact ranks: 8 bytes are packed, wider ones are ranked in pairs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, small_batches, table, to_batch, utf8

LENGTH, SYMBOL = 200, 40
K = 64  # bytes of a winnowing gram
SEEN = 200_000  # segments that a task knows it has sent
CHUNK, PLACE, TASK_BYTES, SHARD_BYTES = 1 << 18, 19, 1 << 20, 1 << 18
WIDTHS = 44, 11, 1  # distances of a gram from the start of its windows that a part of a run holds
_B = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(8)]


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all k-grams of bytes x; k is a power of two."""
    h, n = x.astype(np.uint64) + np.uint64(1), 1
    while n < k:
        h = h[:-n] * _B[n.bit_length() - 1] + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if w > n else h


def runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each run: of windows with the same leftmost place of the smallest gram hash.

    A hash is cut to 45 bits and its place put below, so one minimum gives both. Runs end at multiples of CHUNK
    too, which only splits them.
    """
    first, count, key = [], [], []
    for a in range(0, len(text) - length + 1, CHUNK):
        x = np.frombuffer(text, np.uint8)[a : a + CHUNK + length - 1]
        h = gram_hashes(x, K) >> np.uint64(PLACE) << np.uint64(PLACE)
        m = sliding_min(h | np.arange(len(h), dtype=np.uint64), length - K + 1)
        at = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        first.append(at + a)
        count.append(np.diff(np.append(at, len(m))))
        key.append((m[at] >> np.uint64(PLACE)).view(np.int64))
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(count), np.concatenate(key)


def parts(text: bytes, v: int, width: int, length: int = LENGTH) -> list[tuple[int, int, int, bytes]]:
    """(first window, number of windows, key, text) of each part of a run with key v, of windows whose gram stands `width` near distances behind their start.

    Equal windows have equal keys and distances, so their parts have equal keys too.
    """
    gram = int(np.argmin(gram_hashes(np.frombuffer(text, np.uint8)[:length], K) >> np.uint64(PLACE)))
    n, out = len(text) - length + 1, []
    for low in range(0, length - K + 1, width):
        high = min(low + width, length - K + 1)
        a, z = max(gram - high + 1, 0), min(gram - low + 1, n)
        if a < z:
            shared = text[gram - low : gram - high + 1 + length]
            key = xxhash.xxh3_64_intdigest(b"%d %d %d " % (v, low, high) + shared) - (1 << 63)
            out.append((a, z - a, key, text[a : z + length - 1]))
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.concatenate([[1], (x[order[1:]] != x[order[:-1]]).astype(np.int64)]).cumsum() if len(x) else x
    return out


def symbols(segments: list[bytes], length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense symbol ranks (from 1) of all places of the joined segments, 0 where fewer than `width` bytes are left; segment starts; sizes."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.cumsum(sizes + 1) - sizes - 1  # a byte between segments: each of a segment's strings ends in one place of rank 0
    x = np.frombuffer(b"\0".join(segments) + bytes(width + 1), np.uint8)
    n = len(x) - width
    w = min(width, 8)
    s = np.zeros(n + width - w, np.uint64)
    for i in range(w):
        s = s << np.uint64(8) | x[i : len(x) - w + i]
    rank = _ranks(s.view(np.int64))
    while w < width:  # from two ranks of w bytes, which may overlap, one of up to 2 w
        more = min(w, width - w)
        rank = _ranks(rank[: len(rank) - more] * np.int64(len(rank) + 1) + rank[more:])
        w += more
    rank = rank[:n]
    tail = np.zeros(n + 1, np.int64)
    np.add.at(tail, np.maximum(starts, starts + sizes - width + 1), 1)
    np.add.at(tail, starts + sizes + 1, -1)
    rank[tail[:-1].cumsum() > 0] = 0
    return rank, starts, sizes


class Shard:
    """The transform of some segments: the symbol before each suffix, in the order of the suffixes to a depth of `rounds` symbols."""

    def __init__(self, rank: np.ndarray, first: np.ndarray, base: int, rounds: int, width: int):
        n = len(rank)
        order_of = rank.copy()  # ranks of suffixes by 1, 2, 4 ... symbols; 0 ends a string
        depth = 1
        while depth < rounds:
            nxt = np.zeros(n, np.int64)
            if n > depth * width:
                nxt[: -depth * width] = np.where(rank[: -depth * width] > 0, order_of[depth * width :], 0)
            both = order_of * np.int64(n + int(order_of.max(initial=0)) + 2) + nxt
            order = np.argsort(both)
            step = np.concatenate([[0], (both[order[1:]] != both[order[:-1]]).astype(np.int64)]).cumsum() + 1
            order_of = np.zeros(n, np.int64)
            order_of[order] = step
            order_of[rank == 0] = 0
            depth *= 2
        self.suffixes = np.argsort(order_of * np.int64(n + 1) + np.arange(n))
        before = np.zeros(n, np.int64)
        before[width:] = rank[:-width] if n > width else before[width:]
        before[first[:n]] = 0  # a string's first suffix follows its end
        self.transform = before[self.suffixes]
        self.suffixes += base


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in the merged order, and the block of each: equal to a depth of `rounds` symbols.

    The interleave z has the shard of each suffix; block numbers rise along it and are split where the symbols or
    the former blocks of neighbours differ, in the round that is their common prefix.
    """
    sizes = [len(s.transform) for s in shards]
    transform = np.concatenate([s.transform for s in shards])
    n = len(transform)
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    row = np.arange(n)  # where the transform of the suffix at each place of the interleave stands
    block = np.zeros(n, np.int64)
    for _ in range(rounds):
        dealt = np.sort((transform[row] << np.int64(32)) | np.arange(n))  # stable by symbol
        source = dealt & np.int64(0xFFFFFFFF)
        symbol, former = dealt >> np.int64(32), block[source]
        block = np.concatenate([[0], ((symbol[1:] != symbol[:-1]) | (former[1:] != former[:-1])).astype(np.int64)]).cumsum()
        z = z[source]
        row = np.empty(n, np.int64)
        row[np.argsort(z, kind="stable")] = np.arange(n)
    return np.concatenate([s.suffixes for s in shards])[row], block


def repeats(segments: list[bytes], length: int = LENGTH, width: int = SYMBOL, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment the places whose `length` bytes start at another place too, of this segment or any other."""
    rank, starts, sizes = symbols(segments, length, width)
    rounds = length // width
    first = np.zeros(len(rank), bool)  # the first suffix of each of a segment's strings
    for i in range(width):
        at = starts[sizes >= i] + i
        first[at] = True
    cuts, last = [0], 0
    for k, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        if s + n - last > shard_bytes and s > last:
            cuts.append(s)
            last = s
    cuts.append(len(rank))
    shards = [Shard(rank[a:b], first[a:b], a, rounds, width) for a, b in zip(cuts, cuts[1:])]
    place, block = merge(shards, rounds)
    same = block[1:] == block[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    place = np.sort(place[many])
    owner = np.searchsorted(starts, place, side="right") - 1
    inside = place - starts[owner] + length <= sizes[owner]
    place, owner = place[inside], owner[inside]
    edges = np.searchsorted(owner, np.arange(len(segments) + 1))
    return [place[a:b] - s for a, b, s in zip(edges, edges[1:], starts.tolist())]


def spans(at: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of consecutive numbers: firsts and lasts."""
    if not len(at):
        return [], []
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist()


def removed(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the windows that start from first to last: maximal [begin, end)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, first array<long>, last array<long>): the runs of repeated windows of each distinct row of docs(key, text), key being a row's."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "key long, a int, n int, v long"
    arrow = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = b.column(0).to_pylist(), [runs(t, length) for t in utf8(b.column(1))]
            yield to_batch({"key": np.repeat(np.array(keys, np.int64), [len(x[0]) for x in found]), **{c: np.concatenate([x[i] for x in found]) if found else [] for i, c in enumerate(("a", "n", "v"))}}, arrow)

    all_runs = table(docs.mapInArrow(each, schema), "runs")
    often = table(all_runs.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("v").alias("w")), "often")
    kept = all_runs.join(often, F.col("v") == F.col("w")).select("key", F.struct("a", "n", "v").alias("run"))
    kept = kept.groupBy("key").agg(F.collect_set("run").alias("runs"))

    cut_schema = "key long, a int, n int, v long, s long, c int, sent int, text binary"
    cut_arrow = arrow_schema(cut_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out: dict = {c: [] for c in cut_arrow.names}
            for key, rows, text, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist()):
                for r in rows:
                    part = text[r["a"] : r["a"] + r["n"] + length - 1]
                    s = xxhash.xxh3_64_intdigest(part) - (1 << 63)
                    new = (r["v"], s) not in seen
                    if new:
                        if len(seen) >= SEEN:  # a text may be sent again; the task that gets it keeps one
                            seen.clear()
                        seen.add((r["v"], s))
                    for c, x in zip(cut_arrow.names, (key, r["a"], r["n"], r["v"], s, copies, len(part) if new else 0, part if new else None)):
                        out[c].append(x)
            yield to_batch(out, cut_arrow)

    texts = docs.select(F.col("key").alias("k"), "text", F.lit(1).alias("c"))
    held = table(kept.join(texts, F.col("key") == F.col("k")).select("key", "runs", "text", "c").mapInArrow(cut, cut_schema), "segments")

    segments, split = split_keys(held.where("sent > 0").select("v", "s", "sent", "text"), length)
    tasks = max(1, -(-(segments.agg(F.sum("sent")).first()[0] or 0) // TASK_BYTES))
    found_schema = "v long, s long, first array<int>, last array<int>"
    found_arrow = arrow_schema(found_schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], bytes] = {}
        for b in batches:
            own.update({(v, s): t for v, s, t in zip(*(b.column(i).to_pylist() for i in range(3)))})
        texts = Counter(v for v, _ in own)
        keys = sorted(k for k in own if texts[k[0]] > 1)  # a key's one text can only be repeated as a whole
        if keys:
            found = [(k, *spans(x)) for k, x in zip(keys, repeats([own[k] for k in keys], length)) if len(x)]
            if found:
                yield to_batch({"v": [k[0] for k, _, _ in found], "s": [k[1] for k, _, _ in found], "first": [x for _, x, _ in found], "last": [x for _, _, x in found]}, found_arrow)

    partial = segments.select("v", "s", "text").repartition(tasks, "v").mapInArrow(search, found_schema)
    if split:
        partial = of_runs(table(partial, "partial"), split)
    # a segment that stands in several places: all its windows are repeated
    whole = held.groupBy("v", "s").agg(F.sum("c").alias("c"), F.first("n").alias("n")).where("c > 1").select("v", "s", F.array(F.lit(0)).alias("first"), F.array(F.col("n") - 1).alias("last"))
    hits = table(partial.join(whole, ["v", "s"], "left_anti").union(whole).select(F.col("v").alias("hv"), F.col("s").alias("hs"), "first", "last"), "hits")
    placed = held.select("key", "a", "v", "s").join(hits, (F.col("v") == F.col("hv")) & (F.col("s") == F.col("hs")))
    moved = [F.transform(c, lambda x: x + F.col("a")).alias(c) for c in ("first", "last")]
    return placed.select("key", *moved).groupBy("key").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))


def split_keys(segments: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[DataFrame]]:
    """segments(v, s, sent, text) in which no key has more than SHARD_BYTES of different texts, and for each width used the parts(v, s, a, n, pv, ps) of runs and parts.

    Rows that repeat (v, s) may stay. Only the segments of large keys are read, cut and dealt anew.
    """
    schema = "v long, s long, a int, n int, pv long, ps long, text binary"
    arrow = arrow_schema(schema)
    small, levels = [], []
    for width in WIDTHS:
        large = table(segments.groupBy(F.col("v").alias("w")).agg(F.sum("sent").alias("b")).where(F.col("b") > SHARD_BYTES).select("w"), "large")
        if large.isEmpty():
            break

        def cut(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(v, s, *x) for v, s, t in zip(*(b.column(i).to_pylist() for i in range(3))) for x in parts(t, v, width, length)]
                out = dict(zip(("v", "s", "a", "n", "pv", "text"), zip(*rows))) if rows else dict.fromkeys(arrow.names, ())
                out["ps"] = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in out["text"]]
                yield to_batch(out, arrow)

        here = F.col("v") == F.col("w")
        small.append(segments.join(large, here, "left_anti"))
        level = table(segments.join(large, here, "left_semi").select("v", "s", "text").dropDuplicates(["v", "s"]).mapInArrow(cut, schema), "parts")
        levels.append(level.drop("text"))
        shared = table(level.groupBy(F.col("pv").alias("w")).agg(F.min("ps").alias("x"), F.max("ps").alias("y")).where("x != y").select("w"), "shared")
        texts = level.select(F.col("pv").alias("v"), F.col("ps").alias("s"), F.length("text").alias("sent"), "text")
        segments = table(texts.join(shared, here, "left_semi").dropDuplicates(["v", "s"]), "split")
    for more in small:
        segments = segments.union(more)
    return segments, levels


def of_runs(found: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """found(v, s, first, last) in parts of runs, and what is repeated as a whole part, as places of the runs (see split_keys)."""
    for level in reversed(levels):
        whole = level.groupBy("pv", "ps").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where("c > 1").select(F.col("pv").alias("v"), F.col("ps").alias("s"), F.array(F.lit(0)).alias("first"), F.array(F.col("n") - 1).alias("last"))
        inside = found.union(whole).select(F.col("v").alias("fv"), F.col("s").alias("fs"), "first", "last")
        moved = [F.transform(c, lambda x: x + F.col("a")).alias(c) for c in ("first", "last")]
        found = found.union(level.join(inside, (F.col("pv") == F.col("fv")) & (F.col("ps") == F.col("fs"))).select("v", "s", *moved))
    return found


def with_key(docs: DataFrame) -> DataFrame:
    """A key for each distinct (doc_id, text)."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row of docs(doc_id, text, ...).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document
    too; strings are judged on the input and never cross documents. Null text is empty. Texts shorter than
    `length` stay whole. Rows that repeat a doc_id, or a whole row, are documents of their own.
    """
    base = with_key(docs.select("doc_id", "text"))
    hits = table(repeated_windows(base.select(F.col("_key").alias("key"), "text"), length), "windows").select(F.col("key").alias("k"), "first", "last")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    arrow = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict = {c: [] for c in arrow.names}
            for doc, text, first, last in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                gone = removed(np.array(first or [], np.int64), np.array(last or [], np.int64), length)
                kept = b"".join([text[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(text)])]) if gone else text
                for c, x in zip(arrow.names, (doc, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                    out[c].append(x)
            yield to_batch(out, arrow)

    small_batches(docs.sparkSession)
    return base.join(hits, F.col("_key") == F.col("k"), "left").select("doc_id", "text", "first", "last").mapInArrow(each, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text, n_chars, ...) with the repeated bytes cut out of each text (see remove_repeats) and n_chars counted anew.

    Texts that lose nothing stay as they are, null ones too.
    """
    base = with_key(docs)
    hits = table(repeated_windows(base.select(F.col("_key").alias("key"), "text"), length), "windows").select(F.col("key").alias("_k"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    joined = base.join(hits, F.col("_key") == F.col("_k"), "left")
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    arrow = arrow_schema(fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {c: b.column(i) for i, c in enumerate(others)}
            texts, chars = [], []
            for text, n, first, last in zip(*(b.column(len(others) + i).to_pylist() for i in range(4))):
                if first:
                    whole = text.encode()
                    gone = removed(np.array(first, np.int64), np.array(last, np.int64), length)
                    text = b"".join([whole[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(whole)])]).decode(errors="ignore")
                    n = len(text)
                texts.append(text)
                chars.append(n)
            yield to_batch(own | {"text": texts, "n_chars": chars}, arrow)

    small_batches(docs.sparkSession)
    return joined.select(*others, "text", "n_chars", "_first", "_last").mapInArrow(each, fields)
