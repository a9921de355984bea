"""Near-duplicates: 64-bit SimHash fingerprints of word shingles, linked through BK-trees; or sets of shingles, linked by their Jaccard index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, arrow_schema, map_arrow, small_batches, table, to_batch, utf8
from .components import components

SEED, PART = 42, 200_000
BANDS, BINS = 32, 6  # of sketches


def shingle_hashes(text: bytes, words: int = 4) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, PART at a time; fewer words than a shingle are one, no words give nothing."""
    w = text.translate(LOWER).split()  # bytes.split() splits at 0x20 and 0x09-0x0D
    for a in range(0, max(len(w) - words + 1, 1) if w else 0, PART):
        part = w[a : a + PART + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        k = max(len(part) - words + 1, 1)
        starts = np.concatenate([[0], ends])[:k].tolist()
        stops = (ends[min(words, len(part)) - 1 :] - 1).tolist()
        yield np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, stops)], np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Signed 64-bit: bit i is 1 if set in over half of the XXH64 values of the shingles. No words: 0."""
    return majority(shingle_hashes(text, words))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """Signed 64-bit: bit i is 1 if set in over half of all values of the arrays."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    parts = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> tuple[int, np.ndarray]:
    """A signed 64-bit name of a set of shingles, and BANDS shard keys: like sets have one in common.

    A key is that of BINS min-hashes: hashes are dealt to bins by their size, each keeps its smallest, an empty one
    takes the next one's. At a similarity of 0.8 all keys differ in some six pairs of 100,000, at 0.4 in seven of eight.
    """
    h, bins = np.sort(mixed(s)), BANDS * BINS
    at = np.searchsorted(h, np.array([i * 2**64 // bins for i in range(bins)], np.uint64))
    full = np.flatnonzero(np.append(at[1:], len(h)) > at)
    mins = h[at[full]][np.searchsorted(full, np.arange(bins)) % len(full)] if len(full) else np.full(bins, np.iinfo(np.uint64).max)
    keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), k) for k, x in enumerate(mins.reshape(BANDS, BINS))], np.uint64).view(np.int64)
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), keys


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard index of two sorted sets is at least `similarity`."""
    least, most = sorted((len(a), len(b)))
    if least < similarity * most - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (least + most - both) - 1e-9


def exact_groups(sets: list[np.ndarray], similarity: float) -> list[int]:
    """For each set the least place in its component, where sets are linked by a Jaccard index of at least `similarity`.

    Two such sets have one of their first n - ceil(similarity * n) + 1 shingles in common, in any order of all shingles;
    here rare ones come first. Sets that are in one component already aren't compared: a dense group costs about its size.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    sizes = np.array([len(x) for x in sets])
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, number, count = np.unique(shingle, return_inverse=True, return_counts=True)
    order = np.lexsort((number, count[number], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = order[(place < np.repeat(sizes - np.ceil(similarity * sizes - 1e-9).astype(int) + 1, sizes)) & (count[number[order]] > 1)]
    use = use[np.lexsort((owner[use], number[use]))]
    cuts = np.flatnonzero(np.diff(number[use])) + 1
    seen, tested = set(), set()
    for members in sorted(np.split(owner[use], cuts), key=len):
        if len(members) < 2 or (key := members.tobytes()) in seen:
            continue
        seen.add(key)
        held: dict[int, list[int]] = {}
        for i in members.tolist():
            for r in list(held):
                if (now := find(r)) == find(i):
                    continue
                for j in held[r]:
                    if (j, i) not in tested:
                        tested.add((j, i))
                        if alike(sets[j], sets[i], similarity):
                            root[max(now, find(i))] = min(now, find(i))
                            break
            held.setdefault(find(i), []).append(i)
            for r in [r for r in held if find(r) != r]:
                held.setdefault(find(r), []).extend(held.pop(r))
    return [find(i) for i in range(len(sets))]


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; null text: no words."""
    small_batches(docs.sparkSession)
    return map_arrow(docs.select("doc_id", "text"), lambda b: {"doc_id": b.column(0), "fp": [fingerprint(t, words) for t in utf8(b.column(1))]}, "doc_id long, fp long")


class BKTree:
    """Children keyed by their Hamming distance to the parent. A node is [value, {distance: node}]."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.size = 0

    def add(self, x: int) -> None:
        self.size += 1
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while True:
            d = (x ^ node[0]).bit_count()
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = [x, {}]
                return
            node = nxt

    def within(self, x: int, radius: int) -> Iterator[int]:
        """The values at most radius away; only edges within the radius of the own distance are followed, near ones first."""
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                yield value
            if children:
                todo += [children[e] for e in sorted((e for e in children if abs(e - d) <= radius), key=lambda e: -abs(e - d))]

    def values(self) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            yield value
            todo += children.values()


def group(values: list[int], radius: int) -> list[list[int]]:
    """Components of two values or more under links of at most radius bits.

    Lone values stand in one tree; each component has its own, which is asked for any one link only, so a
    dense group costs about its size times the depth, not its square.
    """
    if len(values) == 2:
        return [values] if (values[0] ^ values[1]).bit_count() <= radius else []
    lone, gone, trees = BKTree(), set(), []
    for x in values:
        near = [y for y in lone.within(x, radius) if y not in gone]
        joined = [t for t in trees if next(t.within(x, radius), None) is not None]
        if not near and not joined:
            lone.add(x)
            continue
        gone.update(near)
        into = max(joined, key=lambda t: t.size, default=None) or BKTree()
        for t in joined:
            if t is not into:
                for y in t.values():
                    into.add(y)
        for y in [x, *near]:
            into.add(y)
        trees = [t for t in trees if t not in joined] + [into]
    return [list(t.values()) for t in trees]


def block_keys(fp: str, radius: int, blocks: int) -> F.Column:
    """Values of all choices of `blocks - radius` out of `blocks` blocks of bits: fingerprints within the radius share one at least."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(k).alias("k"), F.col(fp).bitwiseAND(F.lit(mask)).alias("bits")))
    return F.explode(F.array(*keys))


def near_links(fps: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """(hi, lo) links that connect what is within the radius among the distinct fps(fp).

    Fingerprints go to shards by the values of blocks - radius of their blocks of bits, once for each choice: any
    two within the radius agree on as many, so they meet in a shard (4 bits and 6 blocks: 15 choices of two). Each shard makes its BK-trees and sends the smallest of each
    component with each other one. A shard's trees stay in its task: their sum grows with the corpus, so it
    isn't broadcast.
    """
    schema = "hi long, lo long"
    arrow = arrow_schema(schema)
    small_batches(fps.sparkSession, 20_000)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None  # the shard that may go on in the next batch
        out: list[list[int]] = []

        def close(values: np.ndarray) -> None:
            if len(values) > 1:
                out.extend(group((values.astype(np.uint64)).tolist(), radius))

        def flush():
            rows = [(y, min(c)) for c in out for y in c if y != min(c)] if out else []
            out.clear()
            pairs = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
            return to_batch({"hi": pairs[:, 0], "lo": pairs[:, 1]}, arrow)

        for b in batches:
            k, bits, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if rest is not None:
                k, bits, fp = np.append(rest[0], k), np.append(rest[1], bits), np.append(rest[2], fp)
            cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(bits) != 0)) + 1
            begins, ends = np.append(0, cuts), np.append(cuts, len(k))
            full = np.flatnonzero(ends[:-1] - begins[:-1] > 1)
            for i in full.tolist():
                close(fp[begins[i] : ends[i]])
            rest = (k[begins[-1] :], bits[begins[-1] :], fp[begins[-1] :])
            yield flush()
        if rest is not None:
            close(rest[2])
            yield flush()

    keyed = fps.select("fp", block_keys("fp", radius, blocks).alias("b")).select("b.k", "b.bits", "fp")
    return keyed.repartition("k", "bits").sortWithinPartitions("k", "bits", "fp").mapInArrow(each, schema)


def candidates(keyed: DataFrame) -> DataFrame:
    """(hi, lo) links from each of keyed(fp, keys) to the smallest that shares a key: sets that are alike are in one component of these."""
    shards = keyed.select("fp", F.explode("keys").alias("shard")).repartition("shard").distinct()
    return shards.withColumn("lo", F.min("fp").over(W.partitionBy("shard"))).where("fp > lo").select(F.col("fp").alias("hi"), "lo")


def near_candidates(rows: DataFrame, radius: int = 4) -> DataFrame:
    """(hi, lo) links of the fp in rows(fp, print) that connect what has fingerprints (print) within the radius, found by BK-trees (see near_links)."""
    named = table(rows.select("fp", "print").distinct(), "prints")
    first = table(named.groupBy(F.col("print").alias("p")).agg(F.min("fp").alias("first")), "distinct_prints")
    equal = named.join(first.hint("merge"), F.col("print") == F.col("p")).where("fp != first").select(F.col("fp").alias("hi"), F.col("first").alias("lo"))
    near = table(near_links(first.select(F.col("p").alias("fp")), radius), "near")
    near = near.join(first.select("p", F.col("first").alias("a")).hint("merge"), F.col("hi") == F.col("p")).select("a", "lo")
    near = near.join(first.hint("merge"), F.col("lo") == F.col("p")).select("a", "first")
    return equal.union(near)


def exact_roots(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """(node, root) of the fp in rows(fp, text, print, keys, row), but those alone: roots are the smallest fp of the components under
    a Jaccard index of at least `similarity`.

    Candidates are what SimHash fingerprints link through BK-trees, and what shares a min-hash key: at the similarity itself
    fingerprints are often further apart than trees can be asked for. One text of each fp goes to the task of its component of candidates, where every link is checked by the sets.
    """
    schema = "node long, root long"
    arrow = arrow_schema(schema)
    wide = table(components(near_candidates(rows).union(candidates(rows))), "wide")
    wide = wide.union(wide.select("root", "root").distinct())
    first = rows.groupBy("fp").agg(F.min("row").alias("first"))
    wide = table(wide.join(first.hint("merge"), F.col("node") == F.col("fp")).select("fp", "root", "first"), "candidates")
    small_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nodes, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            least = exact_groups(sets, similarity) if len(sets) > 1 else []
            if pairs := [(nodes[i], nodes[r]) for i, r in enumerate(least) if i != r]:
                yield to_batch({"node": [a for a, _ in pairs], "root": [b for _, b in pairs]}, arrow)

        for b in batches:
            for root, fp, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                if root != own:
                    yield from close()
                    own, nodes, sets = root, [], []
                nodes.append(fp)
                sets.append(shingle_set(text, words))
        yield from close()

    held = rows.select("row", "text").join(wide.hint("merge"), F.col("row") == F.col("first")).select("root", "fp", "text")
    return table(held.repartition("root").sortWithinPartitions("root", "fp").mapInArrow(each, schema), "exact")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links of at most `radius` differing bits reach. Equal fingerprints
    are one node, whatever their number. Texts without words (null and empty ones too) have fingerprint 0
    and link like others. Fewer words than a shingle: the whole sequence. Rows that repeat a doc_id stay. Null
    doc_ids get the component of their fingerprint. Empty tables give empty results.
    """
    fps = table(fingerprints(docs, words), "fingerprints")
    distinct = table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return _with_components(fps, distinct, near_links(distinct.select("fp"), radius, blocks))


def similar_rows(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """docs(text, ...) with columns row (a number of its own), fp, print and keys, and (node, root): the component of each fp that isn't its own root.

    Texts are linked by a Jaccard index of their distinct shingles of at least `similarity`, checked by the shingles themselves
    (their 64-bit hashes). Which pairs are checked is found by SimHash fingerprints (print: of the distinct shingles) through BK-trees, and by min-hash keys (see sketch). fp names a set of shingles; texts without words have the empty one.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    fields = T.StructType([*docs.schema.fields, *T._parse_datatype_string("row long, fp long, print long, keys array<long>").fields])
    arrow = to_arrow_schema(fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            found = []
            for t in utf8(b.column(at)):
                s = shingle_set(t, words)
                found.append((*sketch(s), majority(s[a : a + PART] for a in range(0, len(s), PART))))
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            yield to_batch(columns | {"row": np.arange(row, row + len(found)), "fp": [x for x, _, _ in found], "print": [p for _, _, p in found], "keys": [k.tolist() for _, k, _ in found]}, arrow)
            row += len(found)

    rows = table(docs.mapInArrow(each, fields), "sketched")
    return rows, exact_roots(rows, similarity, words)


def similar_texts(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) as in near_duplicates, but linked where the Jaccard index of the shingles is at least `similarity` (see similar_rows)."""
    rows, roots = similar_rows(docs.select("doc_id", "text"), similarity, words)
    fps = rows.select("doc_id", "fp")
    ids = table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return _named(fps, ids, roots)


def _with_components(fps: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """fps(doc_id, fp, ...) with the smallest doc_id of the component of their fp; distinct: (fp, first: its smallest doc_id)."""
    return _named(fps, distinct, components(links))


def _named(fps: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    classes = table(classes, "classes")
    ids = table(classes.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id")), "ids")  # alone, the join below can split a large component
    named = table(classes.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "named")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")
