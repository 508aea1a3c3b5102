"""Near-duplicates by SimHash, checked by the exact Jaccard similarity of word shingles; what SimHash leaves apart is found by shared prefixes.

First the components of fingerprints (simhash: one-wildcard segments, 3 bits) bring texts together: each set of shingles in one meets
the component's least set, and those whose similarity is enough are linked. 64 bits don't hold a similarity of 0.8, though: such texts
differ in some ten bits, more than segments can be looked up for. So for all that is not one component yet, each distinct set of shingles is indexed under the first n - ceil(t n) + 1 of its n shingles in one global order, rare
ones first: two sets of similarity t or more share one of these. No pair is missed, whatever the order; it only keeps buckets small.

Buckets aren't paired out at once. In each of some rounds all sets of a bucket meet its most central one, whose prefix lies in
the fullest buckets: of edited copies this is the one with the fewest edits. Exact similarities give links, and what has become
one component needs no more pairs; in what is left of a bucket, all sets but those of its largest component then meet the others,
and the join itself gives on only what the bitmaps allow. Before the sets of a pair are fetched, bitmaps of the parity of each set's shingles are compared: sets differ in as many shingles at least as these in bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import KEY, row_key
from quarrylog.llm.simhash import keep_least, rooted
from quarrylog.operators.components import connected_components
from quarrylog.plans.lineage import cut
from quarrylog.plans.scratch import Scratch, release

SHINGLE, SIMILARITY = 5, 0.8
ROUNDS = 1
#: Longs of a set's bitmap, and of the wider one by which pairs of sets of LARGE shingles or more are compared before the sets are fetched.
BITMAP, WIDE, LARGE = 16, 256, 1024
#: Bytes that pairs may bring into one shuffle, or twice those of the sets if these are more: pairs of more are compared part by part.
AT_ONCE = 1 << 28
#: Shingles that often occur in one of SAMPLE texts come last in the order, the MOST_HOT most frequent of them by their number.
SAMPLE, HOT, MOST_HOT = 16, 4, 20_000
EPS = 1e-9


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text; of all its words where they are fewer, none for null."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered, ASCII space splits
    known = {x: xxhash.xxh64_intdigest(x) for x in set(w)}
    h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
    size = min(size, len(h))
    g = np.full(len(h) - size + 1 if size else 0, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            g = (g ^ h[k : k + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    return np.unique(g.view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``(*KEY, sid, s, bits)``: the shingles of each row (the upper 32 bits of their hashes), a hash of them all and their bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles(t, size) for t in batch.column(3).to_pylist()]
            bits = [_parity(s, BITMAP) for s in found]
            ids = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], dtype=np.uint64).view(np.int64)
            found = [(s >> 32).astype(np.int32) for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids), pa.array(found, type=pa.list_(pa.int32())), pa.array(bits, type=pa.list_(pa.int64()))], names=[*KEY, "sid", "s", "bits"])

    return docs.select(*KEY, "text").mapInArrow(run, f"{_key_schema(docs)}, sid long, s array<int>, bits array<long>")


def _key_schema(docs: DataFrame) -> str:
    return ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in KEY)


def _prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(*KEY, doc_id, sid, n, prefix)``: the id and size of each row's set, and the shingles that index it."""
    sample = _prefix_rows(docs.where(f"pmod({KEY[1]}, {SAMPLE}) = 0"), size, 0.0, np.empty((0, 2), dtype=np.int64)).dropDuplicates(["sid"]).select(F.explode("prefix").alias("g"))
    hot = sample.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "g").limit(MOST_HOT).collect()
    often = np.array(sorted(map(tuple, hot)), dtype=np.int64).reshape(-1, 2)
    return _prefix_rows(docs, size, similarity, often)


def _prefix_rows(docs: DataFrame, size: int, similarity: float, often: np.ndarray) -> DataFrame:
    """The prefixes in the order that ``often`` (shingle, how often) gives; a similarity of 0 gives all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, sizes, out = [], [], []
            for t in batch.column(3).to_pylist():
                s = shingles(t, size)
                n = len(s)
                weight = np.zeros(n, dtype=np.int64)
                if len(often) and n:
                    at = np.minimum(np.searchsorted(often[:, 0], s), len(often) - 1)
                    weight = np.where(often[at, 0] == s, often[at, 1], 0)
                ids.append(xxhash.xxh3_64_intdigest(s.tobytes())), sizes.append(n)
                out.append(s[np.lexsort((s, weight))][: n - int(np.ceil(similarity * n - EPS)) + 1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(sizes, type=pa.int32()), pa.array(out, type=pa.list_(pa.int64()))], names=[*KEY, "doc_id", "sid", "n", "prefix"])

    return docs.select(*KEY, "text", "doc_id").mapInArrow(run, f"{_key_schema(docs)}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, sid long, n int, prefix array<long>")


def _parity(s: np.ndarray, longs: int) -> np.ndarray:
    """A bit for each remainder of the hashes: whether the set has an odd number of them. Two sets differ in as many hashes at least as these in bits."""
    return np.packbits(np.bincount(s & (64 * longs - 1), minlength=64 * longs) & 1 == 1).view(np.int64)


def _wide(sets: DataFrame) -> DataFrame:
    """``(sid, n, wide)``: the sizes of sets, and the wide bitmaps of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [x.values.to_numpy() for x in batch.column(1)]
            wide = [_parity(s, WIDE) if len(s) >= LARGE else None for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], type=pa.int32()), pa.array(wide, type=pa.list_(pa.int64()))], names=["sid", "n", "wide"])

    return sets.select("sid", "s").mapInArrow(run, "sid long, n int, wide array<long>")


def _bits_apart(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, p: t + p)


def _parts(pairs: DataFrame, total: int, at_once: int) -> Iterator[DataFrame]:
    """Pairs that bring ``total`` bytes into a shuffle, in parts of about ``at_once``; the shuffle files of a part go before the next."""
    n = max(1, -(-total // at_once))
    for k in range(n):
        yield pairs.where(F.pmod(F.xxhash64("a", "b", F.lit(n)), F.lit(n)) == k) if n > 1 else pairs
        release(pairs.sparkSession)


def _alike(near: DataFrame, sets: DataFrame, similarity: float, steps: Scratch) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is ``similarity`` or more.

    A set is shuffled once for each of its pairs, and pairs grow faster than sets: so the wide bitmaps of large sets are compared
    first, and the rest in parts, whose shuffles stay in proportion to the sets.
    """
    share = (1 - similarity) / (1 + similarity)
    wide = steps.put(_wide(sets))
    at_once = max(AT_ONCE, 8 * (wide.agg(F.sum("n")).first()[0] or 0))
    x, y = (wide.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")
    found = []
    for some in _parts(near, near.count() * 8 * WIDE, at_once):
        can = steps.put(some.join(x, "a").join(y, "b").where(F.coalesce(_bits_apart("wide_a", "wide_b") <= share * (F.col("n_a") + F.col("n_b")) + EPS, F.lit(True))).select("a", "b", "n_a"))
        for part in _parts(can, 4 * (can.agg(F.sum("n_a")).first()[0] or 0), at_once):
            both = part.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("s").alias("y")), "b")
            shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("t"))
            found.append(steps.put(shared.where(f"o >= {similarity!r}D * (t - o) - {EPS}").select("a", "b")))
        steps.drop(can)
    steps.drop(wide)
    return reduce(DataFrame.union, found)


def simhash_links(docs: DataFrame, prints: DataFrame, steps: Scratch, size: int, similarity: float) -> DataFrame:
    """``(node, component)`` of the sets that SimHash finds near and the exact similarity confirms."""
    roots = rooted(docs).select(*KEY, "root").distinct()
    of_set = steps.put(prints.select(*KEY, "sid").join(roots, list(KEY)).groupBy("sid", "root").agg(F.min(F.struct(*KEY)).alias("k")))
    least = of_set.groupBy("root").agg(F.min("sid").alias("a"), F.count("*").alias("c")).where("c > 1")
    pairs = steps.put(of_set.join(least, "root").where("sid <> a").select("a", F.col("sid").alias("b"), "root").select("a", "b").distinct())
    known = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    keys = steps.put(of_set.join(known, "sid", "left_semi").groupBy("sid").agg(F.min("k").alias("k")).select(*[F.col(f"k.{c}") for c in KEY]))
    steps.drop(of_set)
    sets = steps.put(_sets(docs.join(keys, list(KEY), "left_semi").dropDuplicates(list(KEY)), size).select("sid", "s"))
    alike = _alike(pairs, sets, similarity, steps)
    groups = connected_components(alike)
    steps.drop(pairs, keys, sets, alike)
    return groups


def _links(docs: DataFrame, prints: DataFrame, steps: Scratch, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``prints`` without the prefixes, and ``(node, component)`` of the sets that have an alike one. Tables of past steps are removed, so the disk holds one step's at a time."""
    groups = simhash_links(docs, prints, steps, size, similarity)
    slim = steps.put(prints.select(*KEY, "doc_id", "sid"))
    nodes = prints.groupBy("sid").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    nodes = steps.put(nodes.join(groups, F.col("sid") == F.col("node"), "left").select("sid", "n", F.coalesce("component", "sid").alias("comp"), "prefix"))
    steps.drop(prints)
    entries = nodes.select("sid", "n", "comp", F.explode("prefix").alias("g"))
    # written before it is joined: of the entries, one shuffle at a time is on the disk
    held = steps.put(entries.groupBy("g").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g", "c"))
    release(docs.sparkSession)
    left = steps.put(entries.join(held, "g").select("g", "sid", "n", "comp", "c"))
    known = left.select("sid").distinct()
    steps.drop(nodes, held)
    keys = steps.put(slim.join(known, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(*KEY)).alias("k")).select(*[F.col(f"k.{c}") for c in KEY]))
    steps.drop(known)
    sets = steps.put(_sets(docs.join(keys, list(KEY), "left_semi").dropDuplicates(list(KEY)), size).select("sid", "s", "bits", F.size("s").alias("n")))
    steps.drop(keys)
    share = (1 - similarity) / (1 + similarity)
    for k in range(ROUNDS + 1):
        if left.isEmpty():
            break
        first = None
        if k < ROUNDS:
            central = left.groupBy("sid").agg(F.sum("c").alias("score"))
            first = steps.put(left.join(central, "sid").groupBy("g").agg(F.max(F.struct("score", "n", "sid", "comp")).alias("f")))
            met = left.join(first, "g")
            pairs = met.where(f"comp <> f.comp and least(n, f.n) >= {similarity!r}D * greatest(n, f.n) - {EPS}")
            pairs = pairs.select(F.least("sid", "f.sid").alias("a"), F.greatest("sid", "f.sid").alias("b"))
        else:
            wide = left.join(sets.select("sid", *[F.col("bits")[j].alias(f"x{j}") for j in range(BITMAP)]), "sid")
            other = wide.select("g", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("comp").alias("other"), *[F.col(f"x{j}").alias(f"y{j}") for j in range(BITMAP)])
            largest = left.groupBy("g", "comp").agg(F.count("*").alias("c")).groupBy("g").agg(F.max(F.struct("c", "comp"))["comp"].alias("most"))
            minor = wide.join(largest, "g").where("comp <> most")
            apart = " + ".join(f"bit_count(x{j} ^ y{j})" for j in range(BITMAP))
            pairs = minor.join(other, "g").where(f"comp <> other and (other = most or sid < b) and least(n, m) >= {similarity!r}D * greatest(n, m) - {EPS} and {apart} <= {share!r}D * (n + m) + {EPS}")
            pairs = pairs.select(F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b"))
        pairs = steps.put(pairs.distinct())
        steps.drop(known)
        near = pairs
        if k < ROUNDS:
            x, y = (sets.select(F.col("sid").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
            near = steps.put(pairs.join(x, "a").join(y, "b").where(_bits_apart("bits_a", "bits_b") <= share * (F.col("n_a") + F.col("n_b")) + EPS).select("a", "b"))
            steps.drop(pairs)
        some = steps.put(sets.join(near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "sid"), "sid", "left_semi").select("sid", "s"))
        steps.drop(known)
        alike = _alike(near, some, similarity, steps)
        steps.drop(near, some)
        if not alike.isEmpty():
            groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(alike))
        if k < ROUNDS:
            rest = met.where("sid <> f.sid").select("g", "sid", "n", "c").join(groups, F.col("sid") == F.col("node"), "left").select("g", "sid", "n", F.coalesce("component", "sid").alias("comp"), "c")
            rest = steps.put(rest)
            mixed = rest.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g")
            before, left = left, steps.put(rest.join(mixed, "g", "left_semi"))
            steps.drop(before, rest, first, alike)
    return slim, groups


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The row of the least id of every component of texts alike (of the least text hash where ids repeat), with the columns of ``docs``.

    Links are between texts whose sets of shingles have a Jaccard similarity of at least ``similarity``. Texts without words,
    null ones too, are alike. Null and repeated ids are rows like others; an empty table gives an empty one.
    """
    steps = Scratch(docs.sparkSession)
    light = docs.select("doc_id", "text", *row_key())
    prints = steps.put(_prefixes(light, size, similarity))
    prints, groups = _links(light, prints, steps, size, similarity)
    rooted = cut(prints.join(groups, prints["sid"] == groups["node"], "left").select(*KEY, "doc_id", F.coalesce("component", "sid").alias("root")))
    steps.drop()
    return keep_least(docs, rooted)
