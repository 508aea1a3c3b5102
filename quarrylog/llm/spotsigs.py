"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor with the next CHAIN content words; the fingerprint is the set of the 32-bit hashes of a text's
signatures. A text without any anchored chain takes every word as an anchor, so only texts without words have none. Likeness
is Jaccard's; candidates are compared only within set-length partitions that can reach the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.plans.lineage import cut

CHAIN = 2
#: Our choice: common words of English, German, French and Spanish.
ANCHORS = frozenset("the a an of and to in is that it for on was be with as by this at are from der die und das den von zu ist mit dem ein eine nicht auf le la les de des et un une que qui dans pour est par sur el los las y en del se por con para".split())
STRIP = ".,;:!?\"'()[]{}|#*$%&"


def signatures(text: str | None) -> np.ndarray:
    """The sorted distinct signature hashes of a text."""
    w = [x for x in (y.strip(STRIP) for y in (text or "").lower().split()) if x] or (text or "").split()
    if not w:
        return np.empty(0, dtype=np.uint32)
    digest = xxhash.xxh32_intdigest
    content = [x for x in w if x not in ANCHORS]
    found, c = [], 0
    for x in w:
        if x not in ANCHORS:
            c += 1
        elif c + CHAIN <= len(content):
            found.append(digest(f"{x} {content[c]} {content[c + 1]}"))
    if not found:
        found = [digest(" ".join(w[k : k + CHAIN + 1])) for k in range(max(1, len(w) - CHAIN))]
    return np.unique(np.array(found, dtype=np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard's; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def _neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """``(doc_id, text, __b, __extra)``: documents in id-ordered buckets, each with the first row of the bucket that follows.

    Buckets are cut from an ordering of the ids alone; texts are shuffled once.
    """
    ids = docs.select("doc_id")
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    bounds = sorted(set(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.001))) if low is not None else []
    edges = F.array(*[F.lit(int(x)) for x in bounds]) if bounds else F.array().cast("array<bigint>")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(_at(edges, len(bounds), F.col("doc_id")), F.lit(-1)).alias("__b"))
    # a row for each bucket: its first row, and the bucket before it, to which a copy of that row goes (the first one's to the last)
    heads = df.groupBy(F.col("__b").alias("__of")).agg(F.max("doc_id").alias("__head"))
    order = Window.orderBy(F.desc("__of"))
    heads = heads.withColumn("__after", F.coalesce(F.lag("__of").over(order), F.min("__of").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    df = df.join(F.broadcast(heads), (F.col("__b") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__head")), "left")
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("extra"))
    more = F.struct(F.col("__after").alias("b"), F.lit(1).alias("extra"))
    df = df.withColumn("__to", F.explode(F.when(F.col("__after").isNotNull(), F.array(own, more)).otherwise(F.array(own))))
    return df.select("doc_id", "text", F.col("__to.b").alias("__b"), F.col("__to.extra").alias("__extra"))


def _at(edges: Column, n: int, x: Column) -> Column:
    """How many of the ``n`` ascending edges are at most ``x``, by halving; null for null."""
    steps = [F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)]
    if not steps:
        return F.when(x.isNotNull(), 0)
    further = lambda at, step: at + F.when((at + step <= n) & (F.get(edges, at + step - 1) <= x), step).otherwise(0)
    return F.when(x.isNotNull(), F.aggregate(F.array(*steps), F.lit(0), further))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out: list[tuple] = []
    held = None
    taken = False
    for batch in batches:
        for doc_id, text, bucket, extra in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if extra and (held is None or held[2] != bucket):
                continue
            mine = signatures(text)
            if held is not None and held[2] == bucket:
                i, t, _, s = held
                n = len(t)
                edited = t[: n - n // 2] + text[: n // 2]
                e = signatures(edited)
                out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), as_string(s), as_string(e), likeness(s, e), likeness(s, mine)))
                if len(out) >= 500:
                    yield done(out)
                    out = []
            held = None if extra else (doc_id, text, bucket, mine)
    if out:
        yield done(out)


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each row: the fingerprint, that of the text whose second half the next document's beginning replaces, and likenesses.

    The next document is the one before in the order of ids (ties by text; null ids last), the first after the last. Null texts
    are empty. A sole document is its own next one. An empty table gives an empty one.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = _neighbours(docs, parts)
    # a bucket is a task: the partition is the bucket's number itself, not its hash, which would put several into one
    df = df.repartitionById(parts + 1, (F.col("__b") + 1).cast("int")).sortWithinPartitions("__b", "__extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return df.mapInArrow(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b, likeness)``: pairs between distinct fingerprints' least ids whose sets are alike, found by shared prefixes.

    The signatures of the fewest sets index a set: two sets of likeness t share one among the first n - ceil(t n) + 1 of
    each, in any order that is the same for all. The join key holds the signature and the length partition, whose borders grow by 1/t, so that alike sets lie in
    the same or the next one. Rows of null id take no part; texts of one id that are alike give a pair of that id with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(t).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.list_(pa.int64()))], names=["doc_id", "s"])

    sets = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>").where("size(s) > 0")
    sets = cut(sets.groupBy("s").agg(F.min("doc_id").alias("doc_id")).withColumn("h", F.xxhash64("s")))
    share = F.lit(threshold)
    each = sets.select("h", F.explode("s").alias("k"))
    each = each.join(each.groupBy("k").agg(F.count("*").alias("sets")), "k")
    n = F.size("o")
    rare = each.groupBy(F.col("h").alias("x")).agg(F.array_sort(F.collect_list(F.struct("sets", "k"))).alias("o"))
    prefix = F.slice("o", F.lit(1), n - F.ceil(share * n).cast("int") + 1)
    keyed = rare.select("x", n.alias("m"), F.floor(F.log(n.cast("double")) / -np.log(threshold)).cast("int").alias("p"), F.explode(F.transform(prefix, lambda e: e["k"])).alias("k"))
    other = keyed.select(F.col("x").alias("y"), F.col("m").alias("o"), F.explode(F.array("p", F.col("p") + 1)).alias("p"), "k")
    near = keyed.join(other, ["p", "k"]).where((F.col("x") != F.col("y")) & (F.least("m", "o") >= share * F.greatest("m", "o")))
    # only hashes and sizes meet in the join; a pair's sets are fetched once
    pairs = near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = pairs.join(sets.select(F.col("h").alias("x"), "s", F.col("doc_id").alias("a")), "x").join(sets.select(F.col("h").alias("y"), F.col("s").alias("t"), F.col("doc_id").alias("b")), "y")
    both = F.size(F.array_intersect("s", "t"))
    like = both / (F.size("s") + F.size("t") - both)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), like.alias("likeness")).where(F.col("likeness") >= threshold)
