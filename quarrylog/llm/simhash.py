"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. Of two fingerprints with 3 or fewer differing bits, at least one
segment differs by at most one bit, so both hold the same segment once the right bit is deleted: each fingerprint is
indexed under its 2 x 32 one-wildcard segments, an equality join brings the candidates together, and exact distances
decide. Within a bucket only a spanning forest of the links is given on, never all pairs; components follow from the
forests of all buckets, as every link lies in at least one.

A bucket of more than SPLIT fingerprints is cut further, so that templated texts don't meet in one task: the other segment
falls into six pieces, three of which two linked fingerprints share, so each such fingerprint is indexed under its twenty
triples of pieces. With the bucket's own 31 bits these fix at least 46, so no bucket can hold more than 2^18 fingerprints,
whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import KEY, row_key
from quarrylog.operators.components import connected_components
from quarrylog.plans.lineage import cut

BITS, MOST, SEED, SHINGLE = 64, 3, 42, 3
BLOCK = 1 << 21
SPLIT = 4096
#: Pieces of a segment of 32 bits, and the masks of any three of them.
PIECES = (0x3F, 0xFC0, 0x1F000, 0x3E0000, 0x7C00000, 0xF8000000)
TRIPLES = tuple(sum(three) for three in combinations(PIECES, 3))
#: Hot keys that may be broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 100_000


def simhash(text: str | None) -> int:
    """The fingerprint of one text; 0 for null and for texts without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered, ASCII space splits
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(w)] if len(w) < SHINGLE else [b" ".join(g) for g in zip(w, w[1:], w[2:], strict=False)]
    h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((simhash(t) for t in batch.column("__text").to_pylist()), dtype=np.uint64, count=batch.num_rows)
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fp`` (long) in place of the text."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    df = docs.select(*rest, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text") + ", fp long"
    return df.mapInArrow(_fingerprint_batches, schema)


def variant_key() -> Column:
    """The key of variant ``v`` (0 to 63): its segment v div 32 without bit v mod 32, marked with v."""
    return F.expr(
        "(shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295L & ~shiftleft(1L, cast(v % 32 as int))) | shiftleft(cast(v as bigint), 32)"
    )


def spanning_forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect the distinct fingerprints ``x`` as links of up to MOST bits do, by search in blocks."""
    members, roots = [], []
    left = x
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root], dtype=x.dtype)
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            step = max(1, BLOCK // len(left))
            for at in range(0, len(front), step):
                near |= (np.bitwise_count(front[at : at + step, None] ^ left[None, :]) <= MOST).any(axis=0)
            front, left = left[near], left[~near]
            members.append(front)
            roots.append(np.full(len(front), root, dtype=x.dtype))
    none = np.empty(0, dtype=x.dtype)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, links out; a bucket may span batches."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= MOST
        out_a, out_b = [a[near]], [b[near]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            m, r = spanning_forest(np.unique(fps[at : at + n]))
            out_a.append(m)
            out_b.append(r)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    keys, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("key").to_numpy(zero_copy_only=False)
        f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        held.append((k, f))
        if held[0][0][0] == k[-1]:  # one bucket so far
            continue
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        last = np.searchsorted(keys, keys[-1])
        yield links(keys[:last], fps[:last])
        held = [(keys[last:], fps[last:])]
    if held:
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        yield links(keys, fps)


def links(distinct_fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """``(a, b)``: links between the distinct values of column ``fp`` that connect what links of up to 3 bits connect."""
    index = distinct_fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("v")).select("v", variant_key().alias("key"), "fp")
    hot = cut(index.groupBy("key").count().where(F.col("count") > split).select("key", F.lit(True).alias("hot")))
    n_hot = hot.count()
    if n_hot:
        index = index.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left")
        other = F.expr("shiftrightunsigned(fp, 32 * (1 - v div 32)) & 4294967295L")
        # a collision of hashes only brings more candidates together
        finer = F.array(*[F.xxhash64("key", F.lit(k), other.bitwiseAND(F.lit(mask))) for k, mask in enumerate(TRIPLES)])
        index = index.select(F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key"), "fp")
    return index.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_link_batches, "a long, b long").distinct()


def rooted(docs: DataFrame) -> DataFrame:
    """``near_duplicate_components`` with ``root``, a fingerprint that names the component whatever its ids."""
    prints = cut(fingerprints(docs.drop("component_id", "root")))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(links(nodes.select("fp")))
    named_roots = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = named_roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = cut(named_roots.join(named, "root").select("fp", "component_id", "root"))
    return prints.join(of_fp, "fp")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) without the text, with ``fp`` and ``component_id``, the least doc_id reachable.

    Null texts and texts without words have fingerprint 0 and are linked like others. Rows that repeat an id or a text stay
    rows of their own. A component whose ids are all null has a null component_id. An empty table gives an empty one.
    """
    return rooted(docs).drop("root")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the least id of every component (of the least text hash where ids repeat), with the columns of ``docs``.

    Texts without words, null ones too, share a fingerprint, so one of them stays. Null ids come last; unrelated rows of null or
    repeated ids are components of their own. Columns of any name stay as they are; an empty table gives an empty one.
    """
    light = docs.select("doc_id", "text", *row_key())
    return keep_least(docs, rooted(light))


def keep_least(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least of their ``root`` in ``rooted`` (KEY, doc_id, root): ids may be null or repeat."""
    best = F.struct(F.col("doc_id").isNull(), *KEY)
    keepers = rooted.groupBy("root").agg(F.min(best).alias("k")).select(*[F.col(f"k.{c}").alias(c) for c in KEY])
    kept = docs.select("*", *row_key()).join(cut(keepers), list(KEY), "left_semi")
    return kept.dropDuplicates(list(KEY)).select(*docs.columns)
