"""Exact dedup by an extendible-hash index on shared files.

A text's key is the XXH64 of its normalised form. Map tasks combine equal texts, so a text that stands in a third of all rows
leaves a task as one row for each ``HELD`` bytes of other texts. The keys are cut into equal ranges, and each range has an
owner task, which reads its rows in the order of the keys. Texts of one key form a chain; a row joins the entry of the chain
whose bytes are the same. An owner starts with one bucket, its whole range; a bucket of more entries or bytes than a page
may hold is split at the next bit of the key, which doubles the directory over that range, and so on until all pages fit. As
the keys come in order, an owner holds one page. A key can't be split: a page of one key may be larger (an overflow chain).

The index is two Parquet tables in a folder that all executors share: pages (an entry a text, with the smallest id and the
count of its rows) and directory (a row for each bucket). An index is never changed in place: ``write_index`` writes
one that holds an older one's entries, too, so a lost executor leaves nothing half done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm.common import SPACE
from quarrylog.plans.scratch import Scratch

#: Entries and bytes of text in a page; bytes of text that a map task holds while it combines.
PAGE_ENTRIES, PAGE_BYTES, HELD = 4096, 16 << 20, 24 << 20
#: Owners per shuffle partition, and the most there are (as a power of two).
OWNERS, MOST_BITS = 1, 20
COMBINED = "h long, t binary, keep_id long, n long"
PAGE = "low long, depth int, h long, place int, sha binary, keep_id long, n long, t binary"


def normalised(text: str | Column = "text") -> Column:
    """Runs of ASCII white space as one space each; null as ''."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, t, keep_id, n) of equal texts become one, as far as this task has them at hand together."""
    chains: dict[int, list[list]] = {}
    held = 0

    def out() -> pa.RecordBatch:
        rows = [(h, *entry) for h, chain in chains.items() for entry in chain]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["h", "t", "keep_id", "n"])

    for batch in batches:
        for h, t, keep_id, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            chain = chains.setdefault(h, [])
            for entry in chain:
                if entry[0] == t:
                    entry[1], entry[2] = _least(entry[1], keep_id), entry[2] + n
                    break
            else:
                chain.append([t, keep_id, n])
                held += len(t) + 100
            if held > HELD:
                yield out()
                chains.clear()
                held = 0
    if chains:
        yield out()


def _own(bits: int, entries: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What an owner task does: rows (h, t, keep_id, n) of one range, sorted by h, become pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: list[tuple[int, int]] = []  # (low, depth) of the buckets still to be filled, the next one last
        page: list[tuple[int, list[list]]] = []  # (key, chain) of the next bucket
        load = [0, 0]  # its entries and bytes
        key: int | None = None
        chain: list[list] = []

        def high(r: tuple[int, int]) -> int:
            return r[0] + (1 << (64 - r[1]))

        def written(r: tuple[int, int], keys: list[tuple[int, list[list]]]) -> Iterator[pa.RecordBatch]:
            rows = [(_signed(r[0]), r[1], _signed(h), k, hashlib.sha256(e[0]).digest(), e[1], e[2], e[0]) for h, c in keys for k, e in enumerate(c)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["low", "depth", "h", "place", "sha", "keep_id", "n", "t"])

        def weigh() -> None:
            load[:] = sum(len(c) for _, c in page), sum(len(e[0]) for _, c in page for e in c)

        def add(h: int, c: list[list]) -> Iterator[pa.RecordBatch]:
            if not ranges:
                ranges.append((h >> (64 - bits) << (64 - bits), bits))
            while h >= high(ranges[-1]):
                yield from written(ranges.pop(), page)
                page.clear()
                load[:] = 0, 0
            page.append((h, c))
            load[0], load[1] = load[0] + len(c), load[1] + sum(len(e[0]) for e in c)
            while (load[0] > entries or load[1] > size) and len(page) > 1:
                low, depth = ranges.pop()
                middle = low + (1 << (63 - depth))
                ranges.append((middle, depth + 1))
                if page[-1][0] < middle:
                    ranges.append((low, depth + 1))
                    continue
                yield from written((low, depth + 1), [x for x in page if x[0] < middle])
                page[:] = [x for x in page if x[0] >= middle]
                weigh()

        for batch in batches:
            for h, t, keep_id, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if h != key:
                    if key is not None:
                        yield from add(key % 2**64, chain)
                    key, chain = h, []
                for entry in chain:
                    if entry[0] == t:
                        entry[1], entry[2] = _least(entry[1], keep_id), entry[2] + n
                        break
                else:
                    chain.append([t, keep_id, n])
        if key is not None:
            yield from add(key % 2**64, chain)
            yield from written(ranges[-1], page)

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def write_index(docs: DataFrame, folder: str, old: str | None = None, entries: int = PAGE_ENTRIES, size: int = PAGE_BYTES, key: Callable[[Column], Column] = F.xxhash64) -> None:
    """Writes the index of ``docs`` (doc_id, text), and of the index in ``old``, to ``folder``. Both need the same ``key``."""
    spark = docs.sparkSession
    t = normalised()
    rows = docs.select(key(t).alias("h"), t.cast("binary").alias("t"), F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    rows = rows.mapInArrow(_combine, COMBINED)
    if old is not None:
        rows = rows.unionByName(spark.read.parquet(f"{old}/pages").select("h", "t", "keep_id", "n"))
    bits = min(MOST_BITS, max(1, (OWNERS * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    owner = F.shiftrightunsigned("h", 64 - bits).cast("int")
    rows = rows.repartitionById(2**bits, owner).sortWithinPartitions("h")
    rows.mapInArrow(_own(bits, entries, size), PAGE).write.parquet(f"{folder}/pages")
    pages = spark.read.schema(PAGE).parquet(f"{folder}/pages")
    found = pages.groupBy("low", "depth").agg(F.count("*").alias("entries"), F.count_distinct("h").alias("keys"), F.sum(F.length("t")).alias("bytes"))
    found.write.parquet(f"{folder}/directory")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """(low, depth, entries, keys, bytes): a bucket holds the keys whose first ``depth`` bits are those of ``low``. Empty ones have no row."""
    return spark.read.parquet(f"{folder}/directory")


def look_up(docs: DataFrame, folder: str, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs`` with keep_id and group_size of the entry whose text equals theirs, byte for byte; nulls where the index has none."""
    pages = docs.sparkSession.read.schema(PAGE).parquet(f"{folder}/pages").select(F.col("h").alias("__k"), F.col("t").alias("__t"), "keep_id", F.col("n").alias("group_size"))
    columns = [c for c in docs.columns if c not in ("keep_id", "group_size")]
    mine = docs.select(*columns, normalised().alias("__n"))
    mine = mine.withColumn("__h", key(F.col("__n")))
    found = mine.join(pages, (F.col("__h") == F.col("__k")) & (F.col("__n").cast("binary") == F.col("__t")), "left")
    return found.select(*columns, "keep_id", "group_size")


def dedup(docs: DataFrame, entries: int = PAGE_ENTRIES, size: int = PAGE_BYTES, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``; other columns are not looked at.

    Null texts count as empty, and whole texts are compared whatever their length. The row of the smallest id stays (null ids
    come last: a group of null ids only has the null keep_id); of rows equal in id and text one stays. group_size counts
    rows. An empty table gives an empty one. Only ids and digests are shuffled to bring the entries back to their rows, and a
    hot text's rows are split by the adaptive join.
    """
    steps = Scratch(docs.sparkSession)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t = normalised()
    keys = steps.put(df.select("doc_id", key(t).alias("h"), F.unhex(F.sha2(t, 256)).alias("sha")))
    folder = f"{steps.folder}/index"
    write_index(df, folder, None, entries, size, key)
    found = docs.sparkSession.read.schema(PAGE).parquet(f"{folder}/pages").select("h", "sha", "keep_id", F.col("n").alias("group_size"))
    # rows equal in id and text are told apart by their number only
    rows = keys.groupBy("doc_id", "h", "sha").agg(F.count("*").alias("copies")).join(found, ["h", "sha"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, with all their columns as they were."""
    kept = dedup(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    df = docs.withColumn("__own", F.sha2(normalised(), 256))
    found = df.join(kept, (F.col("__own") == F.col("__sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    return found.dropDuplicates(["__own"]).drop("__own")
