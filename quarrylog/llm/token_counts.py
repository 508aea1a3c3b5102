"""Token counts by scanning flat token files for end-of-document identifiers.

Files are sequences of 16-bit little-endian ids without any index. Each file is cut into blocks, read by byte range and
spread over the tasks whatever file they belong to; in a block numpy finds the separators. A prefix scan over the blocks of
a file numbers the documents and stitches those that span blocks.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.plans.lineage import cut, ensure_checkpoint_dir, remove_folder

END = 50256
BLOCK_TOKENS = 1 << 20
#: Stores whose byte ranges Arrow reads; files of any other are read whole, by Spark.
RANGE_STORES = frozenset(("file", "hdfs", "s3", "gs", "abfs", "abfss"))


@cache
def _encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if END in ranks.values() or max(ranks.values()) >= 1 << 16:
        raise ValueError(f"the vocabulary must leave out id {END} and fit 16 bits")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the ids of each text and END, one document after another, in flat files; null texts have no ids before their END.

    Gives ``(file, document)`` of each row, and its ``doc_id`` where ``docs`` has such a column. Each attempt of a task writes a file of its own name; those of attempts
    that were lost or outrun stay in the folder, but no row names them. The folder must lie in one of ``RANGE_STORES``.
    """
    spark = docs.sparkSession
    at, scheme = _qualified(spark, folder)
    if scheme not in RANGE_STORES:
        raise ValueError(f"token files can't be written to {at}: give a folder in one of {', '.join(sorted(RANGE_STORES))}")
    keys = [doc_id] if doc_id in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        end = END.to_bytes(2, "little")
        name, file, n = f"{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            if file is None:
                store, inside = pyarrow.fs.FileSystem.from_uri(quote(at, safe=":/"))
                store.create_dir(inside)
                file = store.open_output_stream(f"{inside}/{name}")
            for t in batch.column(0):
                file.write(np.array(encode(t.as_py() or ""), dtype="<u2").tobytes() + end)
            rows = [pa.array([name] * batch.num_rows), pa.array(range(n, n + batch.num_rows), type=pa.int64()), *batch.columns[1:]]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(rows, names=["file", "document", *("doc_id" for _ in keys)])
        if file is not None:
            file.close()

    schema = T.StructType().add("file", "string").add("document", "long")
    for c in keys:
        schema = schema.add("doc_id", docs.schema[c].dataType)
    return cut(docs.select(text, *keys).mapInArrow(run, schema))


def _qualified(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The whole address of a folder, and its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return path.toString(), path.toUri().getScheme()


FOUND = "file string, length long, block long, ends array<long>"


def _ends(ids: bytes | memoryview, end: int) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(ids, dtype="<u2", count=len(ids) // 2) == end).astype(np.int64)


def _found(batch: pa.RecordBatch, rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "length", "block")), pa.array(rows, type=pa.list_(pa.int64()))], names=["file", "length", "block", "ends"])


def _contents(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _found(batch, [_ends(b.as_buffer(), end) for b in batch.column("bytes")])

    return run


def _ranges(end: int, size: int):
    """Reads the block of each row from its file, which stays open for the rows of it that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for path, group in groupby(zip(part.column("path").to_pylist(), part.column("block").to_pylist(), strict=True), key=lambda r: r[0]):
                    store, inside = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/"))
                    with store.open_input_file(inside) as f:
                        rows += [_ends(f.read_at(size, block * size), end) for _, block in group]
                yield _found(part, rows)

    return run


def scan_token_files(spark: SparkSession, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, document, start, n_tokens)``: the documents of each file from 0, their first id's place and their ids.

    Ids after the last separator are a document, too; an empty file has none. ``file`` is its place under ``folder``. In the
    stores of ``RANGE_STORES`` a task holds one block at a time, whatever a file's length; elsewhere Spark reads a file whole
    (2 GB at most).
    """
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    blocks = F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("block")
    root, scheme = _qualified(spark, folder)
    name = F.coalesce(F.nullif(F.expr(f"substring(path, {len(root) + 2})"), F.lit("")), F.lit(root.rsplit("/", 1)[1])).alias("file")
    if scheme in RANGE_STORES:
        # of a file only its length is read here; its blocks go to tasks by their numbers
        blocks = files.select("path", name, "length", blocks).repartition(F.col("block"), F.col("file"))
        found = blocks.mapInArrow(_ranges(end, size), FOUND)
    else:
        content = F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("bytes")
        blocks = files.select(name, "length", "content", blocks).select("file", "length", "block", content)
        found = blocks.mapInArrow(_contents(end), FOUND)
    found = cut(found.withColumn("ends", F.transform("ends", lambda x: x + F.col("block") * block_tokens)))
    # only a count and a place of each block meet in the scan over a file
    marks = found.select("file", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("end"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("file", "block", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("end").over(before), F.lit(-1)).alias("prior"), F.lead("block").over(order).isNull().alias("final"))
    tail = F.when(F.col("final"), F.array(F.expr("length div 2"))).otherwise(F.array().cast("array<bigint>"))
    out = found.join(marks, ["file", "block"]).withColumn("all", F.concat("ends", tail))
    out = out.select("file", "first", "prior", "n", "all", F.posexplode("all").alias("k", "stop"))
    out = out.withColumn("start", F.when(F.col("k") == 0, F.col("prior")).otherwise(F.get("all", F.col("k") - 1)) + 1)
    return out.where("k < n or stop > start").select("file", (F.col("first") + F.col("k")).alias("document"), "start", (F.col("stop") - F.col("start")).alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)``: writes the token files of ``docs`` into a new folder under ``folder`` (the shared one), scans them, and removes them: their separators are kept.

    A row for each row of ``docs``, in no order: null and empty texts have 0 tokens, repeated rows and null ids are counted each. Only doc_id
    (left out where there is none) and text are read, so other columns can't clash. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = f"{folder or ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    written = write_token_files(docs, folder, vocabulary)
    if written.isEmpty():  # no task had rows, so there is no folder
        found = spark.createDataFrame([], "file string, document long, start long, n_tokens long")
    else:
        found = scan_token_files(spark, folder)
    out = written.join(found, ["file", "document"]).drop("file", "document", "start")
    remove_folder(spark, folder)
    return out
