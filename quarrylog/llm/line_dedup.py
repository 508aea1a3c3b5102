"""Line dedup by winnowing over line hashes.

The lines of a document are hashed in the row. Every two consecutive lines make a gram; of every ``window`` consecutive grams
the least hash is selected (of fewer grams in a whole document, the least of them), so any run of ``window`` + 1 lines that
two places share has a selected gram at the same offset in both. A line of ``long_words`` words or more is a fingerprint by
itself. Only these fingerprints are indexed. Their positions are joined with the first position of the same fingerprint, the
matches are extended line by line both ways over the lines of the two documents, and the lines of the later runs are deleted.

A *line* is what stands between newlines, with the blank lines that follow it; trailing white space does not count in
comparing. Documents are ordered by id (null first), then by a hash of the text. A line goes if and only if it lies in a run of
lines that also stands at the first place of a fingerprint in that run. So no line goes without an equal one at an earlier
place. What may stay: a single short line, a run of two to ``window`` lines that holds no fingerprint, and the part of a run beyond what the
first places of its fingerprints share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import KEY, row_key, words
from quarrylog.llm.periodic_runs import agree, levels_of
from quarrylog.plans.scratch import Scratch

#: A newline before a line with a word; blank lines stay with the line before them.
CUT = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
WINDOW, LONG_WORDS = 3, 40
#: Diagonals of a pair that are compared line by line.
FEW = 8


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), CUT)


def _number(md5: Column) -> Column:
    """60 bits of an MD5 digest, in the order of its hexadecimal digits (so that SQL of any engine can select the same)."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def hashed_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``(*KEY, h, marks)``: the hash of each line, and the fingerprints as (line, value); a row for each key."""
    df = docs.select(*row_key(), lines_of().alias("l"))
    digests = F.transform("l", lambda x: F.md5(F.regexp_replace(x, r"[\x20\x09-\x0D]+$", "")))
    long = F.filter(F.transform("l", lambda x, i: F.when(F.size(words(x)) >= long_words, i)), lambda i: i.isNotNull())
    df = df.select(*KEY, digests.alias("m"), long.alias("long"))
    grams = F.when(F.size("m") > 1, F.transform(F.slice("m", 2, F.greatest(F.lit(0), F.size("m") - 1)), lambda x, i: _number(F.md5(F.concat(F.get("m", i), x)))))
    df = df.select(*KEY, F.transform("m", _number).alias("h"), "long", grams.alias("g"))
    least = lambda j: F.slice("g", j + 1, F.lit(window))
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("g") - window)), lambda j: (j + F.array_position(least(j), F.array_min(least(j))) - 1).cast("int"))
    df = df.select(*KEY, "h", "long", "g", F.when(F.col("g").isNotNull(), F.array_distinct(at)).otherwise(F.array().cast("array<int>")).alias("s"))
    mark = lambda value: lambda i: F.struct(i.alias("line"), value(i).alias("v"))
    marks = F.concat(F.transform("s", mark(lambda i: F.get("g", i))), F.transform("long", mark(lambda i: -F.get("h", i) - 1)))
    return df.select(*KEY, "h", marks.alias("marks")).dropDuplicates(list(KEY))


def _stretches(a: np.ndarray, b: np.ndarray, i: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(first, last, diagonal) of the runs of equal lines that hold the places i of the diagonals d, each once."""
    diagonals = np.unique(d)
    if len(diagonals) <= FEW:
        found = []
        for k in diagonals.tolist():
            low, high = max(0, k), min(len(a), len(b) + k)
            same = np.r_[False, a[low:high] == b[low - k : high - k], False]
            borders = np.flatnonzero(same[1:] != same[:-1]) + low
            starts, stops = borders[::2], borders[1::2]
            run = np.searchsorted(starts, places := np.unique(i[d == k]), side="right") - 1
            run = np.unique(run[(run >= 0) & (places < stops[np.maximum(run, 0)])]) if len(starts) else run[:0]
            found.append(np.stack([starts[run], stops[run] - 1, np.full(len(run), k)]))
        return np.concatenate(found, axis=1)
    # many diagonals of one pair, as where a line stands very often: names of blocks tell how far each place extends
    ids = np.unique(np.r_[a, b], return_inverse=True)[1]
    joined = np.r_[ids[: len(a)], ids.max() + 1, ids[len(a) :]]
    names, j = levels_of(joined, int(joined.max()) + 1), i - d + len(a) + 1
    here = joined[i] == joined[j]
    i, j, d = i[here], j[here], d[here]
    found = np.stack([i - agree(names, i, j, True), i + agree(names, i, j, False) - 1, d])
    return np.unique(found, axis=1)


def _runs(merged: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs of each row (key..., ref, places, h, ref_h); ``merged``: only the stretches of lines that they cover together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for k in range(len(batch)):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("h", "ref_h"))
                places = batch.column("places")[k].values
                found = _stretches(a, b, *(places.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "d")))
                if merged and found.shape[1] > 1:
                    found = found[:, np.argsort(found[0], kind="stable")]
                    reach = np.maximum.accumulate(found[1])
                    new = np.flatnonzero(np.r_[True, found[0][1:] > reach[:-1] + 1])
                    found = np.stack([found[0][new], np.maximum.reduceat(found[1], new), found[2][new]])
                rows += [k] * found.shape[1]
                parts.append(found)
            first, last, diagonal = np.concatenate([*parts, np.empty((3, 0), dtype=np.int64)], axis=1).astype(np.int32)
            kept = batch.select([*KEY, "ref"]).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, (diagonal, first, last))], names=[*KEY, "ref", "diagonal", "first", "last"])

    return run


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, merged: bool = False) -> DataFrame:
    """Later runs: ``(*KEY, first, last, ref, ref_first)``, ref: (key columns) of the earlier place; lines count from 0.

    ``merged``: runs that touch or overlap, with the same ref, are one (ref_first is then that of its first run). A line that
    stands n times gives n runs, in time that grows with n log n.
    """
    steps = Scratch(docs.sparkSession)
    lines = steps.put(hashed_lines(docs, window, long_words))
    at = lines.select(*KEY, F.inline("marks")).select(*KEY, F.col("line").alias("i"), "v")
    firsts = at.groupBy("v").agg(F.min(F.struct(*KEY, "i")).alias("p"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = at.join(steps.put(firsts), "v").where(F.struct(*KEY, "i") > F.col("p"))
    ref = F.struct(*[F.col(f"p.{c}") for c in KEY])
    pairs = later.select(*KEY, ref.alias("ref"), F.struct("i", (F.col("i") - F.col("p.i")).alias("d")).alias("at")).groupBy(*KEY, "ref").agg(F.collect_list("at").alias("places"))
    pairs = steps.put(pairs)
    other = lines.select(F.struct(*KEY).alias("ref"), F.col("h").alias("ref_h"))
    both = pairs.join(lines.select(*KEY, "h"), list(KEY)).join(other, "ref")
    kinds = [(c, lines.schema[c].dataType.simpleString()) for c in KEY]
    key, inner = ", ".join(f"{c} {t}" for c, t in kinds), ", ".join(f"{c}: {t}" for c, t in kinds)
    found = both.mapInArrow(_runs(merged), f"{key}, ref struct<{inner}>, diagonal int, first int, last int")
    return found.select(*KEY, "first", "last", "ref", (F.col("first") - F.col("diagonal")).alias("ref_first"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with text without its later repeated runs, n_lines and n_deleted_lines.

    Null texts stay null with no lines, empty ones have one line. Rows equal in id and text count as one document and get
    one result. A text that loses all lines becomes empty. Columns n_lines and n_deleted_lines of ``docs`` are replaced.
    """
    own = ("n_lines", "n_deleted_lines")
    columns = [c for c in docs.columns if c not in own]
    gone = (
        repeated_runs(docs, window, long_words, merged=True)
        .select(*KEY, F.explode(F.sequence("first", "last")).alias("line"))
        .groupBy(*KEY)
        .agg(F.collect_set("line").alias("__gone"))
    )
    df = docs.select(*columns, *row_key()).join(gone, list(KEY), "left").withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines_of()))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> get(__lines, i)), '\n')")
    newlines = F.size(lines_of())
    return df.select(
        *[F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(newlines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted_lines"),
    )


def without_repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with deduplicated texts and n_chars to match; documents that lose all lines go, others stay as they were."""
    out = dedup_lines(docs, window, long_words).where("n_deleted_lines < n_lines or n_deleted_lines = 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
