"""Periodic runs of words: Karp-Miller-Rosenberg naming, and candidates on a grid.

Blocks of 1, 2, 4, ... words get names by ranking the pairs of names of their halves; equal names mean equal blocks of one
document, and a block that stands once has the name -1. How far two positions agree forwards, or backwards, is then read from the names by descending levels.
For each period p the positions 0, p, 2p, ... are a grid: a run of 2p words or more holds two neighbours of it, so both
ways from each pair of neighbours give every run. A pair is dropped at once unless the name of half of what it needs agrees on
one side of it; where no block of that length stands twice in a document, the period isn't tried there.

Rows never leave the task that reads them. A task names many short documents at once (``BATCH`` words), divided by words that occur once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words; words named at once; pairs of grid positions tested at once.
MIN_WORDS, BATCH, PAIRS = 12, 1 << 18, 1 << 20
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one id in ten with a period made at their end: fixed arithmetic on the CRC-32 of the id; null ids have none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def names_of(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(names by level and position, first positions): documents stand one after the other, a separator behind each."""
    flat: list[int] = []
    first = np.zeros(len(docs), dtype=np.int64)
    base = 0
    for k, words in enumerate(docs):
        first[k] = len(flat)
        seen: dict[bytes, int] = {}
        flat += [base + seen.setdefault(w, len(seen)) for w in words]
        base += len(seen) + 1
        flat.append(base - 1)
    return levels_of(np.array(flat, dtype=np.int64), base), first


def levels_of(ids: np.ndarray, base: int) -> np.ndarray:
    """By level the name of the block of 1, 2, 4, ... ids from each position on, -1 if it stands once; ids lie below ``base``."""
    level = np.where(np.bincount(ids, minlength=base)[ids] > 1, ids, -1) if len(ids) else ids
    levels, n = [level.astype(np.int32)], len(ids)
    width = 1
    while 2 * width <= n:
        left, right = level[: n - width], level[width:]
        at = np.flatnonzero((left >= 0) & (right >= 0))
        if not len(at):
            break
        _, rank, count = np.unique(left[at] * (n + base + 1) + right[at], return_inverse=True, return_counts=True)
        twice = count[rank] > 1
        if not twice.any():
            break
        level = np.full(n, -1, dtype=np.int64)
        level[at[twice]] = rank[twice]
        levels.append(level.astype(np.int32))
        width *= 2
    return np.array(levels)


def agree(names: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """For how many words the positions i and j agree from there on, or right before them (``back``); i < j."""
    n = names.shape[1]
    done = np.zeros(len(i), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = (i - done - (1 << k), j - done - (1 << k)) if back else (i + done, j + done)
        inside = (a >= 0) & (b < n)
        x, y = names[k][np.where(inside, a, 0)], names[k][np.where(inside, b, 0)]
        done += np.where(inside & (x == y) & (x >= 0), 1 << k, 0)
    return done


def runs_of(docs: list[list[bytes]], least: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document by start, then period."""
    names, first = names_of(docs)
    n = np.array([len(d) for d in docs], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not n.any():
        return out
    # the highest level on which a document has a name that occurs twice: it bounds the periods that need trying
    has = np.array([np.maximum.reduceat(level, first) >= 0 for level in names])
    top = np.where(has.any(axis=0), has.sum(axis=0) - 1, -1)
    last = np.minimum(n // 2, np.where(top >= 0, 2 << (np.maximum(top, 0) + 1), 0))
    doc = np.repeat(np.arange(len(docs)), last)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(last) - last, last) + 1
    need = np.maximum(period, least - period)  # words that must agree, both ways together
    level = np.frexp(((need + 1) // 2).astype(np.float64))[1] - 1
    tried = level <= top[doc]
    doc, period, need, level = doc[tried], period[tried], need[tried], level[tried]
    pairs = (n[doc] - 1) // period
    ends = np.cumsum(pairs)
    found: list[np.ndarray] = []
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        index = np.arange(low, min(low + PAIRS, int(ends[-1])))
        of = np.searchsorted(ends, index, side="right")
        p, k = period[of], level[of]
        i = first[doc[of]] + (index - (ends[of] - pairs[of])) * p
        back = i - (1 << k)
        inside = back >= 0
        x, y = names[k, i], names[k, np.where(inside, back, 0)]
        hit = ((x >= 0) & (x == names[k, i + p])) | (inside & (y >= 0) & (y == names[k, np.where(inside, back + p, 0)]))
        i, p, of = i[hit], p[hit], of[hit]
        before = agree(names, i, i + p, True)
        first_pair = before < p  # further pairs of the grid in one run find it again
        i, p, of, before = i[first_pair], p[first_pair], of[first_pair], before[first_pair]
        after = agree(names, i, i + p, False)
        long = before + after >= need[of]
        found.append(np.stack([i - before, p + before + after, p, doc[of]])[:, long])
    if found:
        start, length, p, of = np.concatenate(found, axis=1)
        order = np.lexsort((p, length, start))  # of one stretch the smallest period
        start, length, p, of = start[order], length[order], p[order], of[order]
        new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, dtype=bool)
        start, length, p, of = start[new], length[new], p[new], of[new]
        order = np.lexsort((p, start))
        for s, m, q, d in zip((start - first[of])[order].tolist(), length[order].tolist(), p[order].tolist(), of[order].tolist(), strict=True):
            out[d].append((s, m, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s, m, q in runs:
        change[s + q] += 1
        change[s + m] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def _digest(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    shown = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def _by_batch(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """Ids and words of about ``BATCH`` words at once; a longer document is alone or the last of its batch."""
    ids: list[int | None] = []
    docs: list[list[bytes]] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or b"").split()
            ids.append(doc_id)
            docs.append(planted(words, doc_id) if plant else words)
            held += len(words) + 1
            if held >= BATCH:
                yield ids, docs
                ids, docs, held = [], [], 0
    if ids:
        yield ids, docs


def _records(schema: pa.Schema, made: Callable[[int | None, list[bytes], list[tuple[int, int, int]]], list[tuple]], plant: bool, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _by_batch(batches, plant):
            rows = [r for doc_id, words, runs in zip(ids, docs, runs_of(docs, least), strict=True) for r in made(doc_id, words, runs)]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _ids_and_bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def find_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, length, period)``: every maximal stretch of ``least`` words and two periods or more; words count from 0."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")])
    run = _records(schema, lambda i, _, runs: [(i, *r) for r in runs], False, least)
    return _ids_and_bytes(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def run_report(docs: DataFrame, plant: bool = True, least: int = MIN_WORDS) -> DataFrame:
    """A row for each row of ``docs`` (its doc_id and text; other columns are not looked at): the runs' number, the longest, digests.

    Null, empty and blank texts have no words and no run: n_runs 0, four nulls, the digests of ''. Of runs of equal length the
    one of the smallest start, then period is shown. Repeated rows give repeated results, an empty table an empty one. A very
    long text takes memory and time in proportion to its words times the logarithm of its longest repetition. ``plant`` makes
    periods in some documents first (see ``planted``).
    """
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c, types[t]) for c, t in (x.split() for x in RESULT.split(", "))])
    return _ids_and_bytes(docs).mapInArrow(_records(schema, lambda *x: [_digest(*x)], plant, least), RESULT)


def collapse_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with texts in which each run is its first period; texts without a run stay as they are, white space included.

    n_chars, if there, counts the new text. Other columns, of any name, stay.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            words = [(t or "").encode().split() for t in texts]
            new = [b" ".join(collapsed(w, r)).decode() if r else t for t, w, r in zip(texts, words, runs_of(words, least), strict=True)]
            columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema)} | {"text": pa.array(new, type=pa.string())}
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(x) if x != t else n for x, t, n in zip(new, texts, old, strict=True)], type=columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)
