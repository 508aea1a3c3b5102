"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of all documents are computed in Arrow batches. The trees are fitted on a bounded sample of labelled rows
(``MAX_TRAIN``, the least by a hash of the id) and flattened into arrays of features, cuts and leaves; scoring walks all
rows of a batch down a tree at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.plans.lineage import cut
from quarrylog.plans.sampling import least_by_hash

MAX_TRAIN = 20_000
BINS, DEPTH, TREES, RATE, LEAF, L2 = 64, 4, 60, 0.15, 20, 1.0
SYMBOLS = re.compile(r"[#*$%&|<>]")
NAMES = ("log_words", "word_length", "symbols", "digits", "upper", "punctuation", "distinct_words", "top_word", "lines", "distinct_lines", "words_a_line", "long_words", "non_ascii", "stops", "repeated_pairs", "braces")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of NAMES; all zero for null and empty ones."""
    t = text or ""
    w = t.split()
    if not w:
        return [0.0] * len(NAMES)
    n, chars = len(w), len(t)
    lines = [x for x in t.split("\n") if x.strip()]
    seen: dict[str, int] = {}
    for x in w:
        seen[x] = seen.get(x, 0) + 1
    b = np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)
    h = np.bincount(b, minlength=256)
    letters = h[65:91].sum() + h[97:123].sum()
    punctuation = h[33] + h[44] + h[46] + h[58] + h[59] + h[63]
    return [
        float(np.log1p(n)), (chars - n + 1) / n, len(SYMBOLS.findall(t)) / chars, h[48:58].sum() / chars, h[65:91].sum() / max(1, letters),
        punctuation / n, len(seen) / n, max(seen.values()) / n, float(np.log1p(len(lines))), len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        sum(v for x, v in seen.items() if len(x) > 12) / n, (b >= 128).sum() / len(b), sum(v for x, v in seen.items() if len(x) <= 3) / n,
        1 - len(set(zip(w, w[1:], strict=False))) / max(1, n - 1), (h[40] + h[41] + h[123] + h[125] + h[91] + h[93]) / chars,
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    rest = [c for c in docs.columns if c not in (text, "stats")]
    df = docs.select(*rest, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(found, type=pa.list_(pa.float64()))], names=[*rest, "stats"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text"] + ["stats array<double>"])
    return df.mapInArrow(run, schema)


@dataclass
class Trees:
    """feature (-1: leaf), threshold and value of each tree's nodes; node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                k = f[at]
                at = np.where(k < 0, at, 2 * at + 1 + (x[rows, np.maximum(k, 0)] > c[at]))
            raw += v[at]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on histograms of quantile bins; one class or no rows give a constant score."""
    nodes = 2 ** (DEPTH + 1) - 1
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return Trees(np.full((0, nodes), -1), np.zeros((0, nodes)), np.zeros((0, nodes)), start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        todo = [(0, np.arange(len(y)), 0)]
        for node, rows, depth in todo:
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, -1)
            for j in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * LEAF else ():
                b = binned[rows, j]
                m = len(cuts[j]) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b, weights=z, minlength=m))[:-1] for z in (g[rows], h[rows], np.ones(len(rows))))
                gain = cg**2 / (ch + L2) + (sg - cg) ** 2 / (sh - ch + L2) - sg**2 / (sh + L2)
                gain[(cn < LEAF) | (len(rows) - cn < LEAF)] = -1
                if len(gain) and gain[k := int(gain.argmax())] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] < 0:
                value[node] = -RATE * sg / (sh + L2)
                raw[rows] += value[node]
                continue
            _, j, k = best
            feature[node], threshold[node] = j, cuts[j][k]
            left = binned[rows, j] <= k
            todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the text, with held_out, score (0 to 1) and predicted.

    Null and empty texts have statistics of zero and are scored like others; a null id is never held out nor labelled; labels
    that are null or contradict each other teach nothing. Rows that repeat an id are scored each by its own text. Columns of
    ``docs`` with the names of the results are replaced. An empty table gives an empty one.
    """
    stats = cut(with_statistics(docs.drop("held_out", "score", "predicted")).withColumn("held_out", held_out()))
    taught = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    known = stats.where("not held_out").select("doc_id", "stats").join(taught, "doc_id").select("stats", "y", "doc_id")
    sample = least_by_hash(known, F.xxhash64("doc_id"), ["doc_id", "stats"], MAX_TRAIN, known.count()).collect()
    x = np.array([r["stats"] for r in sample], dtype=np.float64).reshape(-1, len(NAMES))
    shared = docs.sparkSession.sparkContext.broadcast(fit(x, np.array([r["y"] for r in sample], dtype=np.float64)))
    rest = [c for c in stats.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            s = shared.value.score(flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*rest, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name != "stats"] + ["score double", "predicted int"])
    return stats.mapInArrow(run, schema)
