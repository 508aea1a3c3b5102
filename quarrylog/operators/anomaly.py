"""Behaviour anomalies: an isolation forest (Liu, Ting, Zhou 2008) over the features of addresses and of users.

Each entity type has its own forest. Trees grow on executors, each from ``sample`` entities of a pool of at most
``trees * sample``; the flattened trees (bounded by those two parameters) go to the tasks, which score every entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig, AnomalyConfig, block
from quarrylog.operators.detectors import entity_features
from quarrylog.plans.lineage import cut
from quarrylog.plans.sampling import least_by_hash

#: Our feature columns with the names that alerts give them.
NAMES = {
    "total": "total_events", "failed": "failed_logins", "success": "successful_logins", "failed_ratio": "failed_ratio", "users": "unique_users", "ips": "unique_ips",
    "paths": "unique_paths", "http": "http_requests", "http_errors": "http_errors", "auth": "auth_attempts", "unusual_hours": "unusual_hour_events", "sources": "source_diversity",
}
#: From what on a feature of an entity without peers is noted.
ALONE = {"failed_ratio": 0.5, "failed": 10, "total": 10, "unusual_hours": 10, "users": 5, "ips": 5}
TREE = "entity_type string, tree int, psi int, feature array<int>, split array<double>, child array<int>, path array<double>"


def entity_vectors(entries: DataFrame, with_users: bool = True, config: AnalyzerConfig | AnomalyConfig | None = None) -> DataFrame:
    """``(entity_type, entity_id, last_seen, sources, v)``: the features of each address and, if asked for, of each user, from one scan."""
    df = entity_features(entries, ("ip_address", "username")[: 2 if with_users else 1], config)
    kind = F.when(F.col("entity") == "ip_address", "ip").otherwise("user").alias("entity_type")
    return df.select(kind, "entity_id", "last_seen", F.col("seen_sources").alias("sources"), F.array(*NAMES).alias("v"))


def mean_depth(n: int) -> float:
    """The mean depth of an unsuccessful search among n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """One tree as arrays: feature (-1: leaf), split, first child (the second follows it) and path length."""
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    feature, split, child, path = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(usable):
            path[node] = depth + mean_depth(len(rows))
            continue
        f = int(rng.choice(usable))
        at = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] <= at
        feature[node], split[node], child[node] = f, at, len(feature)
        for k, part in enumerate((rows[below], rows[~below])):
            todo.append((len(feature) + k, part, depth + 1))
        for column, empty in ((feature, -1), (split, 0.0), (child, 0), (path, 0.0)):
            column += [empty, empty]
    return feature, split, child, path


def fit(vectors: DataFrame, sizes: dict[str, int], trees: int = 100, sample: int = 256, seed: int = 42) -> dict[str, list[tuple]]:
    """The trees of each type; sizes: its entities. Hashes of the ids choose a tree's entities, so results don't depend on partitions."""
    kinds = sorted(sizes)
    h = F.xxhash64("entity_id", F.lit(seed))
    pools = [least_by_hash(vectors.where(F.col("entity_type") == k), h, ["entity_id"], trees * sample, sizes[k]) for k in kinds]
    pool = pools[0]
    for p in pools[1:]:
        pool = pool.unionByName(p)
    draws = pool.select("entity_type", "entity_id", "v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    order = Window.partitionBy("entity_type", "tree").orderBy(F.xxhash64("entity_id", F.lit(seed), "tree"), "entity_id")
    draws = draws.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("r")["v"].tolist(), dtype=np.float64)
        tree = int(pdf["tree"].iat[0])
        grown = grow(x, np.random.default_rng([seed, tree]))
        return pd.DataFrame([(pdf["entity_type"].iat[0], tree, len(x), *grown)], columns=["entity_type", "tree", "psi", "feature", "split", "child", "path"])

    forest: dict[str, list[tuple]] = {k: [] for k in kinds}
    for r in draws.groupBy("entity_type", "tree").applyInPandas(one, TREE).orderBy("tree").collect():  # trees * types rows
        forest[r["entity_type"]].append((r["psi"], np.array(r["feature"]), np.array(r["split"]), np.array(r["child"]), np.array(r["path"])))
    return forest


def isolation(x: np.ndarray, forest: list[tuple]) -> np.ndarray:
    """The isolation score of each row of ``x``: near 1 if few splits set it apart."""
    depth = np.zeros(len(x))
    for _, feature, split, child, path in forest:
        node = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(feature[node] >= 0)).size:
            at = node[inner]
            node[inner] = child[at] + (x[inner, feature[at]] > split[at])
        depth += path[node]
    return 2.0 ** (-depth / len(forest) / max(mean_depth(forest[0][0]), 1e-9))


def score(vectors: DataFrame, contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 42, minimum: int = 20) -> DataFrame:
    """``vectors`` with decision and score (0 to 100, higher is more anomalous); types of fewer than ``minimum`` entities have no rows.

    An empty table if that leaves no type. Isolation scores are rounded to six digits, so the exact percentile behind the decision
    holds a million distinct values at most.
    """
    sizes = {r["entity_type"]: r["count"] for r in vectors.groupBy("entity_type").count().collect()}  # a row for each type
    kinds = sorted(k for k, n in sizes.items() if n >= minimum)
    if not kinds:
        return vectors.limit(0).withColumn("decision", F.lit(0.0)).withColumn("score", F.lit(0.0))
    forest = fit(vectors, {k: sizes[k] for k in kinds}, trees, sample, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = np.zeros(len(pdf))
            for k in kinds:
                rows = np.flatnonzero((pdf["entity_type"] == k).to_numpy())
                if len(rows):
                    out[rows] = isolation(np.array(pdf["v"].iloc[rows].tolist(), dtype=np.float64), forest[k])
            yield pdf.assign(isolation=out.round(6))

    schema = "entity_type string, entity_id string, last_seen timestamp_ntz, sources array<string>, v array<double>, isolation double"
    found = cut(vectors.where(F.col("entity_type").isin(kinds)).select("entity_type", "entity_id", "last_seen", "sources", "v").mapInPandas(run, schema))
    offset = found.groupBy("entity_type").agg(F.percentile(-F.col("isolation"), F.lit(contamination)).alias("offset"))
    df = found.join(F.broadcast(offset), "entity_type")  # two rows at most
    decision = -F.col("isolation") - F.col("offset")
    df = df.withColumn("decision", decision)
    return df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 - 100 * F.col("decision")))).drop("offset", "isolation")


def _notes(mean: list[Column]) -> Column:
    """The five features highest above the mean of the other entities of the type, as text."""
    found = []
    for k, name in enumerate(NAMES.values()):
        v, base = F.get("v", F.lit(k)), mean[k]
        ratio = F.try_divide(v, base)
        weight = F.when(v <= 0, None).when(base <= 0, F.when(v >= 5, v)).when((ratio >= 2) & (v >= 1), ratio)
        beside = F.when(base > 0, F.concat(F.lit(" (~"), F.format_string("%.1f", ratio), F.lit("x peer average)"))).otherwise("")
        text = F.concat(F.lit(name.replace("_", " ") + ": "), v.cast("long").cast("string"), beside)
        found.append(F.when(weight.isNotNull(), F.struct((-weight).alias("w"), F.lit(k).alias("k"), text.alias("text"))))
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, 5), lambda x: x["text"])


def alone_notes() -> Column:
    """The same for an entity without peers, by fixed bounds."""
    found = []
    for k, (column, name) in enumerate(NAMES.items()):
        v = F.get("v", F.lit(k))
        if column not in ALONE:
            continue
        label = F.concat(F.lit("failed login ratio: "), F.format_string("%.2f", v)) if column == "failed_ratio" else F.concat(F.lit(name.replace("_", " ") + ": "), v.cast("long").cast("string"))
        found.append(F.when(v >= ALONE[column], F.struct((-v).alias("w"), F.lit(k).alias("k"), label.alias("text"))))
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, 5), lambda x: x["text"])


def describe(vectors: DataFrame, with_peers: bool = True) -> DataFrame:
    """``vectors`` with notes: what stands out beside the other entities of the type, or, without peers, by fixed bounds."""
    if not with_peers:
        return vectors.withColumn("notes", alone_notes())
    sums = [F.sum(F.get("v", F.lit(k))).alias(f"s{k}") for k in range(len(NAMES))]
    totals = vectors.groupBy("entity_type").agg(F.count("*").alias("n"), *sums)
    mean = [F.coalesce(F.try_divide(F.round(F.col(f"s{k}") - F.get("v", F.lit(k)), 9), F.col("n") - 1), F.lit(0.0)) for k in range(len(NAMES))]
    return vectors.join(F.broadcast(totals), "entity_type").withColumn("notes", _notes(mean)).select(*vectors.columns, "notes")  # two rows at most


def anomalies(entries: DataFrame, config: AnalyzerConfig | AnomalyConfig | None = None) -> DataFrame:
    """Alerts on entities whose score reaches the threshold, with notes on the features that stand out; empty where no type is large enough."""
    c = block(config, AnomalyConfig)
    contamination, trees, seed, minimum, threshold = c.contamination, c.n_estimators, c.random_state, c.minimum_samples, c.alert_threshold
    vectors = cut(entity_vectors(entries, c.include_user_entities, c))
    scored = score(vectors, contamination, trees, 256, seed, minimum)
    notes = describe(vectors).select("entity_type", "entity_id", "notes")
    df = scored.where(F.col("score") >= threshold).join(notes, ["entity_type", "entity_id"])
    s, is_ip = F.col("score"), F.col("entity_type") == "ip"
    sure = 0.5 + s / 200 if threshold <= 0 else 0.55 + F.greatest(F.lit(0.0), s - threshold) / 100 + s / 400
    shown = F.struct(*[F.get("v", F.lit(k)).alias(n) for k, n in enumerate(NAMES.values())])
    evidence = F.struct(F.lit("IsolationForest").alias("model"), F.struct(F.lit(float(contamination)).alias("contamination"), F.lit(trees).alias("n_estimators"), F.lit(seed).alias("random_state"), F.lit(minimum).alias("minimum_samples"), F.lit(float(threshold)).alias("alert_threshold")).alias("model_parameters"), F.col("entity_id").alias("entity"), "entity_type", F.round("score", 2).alias("anomaly_score"), F.round("decision", 6).alias("decision_function"), shown.alias("features"), F.col("notes").alias("behavioral_notes"), F.col("sources").alias("sample_sources"), F.lit("the score tells how unusual an entity is among its peers, not that it attacks").alias("score_note"))
    about = F.concat(F.lit("Unusual activity of "), "entity_type", F.lit(" "), "entity_id", F.when(F.size("notes") > 0, F.concat(F.lit(": "), F.array_join("notes", "; "))).otherwise(""))
    found = df.select(
        F.lit("ANOMALOUS_BEHAVIOR").alias("alert_type"), F.when(s >= 80, "HIGH").when(s >= 70, "MEDIUM").otherwise("LOW").alias("severity"), F.col("last_seen").alias("timestamp"),
        F.when(is_ip, "-").otherwise(F.col("entity_id")).alias("username"), F.when(is_ip, F.col("entity_id")).otherwise("").alias("ip_address"),
        F.least(F.lit(0.95), sure).alias("confidence"), F.greatest(F.lit(20), F.least(F.lit(85), F.bround(0.85 * s).cast("int"))).alias("risk_score"), F.lit(None).cast("long").alias("line_no"),
        F.lit("anomaly").alias("source"), about.alias("description"), F.to_json(evidence).alias("evidence"), s.alias("anomaly_score"),
    )
    return found.orderBy(F.desc(F.round("anomaly_score", 2)), "timestamp", "ip_address", "username")
