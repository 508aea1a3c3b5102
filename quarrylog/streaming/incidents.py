"""Incidents that grow batch by batch: new alerts join, and may merge, the incidents there are.

A batch is chained with the stored alerts near it only: those of the same key within two windows. As further alerts add
links and never take one away, the links of a batch end at its own alerts and at incidents that are already known; the graph is
contracted to these, components are sought on it alone, and the incidents that it touches are scored anew. Whatever the
batches, the incidents are those of all alerts at once.

Each batch writes its own part of three tables in the store's folder: alerts with their keys, memberships that are new or changed, and
the incidents it touched. A batch that is repeated after a failure reads the parts before its own and writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.config import AnalyzerConfig, CorrelationConfig, block
from quarrylog.operators import correlation
from quarrylog.operators.components import connected_components
from quarrylog.operators.detectors import ALERT
from quarrylog.plans.lineage import cut


class IncidentStore:
    """The incidents of all batches of alerts (columns ``detectors.ALERT``) so far, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, config: AnalyzerConfig | None = None) -> None:
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or AnalyzerConfig()

    def _batches(self, table: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _before(self, table: str, batch: int | None = None) -> DataFrame | None:
        """The parts of earlier batches (all by default) with the column batch; None if there are none."""
        parts = [b for b in self._batches(table) if batch is None or b < batch]
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/batch={b}" for b in parts]) if parts else None

    def _write(self, table: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    @staticmethod
    def _current(memberships: DataFrame) -> DataFrame:
        return memberships.groupBy("alert_id").agg(F.max_by("incident_id", "batch").alias("incident_id"))

    def add(self, alerts: DataFrame, batch: int) -> None:
        """Takes in the alerts of a batch; ids of batches ascend. Alerts that are there already change nothing. Fits ``foreachBatch``."""
        c = block(self.config, CorrelationConfig)
        old_alerts, old_keys, old_members = (self._before(t, batch) for t in ("alerts", "keys", "memberships"))
        new = correlation.deduplicate(alerts.select(*ALERT, *["seq"] * ("seq" in alerts.columns)))
        if old_alerts is not None:
            new = new.join(old_alerts.select("alert_id"), "alert_id", "left_anti")
        new = cut(new)
        keys = cut(correlation.keyed(new, c)) if c.enabled else cut(correlation.keyed(new.limit(0), c))
        near = keys
        if old_keys is not None:
            # every stored alert within a window of a new one lies in its slot or one beside it
            width = max(1, c.window_seconds) * 1_000_000
            slots = keys.select("key", F.explode(F.sequence(F.floor(F.col("t") / width) - 1, F.floor(F.col("t") / width) + 1)).alias("slot")).distinct()
            stored = old_keys.withColumn("slot", F.floor(F.col("t") / width)).join(slots, ["key", "slot"], "left_semi")
            near = keys.unionByName(stored.select(*keys.columns))
        found = correlation.links(near, c)
        members = new.select("alert_id", F.col("alert_id").alias("incident_id"))
        if old_members is not None:
            current = self._current(old_members)
            label = lambda df, x: df.join(current.select(F.col("alert_id").alias(x), F.col("incident_id").alias(f"{x}_in")), x, "left").withColumn(x, F.coalesce(f"{x}_in", x)).drop(f"{x}_in")
            found = label(label(found, "alert_id"), "head")
        moved = cut(connected_components(found.select("alert_id", "head")).where("node <> component"))
        members = members.unionByName(current.join(moved.select(F.col("node").alias("incident_id")), "incident_id", "left_semi").select("alert_id", "incident_id")) if old_members is not None else members
        members = cut(members.join(moved, F.col("incident_id") == F.col("node"), "left").select("alert_id", F.coalesce("component", "incident_id").alias("incident_id")))
        self._write("alerts", batch, new)
        self._write("keys", batch, keys)
        self._write("memberships", batch, members)
        touched = self.memberships(batch).join(members.select("incident_id").distinct(), "incident_id", "left_semi")
        whole = self._before("alerts", batch + 1).drop("batch").join(touched.select("alert_id"), "alert_id", "left_semi")
        self._write("incidents", batch, correlation.score(correlation.correlate(whole, self.config, touched), self.config))

    def memberships(self, batch: int | None = None) -> DataFrame:
        """``(alert_id, incident_id)`` as of now, or as of a batch."""
        parts = self._before("memberships", None if batch is None else batch + 1)
        return self._current(parts) if parts is not None else self.spark.createDataFrame([], "alert_id string, incident_id string")

    def incidents(self) -> DataFrame | None:
        """The scored incidents as of now; those that were merged into others are gone. None before the first batch."""
        parts = self._before("incidents")
        if parts is None:
            return None
        last = parts.groupBy("incident_id").agg(F.max("batch").alias("batch"))
        there = self.memberships().select("incident_id").distinct()
        return parts.join(last, ["incident_id", "batch"], "left_semi").join(there, "incident_id", "left_semi").drop("batch")
