"""Order within keys of which one may hold most of all rows: row before, latest value so far.

A window by key puts a key's rows into one task. Here the rows of keys beyond ``limit`` are cut into ranges of the order, the
window runs within ranges, and what a range needs from those before it (its predecessor's last row, the latest value) is
carried over a table that has one row for each key and range. The results are those of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.plans.lineage import cut
from quarrylog.plans.scratch import Scratch

#: Rows of a key from which on it is cut, and about how many rows a range then has.
HOT, RANGE = 1_000_000, 250_000


def in_ranges(df: DataFrame, keys: list[str], order: list[str], rows: int, size: int = RANGE) -> DataFrame:
    """``df`` (of some ``rows``) written once with ``block``: ranges of the order by keys, then ``order``, of about ``size`` rows.

    A range may hold several keys, and a key several ranges; the numbers ascend with the order.
    """
    n = max(1, -(-rows // size))
    return Scratch(df.sparkSession).put(df.repartitionByRange(n, *keys, *order).withColumn("block", F.spark_partition_id()))


@dataclass(frozen=True)
class Ordered:
    """Rows with their order within ``keys``; where ``split``, a column block cuts the rows of hot keys (0 for all others)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    def _within(self) -> Window:
        return Window.partitionBy(*self.keys, *["block"] * self.split).orderBy(*self.order)

    def _carried(self, last: Column, frame: Column) -> DataFrame:
        """(keys, block, __carried) for each key and block: ``last`` by block, then ``frame`` over the blocks before."""
        ends = self.rows.where("block > 0").groupBy(*self.keys, "block").agg(last.alias("__last"))
        return ends.select(*self.keys, "block", frame.alias("__carried"))

    def _joined(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        return rows.join(carried, [*self.keys, "block"], "left")

    def previous(self, name: str, *fields: str) -> Ordered:
        """Adds ``name``: the struct of ``fields`` of the row before, null for a key's first."""
        rows = self.rows.withColumn(name, F.lag(F.struct(*fields)).over(self._within()))
        if self.split:
            before = F.lag("__last").over(Window.partitionBy(*self.keys).orderBy("block"))
            carried = self._carried(F.max(F.struct(F.struct(*self.order).alias("o"), F.struct(*fields).alias("v"))), before)
            rows = self._joined(rows, carried).withColumn(name, F.coalesce(name, F.col("__carried.v"))).drop("__carried")
        return replace(self, rows=rows)

    def latest(self, name: str, value: Column) -> Ordered:
        """Adds ``name``: the last ``value`` up to this row that isn't null."""
        so_far = (Window.unboundedPreceding, Window.currentRow)
        rows = self.rows.withColumn("__value", value)
        out = replace(self, rows=rows.withColumn(name, F.last("__value", ignorenulls=True).over(self._within().rowsBetween(*so_far))))
        if self.split:
            last = F.max(F.when(F.col("__value").isNotNull(), F.struct(F.struct(*self.order).alias("o"), F.col("__value").alias("v"))))
            before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*self.keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
            carried = replace(self, rows=rows)._carried(last, before)
            out = replace(out, rows=self._joined(out.rows, carried).withColumn(name, F.coalesce(name, F.col("__carried.v"))).drop("__carried"))
        return replace(out, rows=out.rows.drop("__value"))


def ordered(df: DataFrame, keys: list[str], order: list[str], limit: int = HOT, size: int = RANGE, counted: DataFrame | None = None) -> Ordered:
    """``df`` by ``keys`` in ``order``, whose columns tell rows apart; keys of over ``limit`` rows are split.

    Up to ``limit`` rows in all (of ``counted``, if a table of as many rows is had for less) nothing is counted by key. Keys that are null stay whole. The hot keys, at most one for each ``limit`` rows, are broadcast.
    """
    plain = Ordered(df, tuple(keys), tuple(order), False)
    if (df if counted is None else counted).count() <= limit:
        return plain
    hot = cut(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit))
    n = hot.agg(F.sum("__n")).first()[0]
    if n is None:
        return plain
    hot = F.broadcast(hot.drop("__n"))
    cold = df.join(hot, keys, "left_anti").withColumn("block", F.lit(0))
    cut_up = ordered_ranges(df.join(hot, keys, "left_semi"), keys, order, n, size)
    return replace(cut_up, rows=cold.unionByName(cut_up.rows))


def ordered_ranges(df: DataFrame, keys: list[str], order: list[str], rows: int, size: int = RANGE) -> Ordered:
    """``df``, of ``rows`` rows, with all keys cut into ranges."""
    blocks = in_ranges(df, keys, order, rows, size).withColumn("block", F.col("block") + 1)
    return Ordered(blocks, tuple(keys), tuple(order), True)
