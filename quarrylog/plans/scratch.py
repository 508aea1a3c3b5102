"""Intermediate tables in the shared folder, removed when they are done with."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrylog.plans.lineage import ensure_checkpoint_dir, remove_folder

#: Folders of this process that are still there, by the session that made them.
_FOLDERS: dict[str, SparkSession] = {}


class Scratch:
    """Parquet tables of one operator's steps: ``put`` writes one and reads it back, ``drop`` removes some or all.

    What isn't dropped, as results still read it, goes when the driver's process ends, or with ``remove_all``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{ensure_checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}", 0
        _FOLDERS[self.folder] = spark

    def put(self, df: DataFrame, **options: str) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes these tables (none named: all), and lets Spark's cleaner remove the shuffle files of the steps that made them."""
        for path in [getattr(t, "_scratch_path", None) for t in tables] if tables else [self.folder]:
            if path and path.startswith(self.folder):
                remove_folder(self.spark, path)
        if not tables:
            _FOLDERS.pop(self.folder, None)
        release(self.spark)


def remove_all() -> None:
    """Removes the folders of all operators of this process; results that still read them can't be read after that."""
    for folder, spark in list(_FOLDERS.items()):
        _FOLDERS.pop(folder)
        try:
            if spark.sparkContext._jsc is not None:
                remove_folder(spark, folder)
        except Exception:  # the session's JVM is gone: its folder is the cluster's to clean
            return


atexit.register(remove_all)


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files once nothing refers to them, but finds out only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
