"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir``.

    On a local master that names none, a folder under the warehouse is taken, as driver and executors are one process there;
    on a cluster that is an error, as executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    if (at := context.getCheckpointDir()) is None:
        at = context.getConf().get("spark.checkpoint.dir")
        if not at:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(at)
        at = context.getCheckpointDir() or at
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder: lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate files, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
