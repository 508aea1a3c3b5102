"""What the stateful streams share: the state store, and event time as microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.plans.scratch import Scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs a store with several column families; one that the session names is kept."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def event_time(df: DataFrame, delay: str) -> DataFrame:
    """``df`` with ``event_time``, its timestamp as one with a zone (the session's, UTC), watermarked ``delay`` behind the latest."""
    return df.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)


def micros(c: str = "event_time") -> Column:
    return F.unix_micros(c)


def drained(df: DataFrame) -> DataFrame:
    """What a stream in append mode gives for all that its source has by now, written to the shared folder; it starts anew each time."""
    folder = Scratch(df.sparkSession).folder
    writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
