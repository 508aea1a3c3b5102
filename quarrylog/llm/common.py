"""What the operators share: the word pattern, reading a table, and a key for rows whose ids may repeat or be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
KEY = ("__k1", "__k2", "__k3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns ``KEY``: null-free, equal for rows of equal id and text, and in the order of the ids (null first)."""
    at = F.coalesce(F.col(text), F.lit(""))
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias(KEY[0]),
        F.xxhash64(F.col(doc_id).isNull(), at).alias(KEY[1]),
        F.hash(F.length(at), at).alias(KEY[2]),
    ]
