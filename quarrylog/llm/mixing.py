"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by weight; none takes more
than ``most`` times its own words, the excess goes to the others by weight. A source takes its complete epochs first; the
rest of its target is filled with documents in the order of the exponential keys -ln(u) / quality, u fixed by the id, by
prefix sums of their words. Keys are cut into buckets of equal width in their logarithm, none of which holds more than some
1 in 500 of exponential keys whatever their scale, so a hot source is sorted in many tasks and only sums meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.common import KEY, WORD, row_key
from quarrylog.plans.lineage import cut

#: Buckets of an octave of keys.
BUCKETS = 128


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """1 for plain text, down to 0.05 as marks and symbols take the place of letters."""
    at = F.coalesce(F.col(text), F.lit(""))
    return F.greatest(F.lit(0.05), 1 - 5.0 * F.regexp_count(at, F.lit(r"[#*$%&|<>]")) / F.greatest(F.lit(1), F.length(at)))


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)``: one row for each source (one window over that small table, in one task)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") > most * F.col("source_size"))
    per = per.withColumn("level", F.max(F.when(~F.col("capped"), F.struct(-F.col("source_size") / F.col("w"), "level"))).over(Window.partitionBy())["level"])
    return per.select("source", "source_size", F.when(F.col("capped"), most * F.col("source_size")).otherwise(F.col("level") * F.col("w")).cast("double").alias("target"))


def mix(light: DataFrame, most: float = 3.0, seed: int = 17) -> DataFrame:
    """``light`` (doc_id, source, size, quality and others) with source_size, target and taken.

    taken counts words with repeats: complete epochs times size, and the document at the end of the budget gives the words
    left. Documents without words take none. Rows of equal id draw the same key; ties go by id, then size, then KEY where ``light``
    has these columns, so that reruns agree. Null ids are drawn as "null". Columns with the names of the results are replaced.
    """
    light = light.drop("source_size", "target", "taken")
    ties = [c for c in KEY if c in light.columns]
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    df = light.withColumn("__x", -F.log(u) / F.greatest(F.lit(1e-9), F.coalesce("quality", F.lit(1.0))))
    df = cut(df.withColumn("__b", F.floor(BUCKETS * F.log2("__x")).cast("int")))
    targets = source_targets(df, most)
    sums = df.groupBy("source", "__b").agg(F.sum("size").alias("s"))
    past = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__src"), F.col("__b").alias("__at"), F.coalesce(F.sum("s").over(past), F.lit(0)).alias("__before"))
    targets = targets.withColumnRenamed("source", "__src2")
    offsets = cut(sums.join(targets, F.col("__src").eqNullSafe(F.col("__src2"))).drop("__src2"))
    own = Window.partitionBy("source", "__b").orderBy("__x", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__upto", F.sum("size").over(own))
    df = df.join(offsets, F.col("source").eqNullSafe(F.col("__src")) & (F.col("__b") == F.col("__at")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - (F.col("__before") + F.col("__upto") - F.col("size"))))
    return df.withColumn("taken", (epochs * F.col("size") + part).cast("long")).drop("__x", "__b", "__src", "__at", "__before", "__upto")


def mix_documents(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: whole documents, the one at the end of a budget if half of it fits.

    Rows equal in id and text share their copies, rounded up.
    """
    taken = mix(docs.select("doc_id", "source", n_words().alias("size"), quality_weight().alias("quality"), *row_key()), most)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    share = taken.groupBy(*KEY).agg(F.ceil(F.sum(copies) / F.count("*")).cast("int").alias("__n")).where("__n > 0")
    out = docs.select("*", *row_key()).join(cut(share), list(KEY))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), "__n")).alias("__copy")).drop("__copy")
