"""How the sources of a language differ in their words: exact sums of differences between all pairs, by a heavy-light split.

A group is a source in a language. Each kept term of the language has a smoothed share in each group, an integer of billionths; a
group that lacks the term has the share of count 0, its *floor*. The distance of two groups sums the differences of the
shares over all kept terms, and is made of three exact parts:

* V times the difference of the floors, as if no group had any term;
* terms that stand in many groups (heavy): dense tiles, a block of groups by a block of terms as a numpy matrix, with what
  each term adds to the difference of the floors;
* terms of few groups (light): what a group's own terms add against the other's floor, from a histogram of its shares, and,
  for the pairs that share a term, a correction from the postings of that term joined with themselves. As a light term
  stands in at most one group in ``HEAVY``, these lists are short.

Words are counted in map tasks, so a source of a third of all rows leaves a task as a row for each of its terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.plans.scratch import Scratch

#: Documents of the language that a kept term needs; ranks of terms that are reported; what is added to each count.
MIN_DOCS, TOP, ADDED = 30, 50, 5
BILLION = 1_000_000_000
#: A term is heavy if it stands in more than one group in HEAVY; groups and (about) terms of a tile; counts that a map task holds.
HEAVY, TILE, TERMS, HELD = 8, 64, 2048, 300_000
#: Groups of up to this number go to the tasks with a broadcast, more are joined by a shuffle.
SMALL = 50_000
#: ASCII letters in lower case and all bytes above ASCII; the rest are spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) over the rows (lang, source, text) that the task has at hand together."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        groups = [(g, t, c, docs[g][t]) for g, terms in n.items() for t, c in terms.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([g[k] for g, *_ in groups], type=pa.string()) for k in (0, 1)] + [pa.array([x[k] for x in groups], type=t) for k, t in ((1, pa.binary()), (2, pa.int64()), (3, pa.int64()))],
            names=["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            terms = (text.as_py() or b"").translate(LETTERS).split()
            n[lang, source].update(terms)
            docs[lang, source].update(set(terms))
        if sum(map(len, n.values())) > HELD:
            yield out()
            n.clear(), docs.clear()
    yield out()


def group_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in each group, and the group's documents that hold it."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    df = docs.select(blank("lang"), blank("source"), F.col("text").cast("binary").alias("text"))
    df = df.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return df.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 V)), in decimals as the product may pass 64 bits; null where no term is kept."""
    above = F.lit(BILLION).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")
    below = (F.col(total) + ADDED * F.col("V")).cast("decimal(20,0)")
    return F.when(F.col("V") > 0, 1 + F.call_function("div", above, below))


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over the pairs a < b of one tile: of its heavy terms, or (rows without term) of the floors and the light terms."""
    lang, block, one, two = (k.as_py() for k in key)
    g, p, n, kind = (table[c].to_numpy() for c in ("g", "p", "n", "kind"))
    floors = kind == 0
    groups, at = np.unique(g[floors], return_index=True)
    z, terms_kept = p[floors][at], int(n[floors][0])
    row = np.searchsorted(groups, g)
    first, second = np.flatnonzero(groups // TILE == one), np.flatnonzero(groups // TILE == two)
    apart = np.abs(z[:, None] - z[None, :])
    if block < 0:
        own = np.zeros((len(groups), len(groups)), dtype=np.int64)  # what a group's light terms add against each other's floor
        for a in range(len(groups)):
            mine = np.flatnonzero((row == a) & ~floors)
            for low in range(0, len(mine), 4096):
                some = mine[low : low + 4096]
                own[a] += ((np.abs(p[some][:, None] - z[None, :]) - apart[a][None, :]) * n[some][:, None]).sum(axis=0)
        total = terms_kept * apart + own + own.T
    else:
        some = ~floors
        column = table["term"].combine_chunks().filter(pa.array(some)).dictionary_encode()
        m = np.repeat(z[:, None], len(column.dictionary), axis=1)
        m[row[some], column.indices.to_numpy()] = p[some]
        total = np.zeros((len(groups), len(groups)), dtype=np.int64)
        for a in first:
            total[a] = np.abs(m - m[a]).sum(axis=1) - m.shape[1] * apart[a]
    a, b = (x.ravel() for x in np.meshgrid(first, second, indexing="ij"))
    a, b = a[keep := a < b], b[keep]
    return pa.table({"lang": pa.array([lang] * len(a), type=pa.string()), "a": groups[a].astype(np.int64), "b": groups[b].astype(np.int64), "value": total[a, b]})


def _distances(shares: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """``(lang, a, b, value)`` of all pairs of a language's groups by number, a < b."""
    tiles = lambda df: df.withColumn("x", F.explode(F.sequence(F.lit(0), F.floor((F.col("S") - 1) / TILE).cast("int")))).withColumns({"one": F.least("x", "block_g"), "two": F.greatest("x", "block_g")})
    keyed = ["lang", "block", "one", "two", "g", "p", "n", "kind", "term"]
    in_block = F.floor(F.col("g") / TILE).cast("int").alias("block_g")
    heavy = shares.where("heavy").select("lang", "S", "g", in_block, "p", F.lit(1).cast("long").alias("n"), F.lit(1).alias("kind"), "term", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    light = shares.where("not heavy").groupBy("lang", "S", "g", "p").agg(F.count("*").alias("n"))
    light = light.select("lang", "S", "g", in_block, "p", "n", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("term"), F.lit(-1).alias("block"))
    floors = groups.select("lang", "S", "g", in_block, F.coalesce("z", F.lit(0)).alias("p"), F.col("V").alias("n"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))).alias("block"))
    rows = heavy.unionByName(light).unionByName(floors)
    made = tiles(rows).select(*keyed).groupBy("lang", "block", "one", "two").applyInArrow(_tile, "lang string, a long, b long, value long")
    both = shares.where("not heavy and m > 1").select("lang", "term", "g", "p", "z")
    other = both.select("lang", "term", F.col("g").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    d = lambda x, y: F.abs(F.col(x) - F.col(y))
    met = both.join(other, ["lang", "term"]).where("g < b").select("lang", F.col("g").alias("a"), "b", (d("p", "pb") - d("p", "zb") - d("z", "pb") + d("z", "zb")).alias("value"))
    return made.unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each group's distance to every other source of its language, and its most overused terms.

    Null lang, source and text count as ''. Terms are stretches of ASCII letters and characters above ASCII, A-Z lower-cased.
    A group whose texts hold no kept term has its floors alone; in a language without kept terms all distances are 0. A sole
    source has no pair. Values tie by item. Repeated rows count as often as they stand, texts of any length are read whole,
    columns of other names are not looked at, an empty table gives an empty one. Sums stay below 2^63 up to 10^9 kept terms.
    """
    spark = docs.sparkSession
    steps = Scratch(spark)
    of_term = Window.partitionBy("lang", "term")
    counts = group_terms(docs).withColumns({"all_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term), "m": F.count("*").over(of_term), "r": F.row_number().over(of_term.orderBy("source"))})
    kept = steps.put(counts.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "all_n", "m", (F.col("r") == 1).alias("once")))
    langs = kept.groupBy("lang").agg(F.count_if("once").cast("long").alias("V"), F.sum("n").alias("lang_n"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    all_groups = docs.select(blank("lang"), blank("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    of_lang = Window.partitionBy("lang")
    groups = all_groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["group_n", "V", "lang_n"])
    groups = groups.withColumns({"g": F.row_number().over(of_lang.orderBy("source")) - 1, "S": F.count("*").over(of_lang)})
    groups = steps.put(groups.withColumn("z", _share(F.lit(0).cast("long"), "group_n")))
    size = groups.count()
    near = lambda df: F.broadcast(df) if size <= SMALL else df
    shares = kept.join(near(groups), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "m", "once", "g", "S", "z", _share(F.col("n"), "group_n").alias("p"), _share(F.col("all_n"), "lang_n").alias("q"), (F.col("m") * HEAVY > F.col("S")).alias("heavy"))
    most = shares.where("heavy and once").groupBy("lang").count().agg(F.max("count")).first()[0] or 0  # one number
    pairs = _distances(shares, groups, max(1, -(-most // TERMS)))
    both_ways = pairs.select("lang", "a", "b", "value").unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = lambda c, name: near(groups.select("lang", F.col("g").cast("long").alias(c), F.col("source").alias(name)))
    both_ways = both_ways.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    pair = both_ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
