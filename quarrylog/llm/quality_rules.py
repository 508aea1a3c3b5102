"""Quality rules whose cutoffs come from labelled holdouts with a guaranteed bound on false rejections.

Every rule rejects documents whose score lies above a cutoff. For each stratum and rule the candidate cutoffs are tested
from the most lenient to the strictest: the null hypothesis is "the cutoff rejects more than ``alpha / rules`` of the good
documents", its p-value the exact binomial tail of the rejected among the good labelled ones. Cutoffs of a rule are nested,
so testing in that fixed sequence and stopping at the first failure needs no further correction within it; over the
strata and rules the level ``delta`` is split evenly (Bonferroni). So, with probability ``1 - delta`` over the labels, in
no stratum more than ``alpha`` of the good documents are rejected by the chosen cutoffs. Too few labels certify nothing,
and then that rule rejects nothing there.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import words
from quarrylog.plans.lineage import cut

#: Our choice: the score of each rule (higher is worse) and its candidate cutoffs, lenient first.
RULES = {
    "symbols": ("n_symbols / word_chars", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.19, 0.17, 0.15, 0.13, 0.11, 0.09)),
    "word_length": ("word_chars / n_words", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}
WINDOW = 5


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) in place of the text.

    A null or empty text has zeros. n_lines counts lines with a word. Repeated windows are found within the row: window
    hashes are compared as a set first, and only texts with a repeat sort them and sum the words they cover.
    """
    keep = [c for c in docs.columns if c != text]
    at = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, at.alias("__text"), words(at).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__w"),
    )
    df = df.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("__w") >= WINDOW,
            F.slice(
                F.transform("__w", lambda w, i: F.xxhash64(w, *[F.get("__w", i + k) for k in range(1, WINDOW)])),
                F.lit(1),
                F.size("__w") - (WINDOW - 1),
            ),
        ).alias("__h"),
    )
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    df = df.select(
        *kept,
        F.when(
            F.size(F.array_distinct("__h")) < F.size("__h"),
            F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("__s"),
    )
    df = df.select(
        *kept,
        F.expr(
            "sort_array(transform(filter(transform(__s, (x, j) -> struct(x.i AS i, "
            "(x.h <=> get(__s, j - 1).h) OR (x.h <=> get(__s, j + 1).h) AS twice)), x -> x.twice), x -> x.i))"
        ).alias("__p"),
    )
    covered = F.aggregate(
        F.transform("__p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_factorial(n: str) -> str:
    """ln n! by Stirling's series at n + 9, to about 1e-12."""
    z = f"({n} + 9D)"
    down = " + ".join(f"ln({n} + {k}D)" for k in range(1, 9))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - ({down}))"


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k), X binomial(n, p), for columns k and n; 1 where k >= n p, as nothing can be certified there.

    The largest term comes from logarithms, the others by their ratios downwards; what lies beyond 60 standard deviations
    is bounded by its geometric series, so the value never falls below the exact one but by rounding.
    """
    odds = f"({1 - p!r}D / {p!r}D)"
    top = f"{_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')} + {k} * ln({p!r}D) + ({n} - {k}) * ln({1 - p!r}D)"
    m = f"least({k}, cast(60 * sqrt({n}) as bigint) + 100)"
    ratio = f"(({k} - i + 1) / ({n} - {k} + i) * {odds})"
    total = (
        f"CASE WHEN {k} < 1 THEN 1D ELSE aggregate(sequence(1L, greatest(1L, {m})), named_struct('t', 1D, 's', 1D), "
        f"(a, i) -> named_struct('t', a.t * {ratio}, 's', a.s + a.t * {ratio}), "
        f"a -> a.s + CASE WHEN {m} < {k} THEN a.t / (1 - {k} / ({n} - {k} + 1) * {odds}) ELSE 0D END) END"
    )
    return F.expr(f"CASE WHEN {k} >= {n} * {p!r}D THEN 1D ELSE exp({top}) * ({total}) END")


def _scores() -> Column:
    """An array of (rule, bin): the number of the rule's cutoffs that the document exceeds."""
    return F.array(
        *[
            F.expr(
                f"named_struct('rule', '{name}', 'bin', " + " + ".join(f"cast(coalesce(try_divide({score.split(' / ')[0]}, {score.split(' / ')[1]}), 0D) > {c!r}D as int)" for c in cuts) + ")"
            )
            for name, (score, cuts) in RULES.items()
        ]
    )


def risk_controlled_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """``(stratum, bins)``: for each stratum a map from rule to the bin from which on documents are rejected (absent: none).

    labels: (doc_id, quality); rows with a null are ignored, contradicting ones count as not good. Only good documents
    that the base rules keep count. The table has a row for each stratum with such documents.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q")).where("__q = 1")
    cells = (
        stats.where(~base_failed())
        .join(good, "doc_id", "left_semi")
        .select(F.col(stratum).alias("stratum"), F.explode(_scores()).alias("s"))
        .groupBy("stratum", "s.rule", "s.bin")
        .agg(F.count("*").alias("n"))
    )
    grid = (
        cells.groupBy("stratum", "rule")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
        .select("*", F.explode(F.expr("sequence(1, " + "CASE rule " + " ".join(f"WHEN '{k}' THEN {len(v[1])}" for k, v in RULES.items()) + " END)")).alias("bin"))
        .withColumn("k", F.expr("aggregate(map_entries(by_bin), 0L, (a, e) -> a + CASE WHEN e.key >= bin THEN e.value ELSE 0L END)"))
        .drop("by_bin")
    )
    grid = cut(grid)
    strata = grid.agg(F.count_distinct("stratum")).first()[0]
    tested = grid.withColumn("p", binomial_tail("k", "n", alpha / len(RULES)))
    level = delta / (len(RULES) * max(1, strata))
    # the highest bin is the most lenient cutoff, so the sequence runs downwards and stops at the highest bin that fails
    passed = tested.groupBy("stratum", "rule").agg(
        F.coalesce(F.max(F.when(F.col("p") > level, F.col("bin"))) + 1, F.lit(1)).alias("bin"), F.max("bin").alias("most")
    )
    return passed.where("bin <= most").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "bin"))).alias("bins"))


def verdicts(stats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``stats`` with base_failed and kept; a stratum without cutoffs keeps all that the base rules keep."""
    beyond = F.expr("exists(__scores, s -> s.bin >= coalesce(get(array(__bins[s.rule]), 0), 1000))")
    at = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("bins").alias("__bins"))
    return (
        stats.withColumn("__scores", _scores())
        .join(at, F.col(stratum) == F.col("__stratum"), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False)))
        .drop("__scores", "__stratum", "__bins")
    )


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """A row for each row of ``docs``: its columns without the text, the statistics, base_failed and kept.

    Null texts are empty, a null stratum counts as the empty string, repeated rows are judged alike, an empty table gives
    an empty one; columns of ``docs`` with the names of the statistics are replaced by these.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    docs = docs.drop(*own).withColumn("__stratum_of", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    stats = cut(document_statistics(docs))
    out = verdicts(stats, risk_controlled_cutoffs(stats, labels, "__stratum_of", alpha, delta), "__stratum_of")
    return out.drop("__stratum_of")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were.

    Null and empty texts have too few words and go; a null stratum is one of its own, the empty string. Rows equal in id and
    text are judged alike, null ids by their text. Other columns, of whatever names, take no part. An empty table gives an empty one.
    """
    from quarrylog.llm.common import KEY, row_key

    light = docs.select("doc_id", F.col(stratum).alias("lang"), "text", *row_key())
    rejected = judge_documents(light, labels, "lang", alpha, delta).where("not kept").select(*KEY).distinct()
    return docs.select("*", *row_key()).join(rejected, list(KEY), "left_anti").drop(*KEY)
