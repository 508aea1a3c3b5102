"""The registered queries of the operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import divergence_audit, exact_dedup, line_dedup, mixing, periodic_runs, quality_classifier, quality_rules, sentencepiece_codec, simhash, spotsigs, substring_dedup, token_counts, url_filter
from quarrylog.llm.common import row_key, table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs.select("doc_id", "source", mixing.n_words().alias("size"), mixing.quality_weight().alias("quality"), *row_key()))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = quality_rules.judge_documents(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = sentencepiece_codec.load_codec(sentencepiece_codec.default_model_file())
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), codec)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_spotsigs, op2_simhash, op3_line_dedup, op4_mixing, op5_substring_dedup, op6_url_filter, op7_token_counts, op8_quality_rules, op9_sentencepiece, op10_quality_classifier, op11_exact_dedup, op12_periodic_runs, op13_divergence_audit)}
ORACLES = {
    "op4_mixing": r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size FROM documents),
 k AS (SELECT doc_id, source, size, -ln((('0x' || md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:13])::BIGINT + 0.5::DOUBLE) / pow(2::DOUBLE, 52))
  / greatest(0.05::DOUBLE, 1 - 5::DOUBLE * length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) / greatest(1, length(t))) AS x FROM d),
 w AS (SELECT source, sum(size)::DOUBLE AS total, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
 l AS (SELECT *, (sum(total) OVER () - 3 * coalesce(sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY total / w, source IS NULL, source)),
 g AS (SELECT source, total, least(3 * total, w * (SELECT arg_min(level, total / w) FROM l WHERE level * w <= 3 * total)) AS target FROM l),
 r AS (SELECT k.*, total, target, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY k.source ORDER BY x, doc_id, size) - size AS before FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
 SELECT doc_id, size, total::BIGINT AS source_size, target, (epochs * size + greatest(0, least(size, round(target - epochs * total) - before)))::BIGINT AS taken FROM r""",
    "op8_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
 v AS (SELECT row, unnest(generate_series(1, len(w) - 4)) AS i, array_to_string(w[i:i + 4], ' ') AS five FROM d),
 c AS (SELECT row, count(DISTINCT i) AS n FROM (SELECT row, unnest(generate_series(i, i + 4)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY row, five) AS times FROM v) WHERE times > 1) GROUP BY row),
 s AS (SELECT d.row, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM d LEFT JOIN c USING (row)),
 f AS ({" UNION ALL ".join(f"SELECT row, stratum, doc_id, base_failed, '{rule}' AS rule, coalesce({score.split(' / ')[0]}::DOUBLE / nullif({score.split(' / ')[1]}, 0), 0) AS score FROM s" for rule, (score, _) in quality_rules.RULES.items())}),
 cutoffs(rule, cutoff) AS (VALUES {", ".join(f"('{rule}', {c}::DOUBLE)" for rule, (_, cuts) in quality_rules.RULES.items() for c in cuts)}),
 good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
 k AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM (FROM f SEMI JOIN good USING (doc_id) WHERE NOT base_failed) JOIN cutoffs USING (rule) GROUP BY ALL),
 tail AS (SELECT *, CASE WHEN k >= n * 0.005::DOUBLE THEN 1 ELSE list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005::DOUBLE) + (n - i) * ln(0.995::DOUBLE)))) END AS p FROM k),
 chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(p <= 0.05::DOUBLE / 4 / (SELECT count(DISTINCT stratum) FROM k)) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS ok FROM tail) WHERE ok GROUP BY ALL),
 bad AS (SELECT DISTINCT row FROM f JOIN chosen USING (stratum, rule) WHERE score > cutoff)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.row IS NULL AS kept FROM s LEFT JOIN bad USING (row)""",
    "op3_line_dedup": r"""WITH l AS (SELECT doc_id, text, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
 u AS (SELECT *, count(*) FILTER (i > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]')) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM l),
 v AS (SELECT doc_id, unit, string_agg(line, chr(10) ORDER BY i) AS body FROM u GROUP BY ALL),
 b AS (SELECT *, md5(regexp_replace(body, '[\x20\x09-\x0D]+$', '')) AS m, len(list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_words FROM v),
 g AS (SELECT * FROM (SELECT doc_id, unit, substr(md5(m || lead(m) OVER (PARTITION BY doc_id ORDER BY unit)), 1, 15) AS gram FROM b) WHERE gram IS NOT NULL),
 w AS (SELECT doc_id, unit, list(gram) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS three FROM g),
 s AS (SELECT DISTINCT doc_id, unit + list_position(three, list_min(three)) - 1 AS unit FROM w WHERE len(three) = 3 OR unit = 0),
 f AS (SELECT g.doc_id, g.unit, 'g' || gram AS v FROM g JOIN s USING (doc_id, unit) UNION ALL SELECT doc_id, unit, 'l' || substr(m, 1, 15) FROM b WHERE n_words >= 40),
 p AS (SELECT *, first_value(doc_id) OVER o AS ref, first_value(unit) OVER o AS ref_unit FROM f WINDOW o AS (PARTITION BY v ORDER BY doc_id, unit)),
 q AS (SELECT doc_id, ref, unit - ref_unit AS diagonal, list(unit) AS places FROM p WHERE doc_id <> ref OR unit <> ref_unit GROUP BY ALL),
 e AS (SELECT q.doc_id, q.ref, q.diagonal, q.places, a.unit, a.unit - row_number() OVER (PARTITION BY q.doc_id, q.ref, q.diagonal ORDER BY a.unit) AS island
  FROM q JOIN b a ON a.doc_id = q.doc_id JOIN b c ON c.doc_id = q.ref AND c.unit = a.unit - q.diagonal AND substr(c.m, 1, 15) = substr(a.m, 1, 15)),
 r AS (SELECT doc_id, unnest(units) AS unit FROM (SELECT doc_id, list(unit) AS units, any_value(places) AS places FROM e GROUP BY doc_id, ref, diagonal, island) WHERE list_has_any(units, places)),
 d AS (SELECT v.*, r.unit IS NOT NULL AS gone FROM v LEFT JOIN (SELECT DISTINCT * FROM r) r USING (doc_id, unit))
 SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY unit) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted_lines FROM d GROUP BY doc_id""",
    "op11_exact_dedup": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
 SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM d WINDOW g AS (PARTITION BY t)""",
    "op13_divergence_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
 w AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM d),
 k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
 v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY 1),
 c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
 g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (v.total + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
 SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
}
