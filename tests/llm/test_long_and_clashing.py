"""Very long texts, and tables whose other columns have the names that operators use themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from quarrylog.llm import mixing, quality_classifier, quality_rules, sentencepiece_codec, shingle_dedup, simhash, spotsigs, token_counts, url_filter

OTHERS = ("fp", "root", "component", "component_id", "node", "least", "sid", "h", "a", "b", "s", "v", "key", "n", "k", "i", "at", "word", "words", "size", "quality", "taken", "target", "bin", "rule", "stratum", "bins", "n_words", "n_lines",
          "n_symbols", "word_chars", "base_failed", "kept", "stats", "y", "z", "score", "predicted", "held_out", "pieces", "n_pieces", "decoded_ok", "host", "path", "verdict", "trust", "distrust", "said", "file", "document", "start", "count")


def long_rows():
    rng = random.Random(8)
    words = [f"w{rng.randrange(30_000)}" if rng.random() < 0.8 else rng.choice(["the", "a", "is"]) for _ in range(100_000)]
    words += words[500:560]
    text = " ".join(w + "\n" * (k % 40 == 39) for k, w in enumerate(words))
    return [(1, text), (2, text + " end"), (3, "the short text is a plain one of ten words or more"), (4, None)]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(k, t, "en", "s") for k, t in long_rows()], "doc_id long, text string, lang string, source string")


def test_long_texts_of_fingerprints(long_docs):
    rows = {k: t or "" for k, t in long_rows()}
    got = {r["doc_id"]: r for r in spotsigs.edited_likeness(long_docs.select("doc_id", "text"), 3).collect()}
    for k, t in rows.items():
        n, other = len(t), rows[k - 1 or 4]
        edited = t[: n - n // 2] + other[: n // 2]
        assert got[k]["n_chars"] == n and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["near_edited"] == spotsigs.likeness(spotsigs.signatures(t), spotsigs.signatures(edited))
    found = {r["doc_id"]: r for r in simhash.near_duplicate_components(long_docs.select("doc_id", "text")).collect()}
    for k, t in rows.items():
        w = t.lower().split()
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else [], dtype=np.uint64)
        bits = sum(int(2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes)) << b for b in range(64))
        assert found[k]["fp"] & (2**64 - 1) == bits
    assert found[1]["component_id"] == found[2]["component_id"] == 1
    assert sorted(r["doc_id"] for r in shingle_dedup.keep_one_of_each(long_docs).collect()) == [1, 3, 4]


def test_long_texts_of_counts_and_rules(spark, long_docs):
    rows = {k: t or "" for k, t in long_rows()}
    stats = {r["doc_id"]: r for r in quality_rules.document_statistics(long_docs).collect()}
    for k, t in rows.items():
        w = t.split()
        times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (stats[k]["n_words"], stats[k]["n_repeat_words"], stats[k]["word_chars"]) == (len(w), len(covered), sum(map(len, w)))
    assert stats[1]["n_repeat_words"] >= 120
    mixed = mixing.mix(long_docs.select("doc_id", "source", mixing.n_words().alias("size"), mixing.quality_weight().alias("quality"))).collect()
    assert {r["doc_id"]: r["taken"] for r in mixed} == {k: len(t.split()) for k, t in rows.items()}
    encode = token_counts._encoding(None).encode_ordinary
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(long_docs.select("text")).collect()) == sorted(len(encode(t)) for t in rows.values())
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score_documents(long_docs, labels).collect())


def test_long_texts_of_pieces_and_links(spark, long_docs):
    codec = sentencepiece_codec.load_codec(sentencepiece_codec.default_model_file())
    assert all(r["decoded_ok"] for r in sentencepiece_codec.encode_documents(long_docs, codec).collect())
    html = "".join(f'<p>text {k} <a href="http://h{k % 7}.org/{k}">x</a>' for k in range(30_000))
    pages = spark.createDataFrame([(0, "http://a.org/", html), (1, "http://h3.org/fr/", ""), (2, "http://h3.org/", None)], "page_id long, url string, html string")
    edges = {(r["src"], r["dst"]) if "src" in r else tuple(r)[:2] for r in url_filter.link_edges(url_filter._split(pages, "url")).collect()}
    assert len(edges) >= 7
    assert {r["page_id"]: r["rule"] for r in url_filter.judge_pages(pages).collect()} == {0: None, 1: "org/fr/", 2: None}


def test_clashing_columns(spark):
    rng = random.Random(2)
    words = ["the", "of", "plain", "t#xt", "b$d", "good", "line", "is", "a", "word"]
    plain = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40))), "en", f"s{k % 3}") for k in range(60)]
    plain += [(100, plain[3][1], "en", "s0"), (101, None, None, None), (102, "", "fr", "s1")]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(plain, schema)
    clash = spark.createDataFrame([(*r, *range(len(OTHERS))) for r in plain], schema + "".join(f", `{c}` int" for c in OTHERS))
    labels = spark.createDataFrame([(k, k % 2, 7) for k in range(60)], "doc_id long, quality int, n_words int")
    codec = sentencepiece_codec.load_codec(sentencepiece_codec.default_model_file())
    cases = {
        "op1": (spotsigs.edited_likeness, ["doc_id", "fingerprint", "near_next"]),
        "op2": (simhash.near_duplicate_components, ["doc_id", "fp", "component_id"]),
        "keep one": (simhash.keep_one_of_each, ["doc_id", "text"]),
        "near-dedup": (shingle_dedup.keep_one_of_each, ["doc_id", "text"]),
        "op4": (mixing.mix_documents, ["doc_id", "text"]),
        "op8": (lambda d: quality_rules.judge_documents(d, labels), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
        "keep good": (lambda d: quality_rules.keep_good(d, labels), ["doc_id", "text"]),
        "op9": (lambda d: sentencepiece_codec.encode_documents(d, codec), ["doc_id", "pieces", "n_pieces"]),
        "op10": (lambda d: quality_classifier.score_documents(d, labels), ["doc_id", "held_out", "score", "predicted"]),
    }
    for name, (operator, columns) in cases.items():
        narrow, wide = operator(docs), operator(clash)
        a, b = (sorted(map(repr, d.select(*columns).collect())) for d in (narrow, wide))
        assert a == b and a, name
        assert "text" not in columns or wide.columns == clash.columns
    pages = [(k, f"http://h{k}.org/fr/", f'<a href="http://h{k + 1}.org/">x</a>') for k in range(9)]
    wide = spark.createDataFrame([(*r, *range(len(OTHERS))) for r in pages], "page_id long, url string, html string" + "".join(f", `{c}` int" for c in OTHERS))
    judged = [sorted(map(tuple, url_filter.judge_pages(d).select("page_id", "host", "rule", "verdict").collect())) for d in (wide, wide.select("page_id", "url", "html"))]
    assert judged[0] == judged[1]
