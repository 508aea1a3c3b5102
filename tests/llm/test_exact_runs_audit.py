"""Exact dedup, periodic runs and the divergence audit against brute force, with nulls, empties, ties, long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylog.llm import divergence_audit, exact_dedup, periodic_runs

DOC = "doc_id long, text string, lang string, source string, h long, keep_id string, n long, value long, length long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], DOC)


def mixed_rows(seed=3, n=400):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice("ab cd ef gh é 漢".split()) for _ in range(rng.randrange(0, 5))), "en", f"s{k % 3}") for k in range(n)]
    rows += [(n + k, "hot  \n text", "en", None) for k in range(n // 2)]  # a third of all rows
    rows += [(7, "hot text", None, "s1"), (None, "hot text", None, None), (None, "only null ids", "en", ""), (None, "only null ids", "en", ""), (n * 3, None, None, None), (n * 3 + 1, "", "", ""), (n * 3 + 2, " ", "en", "s1"), (n * 3 + 3, "\t\n", "en", "s1")]
    rows += [(9000, "same row", "en", "s0")] * 3 + [(9001, "x " * 200_000, "en", "s0"), (9002, "x\n" * 200_000, "en", "s0"), (9003, " lead", "en", "s2"), (9004, "lead", "en", "s2")]
    return rows


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[norm(text)].append(doc_id)
    out, seen = [], set()
    for doc_id, text, *_ in rows:
        t = norm(text)
        keep = min((i for i in groups[t] if i is not None), default=None)
        first = doc_id == keep and t not in seen
        if first:
            seen.add(t)
        out.append((doc_id, keep, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def few_keys(c):
    """Collides: seven keys, far apart."""
    return F.pmod(F.xxhash64(c), F.lit(7)) * F.lit(2**60)


@pytest.mark.parametrize("entries,size,key", [(4096, 1 << 24, F.xxhash64), (3, 1 << 24, F.xxhash64), (4096, 200, F.xxhash64), (2, 1 << 24, few_keys)])
def test_exact_dedup(spark, entries, size, key):
    rows = mixed_rows()
    found = exact_dedup.dedup(frame(spark, rows), entries, size, key).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in found), key=repr) == brute_dedup(rows)


def test_index_splits_chains_grows_and_finds(spark, tmp_path):
    rows = mixed_rows()
    docs = frame(spark, rows)
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 or doc_id is null")
    exact_dedup.write_index(first, f"{tmp_path}/a", entries=8)
    exact_dedup.write_index(second, f"{tmp_path}/b", old=f"{tmp_path}/a", entries=8)
    for folder, some in (("a", first), ("b", docs)):
        buckets = [(r["low"] % 2**64, r["depth"], r["entries"], r["keys"]) for r in exact_dedup.directory(spark, f"{tmp_path}/{folder}").collect()]
        spans = sorted((low, low + 2 ** (64 - depth)) for low, depth, *_ in buckets)
        assert all(low % 2 ** (64 - depth) == 0 for low, depth, *_ in buckets)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # no two buckets share a key
        assert all(n <= 8 or keys == 1 for _, _, n, keys in buckets) and len({d for _, d, *_ in buckets}) > 1
        # a bucket is no smaller than it must be: with its other half it would overflow, or it is an owner's whole range
        pages = [(r["low"] % 2**64, r["depth"], r["h"] % 2**64) for r in spark.read.parquet(f"{tmp_path}/{folder}/pages").collect()]
        assert all(low <= h < low + 2 ** (64 - depth) for low, depth, h in pages)
        least = min(d for _, d, *_ in buckets)
        for low, depth, *_ in buckets:
            parent = 2 ** (65 - depth)
            assert depth == least or sum(low // parent == h // parent for *_, h in pages) > 8
        want = {(r[0], r[4]): r[1:3] for r in brute_dedup([tuple(r)[:4] for r in some.collect()])}
        for r in exact_dedup.look_up(some, f"{tmp_path}/{folder}").collect():
            sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest()
            assert (r["keep_id"], r["group_size"]) == want[r["doc_id"], sha]
    unknown = exact_dedup.look_up(frame(spark, [(1, "never seen", None, None)]), f"{tmp_path}/b").first()
    assert unknown["keep_id"] is None and unknown["group_size"] is None and unknown["n"] == 2


def test_keep_first(spark):
    rows = mixed_rows()
    docs = frame(spark, rows)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["keep_id"]) for r in kept.collect()), key=repr) == sorted(((r[0], "x") for r in brute_dedup(rows) if r[3]), key=repr)


def brute_runs(words, least=12):
    """Every maximal stretch of each period that is its smallest one."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            if words[k] != words[k + p]:
                k += 1
                continue
            e = k
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e - k + p >= max(least, 2 * p):
                out.setdefault((k, e - k + p), p)  # periods ascend, so the first is the smallest
            k = e
    return sorted(((s, m, p) for (s, m), p in out.items()), key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    shown = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *shown, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())


def periodic_rows(seed=5, n=260):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        letters = [f"w{x}" for x in range(rng.choice([1, 2, 2, 3, 6, 40]))]
        w = []
        while len(w) < rng.randrange(0, 90):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
            w += unit * rng.choice([1, 1, 2, 3, 5]) + unit[: rng.randrange(0, len(unit))]
        rows.append((k, rng.choice([" ", "\n", "\x0b\t", "  "]).join(w) + rng.choice(["", " ", "   "]), "en", "s"))
    fib = ["a", "b"]
    while len(fib) < 600:
        fib = fib + fib[: len(fib) * 5 // 8]
    rows += [(n, " ".join(fib[:600]), "en", "s"), (n + 1, "a " * 300, "en", "s"), (n + 2, None, None, None), (n + 3, "", "en", "s"), (n + 4, " \n ", "en", "s"), (None, "x y " * 9, "en", "s"), (None, "x y " * 9, "en", "s")]
    return rows


def test_periodic_runs(spark, monkeypatch):
    rows = periodic_rows()
    want = sorted((brute_report(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 1 for r in want) > 40
    found = periodic_runs.run_report(frame(spark, rows))
    order = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.select(*order).collect()), key=repr) == want
    words = [WORD.findall(r[1] or "") for r in rows]
    for batch, pairs in ((50, 1 << 20), (1 << 18, 7), (1, 1)):
        monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
        some = [w for k, w in enumerate(words) if k % (20 if pairs == 1 else 3) == 0]
        parts = [some[k : k + batch] for k in range(0, len(some), batch)]
        assert [r for p in parts for r in periodic_runs.runs_of([[x.encode() for x in w] for w in p])] == [brute_runs(w) for w in some]


def test_shorter_least_length_and_rows_of_runs(spark):
    rows = [r for r in periodic_rows(9, 60) if r[0] is not None]
    found = defaultdict(list)
    for r in periodic_runs.find_runs(frame(spark, rows), 4).collect():
        found[r["doc_id"]].append((r["start"], r["length"], r["period"]))
    assert all(found.get(i, []) == brute_runs(WORD.findall(t or ""), 4) for i, t, *_ in rows)


def test_collapsed_texts_and_one_very_long_text(spark):
    rng = random.Random(1)
    long = [rng.choice("abcdefgh") for _ in range(150_000)]
    long[40_000:90_000] = [f"u{k % 25_000}" for k in range(50_000)]  # two periods of 25,000 words
    rows = [(1, "one  two\nthree", "en", "s"), (2, "go " * 20 + "on", "en", "s"), (3, None, "en", "s"), (4, " ".join(long), "en", "s")]
    out = {r["doc_id"]: r for r in periodic_runs.collapse_runs(frame(spark, rows)).collect()}
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == ("one  two\nthree", "go on", None) and out[1]["length"] == 4
    best = next(r for r in periodic_runs.find_runs(frame(spark, rows)).where("doc_id = 4").orderBy(F.desc("length")).collect())
    assert best["period"] == 25_000 and best["start"] <= 40_000 and 50_000 <= best["length"] <= 50_010


def brute_audit(rows, min_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        n[g].update(terms(text))
        df[g[0]].update(set(terms(text)))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= min_docs]
        own = {s: [n[lang, s][t] for t in kept] for x, s in groups if x == lang}
        whole = [sum(c) for c in zip(*own.values())]
        share = lambda counts: [1 + 10**9 * (c + 5) // (sum(counts) + 5 * len(kept)) for c in counts]
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in own if o != s]
            over = [(a - b, t) for a, b, t, c in zip(p[s], q, kept, own[s]) if c and a > b]
            for part, found in (("pair", pairs), ("term", over)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("sources,min_docs", [(5, 4), (150, 3), (20, 10_000)])
def test_divergence_audit(spark, monkeypatch, sources, min_docs):
    rng = random.Random(sources)
    monkeypatch.setattr(divergence_audit, "TERMS", 40)
    vocabulary = [f"T{chr(97 + k % 26)}{chr(97 + k // 26)}" + "é" * (k % 3) for k in range(300)]
    rows = []
    for k in range(900):
        s = 0 if k % 3 == 0 else k % sources
        own = vocabulary[s : s + 4] if rng.random() < 0.3 else [vocabulary[int(300 * rng.random() ** 3)]]
        rows.append((k, " ".join(rng.choice(own) + rng.choice(["", "_x", "9", "、"]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de"]), f"s{s}" if s else rng.choice(["", None])))
    rows += [(1000, None, None, None), (1001, "", "fr", "sole"), (1002, "12 34", "en", "no terms"), (1003, "tab " * 100_000, "en", "long"), (1003, "tab " * 10, "en", "long"), (None, "Taa tAA", "en", "s1")]
    found = divergence_audit.audit(frame(spark, rows), min_docs, 7)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows, min_docs, 7)


def test_empty_tables(spark):
    none = frame(spark, [(1, "a", "b", "c")]).limit(0)
    assert [df.count() for df in (exact_dedup.dedup(none), exact_dedup.keep_first(none), periodic_runs.run_report(none), periodic_runs.collapse_runs(none), divergence_audit.audit(none))] == [0] * 5
