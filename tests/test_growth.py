"""What must not grow with the rounds of a loop or with the rows that have one thing in common."""

import random

from quarrylog.llm import shingle_dedup, substring_dedup
from quarrylog.operators import components
from quarrylog.plans.scratch import Scratch


def test_estimated_sizes_dont_grow_with_the_rounds_of_components(spark, monkeypatch):
    """A join multiplies the estimates of its sides: a table that is joined with itself round by round must not carry its own on."""
    star, bits = components._star, []

    def seen(edges, both_ways):
        bits.append(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return star(edges, both_ways)

    monkeypatch.setattr(components, "_star", seen)
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    found = components.connected_components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"))
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 300
    assert len(bits) >= 10 and max(bits) < 64


def test_sets_of_pairs_are_fetched_in_parts_and_only_for_pairs_that_can_be_alike(spark, monkeypatch):
    """Long texts of one opening that are otherwise apart, and edited copies of some: pairs grow with the square of the texts."""
    rng = random.Random(5)
    opening = " ".join(f"o{k}" for k in range(40))
    texts = [f"{opening} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(12)]
    texts += [t.replace(t.split()[700], "edited") for t in texts[:4]]
    found = [(k, sorted({int(x >> 32) for x in shingle_dedup.shingles(t)})) for k, t in enumerate(texts)]
    sets = spark.createDataFrame(found, "sid long, s array<int>")
    near = spark.createDataFrame([(a, b) for b in range(16) for a in range(b)], "a long, b long")
    want = {(a, b) for b in range(16) for a in range(b) if len({*found[a][1]} & {*found[b][1]}) >= 0.8 * len({*found[a][1]} | {*found[b][1]})}
    assert want == {(k, 12 + k) for k in range(4)}
    shuffled, parts = [], shingle_dedup._parts
    monkeypatch.setattr(shingle_dedup, "_parts", lambda pairs, total, at_once: shuffled.append((total, at_once)) or parts(pairs, total, at_once))
    for at_once in (1 << 28, 1):
        monkeypatch.setattr(shingle_dedup, "AT_ONCE", at_once)
        del shuffled[:]
        assert set(map(tuple, shingle_dedup._alike(near, sets, 0.8, Scratch(spark)).collect())) == want
        least = 8 * sum(len(s) for _, s in found)
        assert [x[1] for x in shuffled] == [max(at_once, least)] * len(shuffled)
        assert sum(x[0] for x in shuffled[1:]) == 4 * sum(len(found[a][1]) for a, _ in want)  # of 120 pairs, the sets of four
    monkeypatch.setattr(shingle_dedup, "LARGE", 10**9)  # no bitmaps: 120 pairs of 6 KB sets in more than one part
    del shuffled[:]
    assert set(map(tuple, shingle_dedup._alike(near, sets, 0.8, Scratch(spark)).collect())) == want
    assert sum(x[0] for x in shuffled[1:]) == 4 * sum(len(found[a][1]) for b in range(16) for a in range(b)) and shuffled[1][0] > shuffled[1][1]


def test_seeds_of_a_text_are_made_once(spark, monkeypatch):
    """For the sample, here every text, and for all texts: the rows of common seeds come from the same pass as the others."""
    made, plain = spark.sparkContext.accumulator(0), substring_dedup.seeds

    def counted(h):
        made.add(1)
        return plain(h)

    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "seeds", counted)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(k, passage + " " + " ".join(f"w{k}_{j}" for j in range(30))) for k in range(12)], "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["ref_id"]) for r in found} == {(k, j) for k in range(1, 12) for j in {0, k - 1}} and {r["class_id"] for r in found} == {0}
    assert made.value == 2 * 12
