import random

import pytest

from tessera.llm import triejoin as tj

SCHEMA = "key string, s array<long>"


def random_sets(seed, n, vocabulary, size):
    rng = random.Random(seed)
    sets = []
    for i in range(n):
        if sets and rng.random() < 0.5:
            base = set(rng.choice(sets)[1])
            for _ in range(rng.randrange(0, max(1, len(base) // 2))):
                base.discard(rng.choice(sorted(base)) if base else None)
                base.add(rng.randrange(vocabulary))
        else:
            base = {rng.randrange(vocabulary) for _ in range(rng.randrange(1, size))}
        sets.append((f"k{i:03}", sorted((x * 0x9E3779B97F4A7C15 + 7) % 2**63 for x in base)))
    # keep hashes of hashes out of it: the numbers are already well spread
    return [(k, sorted(set(s))) for k, s in sets if s]


def brute(sets, t):
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(set(x) & set(y))
            if common >= t * (len(x) + len(y) - common) - 1e-12:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("t,seed,vocabulary,size,block", [(0.6, 1, 400, 60, 512), (0.8, 2, 300, 40, 512), (0.5, 3, 60, 20, 512), (0.6, 4, 200, 50, 8), (0.7, 5, 1000, 200, 16)])
def test_no_link_is_lost(spark, monkeypatch, t, seed, vocabulary, size, block):
    monkeypatch.setattr(tj, "BLOCK", block)
    sets = random_sets(seed, 160, vocabulary, size)
    members, links = tj.similar_sets(spark.createDataFrame(sets, SCHEMA), t, width=1 << 10)
    assert {tuple(r) for r in tj.similar_pairs(members, links).collect()} == brute(sets, t)


def test_groups_and_copies(spark):
    s = lambda *x: [v * 1_000_003 for v in x]
    rows = [("a", s(*range(1, 21))), ("b", s(*range(1, 21))), ("c", s(*range(2, 22))), ("d", s(*range(4, 24))), ("e", s(100, 101)), ("f", s(*range(6, 26)))]
    members, links = tj.similar_sets(spark.createDataFrame(rows, SCHEMA), 0.8)
    got = {r.key: (r.class_id, r.group_id, r.n_links) for r in tj.near_duplicate_groups(members, links).collect()}
    assert got == {"a": ("a", "a", 2), "b": ("a", "a", 2), "c": ("c", "a", 3), "d": ("d", "a", 2), "f": ("f", "a", 1), "e": ("e", "e", 0)}


def test_texts_null_empty_short_and_long(spark):
    df = spark.createDataFrame([("n", None, 1), ("e", "", 2), ("s", "two words", 3), ("p", "?! --", 4), ("x", "一二三四五六", 5), ("l", "word " * 50_000, 6), (None, "a b c d", 7)], "id string, text string, s int")
    got = {r.key: len(r.s) for r in tj.shingle_sets(df, "id", "text", 3).collect()}
    assert got == {"x": 4, "l": 1}


def test_empty_table(spark):
    members, links = tj.similar_sets(spark.createDataFrame([], SCHEMA), 0.8)
    assert members.count() == 0 and links.count() == 0 and tj.near_duplicate_groups(members, links).count() == 0
