"""The walk of the tries alone, and texts of many words."""

import numpy as np

from tessera.llm import triejoin as tj


def rows_of(sets, t):
    """All sets of one trie below shingle 0, in the order of their paths."""
    out = np.zeros(len(sets), tj._BODY)
    for i, s in enumerate(sets):
        path = np.concatenate([s[1 : tj.DEPTH + 1], np.full(tj.DEPTH, tj._END)])[: tj.DEPTH]
        sign = np.zeros(tj.SIGNATURE, np.uint8)
        np.add.at(sign, s % tj.SIGNATURE, 1)
        out[i] = (path, len(s), 0, 1, i, np.packbits(sign & 1).view(np.uint64))
    return out[np.lexsort(out["path"].T[::-1])]


def test_no_similar_pair_is_pruned():
    rng = np.random.default_rng(0)
    for t in (0.5, 0.6, 0.8):
        for _ in range(80):
            m = int(rng.integers(2, 40))
            base = np.unique(rng.integers(1, 200, 60))
            sets = [np.unique(np.concatenate([[0], rng.choice(base, int(rng.integers(len(base) // 2, len(base))), replace=False), rng.integers(1, 200, 5)])) for _ in range(m)]
            x, y = tj.Tries(np.zeros(m, np.int64), rows_of(sets, t), t).pairs()
            got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
            for a in range(m):
                for b in range(a):
                    common = len(np.intersect1d(sets[a], sets[b]))
                    if common >= t * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                        assert (b, a) in got


def test_subtrees_are_left_as_a_whole():
    """Two families below one shingle: a set of one leaves the other's subtree without looking at its sets."""
    rng = np.random.default_rng(1)
    family = lambda low: [np.unique(np.concatenate([[0], np.arange(low, low + 90), rng.integers(low + 90, low + 100, 4)])) for _ in range(30)]
    sets = family(1) + family(1137)
    tries = tj.Tries(np.zeros(60, np.int64), rows_of(sets, 0.6), 0.6)
    x, _ = tries.pairs()
    assert tries.seen["left in a subtree"] >= 2 * 30 * 30 and tries.seen["pairs"] == 60 * 60 and len(x) == 2 * 30 * 29 // 2
    assert tries.seen["pairs"] == sum(v for k, v in tries.seen.items() if k != "pairs")


def test_very_long_texts(spark):
    """Texts of 100 000 distinct words: paths, counters and offsets hold."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 40, 100_000).tolist()
    other = words[:50_000] + [7] + words[50_001:]
    df = spark.createDataFrame([("a", " ".join(map(str, words))), ("b", " ".join(map(str, other))), ("c", " ".join(map(str, words[:40_000])))], "id string, text string")
    members, links = tj.similar_sets(tj.shingle_sets(df, "id", "text", 5), 0.8)
    assert {tuple(r) for r in tj.similar_pairs(members, links).collect()} == {("a", "b")}


def test_short_texts_are_classed_by_their_words(spark):
    df = spark.createDataFrame([("a", "One, two"), ("b", "one two"), ("c", "two one"), ("d", ""), ("e", "?"), ("f", None)], "id string, text string")
    got = {r.key: list(r.s) for r in tj.shingle_sets(df, "id", "text", 5, short=True).collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] == got["e"] != got["a"] and "f" not in got
