import numpy as np

from tessera.llm import neighbors as nb

SCHEMA = "id string, embedding array<float>, handle int, query string"


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        best = sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in best if s[i, j] >= least and i != j}
    return out


def vectors(n, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    near = rng.integers(0, n // 2, n // 2)
    x[n // 2 :] = x[near] + rng.normal(size=(n - n // 2, dims)) * 0.25
    return (x * rng.uniform(0.3, 4, (n, 1))).astype(np.float32)


def test_near_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "BUCKET", 16)
    x = vectors(1200)
    ids = [f"v{i:04}" for i in range(len(x))]
    rows = [(i, v.tolist(), 1, "q") for i, v in zip(ids, x)] + [(ids[0], x[0].tolist(), 1, "q"), ("bad1", None, 1, "q"), ("bad2", [1.0], 1, "q"), ("bad3", [0.0] * 64, 1, "q"), ("bad4", [float("nan")] * 64, 1, "q"), (None, [1.0] * 64, 1, "q")]
    want = brute(ids, x.astype(np.float64), 5, 0.9)
    got = {(r.id, r.neighbor_id) for r in nb.nearest(spark.createDataFrame(rows, SCHEMA), 5, 64, least_cosine=0.9).collect()}
    assert len(got & want) >= 0.99 * len(want) and not got - want


def test_equal_vectors_and_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 8)
    x = np.ones((40, 64), np.float32)
    x[20:] += np.random.default_rng(1).normal(size=(20, 64)).astype(np.float32) * 0.05
    ids = [f"v{i:02}" for i in range(40)]
    got = nb.nearest(spark.createDataFrame([(i, v.tolist(), 1, "q") for i, v in zip(ids, x)], SCHEMA), 5, 64, least_cosine=0.9).collect()
    assert {r.neighbor_id for r in got if r.id == "v00"} == {"v01", "v02", "v03", "v04", "v05"}
    want = brute(ids, x.astype(np.float64), 5, 0.9)
    assert len({(r.id, r.neighbor_id) for r in got} & want) >= 0.97 * len(want) and len(got) == 200


def test_recall_without_a_least_cosine(spark):
    """Five nearest among vectors without near pairs: at least nine tenths are found."""
    from pyspark.sql import functions as F

    from tessera.llm.neighbors_queries import RECALL

    x = np.random.default_rng(2).normal(size=(3000, 64)).astype(np.float32)
    ids = [f"v{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1, "q") for i, v in zip(ids, x)], SCHEMA)
    got = {(r.id, r.neighbor_id) for r in nb.nearest(df, 5, 64, recall=RECALL, queries=F.col("id").endswith("00")).collect()}
    want = {p for p in brute(ids, x.astype(np.float64), 5, -1) if p[0].endswith("00")}
    assert len(got & want) >= 0.9 * len(want)


def test_codes_are_as_far_off_as_they_say():
    for dims in (64, 33):
        x = np.random.default_rng(3).normal(size=(500, dims)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1)[:, None]
        y, off = nb._decode(nb._encode(x), dims)
        assert (np.linalg.norm(x - y, axis=1) <= off).all() and off.max() < 0.002


def test_a_larger_share_is_left_out_as_vectors_grow():
    """The k-th neighbour of more vectors is nearer, and fewer of them are visited."""
    shares = [nb.plan_for_queries(n, 64, np.full(5, c), 0.95)[1] for n, c in ((3000, 0.42), (75_000, 0.5), (10_000_000, 0.62))]
    assert shares[0] > shares[1] > shares[2]


def test_empty(spark):
    assert nb.nearest(spark.createDataFrame([], SCHEMA), 5, 64, least_cosine=0.9).count() == 0
