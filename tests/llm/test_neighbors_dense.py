import numpy as np
from test_neighbors import SCHEMA, brute

from tessera.llm import neighbors as nb


def test_topic_of_many_vectors(spark):
    """Cosines of a topic's vectors lie closer than the codes can tell."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    noise = rng.normal(size=(2000, 64))
    noise *= np.linalg.norm(centre) / np.linalg.norm(noise, axis=1)[:, None] * np.sqrt(1 / 0.99 - 1)
    x = (centre + noise).astype(np.float32)
    ids = [f"v{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1, "q") for i, v in zip(ids, x)], SCHEMA)
    got = {(r.id, r.neighbor_id) for r in nb.nearest(df, 5, 64, least_cosine=0.9).collect()}
    want = brute(ids, x.astype(np.float64), 5, 0.9)
    assert len(got & want) >= 0.97 * len(want)


def test_scaled_copies_are_told_apart_by_id(spark):
    one = np.random.default_rng(5).normal(size=64).astype(np.float32)
    ids = [f"v{i:02}" for i in range(40)]
    df = spark.createDataFrame([(i, (one * 2.0 ** (n - 20)).tolist(), 1, "q") for n, i in enumerate(ids)], SCHEMA)
    got = {}
    for r in nb.nearest(df, 5, 64, least_cosine=0.9).collect():
        got.setdefault(r.id, []).append(r.neighbor_id)
    assert {i: sorted(n) for i, n in got.items()} == {i: [n for n in ids[:6] if n != i][:5] for i in ids}
