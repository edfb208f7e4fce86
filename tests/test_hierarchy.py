import random

import pytest

from tessera.operators import hierarchy as h

SCHEMA = "id string, parent string, grp string, depth int"


def brute(rows):
    parent = {i: (p.strip().lower() if p and p.strip() else None) for i, p, *_ in rows}
    out = {}
    for i in parent:
        path, x = [i], i
        while parent[x] in parent and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if parent[x] in parent:  # runs in a circle, from where the path was met again
            circle = path[path.index(parent[x]):]
            out[i] = ("circle" if i in circle else "below", min(circle), None)
        else:
            out[i] = ("tree", x, path[::-1])
    return out


def check(spark, rows):
    tree = h.hierarchy(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r for r in tree.collect()}
    want = brute(rows)
    assert set(got) == set(want)
    paths = {r.id: list(r.path) for r in h.paths(tree, block=16).collect()}
    below = {i: sum(1 for j, w in want.items() if w[2] and i in w[2]) - 1 for i in want}
    for i, (status, root, path) in want.items():
        assert (got[i].status, got[i].root_id) == (status, root)
        if path:
            assert got[i].depth == len(path) - 1 and paths[i] == path and got[i].n_descendants == below[i]
        else:
            assert i not in paths


def test_forest_with_cycles(spark):
    rng = random.Random(3)
    rows = [(f"n{i:03}", f" N{rng.randrange(max(0, i - 9), i):03} " if i % 13 else None, "s", 0) for i in range(1, 120)]
    rows += [("x1", "x2", "s", 0), ("x2", "X3", "s", 0), ("x3", "x1", "s", 0), ("y", "x2", "s", 0), ("z", "y", "s", 0), ("self", "self", "s", 0), ("lost", "nowhere", "s", 0), ("blank", "  ", "s", 0)]
    check(spark, rows)


def test_deep_chain(spark):
    check(spark, [(f"n{i:03}", f"n{i - 1:03}" if i else None, "s", 0) for i in range(70)])


def test_star_with_heavy_parent(spark, monkeypatch):
    monkeypatch.setattr(h, "heavy_keys", lambda df, keys, rows: df.select(*keys).na.drop().groupBy(*keys).count().where("count > 20").select(*keys))
    check(spark, [("root", None, "s", 0)] + [(f"c{i:03}", "root" if i < 60 else f"c{i % 5:03}", "s", 0) for i in range(80)])


def test_empty(spark):
    assert h.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
