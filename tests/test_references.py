from datetime import datetime

import pytest

from tessera.operators.references import Reference, orphan_references, orphan_report
from tessera.operators import references

T = lambda d: datetime(2025, 1, d)
CHILD = "id string, parent_id string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, key string, n int"
PARENT = "id string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
REFS = [Reference("child", "parent_id", "parent")]


def run(spark, children, parents):
    t = {"child": spark.createDataFrame(children, CHILD), "parent": spark.createDataFrame(parents, PARENT)}
    return orphan_references(t, REFS)


CHILDREN = [
    ("a", " P1\t", T(5), T(5), None, "x", 1), ("b", "gone", T(5), T(5), None, None, 2), ("c", "p2", T(5), T(5), None, "x", 3), ("d", "p3", T(5), T(5), None, "x", 4),
    ("e", "  ", T(5), T(5), None, "x", 5), ("f", None, T(5), T(5), None, "x", 6), ("g", "gone", T(5), T(5), T(6), "x", 7), ("h", "gone", T(5), T(5), None, "x", 8), ("h", "p1", T(5), T(6), None, "x", 9),
    ("b", "gone", T(5), T(5), None, None, 2), (None, "gone", T(5), T(5), None, "x", 0), ("i", "p3", None, T(5), None, "x", 1),
]
PARENTS = [("p1", T(1), T(1), None), ("p2", T(1), T(3), T(3)), ("p2", T(1), T(1), None), ("p3", T(9), T(9), None), ("p1", T(1), T(1), None)]


def test_missing_deleted_late(spark):
    out = run(spark, CHILDREN, PARENTS)
    assert {(r.row_id, r.status) for r in out.collect()} == {("b", "missing"), ("c", "deleted"), ("d", "late")}
    assert out.count() == 3
    assert {(r.month, r.status, r.n_orphans) for r in orphan_report(out).collect()} == {("2025-01", "missing", 1), ("2025-01", "deleted", 1), ("2025-01", "late", 1)}


def test_empty_tables(spark):
    assert run(spark, [], PARENTS).count() == 0
    assert run(spark, [], []).count() == 0
    assert {r.status for r in run(spark, CHILDREN, []).collect()} == {"missing"}


def test_hot_key_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(references, "heavy_keys", lambda df, keys, rows: df.select(*keys).na.drop().groupBy(*keys).count().where("count > 20").select(*keys))
    children = [(f"c{i}", "hot" if i % 2 else f"q{i}", T(5), T(5), None, "x", i) for i in range(200)]
    out = {r.row_id: r.status for r in run(spark, children, [("hot", T(1), T(2), T(2))]).collect()}
    assert len(out) == 200 and all(out[f"c{i}"] == ("deleted" if i % 2 else "missing") for i in range(200))
