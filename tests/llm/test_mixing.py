import random

import pytest

from tessera.llm import mixing as m


def test_flight_keeps_the_totals():
    rng = random.Random(4)
    sizes = [float(rng.randrange(1, 500)) for _ in range(300)]
    p = m.flight(sizes, [0.3] * 300, random.Random(1))
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 90) < 1e-6 and abs(sum(x * s for x, s in zip(p, sizes)) - 0.3 * sum(sizes)) < 1e-3


def test_every_document_keeps_its_chance():
    hits = [0] * 12
    for seed in range(3000):
        for k, x in enumerate(m.land([float(k + 1) for k in range(12)], m.flight([float(k + 1) for k in range(12)], [0.5] * 12, random.Random(seed)))):
            hits[k] += x
    assert all(0.35 < h / 3000 < 0.65 for h in hits)


DOCS = "doc_id long, source string, text string, block int, p int"


@pytest.mark.parametrize("block", [20_000, 40])
def test_shares_and_caps(spark, block):
    rng = random.Random(0)
    docs = [(i, ("Wiki-Page ", "faq", "FAQ", "chat_answer")[min(3, i % 7)], "word " * rng.randrange(1, 60), 0, 0) for i in range(900)]
    docs += [(2000, "faq", None, 0, 0), (2001, None, "text", 0, 0), (2002, "unknown", "text", 0, 0), (2003, "faq", "", 0, 0), docs[3]]
    targets = spark.createDataFrame([("wiki page", 0.3, 2), ("faq", 0.5, 3), ("chat-answer", 0.2, 1)], "source string, target_share double, max_repeats int")
    chosen, report = m.mix(spark.createDataFrame(docs, DOCS), targets, block=block)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and not {2000, 2001, 2002, 2003} & {r.doc_id for r in rows}
    for r in report.collect():
        assert abs(r.deviation) < 0.01 and r.most_repeats <= r.max_repeats
    again, _ = m.mix(spark.createDataFrame(docs, DOCS).repartition(7), targets, block=block)
    assert sorted(rows) == sorted(again.collect())


def test_empty(spark):
    targets = spark.createDataFrame([("faq", 1.0, 3)], "source string, target_share double, max_repeats int")
    chosen, report = m.mix(spark.createDataFrame([], DOCS), targets)
    assert chosen.count() == 0 and [r.share for r in report.collect()] == [0.0]
