import random

import pytest

from tessera.llm.leaks import leaked_items


def brute(docs, items, window=13):
    seen = {}
    for i, text in items:
        w = text.lower().split() if text else []
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = set()
    for d, text in docs:
        w = text.lower().split() if text else []
        for k in range(len(w) - window + 1):
            out |= {(d, i) for i in seen.get(tuple(w[k : k + window]), ())}
    return out


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_against_brute_force(spark, block):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 40)))) for i in range(20)] + [(99, None), (98, ""), (97, "short")]
    docs = []
    for d in range(120):
        parts = rng.choices(vocabulary, k=rng.randrange(0, 40))
        if d % 3 == 0:
            w = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(w))
            parts += w[a : a + rng.randrange(8, 30)]
        docs.append((d, " ".join(parts + rng.choices(vocabulary, k=5))))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (0, docs[0][1]), (None, "x")]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(brute([x for x in docs if x[0] is not None], items))


def test_spelling_does_not_matter(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, "Intro. **One** TWO, three—four five; six (seven) eight\n> nine `ten` eleven Тwelve thirteen"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, "一二三四五六七八九十百千萬"), (4, words)]
    items = [(7, words), (8, "一，二三四五六。七八九十百千萬")]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 7): (1, 2), (4, 7): (2, 2), (3, 8): (1, 1)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert leaked_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_no_items_and_several_texts_of_one(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words), 0), (2, " ".join(words[30:]), 0)], "doc_id long, text string, item_id int")
    none = spark.createDataFrame([], "item_id long, text string")
    few = spark.createDataFrame([(1, "too short")], "item_id long, text string")
    assert leaked_items(docs, none).count() == 0 and leaked_items(docs, few).count() == 0
    two = spark.createDataFrame([(7, " ".join(words[:20])), (7, " ".join(words[35:50])), (8, " ".join(words))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in leaked_items(docs, two, block_windows=20).collect()}
    assert got == {(1, 7): (11, 11), (2, 7): (3, 11), (1, 8): (48, 48), (2, 8): (18, 48)}
