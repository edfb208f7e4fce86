import re

import pytest

from tessera.operators import compilation
from tessera.plans import knowledge_queries as kq

ROWS = [
    ("a", "s", "Chunk", "see the API guide, 知识库管理 and xüber; Chunk"),
    ("b", "s", None, "a chunk of API Guide, not apis. 新知识库 AB"),
    ("c", "s", "API guide", None),
    ("d", "s", "知识库", "chunky chunk_ chunk2 (CHUNK)"),
    ("e", "s", "über", ""),
    ("f", "s", "AB", "no title here, c++."),
    ("g", "s", "c++", "知 abc and !!!"),
    ("h", "s", "知 abc", "AB c++x"),
    ("i", "s", "!!!", " API  guide 知识库"),
    ("j", "s", " chunk ", "the API"),
    ("k", "z", "Chunk", "chunk 知识库 API guide"),
    ("l", "z", "other", "(chunk)"),
    ("m", None, "Chunk", "chunk"),
]


def brute(rows, shortest=3):
    out = set()
    for k, s, _, x in rows:
        for to, z, t, _ in rows:
            t = (t or "").strip(" ").lower()
            if x is None or s is None or s != z or k == to or len(t) < shortest:
                continue
            if re.search(r"(?<!\w)" + re.escape(t) + r"(?!\w)" if t.isascii() else re.escape(t), x.lower()):
                out.add((k, to))
    return out


@pytest.mark.parametrize("block", [16_000_000, 500])
def test_against_brute_force(spark, block):
    docs = spark.createDataFrame(ROWS, "doc_id string, space_id string, title string, text string")
    got = sorted(map(tuple, compilation.title_links(docs, "doc_id", "space_id", "title", "text", block=block).collect()))
    assert got == sorted(brute(ROWS)) and ("a", "e") in got and ("g", "h") in got and ("b", "c") in got


def test_query_over_whole_documents(spark, data):
    rows = [(r.doc_id, r.space_id, r.title, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted(map(tuple, kq.title_links(spark, data).collect()))
    assert got == sorted(brute(rows)) and any(len(t.strip()) < 12 for _, to in got for k, _, t, _ in rows if k == to)
