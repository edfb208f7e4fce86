from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import compilation as c
from tessera.operators import graph, relational, retrieval

TEXT = "intro line\n\n# Top\n\nfirst para\n\n## Sub\n\n- a\n- b\n\n| x | y |\n| 1 | 2 |\n\n```\n# no heading\n```\ntail\n\n## Sub\n\n" + "Sentence one. " * 120 + "\r\n"


def test_chunks_are_slices_of_their_text():
    chunks = c.chunk_text("Page", TEXT)
    assert all(TEXT[x["start_offset"] : x["end_offset"]] == x["text"] and len(x["text"]) <= 900 for x in chunks)
    assert [x["heading_path"] for x in chunks][:2] == [[], ["Top"]] and len({x["stable_key"] for x in chunks}) == len(chunks)
    assert chunks[1]["embedding_text"].startswith("Page > Top\n\n") and any(x["text"].startswith("```") for x in chunks)
    assert len({x["parent_key"] for x in chunks if x["heading_path"] == ["Top", "Sub"]}) == 2
    assert c.chunk_text("P", "") == [] and c.chunk_text(None, None) == [] and c.chunk_text("P", " \n ") == []


def test_tokens_and_terms(spark):
    df = spark.createDataFrame([("Ab1 x-y 知识库abc识",), ("",), ("The API /v1/x for ＫＢ 什么知识",)], "s string")
    got = [list(r.t) for r in df.select(t.search_tokens("s").alias("t")).collect()]
    assert got[0] == ["ab1", "x", "y", "abc", "知", "识", "库", "识", "知识", "识库", "库识"] and got[1] == []
    assert list(df.select(t.informative_terms("s").alias("t")).collect()[2].t) == ["api", "/v1/x", "kb", "么知", "知识"]


def test_texts_of_titles(spark):
    df = spark.createDataFrame([("  A  Title ", "x" * 200, "Bad Code!")], "a string, b string, c string")
    r = df.select(t.title_key("a"), t.clip("b", 180, "…"), t.error_code("c"), t.mentions(F.lit("see A Title."), F.lit("a title")), t.mentions(F.lit("see AA Title."), F.lit("a title")), t.contains_unaccented(F.lit("Élargie"), "elar")).first()
    assert r[0] == "a title" and len(r[1]) == 178 + 2 and r[2] == "bad_code_" and r[3] and not r[4] and r[5]


def test_cursor_and_fusion(spark):
    fields = [("a", True), ("b", False)]
    assert relational.decode_cursor(fields, relational.encode_cursor(fields, {"a": 3, "b": "x"})) == [3, "x"]
    one = spark.createDataFrame([("p", 1), ("q", 2)], "k string, rank int")
    two = spark.createDataFrame([("q", 1), ("r", 2)], "k string, rank int")
    got = retrieval.fuse({"lexical": one, "semantic": two}, "k", 5)
    assert [r.k for r in got.orderBy("rank").collect()] == ["q", "p", "r"] or [r.k for r in got.orderBy("rank").collect()][0] == "q"
    swapped = retrieval.fuse({"semantic": two, "lexical": one}, "k", 5)
    assert sorted(got.collect()) == sorted(swapped.collect())


def test_communities_and_caps(spark):
    clique = lambda p: [("s", f"{p}{i}", f"{p}{j}", 1.0) for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([*clique("a"), *clique("b"), ("s", "a0", "b0", 1.0)], "g string, a string, b string, weight double")
    got = {}
    for r in graph.communities(edges, "g").collect():
        got.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [["a0", "a1", "a2", "a3"], ["b0", "b1", "b2", "b3"]]
    star = spark.createDataFrame([("s", "hub", f"n{i}", float(i)) for i in range(9)], "g string, a string, b string, weight double")
    assert {r.b for r in graph.capped_edges(star, "g", 3).collect()} == {"n8", "n7", "n6"}


def test_validation(spark):
    body = "one two three"
    sources = spark.createDataFrame([("s", body)], "source_key string, body string")
    rows = [("ok", "two", 4, 7, "s"), ("range", "x", 4, 99, "s"), ("hash", "two", 4, 6, "s"), ("lost", "two", 4, 7, "zz"), ("none", "two", 4, 7, None)]
    df = spark.createDataFrame(rows, "id string, text string, start_offset int, end_offset int, source_key string").withColumn("quote_hash", t.sha(F.lit("two")))
    got = {r.id: list(r.reasons) for r in c.validation_reasons(df, sources, "id").collect()}
    assert got == {"ok": [], "range": ["range"], "hash": ["quote_hash"], "lost": ["unknown_source"], "none": ["missing_lineage"]}


def test_semantic_edges_against_brute_force(spark):
    """Shared terms within longer ones don't count again; linked pairs are left out; groups don't meet."""
    import itertools
    import math
    import random

    rng = random.Random(2)
    words = ["alpha", "betagamma", "deltaepsilon", "zeta", "common", "知识管理", "数据平台"]
    texts = {i: " ".join([*rng.sample(words, rng.randrange(1, 5)), "common"]) for i in range(24)}
    group = {i: "g" if i % 3 else "h" for i in texts}
    rows = [(i, group[i], t) for i, t in texts.items()] + [(90, "g", None), (91, None, "alpha betagamma"), (92, "g", "")]
    linked = [(1, 2), (5, 4)]

    def terms(t):
        out = {w for w in t.split() if w.isascii()}
        for w in t.split():
            if not w.isascii():
                out |= {w[a : a + n] for n in (2, 3, 4) for a in range(len(w) - n + 1)}
        return out

    want = {}
    for g in "gh":
        mine = {i: terms(t) for i, t in texts.items() if group[i] == g}
        total = len(mine) + (g == "g")
        df = {t: sum(t in m for m in mine.values()) for t in set().union(*mine.values())}
        ok = {t: round((math.log((total + 1) / (n + 1)) + 1) * max(1.0, min(4.0, len(t) / 4)), 6) for t, n in df.items() if n > 1 and not (n >= 4 and n >= 0.65 * total)}
        for a, b in itertools.combinations(sorted(mine), 2):
            both = [t for t in mine[a] & mine[b] if t in ok]
            top = [t for t in both if not any(t != u and t in u for u in both)]
            score = round(sum(ok[t] for t in top), 4)
            if len(top) >= 2 and score >= 3 and (a, b) not in {tuple(sorted(x)) for x in linked}:
                want.setdefault(a, []).append((-score, b, len(top)))
    want = {(a, b): (n, -s) for a, xs in want.items() for s, b, n in sorted(xs)[:3]}
    from tessera.operators.compilation import semantic_edges

    df = spark.createDataFrame(rows, "doc_id long, space string, text string")
    got = {(r.a, r.b): (r.anchors, round(r.score, 4)) for r in semantic_edges(df, "doc_id", "text", "space", spark.createDataFrame(linked, "a long, b long"), least_score=3.0, most=3).collect()}
    assert {k: (n, round(s, 3)) for k, (n, s) in got.items()} == {k: (n, round(s, 3)) for k, (n, s) in want.items()}


def test_search_expressions(spark):
    from tessera.operators import search

    df = spark.createDataFrame([(1, "The OUTLINE, draft two"), (2, "outline the draft"), (3, "a policy-import note"), (4, "policy import locked"), (5, None), (6, "")], "id int, text string")
    find = lambda q: [r.id for r in df.where(search.web_matches("text", q)).orderBy("id").collect()]
    assert find('"the outline" draft or policy -locked') == [1, 3]
    assert find("outline") == [1, 2] and find('"import note"') == [3] and find("-policy draft") == [1, 2] and find(" ?! ") == []
    assert [r.id for r in df.where(search.prefix_matches("text", "out dra*")).orderBy("id").collect()] == [1, 2]
    assert df.select(search.snippet("text", ["draft"], 2, 1).alias("s")).first().s == "draft two"


def test_keyset_pages_with_nulls(spark):
    from tessera.operators.relational import keyset_page

    rows = [(i, None if i % 3 == 0 else f"t{i % 4}") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, title string")
    fields = [("title", False), ("id", False)]
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    seen, at = [], None
    while True:
        page = keyset_page(df, fields, 3, after=at).collect()
        seen += [(r.id, r.title) for r in page[:3]]
        if len(page) <= 3:
            break
        at = [seen[-1][1], seen[-1][0]]
    assert seen == order
    for k in (5, 15, 19):  # the pages before a cursor, nearest first
        back = keyset_page(df, fields, 4, before=[order[k][1], order[k][0]]).collect()
        assert [(r.id, r.title) for r in back] == order[:k][::-1][:5]


def test_semantic_edges_without_pairs_of_all_texts(spark):
    """Parts of a group, and mentioned titles instead of linked pairs, give the same edges; no plan joins texts by terms."""
    import random

    rng = random.Random(4)
    words = ["alpha", "alphabet", "betagamma", "gamma", "zeta", "知识管理", "识管", "数据平台", "平台"]
    rows = [(i, "gh"[i % 3 == 0], f"Title {'ABCD'[i % 4]}{i // 8}", " ".join(rng.sample(words, 4)) + (f" see title {'ABCD'[i % 3]}{i // 9}" if i % 5 == 0 else "")) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, space string, title string, text string")
    links = c.title_links(df, "doc_id", "space", "title", "text").select(F.col("from").alias("a"), F.col("to").alias("b"))
    args = (df, "doc_id", "text", "space")
    want = sorted(tuple(r) for r in c.semantic_edges(*args, links, least_score=3.0, most=2).collect())
    free = c.semantic_edges(*args, least_score=3.0, most=2, part=5)
    named = c.semantic_edges(*args, least_score=3.0, most=2, part=5, named=c.title_mentions(df, "doc_id", "space", "title", "text"))
    assert want and links.count() and sorted(tuple(r) for r in named.collect()) == want != sorted(tuple(r) for r in free.collect())
    assert "term" not in " ".join(x for x in free._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
