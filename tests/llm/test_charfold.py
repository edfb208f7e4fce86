import unicodedata

from tessera.llm import charfold as c

ALIKE = dict(zip(c.CYRILLIC + c.GREEK, c.CYR_LATIN + c.GRE_LATIN, strict=True))


def fold(text):
    return c.engine().execute("select fold_text(?)", [text]).fetchone()[0]


def test_forms_that_look_alike():
    same = [("ﬁne ﬂow", "fine flow"), ("Ｆｕｌｌ　ｗｉｄｔｈ１", "Full width1"), ("été", "été"), ("a​b⁠c﻿", "abc"), ("x y z\r\n\tw ", "x y z w"), ("Сору", "Copy"), ("ё", "ë"), ("ё", "ë"), ("2025‐01‑2", "2025-01-2"), ("ｶﾞ", "ガ"), ("更", "更"), ("豈", unicodedata.normalize("NFC", "豈"))]
    for a, b in same:
        assert fold(a) == fold(b), (a, b)


def test_what_can_be_seen_stays():
    for a, b in [("Case", "case"), ("resume", "résumé"), ("a–b", "a-b"), ("ab", "a b"), ("1.5", "15")]:
        assert fold(a) != fold(b)
    assert fold("") == "" and fold(" 　\n") == ""


def test_every_compatibility_form_matches_the_rule():
    """Round trip over all code points: what the SQL does is what the decompositions say."""
    con = c.engine()
    chars = [chr(k) for k in range(0x20, 0x30000) if unicodedata.category(chr(k)) not in ("Cs", "Co", "Cn", "Cc", "Cf", "Zs", "Zl", "Zp") and chr(k) not in ALIKE and chr(k) not in c.HYPHENS]
    got = con.execute("select fold_text(x) from (select unnest(?) as x)", [chars]).fetchall()
    wrong = []
    for ch, (have,) in zip(chars, got):
        want = unicodedata.normalize("NFC", "".join(ALIKE.get(x, x) for x in unicodedata.normalize("NFKD", ch)))
        want = " ".join(want.split())
        if have != want and have != "" and unicodedata.normalize("NFC", have) != want:
            wrong.append((hex(ord(ch)), have, want))
    assert len(wrong) <= 0.002 * len(chars), wrong[:20]


def test_folding_twice_changes_nothing():
    for t in ["ﬁﬂ Ⅷ ½ é", "Сору​ тест", "  a  b "]:
        assert fold(fold(t)) == fold(t)


def test_pairs_classes_and_nulls(spark):
    df = spark.createDataFrame([(1, "Copy"), (2, "Сору"), (3, "Copy"), (4, "copy"), (5, None), (6, ""), (7, "​"), (8, "Copy\n")], "doc_id long, text string").withColumn("k", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    keys = c.look_alike_keys(df, "doc_id")
    assert {tuple(r) for r in c.look_alike_pairs(keys, "doc_id").collect()} == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8), (6, 7)}
    classes = {r.doc_id: (r.form_id, r.spelling_id, r.n_spellings) for r in c.look_alike_classes(keys, "doc_id").collect()}
    assert classes == {1: (1, 1, 3), 2: (1, 2, 3), 3: (1, 1, 3), 8: (1, 8, 3), 4: (4, 4, 1), 6: (6, 6, 2), 7: (6, 7, 2)}
    assert {r.doc_id: r.text for r in c.normalize_text(df, "doc_id").collect()}[5] is None


def test_empty(spark):
    keys = c.look_alike_keys(spark.createDataFrame([], "doc_id long, text string"), "doc_id")
    assert c.look_alike_pairs(keys, "doc_id").count() == 0
