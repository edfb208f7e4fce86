"""One consistent form for text that looks the same but is made of different characters.

The work runs in DuckDB inside the Arrow partitions: embedded SQL of translate, regular expressions and
nfc_normalize over each batch. The tables that the SQL needs are computed here from rules, not listed:
compatibility forms come from Unicode's own decompositions, look-alikes from the short lists below, and
precomposed look-alikes (such as a Cyrillic letter with a diaeresis) from both together.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import heavy_keys, salted_join
from tessera.session import Workspace

# Cyrillic and Greek letters that look like a Latin one, each above the letter it looks like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԌԚԜҮӀасеіјорѕухԁԛԝһѵѴ"
CYR_LATIN = "ABESIJKMHOPCTYXGQWYIaceijopsyxdqwhvV"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳϲϹͿ"
GRE_LATIN = "ABEZHIKMNOPTYXovjcCJ"

# Hyphens that look like the ASCII one.
HYPHENS = "‐‑­⁃﹣－"

#: Invisible: format characters, variation selectors, fillers, and controls that aren't white space.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}\x00-\x08\x0E-\x1B\x7F]"
#: White space of any kind, line ends too.
ODD_SPACE = r"\x09-\x0D\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: What must become one blank; a single blank is left alone, which spares most of the replacing.
SPACE = f"[ {ODD_SPACE}]{{2,}}|[{ODD_SPACE}]"


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, long): one-to-one replacements, and those of one character by several."""
    alike = dict(zip(CYRILLIC + GREEK, CYR_LATIN + GRE_LATIN, strict=True))
    alike |= {h: "-" for h in HYPHENS if h != "­"}
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Cs", "Co", "Cn") or c in alike:
            continue
        whole = unicodedata.normalize("NFKD", c)
        if whole == c or 0xAC00 <= code < 0xD7A4:
            continue
        new = unicodedata.normalize("NFC", "".join(alike.get(x, x) for x in whole))
        if new == unicodedata.normalize("NFC", c):
            continue  # nfc_normalize does the rest
        if len(new) == 1:
            single[c] = new
        else:
            several[c] = new
    single |= alike
    return "".join(single), "".join(single.values()), several


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """A regular expression's class of the characters, as ranges."""
    codes, out = sorted(map(ord, chars)), []
    first = last = codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            out.append(f"\\x{{{first:X}}}-\\x{{{last:X}}}")
            first = c
        last = c
    return "[" + "".join(out) + "]"


@cache
def setup_sql() -> list[str]:
    """Macros of which fold_text(t) gives the consistent form of t."""
    old, new, several = _tables()
    long_class = _class("".join(several))
    one = _class(old)
    return [
        # Characters that become several: cut out one by one, only in the texts that have any.
        f"create macro expand_forms(t) as case when not regexp_matches(t, '{long_class}') then t else list_aggregate(list_transform(string_split(t, ''), lambda c: coalesce(long_forms()[c], c)), 'string_agg', '') end",
        f"create macro map_forms(t) as case when regexp_matches(t, '{one}') then translate(t, {_literal(old)}, {_literal(new)}) else t end",
        f"create macro bare(t) as trim(regexp_replace(regexp_replace(t, '{INVISIBLE}', '', 'g'), '{SPACE}', ' ', 'g'))",
        # Plain ASCII needs its white space seen to, and nothing else.
        f"create macro fold_text(t) as case when not regexp_matches(t, '[^\\x09-\\x0D\\x20-\\x7E]') then trim(regexp_replace(t, '{SPACE}', ' ', 'g')) else trim(regexp_replace(nfc_normalize(map_forms(expand_forms(nfc_normalize(bare(t))))), '  +', ' ', 'g')) end",
    ]


@cache
def engine():
    """One DuckDB connection for each Python worker, with the macros and one thread."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    _, _, several = _tables()
    pairs = ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in several.items())
    con.execute(f"create macro long_forms() as map {{{pairs}}}")
    for statement in setup_sql():
        con.execute(statement)
    return con


def fold_batches(batches: Iterator[pa.RecordBatch], select: str, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Run ``select`` (which reads the view ``batch``) over each batch, in slices of ``rows``."""
    con = engine()
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            part = pa.Table.from_batches([whole.slice(at, rows)])
            con.register("batch", part)
            yield from con.sql(select).to_arrow_table().to_batches()
            con.unregister("batch")


def normalize_text(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): every row with its text in the consistent form; null stays null, empty stays empty.

    White space is one blank, none at the ends. Columns besides the two are not carried along.
    """
    kind = df.schema[key].dataType.simpleString()
    query = "select k, fold_text(t) as t from batch"
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lambda b: fold_batches(b, query), f"k {kind}, t string")
    return out.select(F.col("k").alias(key), F.col("t").alias(text))


def look_alike_keys(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, form, spelling): digests of the consistent form and of the text as it is, of non-null texts."""
    kind = df.schema[key].dataType.simpleString()
    query = "select k, md5(fold_text(t)) as form, md5(t) as spelling from batch"
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lambda b: fold_batches(b, query), f"k {kind}, form string, spelling string").withColumnRenamed("k", key)


def look_alike_classes(keys: DataFrame, key: str) -> DataFrame:
    """(key, form_id, spelling_id, n_spellings): one row per record.

    form_id is the smallest key that reads the same, spelling_id the smallest with the very same text.
    Counted by spelling before the form's rows meet, so a text copied many times is one row by then.
    """
    keys = Workspace(keys.sparkSession).table(keys, "keys")
    spellings = keys.groupBy("form", "spelling").agg(F.min(key).alias("spelling_id"))
    forms = spellings.groupBy("form").agg(F.min("spelling_id").alias("form_id"), F.count("*").alias("n_spellings"))
    both = spellings.join(forms, "form")
    heavy = heavy_keys(keys, ["form", "spelling"], keys.count())
    return salted_join(keys, both, ["form", "spelling"], heavy, [key], how="inner").select(key, "form_id", "spelling_id", "n_spellings")


def look_alike_pairs(keys: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b): records that read the same but differ as strings, each pair once, the smaller first.

    Spellings that meet in a form are paired first; records join by spelling then, so that copies of one
    text never meet each other. A text copied very often is spread over several tasks. Texts are brought to
    their form once, their digests are kept.
    """
    ws = Workspace(keys.sparkSession)
    keys = ws.table(keys, "keys")
    spellings = ws.table(keys.groupBy("form", "spelling").agg(F.count("*").alias("copies")), "spellings")
    mixed = spellings.groupBy("form").count().where("count > 1").select("form")
    s = ws.table(spellings.join(mixed, "form", "left_semi"), "mixed")
    pairs = s.select("form", F.col("spelling").alias("sa")).join(s.select("form", F.col("spelling").alias("sb")), "form").where("sa < sb")
    some = keys.join(s.select("form", "spelling"), ["form", "spelling"], "left_semi")
    rows = s.agg(F.sum("copies")).first()[0] or 0
    a = some.select("form", F.col("spelling").alias("sa"), F.col(key).alias("ka"))
    b = some.select("form", F.col("spelling").alias("sb"), F.col(key).alias("kb"))
    first = salted_join(a, pairs, ["form", "sa"], heavy_keys(a, ["form", "sa"], rows), ["ka"], how="inner", hint=None)
    met = salted_join(b, first, ["form", "sb"], heavy_keys(b, ["form", "sb"], rows), ["kb"], how="inner", hint=None)
    return met.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
