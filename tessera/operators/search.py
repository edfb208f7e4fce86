"""Full-text matching: which texts a search expression finds, and what of them to show.

A text is compared as its words between blanks, so a word, the beginning of a word and a phrase are all
substrings of one string, and matching stays in the JVM without exploding a text into rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\p{L}\p{N}]+"


def bare_words(col: Column | str) -> Column:
    """The words of a text in lower case, a blank around each; null is no word."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" ")), _WORD, " ")


def _plain(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def web_query(query: str) -> list[list[tuple[str, bool]]]:
    """A search expression as alternatives of (words, wanted) that must all hold.

    Words stand for themselves, quoted words for a phrase, a leading minus for what must not occur; ``or``
    separates alternatives and binds less than the rest. Parts without a word are left out.
    """
    out: list[list[tuple[str, bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', query):
        if not minus and word.lower() == "or":
            out.append([])
            continue
        text = _plain(phrase or word)
        if text:
            out[-1].append((text, not minus))
    return [part for part in out if part]


def web_matches(text: Column | str, query: str) -> Column:
    """Whether a text matches a search expression; an expression without words matches nothing."""
    w = bare_words(text)
    has = lambda words: F.contains(w, F.lit(f" {words} "))
    parts = [reduce(Column.__and__, [has(x) if wanted else ~has(x) for x, wanted in part]) for part in web_query(query)]
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def prefix_matches(text: Column | str, query: str) -> Column:
    """Whether a text has, for each word of the query, a word that begins with it; a query without words matches nothing."""
    w = bare_words(text)
    parts = [F.contains(w, F.lit(f" {x}")) for x in dict.fromkeys(_plain(query).split())]
    return reduce(Column.__and__, parts) if parts else F.lit(False)


def snippet(text: Column | str, terms: list[str], words: int = 10, fragments: int = 3) -> Column:
    """The first stretches of ``words`` words that hold one of the terms, at most ``fragments`` of them; empty if none does."""
    all_ = F.split(F.trim(bare_words(text)), " ")
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / words).cast("int")), lambda i: F.slice(all_, i * words + 1, words))
    hit = F.filter(stretches, lambda s: F.arrays_overlap(s, F.array(*map(F.lit, terms))))
    return F.concat_ws(" ... ", F.transform(F.slice(hit, 1, fragments), lambda s: F.concat_ws(" ", s)))


def cited_windows(windows: DataFrame, page: str, order: list[str], score: Column, least: int = 1, most: int = 2) -> DataFrame:
    """The best windows of each page, at most ``most``, of those that score ``least`` or more; ties by ``order``."""
    from tessera.operators.relational import first_rows

    scored = windows.withColumn("score", score).where(F.col("score") >= least)
    return first_rows(scored, [page], [F.col("score").desc(), *map(F.col, order)], most)
