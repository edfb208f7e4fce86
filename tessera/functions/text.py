"""Text functions as column expressions: they stay in the JVM. NFKC is the one that can't (see nfkc)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no information in a search.
STOP_WORDS = ["and", "are", "for", "how", "the", "what", "when", "where", "which", "who", "why"]
STOP_HAN = ["什么", "如何", "多少", "时候", "的是", "一下"]

@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, over Arrow batches; Spark has no such function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def contains_unaccented(col: Column | str, needle: str) -> Column:
    """Substring, ignoring case and accents of any script, by Unicode's collation; the needle's wildcards are plain characters."""
    return F.contains(F.collate(_c(col), "UNICODE_CI_AI"), F.collate(F.lit(needle), "UNICODE_CI_AI"))


def like_escaped(needle: str) -> str:
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def words(col: Column | str) -> Column:
    """ASCII letters and digits in runs."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit("[a-z0-9]+"), 0)


def _bigrams(chars: Column) -> Column:
    return F.when(F.length(chars) >= 2, F.transform(F.sequence(F.lit(1), F.length(chars) - 1), lambda i: F.substring(chars, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def search_tokens(col: Column | str) -> Column:
    """Words, Han characters, and pairs of neighbouring Han characters, with whatever stands between these left out."""
    han = F.regexp_replace(_c(col), r"[^\p{IsHan}]", "")
    return F.concat(words(col), F.regexp_extract_all(_c(col), F.lit(r"\p{IsHan}"), 0), _bigrams(han))


def informative_terms(col: Column | str) -> Column:
    """Distinct terms of two characters or more that aren't stop words; Han pairs don't cross other characters."""
    low = F.lower(nfkc(_c(col)))
    latin = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9_./:-]{2,}"), 0), lambda t: ~t.isin(STOP_WORDS))
    pairs = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"\p{IsHan}{2,}"), 0), _bigrams))
    return F.array_distinct(F.concat(latin, F.filter(pairs, lambda t: ~t.isin(STOP_HAN))))


def semantic_terms(col: Column | str) -> Column:
    """Latin words of three letters or more, and Han sequences of two to four characters."""
    low = F.lower(_c(col))
    latin = F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_&&[^\p{IsHan}]-]+"), 0), lambda t: F.length(t) >= 3)
    runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+"), 0)
    grams = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    han = F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3), grams(r, 4))))
    return F.array_distinct(F.concat(latin, han))


def evidence_score(terms: Column, text: Column) -> Column:
    """Four for each term with a letter or an identifier's sign that the text holds, one for each other."""
    weight = lambda t: F.when(F.contains(text, t), F.when(t.rlike("[/_.:-]|[a-z]"), 4).otherwise(1)).otherwise(0)
    return F.aggregate(terms, F.lit(0), lambda s, t: s + weight(t))


def title_key(col: Column | str) -> Column:
    """A title as it compares: trimmed, lower case, single blanks."""
    return F.regexp_replace(F.lower(F.trim(_c(col))), r"\s+", " ")


def match_key(col: Column | str) -> Column:
    """Only letters and digits."""
    return F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}]+", "")


def mentions(text: Column, title: Column) -> Column:
    """Whether the text holds the title; an ASCII title must stand between word boundaries."""
    low, needle = F.lower(text), F.lower(title)
    bounded = F.regexp_like(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), needle, F.lit(r"\E(?![\p{L}\p{N}_])")))
    return F.when(needle.rlike(r"^[\x00-\x7f]+$"), bounded).otherwise(F.contains(low, needle))


def clip(col: Column | str, most: int, tail: str) -> Column:
    """At most ``most`` characters, the last of them ``tail`` if something was cut."""
    c = _c(col)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(tail)), F.lit(tail))).otherwise(c)


def error_code(col: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9_-]", "_"), 1, 80)


def error_class(col: Column | str) -> Column:
    """The class of an error code: some codes by equality, the others by what they contain, the first that fits; null or empty has none."""
    c = F.lower(_c(col))
    part = lambda *xs: c.rlike("|".join(xs))
    kind = F.when(c == "page_timeout", "budget_timeout").when(part("provider", "llm") | c.isin("rate_limited", "invalid_output"), "provider")
    kind = kind.when(part("publication", "import", "merge"), "publication").when(part("storage", "database", "embedding", "job"), "infrastructure")
    return F.when(c != "", kind.otherwise("other"))


def error_message(col: Column | str) -> Column:
    return F.substring(F.trim(F.regexp_replace(_c(col), r"[\x00-\x1f\x7f]+", " ")), 1, 500)


def last_part(col: Column | str) -> Column:
    """What follows the last hyphen."""
    return F.element_at(F.split(_c(col), "-"), -1)


def headings(col: Column | str, most: int = 32) -> Column:
    return F.slice(F.regexp_extract_all(_c(col), F.lit(r"(?m)^#{1,6}\s+(.+)$"), 1), 1, most)


def trigrams(col: Column | str) -> Column:
    """Distinct runs of three characters over the padded words."""
    padded = F.transform(F.regexp_extract_all(F.lower(_c(col)), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams, of two arrays of trigrams."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def sha(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped digest of the parts: version nibble 5, variant bits 10."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
