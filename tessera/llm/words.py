"""Words and word shingles, as arrays that numpy and Spark can work on.

A word is, after lower-casing, a run of letters or digits; each Han character is a word of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: DuckDB: the words of a text, blank-separated, with the differences of look-alike characters removed.
FOLDED_WORDS = r"trim(regexp_replace(regexp_replace(lower(fold_text(t)), '(\p{Han})', ' \1 ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))"

#: The same of a text as it is.
PLAIN_WORDS = r"trim(regexp_replace(regexp_replace(lower({}), '(\p{{Han}})', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
WORD_COUNT = f"coalesce(len(list_filter(string_split({PLAIN_WORDS}, ' '), lambda w: w <> '')), 0)"


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of words, each distinct word hashed once."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` hashes; runs over the ends of texts are the caller's to drop."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    base, total = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        total = total * base + hashes[j : len(hashes) - size + 1 + j]
    total ^= total >> np.uint64(31)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Blank-separated texts: all their words in a row, and where each text begins (one more at the end)."""
    lists = pc.split_pattern(texts, " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if empty.any():  # a text without words has no word, not an empty one
        lists = pc.if_else(pc.equal(texts, ""), pa.scalar([], pa.list_(pa.string())), lists)
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def tables_of(batches: Iterator[pa.RecordBatch], select: str) -> Iterator[pa.Table]:
    """Non-empty results of a DuckDB select over each batch."""
    from tessera.llm.charfold import fold_batches

    for b in fold_batches(batches, select):
        if b.num_rows:
            yield pa.Table.from_batches([b])
