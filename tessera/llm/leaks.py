"""Evaluation texts inside a training corpus.

A prefix-filtered set join. A document leaks an item if it holds ``window`` consecutive words of it, that is,
all the shingles of one of the item's windows at the right distances. As a window's shingles are all
needed, the necessary prefix of a window, ordered by rarity in the corpus, is its rarest shingle.

1. One pass over the corpus brings the texts to one form, which is kept, and counts in how many documents
   the items' shingles occur, in counters of fixed number.
2. Windows whose rarest shingle is in no document are out; of the others this shingle alone is sought.
3. Where a document has it, the window must fit into the document on both sides (length and position), and
   then all its words are compared with the item's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import FOLDED_WORDS, rolling, split_words, tables_of, word_hashes
from tessera.session import Workspace

#: Items are taken in blocks of about so many windows, so what is broadcast at once is bounded (some 20 MB),
#: however many items there are. Each further block costs a pass over the folded texts.
BLOCK_WINDOWS = 400_000
PIECE = 4096  #: Windows of one row of items; longer items are several rows.
COUNTERS = 1 << 20  #: Of shingles' documents.


def _item_pieces(items: DataFrame, item: str, window: int) -> DataFrame:
    """(item_id, text, base, words): the items' words; ``text`` tells several texts of one id apart."""
    query = f"select k, {FOLDED_WORDS} as t from batch"
    found = items.where(f"{item} is not null and text is not null").select(F.col(item).cast("long").alias("k"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables_of(batches, query):
            rows = []
            for k, x in zip(t["k"].to_pylist(), t["t"].to_pylist()):
                words = x.split(" ")
                rows += [(k, x, base, words[base : base + PIECE + window - 1]) for base in range(0, len(words) - window + 1, PIECE)]
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "whole", "base", "words"), r)) for r in rows], pa.schema([("item_id", pa.int64()), ("whole", pa.string()), ("base", pa.int32()), ("words", pa.list_(pa.string()))]))

    pieces = found.mapInArrow(run, "item_id long, whole string, base int, words array<string>")
    return pieces.withColumn("text", F.xxhash64("whole")).drop("whole").dropDuplicates(["item_id", "text", "base"])


def _item_slots(pieces: DataFrame, size: int) -> np.ndarray:
    """The counters that the items' shingles have: COUNTERS of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [rolling(word_hashes(words.values), size) for words in b.column("words")]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *h]) % np.uint64(COUNTERS)).astype(np.int32))], ["slot"])

    return pieces.mapInArrow(run, "slot int").distinct().toArrow()["slot"].to_numpy()


def _fold_and_count(docs: DataFrame, doc: str, slots, size: int) -> DataFrame:
    """(key, t, slot, n): the texts as blank-separated words; and for each task, in how many texts each counter's shingles are."""
    query = f"select k, {FOLDED_WORDS} as t from batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(COUNTERS, bool)
        wanted[slots.value] = True
        total = np.zeros(COUNTERS, np.int64)
        for t in tables_of(batches, query):
            texts = t["t"].combine_chunks()
            words, ends = split_words(texts)
            h = rolling(word_hashes(words), size)
            if len(h):
                owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                slot = (h % np.uint64(COUNTERS)).astype(np.int64)
                at = np.flatnonzero(wanted[slot] & (owner[: len(h)] == owner[size - 1 :]))
                total += np.bincount(np.unique(owner[at] * COUNTERS + slot[at]) % COUNTERS, minlength=COUNTERS)
            none = pa.nulls(len(t), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([t["k"].combine_chunks(), texts, none, pa.nulls(len(t), pa.list_(pa.int64()))], ["key", "t", "slot", "n"])
        used = np.flatnonzero(total)
        if len(used):
            lists = [pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[used]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), *lists], ["key", "t", "slot", "n"])

    texts = docs.where(f"{doc} is not null and text is not null").select(F.col(doc).cast("long").alias("k"), F.col("text").alias("t"))
    return texts.mapInArrow(run, "key long, t string, slot array<int>, n array<long>")


def prefix_index(pieces: pa.Table, counts: np.ndarray, window: int, size: int) -> dict[str, np.ndarray | pa.Array]:
    """The rarest shingle of each window of the pieces, sorted: h, and at ``start`` (one more at the end) the
    windows that have it, with off (its place in the window), at (the window's first word among all words),
    whole (the hash of the window's words); and the words of all pieces."""
    words = pieces["words"].combine_chunks()
    words = words if isinstance(words, pa.Array) else words.chunk(0)
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = words.flatten()
    own = word_hashes(flat)
    h, whole = rolling(own, size), rolling(own, window)
    first = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(ends[:-1], ends[1:])])
    docs = counts[(h % np.uint64(COUNTERS)).astype(np.int64)]
    views = np.lib.stride_tricks.sliding_window_view
    best = np.full(len(h) - (window - size), 0, np.int64)
    for at in range(0, len(best), 100_000):  # ties go to the first of the window
        best[at : at + 100_000] = np.argmin(views(docs, window - size + 1)[at : at + 100_000], axis=1)
    off = best[first]
    keep = docs[first + off] > 0
    first, off = first[keep], off[keep]
    key = h[first + off]
    order = np.argsort(key, kind="stable")
    unique, start = np.unique(key[order], return_index=True)
    piece = np.searchsorted(ends, first[order], side="right") - 1
    return {
        "h": unique, "start": np.append(start, len(order)), "off": off[order], "at": first[order], "whole": whole[first[order]], "words": flat,
        "item_id": pieces["item_id"].to_numpy()[piece], "text": pieces["text"].to_numpy()[piece], "wpos": pieces["base"].to_numpy()[piece] + first[order] - ends[piece],
    }


def _seek(folded: DataFrame, index, window: int, size: int, most: int = 1 << 20) -> DataFrame:
    """(key, item_id, text, wpos): the items' windows that each document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for b in batches:
            for begin in range(0, b.num_rows, 2000):
                part = b.slice(begin, 2000)
                words, ends = split_words(part.column("t"))
                own = word_hashes(words)
                h = rolling(own, size)
                if not len(h):
                    continue
                found = np.searchsorted(x["h"], h)
                found[found == len(x["h"])] = 0
                places = np.flatnonzero(x["h"][found] == h)
                entry, whole = found[places], rolling(own, window)
                owner = np.searchsorted(ends, places, side="right") - 1
                many = x["start"][entry + 1] - x["start"][entry]
                total, at = np.cumsum(many), 0
                while at < len(places):
                    upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
                    k = many[at:upto]
                    w = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(x["start"][entry[at:upto]], k)
                    start, who = np.repeat(places[at:upto], k) - x["off"][w], np.repeat(owner[at:upto], k)
                    fits = (start >= ends[who]) & (start + window <= ends[who + 1])
                    w, start, who = w[fits], start[fits], who[fits]
                    same = whole[start] == x["whole"][w]
                    w, start, who = w[same], start[same], who[same]
                    if len(w):
                        steps = np.arange(window)
                        mine, its = words.take(pa.array((start[:, None] + steps).ravel())), x["words"].take(pa.array((x["at"][w][:, None] + steps).ravel()))
                        same = pc.equal(mine, its).to_numpy(zero_copy_only=False).reshape(-1, window).all(axis=1)
                        w, who = w[same], who[same]
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(who)), pa.array(x["item_id"][w]), pa.array(x["text"][w]), pa.array(x["wpos"][w].astype(np.int64))], ["key", "item_id", "text", "wpos"])
                    at = upto

    return folded.mapInArrow(run, "key long, item_id long, text long, wpos long")


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", window: int = 13, size: int = 5, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc, item, n_windows, item_windows): documents that hold ``window`` consecutive words of an item.

    n_windows says how many of the item's item_windows windows the document holds; equal numbers mean that the
    whole item is in it. Case, punctuation, markup, white space and look-alike characters don't matter.
    Null texts and ids, texts without words and items of fewer words than a window give no row. A repeated
    document or item row gives its row once; several texts of one item id count together.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    pieces = ws.table(_item_pieces(items, item, window), "items")
    many = F.size("words") - (window - 1)
    total = pieces.agg(F.sum(many)).first()[0] or 0
    slots = spark.sparkContext.broadcast(_item_slots(pieces, size) if total else np.zeros(0, np.int32))
    parts = []
    if total:
        both = ws.table(_fold_and_count(docs, doc, slots, size), "folded")
        sums = both.where("slot is not null").select(F.explode(F.arrays_zip("slot", "n")).alias("c")).groupBy("c.slot").agg(F.sum("c.n").alias("n")).toArrow()
        counts = np.zeros(COUNTERS, np.int64)
        counts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
        blocks = -(-total // block_windows)
        for b in range(blocks):
            mine = pieces.where(F.pmod(F.xxhash64("item_id", "text", "base"), F.lit(blocks)) == b).toArrow()
            index = prefix_index(mine, counts, window, size) if len(mine) else {"h": ()}
            if len(index["h"]):
                parts.append(_seek(both.where("t is not null").select("key", "t"), spark.sparkContext.broadcast(index), window, size))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{doc} long, {item} long, n_windows long, item_windows long")
    found = ws.table(reduce(DataFrame.unionByName, parts).groupBy("key", "item_id").agg(F.count_distinct("text", "wpos").alias("n_windows")), "found")
    sizes = pieces.groupBy("item_id").agg(F.sum(many).alias("item_windows"))
    # An item that is everywhere is one row here, however many documents have it; AQE splits its documents.
    return found.join(sizes, "item_id").select(F.col("key").alias(doc), F.col("item_id").alias(item), "n_windows", "item_windows")
