"""From page texts to chunks: structural chunking, hashes, links, validation, merging of contributions, staleness."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import semantic_terms
from tessera.session import Workspace, tasks

MOST_CHARACTERS = 900
#: Titles are sought in blocks of about so many bytes (200 and the characters each); more titles take more passes.
TITLE_BLOCK = 16_000_000
GROUP_PART = 8192  #: Documents of a group that one task compares with all others of it.

# Markdown's block marks, as regular expressions.
HEADING = re.compile(r"^(#{1,3})\s+(.+?)\s*$")
FENCE = re.compile(r"^\s*```")
RUNS = (re.compile(r"^\s*\|"), re.compile(r"^\s*>"), re.compile(r"^\s*(?:[-*+] |\d+[.)] )"))


@dataclass
class _Block:
    start: int
    end: int
    level: int = 0
    title: str = ""
    whole: bool = False  #: stands for itself: a table, a list, a quotation, a fenced block


@dataclass
class _Section:
    path: tuple[str, ...]
    start: int
    end: int = 0
    blocks: list[_Block] = field(default_factory=list)


def _kind(line: str) -> int | None:
    """0 to 2 for lines that go on a run of their kind, 3 for a fence, None for plain text."""
    if FENCE.match(line):
        return 3
    return next((i for i, r in enumerate(RUNS) if r.match(line)), None)


def _blocks(text: str) -> Iterator[_Block]:
    """A state machine over the lines: one pass, one open block at most."""
    open_: _Block | None = None
    state: int | str | None = None  # the kind of the open block; 'text' for plain
    at = 0
    for line in text.split("\n"):
        start, end = at, at + len(line)
        at = end + 1
        kind = _kind(line)
        if state == 3:  # inside a fence, all is content until it closes
            open_.end = end
            if kind == 3:
                yield open_
                open_, state = None, None
            continue
        title = HEADING.match(line)
        plain = bool(line.strip()) and kind is None and not title
        if open_ is not None:
            if (state == "text" and plain) or (state == kind and kind is not None):
                open_.end = end
                continue
            yield open_
            open_, state = None, None
        if title:
            yield _Block(start, end, len(title[1]), title[2])
        elif kind is not None:
            open_, state = _Block(start, end, whole=True), kind
        elif plain:
            open_, state = _Block(start, end), "text"
    if open_ is not None:
        yield open_


def _sections(text: str) -> list[_Section]:
    found: list[_Section] = []
    titles = ["", "", ""]
    for b in _blocks(text):
        if b.level:
            titles[b.level - 1 :] = [b.title] + [""] * (3 - b.level)
            found.append(_Section(tuple(t for t in titles if t), b.start))
        else:
            if not found:
                found.append(_Section((), b.start))
            found[-1].blocks.append(b)
    for here, ahead in zip(found, found[1:] + [None]):
        here.end = ahead.start if ahead else len(text)
    return found


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    body = text[start:end]
    return start + len(body) - len(body.lstrip()), end - (len(body) - len(body.rstrip()))


# Where a long block may be cut, before the end of a line or behind the end of a sentence.
BREAK = re.compile(r"\n|[。；]|\. ")


def _split(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """A long block as pieces of ``most`` characters or fewer.

    All its breaks are found once; a piece ends at the last break in its second half, or is full.
    """
    found = [(m.end() - 1, m.start() + (m[0] != "\n")) for m in BREAK.finditer(text, start, end)]
    last = [at for at, _ in found]
    edges = [start]
    while end - edges[-1] > most:
        full = edges[-1] + most
        k = bisect_left(last, full) - 1
        edges.append(found[k][1] if k >= 0 and found[k][1] - edges[-1] >= most // 2 else full)
    spans = [_trimmed(text, a, z) for a, z in itertools.pairwise([*edges, end])]
    return [(a, z) for a, z in spans if a < z]


def _pieces(text: str, blocks: list[_Block], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring blocks together as long as they fit; one that stands for itself begins a piece."""
    spans: list[list[int]] = []
    for b in blocks:
        a, z = _trimmed(text, b.start, b.end)
        if a >= z:
            continue
        if spans and not b.whole and z - spans[-1][0] <= most:
            spans[-1][1] = z
        else:
            spans.append([a, z])
    return itertools.chain.from_iterable(_split(text, a, z, most) for a, z in spans)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# What the keys of chunks are digests of.
PARENT_KEY, CHILD_KEY, INTRO, HEADING_JOIN, CRUMB_JOIN = "parent|{}|{}", "child|{}|{}|{}", "(intro)", "\x1f", " > "


def _numbered(names: Iterable[str]) -> Iterator[tuple[str, int]]:
    """Each name with how many times it has come up so far."""
    seen: Counter[str] = Counter()
    for n in names:
        seen[n] += 1
        yield n, seen[n]


def chunk_text(title: str | None, text: str | None, most: int = MOST_CHARACTERS) -> list[dict]:
    """The chunks of one text. Every chunk's text is text[start_offset:end_offset]."""
    text = text or ""
    sections = [s for s in _sections(text) if text[s.start : s.end].strip()]
    parents = [_sha(PARENT_KEY.format(*x)) for x in _numbered(HEADING_JOIN.join(s.path) or INTRO for s in sections)]
    out: list[dict] = []
    for s, parent in zip(sections, parents):
        spans = list(_pieces(text, s.blocks, most))
        crumb = CRUMB_JOIN.join(filter(None, (title, *s.path)))
        for (a, z), (same, n) in zip(spans, _numbered(" ".join(text[a:z].split()) for a, z in spans)):
            body = text[a:z]
            out.append({
                "parent_key": parent, "stable_key": _sha(CHILD_KEY.format(parent, same, n)), "heading_path": list(s.path), "text": body,
                "embedding_text": f"{crumb}\n\n{body}" if crumb else body, "start_offset": a, "end_offset": z, "quote_hash": f"sha256:{_sha(body)}",
            })
    return out


CHUNKS = "parent_key string, stable_key string, heading_path array<string>, text string, embedding_text string, start_offset int, end_offset int, quote_hash string"


def structural_chunks(docs: DataFrame, key: str, title: str, text: str, most: int = MOST_CHARACTERS) -> DataFrame:
    """Chunks of every text: one row in, as many out as the text has; no shuffle. Empty and null texts have none."""
    kind = docs.schema[key].dataType.simpleString()
    names = [p.split()[0] for p in CHUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [{"key": k, **c} for k, h, x in zip(rows["key"], rows["title"], rows["text"]) for c in chunk_text(h, x, most)]
            yield pd.DataFrame(out, columns=["key", *names])

    picked = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(text).alias("text"))
    return picked.mapInPandas(run, f"key {kind}, {CHUNKS}").withColumnRenamed("key", key)


def _letter(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _title_index(rows: Iterator[tuple]) -> dict:
    """By space and the title's beginning: titles by length, so that what a place of a text costs doesn't grow with their number."""
    out: dict = {}
    for space, title, key in rows:
        out.setdefault(space, {}).setdefault(key, {}).setdefault(len(title), set()).add(title)
    return out


def _titles_in(text: str, index: dict, width: int) -> set[str]:
    """The titles that the text holds, both in lower case; an ASCII title must stand between word boundaries."""
    found = set()
    for at in range(len(text) - width + 1):
        for length, titles in index.get(text[at : at + width], {}).items():
            t = text[at : at + length]
            if t in titles and t not in found and not (t.isascii() and (at and _letter(text[at - 1]) or at + length < len(text) and _letter(text[at + length]))):
                found.add(t)
    return found


def title_mentions(docs: DataFrame, key: str, space: str, title: str, text: str, shortest: int = 3, block: int = TITLE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(from, s, t): titles that documents' texts mention, within a space s; (s, to, t): documents of the titles.

    Equal titles of a space are sought once. They are taken in blocks of bounded size, each in one pass over
    the texts, which aren't shuffled; at each place of a text, titles are looked up by how they begin and by length.
    """
    spark, width = docs.sparkSession, max(1, shortest)
    ws = Workspace(spark)
    kind, within = docs.schema[key].dataType.simpleString(), docs.schema[space].dataType.simpleString()
    name = F.lower(F.trim(F.col(title)))
    titles = ws.table(docs.where(F.length(F.trim(F.col(title))) >= width).where(F.col(space).isNotNull()).select(F.col(space).alias("s"), F.col(key).alias("to"), name.alias("t")).distinct(), "titles")
    sought = titles.groupBy("s", "t").agg(F.count("*").alias("n")).select("s", "t", F.substring("t", 1, width).alias("w"))
    sought = ws.table(sought.withColumn("size", F.length("t") + F.lit(200)), "sought")
    blocks = max(1, -(-(sought.agg(F.sum("size")).first()[0] or 0) // block))
    bodies = docs.where(F.col(text).isNotNull() & F.col(space).isNotNull()).select(F.col(key).alias("k"), F.col(space).alias("s"), F.lower(F.col(text)).alias("x"))

    def seek(mine):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _title_index(mine.value)
            for rows in batches:
                out = [(k, s, t) for k, s, x in zip(rows["k"], rows["s"], rows["x"]) if s in index for t in _titles_in(x, index[s], width)]
                yield pd.DataFrame(out, columns=["from", "s", "t"])

        return bodies.mapInPandas(run, f"from {kind}, s {within}, t string")

    parts = []
    for b in range(blocks):
        mine = sought.where(F.pmod(F.xxhash64("s", "t"), F.lit(blocks)) == b).select("s", "t", "w")
        parts.append(seek(spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])))
    return ws.table(reduce(DataFrame.unionByName, parts), "met"), titles


def title_links(docs: DataFrame, key: str, space: str, title: str, text: str, shortest: int = 3, block: int = TITLE_BLOCK) -> DataFrame:
    """(from, to): documents whose text mentions another's title, within a space."""
    met, titles = title_mentions(docs, key, space, title, text, shortest, block)
    return met.join(titles, ["s", "t"]).where(F.col("from") != F.col("to")).select("from", "to").distinct()


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ...: n numbers of each, one run after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _listed(of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the values of each of n begin, how many there are, and the values."""
    size = np.bincount(of, minlength=n)
    return np.cumsum(size) - size, size, values[np.lexsort((values, of))]


def _within(terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(longer, term): which terms lie within which."""
    lengths, out = sorted({len(t) for t in terms}), []
    for t, k in terms.items():
        inner = {terms.get(t[i : i + n]) for n in lengths if n < len(t) for i in range(len(t) - n + 1)} - {None}
        out += [(k, x) for x in inner]
    return tuple(np.array(x, np.int64) for x in (zip(*out) if out else ((), ())))


@dataclass
class _Rules:
    least_anchors: int
    least_score: float
    most: int
    common_df: int
    common_share: float


def _semantic_group(keys: pa.Array, n: int, docs: np.ndarray, terms: pa.DictionaryArray, marks: tuple, bears: tuple, parts: int, part: int, rules: _Rules) -> Iterator[tuple]:
    """Arrays of (a, b, anchors, score) for the documents a of one part of a group, whose keys are sorted.

    n: documents with those of no key, docs and terms: which document has which term (-1 for no key); marks and
    bears: (document, mark); a document is linked with those that bear a mark of it. Weights are summed in millionths.
    """
    codes, names, total = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary.to_pylist(), len(keys)
    df = np.bincount(codes, minlength=len(names))
    share = Decimal(str(rules.common_share)) * n
    kept = {t: k for k, (t, d) in enumerate(zip(names, df.tolist())) if d > 1 and not (d >= rules.common_df and d >= share)}
    weight, is_kept = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    for t, k in kept.items():
        w = (math.log((n + 1) / (int(df[k]) + 1)) + 1) * max(1.0, min(4.0, len(t) / 4))
        weight[k], is_kept[k] = int((Decimal(repr(w)) * 1_000_000).to_integral_value(ROUND_HALF_UP)), True
    use = is_kept[codes] & (docs >= 0)
    begin, size, posted = _listed(codes[use], docs[use], len(names))  # the documents of each term
    term = np.repeat(np.arange(len(names)), size)
    at_first, at_size, at = _listed(posted, np.arange(len(posted)), total)  # each document's places in them
    longer, inner = _within(kept)
    inner_first, inner_size, inner = _listed(longer, inner, len(names))
    n_marks = 1 + max((int(x[1].max(initial=-1)) for x in (marks, bears)), default=-1)
    of_doc = [_listed(x[0], x[1], total) for x in (marks, bears)]
    of_mark = [_listed(x[1], x[0], n_marks) for x in (bears, marks)]
    has, hidden = np.full(len(names), -1), np.zeros(total, bool)
    for a in range(part, total, parts):
        p = at[at_first[a] : at_first[a] + at_size[a]]
        t = term[p]
        after = begin[t] + size[t] - p - 1
        p, t, after = (x[after > 0] + k for x, k in ((p, 1), (t, 0), (after, 0)))
        if len(t) < rules.least_anchors:
            continue
        has[t] = np.arange(len(t))
        within = has[inner[_runs(inner_first[t], inner_size[t])]]
        by = np.repeat(np.arange(len(t)), inner_size[t])[within >= 0]
        within = within[within >= 0]
        has[t] = -1
        alone = np.ones(len(t), bool)
        alone[within] = False
        found, w = [posted[_runs(p[alone], after[alone])]], [np.repeat(weight[t[alone]], after[alone])]
        order = np.argsort(within, kind="stable")
        within, by = within[order], by[order]
        for i, js in zip(np.unique(within), np.split(by, np.flatnonzero(np.diff(within)) + 1)):
            over = [posted[p[k] : p[k] + after[k]] for k in js]
            for x in over:
                hidden[x] = True
            b = posted[p[i] : p[i] + after[i]]
            found.append(b[~hidden[b]])
            w.append(np.full(len(found[-1]), weight[t[i]]))
            for x in over:
                hidden[x] = False
        b = np.concatenate(found) - a
        anchors = np.bincount(b, minlength=total - a)
        score = np.bincount(b, weights=np.concatenate(w), minlength=total - a).astype(np.int64)  # whole numbers, exact
        for (first, many, own), (f, m, others) in zip(of_doc, of_mark):
            mine = own[first[a] : first[a] + many[a]]
            gone = others[_runs(f[mine], m[mine])] - a
            anchors[gone[gone >= 0]] = 0
        score = (score + 50) // 100
        good = np.flatnonzero((anchors >= rules.least_anchors) & (score / 1e4 >= rules.least_score))
        if len(good) > rules.most:
            good = good[np.argpartition(good - score[good] * total, rules.most)[: rules.most]]
        if len(good):
            yield np.full(len(good), a), good + a, anchors[good].astype(np.int32), score[good] / 1e4


def _semantic_groups(kind: pa.DataType, rules: _Rules):
    """Over rows sorted by (g, part), each of a document with its terms, or its marks, or those that it bears."""

    def whole(parts: int, part: int, rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(rows)
        of = {c: t.filter(pc.is_valid(t.column(c))) for c in ("terms", "marks", "bears")}
        docs = of["terms"].column("k").combine_chunks().cast(kind)
        n, keys = len(docs), docs.drop_null().unique()
        keys = keys.take(pc.sort_indices(keys))

        def lists(c: str) -> tuple[np.ndarray, pa.Array]:
            at = pc.fill_null(pc.index_in(of[c].column("k").cast(kind), value_set=keys), -1).to_numpy()
            values = of[c].column(c).combine_chunks()
            return np.repeat(at.astype(np.int64), pc.list_value_length(values).to_numpy()), pc.list_flatten(values)

        (d, terms), (m, marks), (b, bears) = (lists(c) for c in ("terms", "marks", "bears"))
        names = pa.concat_arrays([marks, bears]).unique()
        code = lambda x: pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        linked = [(at[at >= 0], code(x)[at >= 0]) for at, x in ((m, marks), (b, bears))]
        for x, y, anchors, score in _semantic_group(keys, n, d, terms.dictionary_encode(), *linked, parts, part, rules):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y)), pa.array(anchors), pa.array(score)], ["a", "b", "anchors", "score"])

    def merged(found: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
        while some := list(itertools.islice(found, most)):
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            own = list(zip(*(batch.column(c).to_pylist() for c in ("g", "part", "parts"))))
            ends = [k for k in range(1, len(own)) if own[k] != own[k - 1]]
            for x, y in itertools.pairwise([0, *ends, len(own)]):
                if x < y and own[x] != at:
                    if rows:
                        yield from merged(whole(at[2], at[1], rows))
                    at, rows = own[x], []
                rows.append(t.slice(x, y - x).drop_columns(["g", "part", "parts"]))
        if rows:
            yield from merged(whole(at[2], at[1], rows))

    return run


def semantic_edges(docs: DataFrame, key: str, text: str, group: str, linked: DataFrame | None = None, least_anchors: int = 2, least_score: float = 6.0, most: int = 6, common_df: int = 4, common_share: float = 0.65, named: tuple[DataFrame, DataFrame] | None = None, part: int = GROUP_PART) -> DataFrame:
    """(a, b, anchors, score): documents of a group that share informative terms, at most ``most`` for each a.

    Terms that too many documents of the group have count for nothing (df of common_df or more and a share of
    common_share or more); a term's weight is its inverse frequency by its length, counted up to four times. Of
    the terms that two documents share, those within a longer one are no anchors of their own. Pairs in
    ``linked`` (a, b, in either order) are left out, as are those of ``named`` (see title_mentions), where one
    mentions the other's title. Null texts and groups have no edges.

    Neither pairs nor shared terms are written or shuffled: a task has the terms of all documents of a group and
    compares up to ``part`` of these with all others, one at a time by the documents of its terms.
    """
    live = docs.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("x"))
    n = live.groupBy("g").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    rows = [live.select("g", "k", semantic_terms("x").alias("terms"))]
    listed = lambda df, c: rows.append(df.groupBy("g", "k").agg(F.collect_list("m").alias(c)))
    if named is not None:
        listed(named[0].select(F.col("s").alias("g"), F.col("from").alias("k"), F.col("t").alias("m")), "marks")
        listed(named[1].select(F.col("s").alias("g"), F.col("to").alias("k"), F.col("t").alias("m")), "bears")
    if linked is not None:
        ids = live.select("g", "k").where("k is not null").distinct()
        mark = lambda c: F.concat(F.lit("\0"), F.col(c).cast("string")).alias("m")
        listed(linked.select(F.col("a").alias("k"), mark("b")).join(ids, "k"), "marks")
        listed(ids.select("g", "k", mark("k")), "bears")
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    whole = whole.withColumns({c: F.lit(None).cast("array<string>") for c in ("marks", "bears") if c not in whole.columns})
    whole = whole.join(n, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = whole.repartition(2 * tasks(docs.sparkSession), "g", "part").sortWithinPartitions("g", "part")
    kind = docs.schema[key].dataType
    rules = _Rules(least_anchors, least_score, most, common_df, common_share)
    return placed.mapInArrow(_semantic_groups(to_arrow_type(kind), rules), f"a {kind.simpleString()}, b {kind.simpleString()}, anchors int, score double")


def validation_reasons(chunks: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, reasons): what is wrong with each chunk; an empty array accepts it.

    chunks: key, text, start_offset, end_offset, quote_hash, source_key; sources: source_key, body. Line ends
    are one kind before hashing.
    """
    both = chunks.join(sources.select("source_key", "body"), "source_key", "left")
    quote = F.substring(F.col("body"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    lines = lambda c: F.regexp_replace(c, r"\r\n?", "\n")
    inside = (F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset")) & (F.col("end_offset") <= F.length("body"))
    rules = F.array(
        F.when(F.col("source_key").isNull(), "missing_lineage"), F.when(F.col("source_key").isNotNull() & F.col("body").isNull(), "unknown_source"),
        F.when(~F.coalesce(inside, F.lit(False)) & F.col("body").isNotNull(), "range"), F.when(inside & (F.concat(F.lit("sha256:"), F.sha2(lines(quote), 256)) != F.col("quote_hash")), "quote_hash"), F.when(F.length(F.trim("text")) == 0, "empty"),
    )
    return both.select(key, F.array_compact(rules).alias("reasons"))


def merge_contributions(contributions: DataFrame, artifact: str, source: str, ref: str, order: str) -> DataFrame:
    """(artifact, action, sources, refs): one contribution passes, several are merged with their references once each, none but nulls is a removal."""
    n = F.count_distinct(source)
    return contributions.groupBy(artifact).agg(F.when(n == 0, "remove").when(n == 1, "keep").otherwise("merge").alias("action"), F.array_sort(F.collect_set(source)).alias("sources"), F.array_sort(F.collect_set(ref)).alias("refs"))


def stale_after(changed: DataFrame, *bridges: DataFrame) -> DataFrame:
    """(id): what rests on a changed source by any of the bridges (source_id, id)."""
    hit = [b.join(changed.select("source_id"), "source_id", "left_semi").select("id") for b in bridges]
    out = hit[0]
    for h in hit[1:]:
        out = out.unionByName(h)
    return out.distinct()
