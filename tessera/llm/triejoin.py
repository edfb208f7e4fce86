"""Near-duplicate records: a prefix-tree join of sets of word shingles.

1. Each text becomes its set of distinct shingles; equal sets are one class from here on.
2. Shingles have one global order, the rarest first. Rarity is counted over all texts.
3. Two sets of similarity t or more share a shingle in their prefixes; the first one they share is where
   they meet. A set goes once to the trie below each shingle of its prefix that another set has too, with
   the shingles that follow as its path. The smaller of two sets needs a shorter prefix than the larger
   one: only in that is it stored, in the longer one it only looks for others.
4. Each trie is walked from its root for all its sets at once. A walking set and a node stand for all pairs
   of the set with the sets below the node: what their paths share so far is counted once for them, and the
   subtree is left if that, plus the shorter of the two remaining lengths, can't reach what the similarity
   needs, or if the sizes or signatures below the node (their bounds are kept in it) rule all of them out.
5. What reaches a leaf is compared exactly on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import PLAIN_WORDS, WORD_COUNT, rolling, split_words, tables_of, word_hashes
from tessera.session import Workspace, tasks

#: Counters of rarity. The table is broadcast as the slots in use, five bytes each (80 MB at most), so it
#: grows with the input up to this bound; beyond it rare shingles are ordered less well, with the same result.
WIDTH = 1 << 24
DEPTH = 8  #: Shingles of a path.
SIGNATURE = 512  #: Bits of a set's signature.
BLOCK = 2048  #: Stored sets of a trie that one task walks; larger tries are split.
SLICE = 1 << 20  #: Shingles that a task orders at a time.
FEW = 200_000  #: Rows of one or two numbers or keys that are still broadcast (some 20 MB).
_END = 0xFFFFFFFF  #: Behind a set's last shingle.


def shingle_sets(df: DataFrame, key: str, text: str, size: int, least_words: int = 0, counted: str | None = None, short: bool = False) -> DataFrame:
    """(key, s): the distinct shingles of texts that have any, sorted; ``counted`` must have ``least_words`` words.

    Null keys and texts, and texts of fewer words than a shingle has, give no row. With ``short`` a text of
    fewer words, even of none, has one shingle made of all its words, so that it is only like its equals.
    """
    query = f"select k, {PLAIN_WORDS.format('t')} as t, {WORD_COUNT.format('c')} as c from batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables_of(batches, query):
            words, ends = split_words(t["t"].combine_chunks())
            own = word_hashes(words)
            h = rolling(own, size)
            many = np.diff(ends)
            owner = np.repeat(np.arange(len(many)), many)
            enough = t["c"].to_numpy() >= least_words
            inside = owner[: len(h)] == owner[size - 1 :] if len(h) else np.zeros(0, bool)
            inside &= enough[owner[: len(h)]]
            rows, h = owner[: len(h)][inside], h[inside]
            if short:
                few = np.flatnonzero((many < size) & enough)
                whole = np.array([rolling(np.concatenate([[np.uint64(many[i])], own[ends[i] : ends[i + 1]]]), int(many[i]) + 1)[0] for i in few], np.uint64)
                rows, h = np.concatenate([rows, few]), np.concatenate([h, whole])
            order = np.lexsort((h.view(np.int64), rows))
            rows, h = rows[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(rows) != 0) | (h[1:] != h[:-1])
            rows, counts = np.unique(rows[new], return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(h[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([t["k"].combine_chunks().take(pa.array(rows)), lists], ["key", "s"])

    texts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(counted or text), F.lit("")).alias("c"))
    return texts.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, s array<long>")


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their shingles in a row, sizes) of about so many shingles; a set is never cut."""
    for b in batches:
        ends = np.cumsum(b.column("s").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            part = b.slice(at, upto - at)
            yield part, part.column("s").flatten().to_numpy(zero_copy_only=False), np.diff(ends[at:upto], prepend=before)
            at = upto


def _rarity(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots in use, 4 * log2 of how many sets have a shingle of that slot): a slot's 0 says that no other set has it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, _ in _slices(batches, SLICE):
            slot, n = np.unique(np.mod(flat, width).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    counts = classes.select("s").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.least(F.lit(127), F.round(4 * F.log2(F.sum("n")))).cast("byte").alias("r")).toArrow()
    return counts["slot"].to_numpy(), counts["r"].to_numpy().astype(np.uint8)


def _dense(found: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    table = np.zeros(width, np.uint8)
    table[found[0]] = found[1]
    return table


def _need(t: float, a, b):
    """Shingles that sets of sizes a and b must share for similarity t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-6)


def prefix_lengths(n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of sizes n: the shingles in which a smaller set is sought, and those in which it is stored for larger ones."""
    return (n - np.ceil(t * n - 1e-6) + 1).astype(np.int64), (n - np.ceil(2 * t / (1 + t) * n - 1e-6) + 1).astype(np.int64)


def _ordered(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles as places in the order, set of each, place of each in its set); rarity is the top byte of a place."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    g = (table[np.mod(flat, len(table))].astype(np.uint64) << np.uint64(56)) | (flat.view(np.uint64) >> np.uint64(8))
    g = g[np.lexsort((g, owner))]
    return g, owner, np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


#: A set in a trie: its path (as bytes, so that rows sorted by them are in the trie's order), then the rest.
_BODY = np.dtype([("path", ">u4", DEPTH), ("n", "<i4"), ("pos", "<i4"), ("home", "u1"), ("handle", "<i8"), ("sign", "<u8", SIGNATURE // 64)])


def _crowded(classes: DataFrame, t: float, width: int, rarity, block: int) -> DataFrame:
    """(g, blocks): tries that store more than ``block`` sets. Only shingles whose counter allows it are counted."""
    least = np.floor(4 * np.log2(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _dense(rarity.value, width)
        for _, flat, sizes in _slices(batches, SLICE):
            g, owner, pos = _ordered(flat, sizes, table)
            own, counts = np.unique(g[(pos < prefix_lengths(sizes, t)[1][owner]) & ((g >> np.uint64(56)) >= least)].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts)], ["g", "n"])

    return classes.select("s").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def _routes(classes: DataFrame, t: float, width: int, rarity) -> DataFrame:
    """(g, handle, body): a row for each shingle g of a set's prefix that another set has too.

    A path has the upper 32 bits of the places that follow g; if two shingles share these, a pair may be
    looked at needlessly but isn't lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _dense(rarity.value, width)
        for b, flat, sizes in _slices(batches, SLICE):
            g, owner, pos = _ordered(flat, sizes, table)
            handles = b.column("handle").to_numpy()
            # Of each set, the parity of its shingles in each of SIGNATURE residues.
            signs = np.zeros((len(sizes), SIGNATURE), np.uint8)
            np.add.at(signs, (owner, np.mod(flat >> 3, SIGNATURE)), 1)
            signs = np.packbits(signs & 1, axis=1).view(np.uint64)
            short = np.concatenate([(g >> np.uint64(32)).astype(np.uint32), np.full(DEPTH, _END, np.uint32)])
            ends = np.cumsum(sizes)
            at = np.flatnonzero((pos < prefix_lengths(sizes, t)[0][owner]) & ((g >> np.uint64(56)) > 0))
            for k in range(0, len(at), 20_000):
                some = at[k : k + 20_000]
                who = owner[some]
                out = np.zeros(len(some), _BODY)
                places = some[:, None] + np.arange(1, DEPTH + 1)
                out["path"] = np.where(places < ends[who][:, None], short[places], _END)
                out["n"], out["pos"], out["home"], out["handle"], out["sign"] = sizes[who], pos[some], 1, handles[who], signs[who]
                body = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(0, (len(some) + 1) * _BODY.itemsize, _BODY.itemsize, dtype=np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([pa.array(g[some].view(np.int64)), pa.array(handles[who]), body], ["g", "handle", "body"])

    return classes.select("handle", "s").mapInArrow(run, "g long, handle long, body binary")


class Tries:
    """Tries of many shingles, one behind the other, over rows sorted by (trie, path).

    ``trie`` numbers the rows' tries; ``rows`` is of type _BODY. Sets that are stored in a trie are its
    leaves, in the order of their paths, so a node is a run of them that agree up to its level.
    """

    def __init__(self, trie: np.ndarray, rows: np.ndarray, t: float):
        self.t, self.trie = t, trie
        self.path, self.sign, self.handle = rows["path"].astype(np.uint32), rows["sign"], rows["handle"]
        self.n, self.rest = rows["n"].astype(np.int64), rows["n"].astype(np.int64) - rows["pos"]
        self.leaf = np.flatnonzero((rows["home"] == 1) & (rows["pos"] < prefix_lengths(self.n, t)[1]))
        same = self.trie[self.leaf][1:] == self.trie[self.leaf][:-1]
        alike = np.logical_and.accumulate(self.path[self.leaf][1:] == self.path[self.leaf][:-1], axis=1) if len(self.leaf) else np.zeros((0, DEPTH), bool)
        self.levels = []  # for each level: where its nodes begin, and each leaf's node
        for d in range(DEPTH + 1):
            begins = np.ones(len(self.leaf), bool)
            begins[1:] = ~(same & (alike[:, d - 1] if d else True))
            self.levels.append((np.flatnonzero(begins), np.cumsum(begins) - 1))
        self.seen = {"pairs": 0, "left in a subtree": 0, "left at a leaf": 0, "compared": 0}

    def _bounds(self, d: int) -> dict[str, np.ndarray]:
        first, _ = self.levels[d]
        stop = np.append(first[1:], len(self.leaf))
        n, rest, sign = self.n[self.leaf], self.rest[self.leaf], self.sign[self.leaf]
        return {"first": first, "many": stop - first, "least": np.minimum.reduceat(n, first), "most": np.maximum.reduceat(n, first), "rest": np.maximum.reduceat(rest, first), "any": np.bitwise_or.reduceat(sign, first), "all": np.bitwise_and.reduceat(sign, first)}

    def pairs(self, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Handles (x, y) of the pairs of similarity t that may be; y is the smaller set, or of equals the smaller handle."""
        if not len(self.leaf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bounds = [self._bounds(d) for d in range(DEPTH + 1)]
        # All sets of a trie begin at its root.
        roots = self.levels[0][0]
        root_of = np.full(int(self.trie[-1]) + 1, -1)
        root_of[self.trie[self.leaf[roots]]] = np.arange(len(roots))
        probe = np.flatnonzero(root_of[self.trie] >= 0)
        node = root_of[self.trie[probe]]
        self.seen["pairs"] += int(self.bounds[0]["many"][node].sum())
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.cumsum(self.bounds[0]["many"][node])
        at = 0
        while at < len(probe):
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            out += self._descend(0, probe[at:upto], node[at:upto], np.ones(upto - at, np.int64))
            at = upto
        x, y = np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
        return self.handle[x], self.handle[y]

    def _descend(self, d: int, probe: np.ndarray, node: np.ndarray, shared: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """From nodes of level d on. ``shared``: how many shingles of the node's path the walking set may have."""
        out = []
        while len(probe):
            here = self.bounds[d]
            single = here["many"][node] == 1
            out.append(self._leaves(probe[single], here["first"][node[single]]))
            probe, node, shared = probe[~single], node[~single], shared[~single]
            if d == DEPTH:  # equal paths: each leaf for itself
                out.append(self._leaves(*self._spread(probe, here["first"][node], here["many"][node])[:2]))
                break
            # Children: the nodes of the next level among the node's leaves.
            below = self.levels[d + 1][1]
            first = below[here["first"][node]]
            probe, node, which = self._spread(probe, first, below[here["first"][node] + here["many"][node] - 1] - first + 1)
            shared = shared[which]
            d += 1
            keep = self._possible(d, probe, node, shared)
            probe, node, shared = probe[keep[0]], node[keep[0]], keep[1][keep[0]]
        return out

    @staticmethod
    def _spread(probe: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(probe)), many)
        return probe[which], np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + first[which], which

    def _possible(self, d: int, probe: np.ndarray, node: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether any set below each node may be similar to the walking set; and what they share by then."""
        b, t = self.bounds[d], self.t
        n = self.n[probe]
        ok = (b["most"][node] >= t * n - 1e-6) & (b["least"][node] <= n)
        inner = np.flatnonzero(ok & (b["many"][node] > 1))  # a single leaf is looked at in the next step
        p, v = probe[inner], node[inner]
        token = self.path[self.leaf[b["first"][v]], d - 1]
        mine = self.path[p]
        before = (mine < token[:, None]).sum(axis=1)
        equal = (mine == token[:, None]).any(axis=1)
        # What follows the walking set's path is unknown: it may have the shingle. Of several that look equal one is spent.
        by_now = shared[inner] + (equal | (before == DEPTH))
        left = np.minimum(self.rest[p] - 1 - before - equal, b["rest"][v] - 1 - d)
        good = by_now + left >= _need(t, self.n[p], b["least"][v])
        # Bits that the walking set has and no set below, and the reverse, differ for every pair.
        apart = np.bitwise_count(self.sign[p] & ~b["any"][v]).sum(axis=1, dtype=np.int64) + np.bitwise_count(b["all"][v] & ~self.sign[p]).sum(axis=1, dtype=np.int64)
        good &= self.n[p] + b["most"][v] - apart >= 2 * _need(t, self.n[p], b["most"][v]) - 1
        ok[inner] = good
        self.seen["left in a subtree"] += int(b["many"][node[~ok]].sum())
        shared = shared.copy()
        shared[inner] = by_now
        return ok, shared

    def _leaves(self, probe: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stored = self.leaf[leaf]
        many = len(probe)
        n, m = self.n[probe], self.n[stored]
        ok = ((m < n) & (m >= self.t * n - 1e-6)) | ((m == n) & (self.handle[stored] < self.handle[probe]))
        probe, stored, n, m = probe[ok], stored[ok], n[ok], m[ok]
        need = _need(self.t, n, m)
        ok = np.minimum(self.rest[probe], self.rest[stored]) >= need
        probe, stored, slack = probe[ok], stored[ok], (n + m - 2 * need)[ok]
        ok = np.bitwise_count(self.sign[probe] ^ self.sign[stored]).sum(axis=1, dtype=np.int64) <= slack
        probe, stored = probe[ok], stored[ok]
        self.seen["left at a leaf"] += many - len(probe)
        self.seen["compared"] += len(probe)
        return probe, stored


def _walker(t: float):
    """Over rows sorted by trie and path: the candidate pairs of handles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            g, salt = table["g"].to_numpy(), table["salt"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(g) != 0) | (np.diff(salt) != 0)) + 1, [len(g)]])
            done = len(edges) - 1 if whole else len(edges) - 2
            if done > 0:
                body = table["body"].combine_chunks()
                body = body if isinstance(body, pa.Array) else body.chunk(0)
                begin = np.frombuffer(body.buffers()[1], np.int32)[body.offset]
                rows = np.frombuffer(body.buffers()[2], np.uint8)[begin : begin + int(edges[done]) * _BODY.itemsize].view(_BODY).copy()
                rows["home"] = table["home"].to_numpy()[: edges[done]]
                x, y = Tries(np.repeat(np.arange(done), np.diff(edges[: done + 1])), rows, t).pairs()
                if len(x):
                    pairs = np.unique(np.stack([x, y], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])
            held = [] if done == len(edges) - 1 else table.slice(int(edges[done])).to_batches()

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                yield from finish(False)
                rows = sum(h.num_rows for h in held)
        if held:
            yield from finish(True)

    return run


def _candidates(ws: Workspace, classes: DataFrame, t: float, width: int) -> DataFrame:
    """(x, y): handles of the pairs that the tries leave."""
    spark = classes.sparkSession
    rarity = spark.sparkContext.broadcast(_rarity(classes, width))
    routes = _routes(classes, t, width, rarity).withColumns({"salt": F.lit(0), "home": F.lit(True)})
    crowded = ws.table(_crowded(classes, t, width, rarity, BLOCK), "crowded")
    if not crowded.isEmpty():
        # A crowded trie's stored sets are split into blocks; its walking sets go to each block.
        met = routes.drop("salt", "home").join(crowded, "g", "left")
        mine = F.pmod(F.xxhash64("handle"), F.col("blocks")).cast("int")
        salts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        routes = met.withColumn("salt", F.explode(salts)).withColumn("home", F.col("blocks").isNull() | (F.col("salt") == mine))
    placed = routes.select("g", "salt", "home", "body").repartition(tasks(spark), "g", "salt").sortWithinPartitions("g", "salt", "body")
    return placed.mapInArrow(_walker(t), "x long, y long").distinct()


def similar_sets(sets: DataFrame, t: float, width: int = WIDTH, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes and links of (key, s) rows with sorted, distinct, non-empty arrays s.

    Returns members (key, class_id, one row per key; class_id is the smallest key of the same set) and links
    (class_a, class_b, similarity) between different sets of similarity t or more, the smaller first, each once.
    """
    ws = ws or Workspace(sets.sparkSession)
    held = ws.table(sets.select("key", F.xxhash64("s").alias("handle"), F.hash("s").alias("check"), "s"), "sets")
    ids = held.groupBy("handle", "check").agg(F.min("key").alias("class_id"))
    members = ws.table(held.select("key", "handle", "check").join(ids, ["handle", "check"]).select("key", "class_id"), "members")
    # Copies leave. If few, their keys go to all tasks; else the sets that stay are written once more.
    copies = members.where("key != class_id").select("key")
    few = copies.count() <= FEW
    classes = held.join(F.broadcast(copies) if few else copies, "key", "left_anti").select(F.col("key").alias("class_id"), "handle", "s")
    classes = classes if few else ws.table(classes, "classes")
    near = ws.table(_candidates(ws, classes, t, width), "near")
    if near.count() <= FEW:  # then only sets of candidates are moved
        ends = near.select(F.explode(F.array("x", "y")).alias("handle")).distinct()
        classes = classes.join(F.broadcast(ends), "handle", "left_semi")
    a = classes.select(F.col("handle").alias("x"), F.col("class_id").alias("ca"), F.col("s").alias("sa"))
    b = classes.select(F.col("handle").alias("y"), F.col("class_id").alias("cb"), F.col("s").alias("sb"))
    both = near.join(a, "x").join(b, "y").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = both.select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"), (F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= t - 1e-12)
    return members, ws.table(links.where("class_a != class_b").distinct(), "links")


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b): all pairs of similar records, the smaller first. As many rows as there are such pairs."""
    twins = members.groupBy("class_id").count().where("count > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    a, b = members.select(F.col("class_id").alias("class_a"), F.col("key").alias("ka")), members.select(F.col("class_id").alias("class_b"), F.col("key").alias("kb"))
    met = links.select("class_a", "class_b").unionByName(twins).join(a, "class_a").join(b, "class_b").where("class_a != class_b or ka < kb")
    return met.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def near_duplicate_groups(members: DataFrame, links: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(key, class_id, group_id, n_links): one row per record.

    group_id is the smallest class_id that links lead to, over any number of steps; n_links is the number of
    other records of similarity t or more. Groups come from joins between links and labels with pointer
    jumping, so a chain of n links takes about log n rounds.
    """
    ws = ws or Workspace(members.sparkSession)
    edges = ws.table(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).unionByName(links.select(F.col("class_b").alias("u"), F.col("class_a").alias("v"))), "edges")
    state = ws.table(edges.select("u").distinct().select("u", F.col("u").alias("c")), "groups")
    while True:
        seen = edges.join(state.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("cv"))
        lowered = state.join(seen, "u").select("u", "c", F.least("c", "cv").alias("low"))
        # Hook each label to the smallest one seen from it, then follow the labels one step.
        hooks = lowered.groupBy("c").agg(F.min("low").alias("to"))
        stepped = ws.table(lowered.join(hooks, "c").select("u", F.col("c").alias("old"), F.least("low", "to").alias("c")), "step")
        jump = stepped.select(F.col("u").alias("c"), F.col("c").alias("c2"))
        after = ws.table(stepped.join(jump, "c", "left").select("u", "old", F.least("c", F.coalesce("c2", "c")).alias("c")), "groups")
        done = after.where("c != old").isEmpty()
        ws.drop(state, stepped)
        state = after
        if done:
            break
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    reach = edges.join(sizes.select(F.col("class_id").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("linked"))
    by_class = sizes.join(reach, sizes.class_id == reach.u, "left").drop("u").join(state.select(F.col("u").alias("class_id"), F.col("c").alias("group_id")), "class_id", "left")
    by_class = by_class.select("class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(by_class, "class_id").select("key", "class_id", "group_id", "n_links")
