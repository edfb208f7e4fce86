"""The k most similar vectors of every vector, by multiprobe p-stable hashing.

Each of several tables hashes a unit vector by Gaussian (2-stable) projections cut into cells. A vector lies
in one bucket of each table and visits the buckets around it in the order of their estimated success, the
squared distances to the cells' boundaries that must be crossed. In a bucket, visitors are compared with
residents on 12-bit codes, and all that the codes' error leaves possible stay; what the tables find is merged
and ranked again by exact cosine.

The numbers of projections, tables and probes follow from the number of vectors: projections so that a
bucket of unrelated vectors has about BUCKET residents, tables so that a pair at the least cosine of
interest is found with the given probability, estimated by simulation. Without a least cosine, the cosines of
the nearest come from an exact search for a few of the queries. The index holds every vector.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Workspace, tasks

BUCKET = 1024  #: Residents of a bucket of unrelated vectors.
BLOCK = 4096  #: Residents of a bucket that one task compares at a time; larger buckets are split.
TEMPLATES = 96  #: Perturbations whose estimated success is compared for each vector; more if more are visited.
SAMPLED = 128  #: Queries by whose exact neighbours an index without a least cosine is laid out.


@dataclass(frozen=True)
class Plan:
    dims: int
    width: float
    projections: int
    tables: int
    probes: int
    seed: int = 7

    @property
    def shapes(self) -> np.ndarray:
        return templates(self.projections, max(TEMPLATES, self.probes + self.probes // 2))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.tables * self.projections
        return rng.normal(size=(self.dims, n)).astype(np.float32), rng.uniform(0, self.width, n).astype(np.float32), rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def templates(m: int, most: int = TEMPLATES) -> np.ndarray:
    """Perturbations as 0/1 rows over the 2m boundary distances in rising order, by expected sum of squares.

    The j-th and the (2m - 1 - j)-th nearest boundary belong to the same cell, so no row has both.
    """
    j = np.arange(1, 2 * m + 1)
    near = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    top = range(min(2 * m, 12))
    rows = [s for r in range(1, 5) for s in itertools.combinations(top, r) if not any(2 * m - 1 - a in s for a in s)]
    rows.sort(key=lambda s: near[list(s)].sum())
    out = np.zeros((min(most, len(rows)), 2 * m), np.float32)
    for i, s in enumerate(rows[:most]):
        out[i, list(s)] = 1
    return out


def bucket_keys(x: np.ndarray, plan: Plan, arrays=None, shapes=None) -> np.ndarray:
    """(n, tables, probes) keys: the vector's own bucket first, then those around it in estimated success order."""
    a, b, primes = arrays or plan.arrays()
    shapes = plan.shapes if shapes is None else shapes
    m, out = plan.projections, np.zeros((len(x), plan.tables, plan.probes), np.uint64)
    p = (x @ a + b) / plan.width
    cell = np.floor(p)
    part = p - cell
    with np.errstate(over="ignore"):
        for t in range(plan.tables):
            cols = slice(t * m, (t + 1) * m)
            own = (cell[:, cols].astype(np.int64).view(np.uint64) * primes[cols]).sum(axis=1, dtype=np.uint64)
            keys = [own[:, None]]
            if plan.probes > 1:
                f = part[:, cols]
                cost = np.concatenate([f**2, (1 - f) ** 2], axis=1)  # down, up
                order = np.argsort(cost, axis=1)
                sums = np.take_along_axis(cost, order, axis=1) @ shapes.T
                best = np.argsort(sums, axis=1)[:, : plan.probes - 1]
                steps = np.concatenate([-primes[cols], primes[cols]])[order]  # what each boundary adds to the key
                added = (shapes[best].astype(np.uint64) * steps[:, None, :]).sum(axis=2, dtype=np.uint64)
                keys.append(own[:, None] + added)
            k = np.concatenate(keys, axis=1) + np.uint64(t + 1) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
            out[:, t, : k.shape[1]] = k * np.uint64(0xBF58476D1CE4E5B9)
    return out


def success(cosine: float, plan: Plan, mutual: bool, trials: int = 1500) -> float:
    """How often a pair of that cosine meets in one table: one visits the other's bucket."""
    rng = np.random.default_rng(11)
    u, w = (rng.normal(size=(trials, plan.dims)) for _ in range(2))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = cosine * u + math.sqrt(1 - cosine**2) * w
    ku, kv = (bucket_keys(z.astype(np.float32), plan) for z in (u, v))
    met = (ku == kv[:, :, :1]).any(axis=2)
    return float((met | (kv == ku[:, :, :1]).any(axis=2) if mutual else met).mean())


def make_plan(n: int, dims: int, cosine: float, recall: float, mutual: bool = True, width: float = 1.5, probes: int = 2, bucket: int | None = None) -> Plan:
    rng = np.random.default_rng(5)
    x, y, b = rng.normal(size=200_000), rng.normal(size=200_000), rng.uniform(0, width, 200_000)
    far = float((np.floor((x + b) / width) == np.floor((y + b) / width)).mean())
    m = max(2, round(math.log(max(1.0, n / (bucket or BUCKET))) / math.log(1 / far)))
    s = success(cosine, Plan(dims, width, m, 2, probes), mutual)
    return Plan(dims, width, m, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(s, 0.999)))), probes)


def plan_for_queries(n: int, dims: int, cosines: np.ndarray, recall: float, width: float = 2.0, most_tables: int = 12, trials: int = 400) -> tuple[Plan, float]:
    """The plan that visits the smallest share of all vectors, and that share, if its neighbours have these cosines.

    For several numbers of projections and probes, how often a pair meets is simulated at some cosines; the
    tables follow from the recall that is wanted on average over ``cosines``.
    """
    rng = np.random.default_rng(11)
    u, w, z = (rng.normal(size=(trials, dims)) for _ in range(3))
    u, z = (y / np.linalg.norm(y, axis=1)[:, None] for y in (u, z))
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    grid = np.array([0.0, 0.2, 0.35, 0.45, 0.55, 0.65, 0.8, 0.9, 1.0])
    best = None
    base = make_plan(n, dims, 0.9, 0.5, False, width, 1).projections
    for m in range(max(2, base - 2), base + 9, 2):
        for probes in (16, 64, 256):
            plan = Plan(dims, width, m, 1, probes)
            visited = bucket_keys(u.astype(np.float32), plan)[:, 0]
            homes = [bucket_keys((c * u + math.sqrt(1 - c * c) * w).astype(np.float32), Plan(dims, width, m, 1, 1))[:, 0, 0] for c in grid]
            met = np.interp(cosines, grid, [float((visited == h[:, None]).any(axis=1).mean()) for h in homes])
            far = bucket_keys(z.astype(np.float32), Plan(dims, width, m, 1, 1))[:, 0, 0]
            one = float(np.mean([np.isin(far, v).mean() for v in visited]))
            for tables in range(1, most_tables + 1):
                if np.mean(1 - (1 - met) ** tables) >= recall:
                    share = 1 - (1 - one) ** tables
                    if best is None or share < best[1]:
                        best = Plan(dims, width, m, tables, probes), share
                    break
    return best or (Plan(dims, width, 1, most_tables, 3), 1.0)


def sampled_cosines(classes: DataFrame, k: int, dims: int, sampled: int = SAMPLED) -> np.ndarray:
    """The cosines of the k nearest of ``sampled`` queries (those of smallest handle), exact, over all vectors."""
    few = classes.where("query").orderBy("handle").limit(sampled).select("v").toArrow()
    if not len(few):
        return np.zeros(0)
    asked = classes.sparkSession.sparkContext.broadcast(_matrix(few["v"].combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asked.value), k + 1), -2.0)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                s = asked.value @ _matrix(b.column("v").slice(at, 4096)).T
                best = -np.partition(-np.concatenate([best, s], axis=1), k, axis=1)[:, : k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), k + 1)), pa.array(best.ravel())], ["q", "c"])

    found = classes.select("v").mapInArrow(run, "q long, c double").where("c > -2")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("c").desc()))).where(f"r between 2 and {k + 1}")  # the first is the query itself
    return top.toArrow()["c"].to_numpy()


def _encode(x: np.ndarray) -> pa.Array:
    """Unit vectors as a scale, the length of the code's error, and 12 bits for each number."""
    top = np.abs(x).max(axis=1)
    scale = (top / 2047).astype(np.float32)
    q = np.clip(np.round(x / scale[:, None]), -2047, 2047)
    off = (np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-5) + 1e-6).astype(np.float32)
    q = (q + 2048).astype(np.uint16)
    if q.shape[1] % 2:
        q = np.concatenate([q, np.zeros((len(q), 1), np.uint16)], axis=1)
    a, b = q[:, 0::2], q[:, 1::2]
    bits = np.stack([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4], axis=2).astype(np.uint8).reshape(len(x), -1)
    raw = np.concatenate([scale[:, None].view(np.uint8), off[:, None].view(np.uint8), bits], axis=1)
    width = raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _decode(codes: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, and of each how far it is from the one that was coded."""
    first, last = codes.offset, codes.offset + len(codes)
    ends = np.frombuffer(codes.buffers()[1], np.int32)[first : last + 1]
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(codes), -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    x, y, z = (raw[:, 8 + i :: 3].astype(np.int16) for i in range(3))
    q = np.stack([x | ((y & 15) << 8), (y >> 4) | (z << 4)], axis=2).reshape(len(codes), -1)[:, :dims]
    return (q - 2048).astype(np.float32) * head[:, :1], head[:, 1]


def _matrix(lists: pa.Array) -> np.ndarray:
    """The lists as rows of length 1."""
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


_ROW = pa.schema([("bucket", pa.int64()), ("home", pa.bool_()), ("handle", pa.int64()), ("code", pa.binary())])


def _visits(vectors: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, home, handle, code): residents (home, of every vector) and visitors (of the vectors with query).

    A resident that is a query too visits its own bucket in the same row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, shapes = plan.arrays(), plan.shapes
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = _matrix(b.column("v"))
                keys = bucket_keys(x, plan, arrays, shapes).view(np.int64)
                handle, query, code = b.column("handle"), b.column("query").to_numpy(zero_copy_only=False), _encode(x)
                asks = np.flatnonzero(query)
                for t in range(plan.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t, 0]), pa.array(np.ones(len(x), bool)), handle, code], schema=_ROW)
                    for p in range(1, plan.probes):
                        if len(asks):
                            yield pa.RecordBatch.from_arrays([pa.array(keys[asks, t, p]), pa.array(np.zeros(len(asks), bool)), handle.take(pa.array(asks)), code.take(pa.array(asks))], schema=_ROW)

    return vectors.mapInArrow(run, "bucket long, home boolean, handle long, code binary")


def _homes(vectors: DataFrame, plan: Plan) -> DataFrame:
    """(bucket): of every vector its own bucket of each table, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Plan(plan.dims, plan.width, plan.projections, plan.tables, 1, plan.seed)
        arrays = one.arrays()
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                keys = bucket_keys(_matrix(b.column("v").slice(at, 4096)), one, arrays, one.shapes)
                bucket, n = np.unique(keys.ravel().view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], ["bucket", "n"])

    return vectors.select("v").mapInArrow(run, "bucket long, n long")


def _compare(dims: int, k: int, least: float | None, mutual: bool):
    """Over rows sorted by (bucket, salt, home first): the residents that may be among the k best of each visitor.

    For vectors x and y with codes off by e and f at most, the codes' product is off by e + f + ef at most. So
    one of the k best is no further below the k-th best code than twice that. With ``mutual`` a visitor
    also stays that may be among the k best of a resident, of which only these visitors are known.
    """

    def best(handle: np.ndarray, home: np.ndarray, ask: np.ndarray, x: np.ndarray, off: np.ndarray) -> list[pa.RecordBatch]:
        res, vis, out = np.flatnonzero(home), np.flatnonzero(ask), []
        if len(res) == 0 or len(vis) == 0:
            return out
        most = off.max()
        bound = off + most + off * most + 1e-5  # and the rounding of sums
        for at in range(0, len(vis), 1024):
            rows = vis[at : at + 1024]
            s = x[rows] @ x[res].T
            s[handle[rows][:, None] == handle[res][None, :]] = -2
            good = s > -1.9
            if len(res) > k:
                near = s >= (-np.partition(-s, k - 1, axis=1)[:, k - 1] - 2 * bound[rows])[:, None]
                if mutual and len(rows) > k:
                    near |= s >= (-np.partition(-s, k - 1, axis=0)[k - 1] - 2 * bound[res])[None, :]
                elif mutual:
                    near[:] = True
                good &= near
            if least is not None:
                good &= s >= least - bound[rows][:, None]
            i, j = np.nonzero(good)
            if len(i):
                out.append(pa.RecordBatch.from_arrays([pa.array(handle[rows[i]]), pa.array(handle[res[j]])], ["x", "y"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(upto_last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            bucket, salt = table["bucket"].to_numpy(), table["salt"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0)) + 1, [len(bucket)]])
            done = len(edges) - 1 if upto_last else len(edges) - 2  # the last bucket may go on
            if done > 0:
                handle, home, ask = table["handle"].to_numpy(), table["home"].to_numpy(), table["ask"].to_numpy()
                code = table["code"].combine_chunks()
                x, off = _decode(code if isinstance(code, pa.Array) else code.chunk(0), dims)
                for a, b in zip(edges[:done], edges[1 : done + 1]):
                    if b - a > 1:
                        yield from best(handle[a:b], home[a:b], ask[a:b], x[a:b], off[a:b])
            held = [] if done == len(edges) - 1 else table.slice(int(edges[done])).to_batches()

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 40_000:
                yield from finish(False)
                rows = sum(h.num_rows for h in held)
        if held:
            yield from finish(True)

    return run


def _candidates(vectors: DataFrame, plan: Plan, k: int, least: float | None, ws: Workspace, every: bool) -> DataFrame:
    """(x, y): handles of visitors and residents worth an exact look, each once."""
    rows = _visits(vectors, plan).withColumn("ask", F.lit(True) if every else (~F.col("home") | F.col("bucket").isNull()))
    if not every:  # queries visit their own bucket by a row of their own
        rows = rows.unionByName(_visits(vectors.where("query"), Plan(plan.dims, plan.width, plan.projections, plan.tables, 1, plan.seed)).withColumn("home", F.lit(False)).withColumn("ask", F.lit(True)))
    # Buckets of more than BLOCK residents are split into blocks of residents; their visitors go to each block.
    own = F.pmod(F.xxhash64("handle"), F.col("blocks")).cast("int")
    crowded = _homes(vectors, plan).groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    crowded = ws.table(crowded, "crowded")
    if crowded.isEmpty():
        placed = rows.withColumn("salt", F.lit(0))
    else:
        met = rows.join(crowded, "bucket", "left")
        home_row = met.where("home").withColumn("salt", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(own))
        asking = met.where("ask").withColumn("salt", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        asking = asking.where("not home or (blocks is not null and salt != " + "pmod(xxhash64(handle), blocks))").withColumn("home", F.lit(False))
        placed = home_row.unionByName(asking).drop("blocks")
    placed = placed.select("bucket", "salt", "home", "ask", "handle", "code")
    placed = placed.repartition(tasks(vectors.sparkSession), "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("home").desc())
    return placed.mapInArrow(_compare(plan.dims, k, least, every), "x long, y long").distinct()


def cosine(a: str, b: str) -> Column:
    """Exact cosine of two arrays, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(F.col(a), F.col(b)) / (F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))))


def usable(col: str, dims: int) -> Column:
    """Not null, of that many numbers, all of them finite, and not all zero."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col) == dims) & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, k: int, dims: int, least_cosine: float | None = None, recall: float = 0.995, queries: Column | None = None, plan: Plan | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, neighbor_id, rank, cosine): the k most similar vectors of each vector, or of those for which ``queries`` holds.

    With ``least_cosine`` only neighbours at least that similar are given, and the index is made so that a
    pair of that cosine is found with probability ``recall``; without, so that ``recall`` of the k nearest are
    found, going by the exact neighbours of SAMPLED queries. Vectors that aren't
    usable have no row and are nobody's neighbour. Repeated rows of an id count once (of different vectors
    of one id, that of the smallest hash). Equal cosines are ranked by id. Vectors that are equal are
    indexed once and expanded at the end, at most k + 1 of each, which is all that k neighbours can show.
    """
    ws = Workspace(df.sparkSession)
    good = df.where(F.col(id_col).isNotNull() & usable(vector, dims)).select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v"), (queries if queries is not None else F.lit(True)).alias("query"))
    good = good.withColumn("h", F.struct(F.xxhash64("v").alias("handle"), F.hash("v").alias("check")))
    members = ws.table(good.groupBy("id").agg(F.min("h").alias("h"), F.bool_or("query").alias("query")), "members")
    held = members.groupBy("h").agg(F.bool_or("query").alias("query"))
    classes = ws.table(good.select("h", "v").dropDuplicates(["h"]).join(held, "h").select("h", F.col("h.handle").alias("handle"), "query", "v"), "classes")
    n = classes.count()
    if plan is None and least_cosine is not None:
        plan = make_plan(n, dims, least_cosine, recall, mutual=queries is None)
    elif plan is None:
        plan, _ = plan_for_queries(n, dims, sampled_cosines(classes, k, dims), recall)
    found = _candidates(classes.select("handle", "query", "v"), plan, k, least_cosine, ws, queries is None)
    if queries is None:
        found = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    left, right = classes.select(F.col("handle").alias("x"), F.col("h").alias("hx"), F.col("v").alias("vx"), "query"), classes.select(F.col("handle").alias("y"), F.col("h").alias("hy"), F.col("v").alias("vy"))
    pairs = found.join(left, "x").join(right, "y").withColumn("cosine", cosine("vx", "vy")).select("hx", "hy", "cosine")
    if least_cosine is not None:
        pairs = pairs.where(F.col("cosine") >= least_cosine)
    if queries is None:
        pairs = ws.table(pairs, "pairs")
        pairs = pairs.unionByName(pairs.select(F.col("hy").alias("hx"), F.col("hx").alias("hy"), "cosine"))
    top = Window.partitionBy("hx").orderBy(F.col("cosine").desc())  # equal cosines are told apart by id, below
    pairs = pairs.withColumn("r", F.rank().over(top)).where(F.col("r") <= k).drop("r")

    few = members.select("id", "h").withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("id").alias("neighbor_id"), F.col("h").alias("hy"))
    twins = members.groupBy("h").count().where("count > 1").select(F.col("h").alias("hx"), F.col("h").alias("hy"), F.lit(1.0).alias("cosine"))
    reach = pairs.unionByName(twins).join(few, "hy")
    asked = members.where("query").select("id", F.col("h").alias("hx"))
    rows = asked.join(reach, "hx").where("id != neighbor_id").select("id", "neighbor_id", "cosine")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbor_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbor_id", "rank", "cosine")
