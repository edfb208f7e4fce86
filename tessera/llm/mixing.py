"""Mixing sources to target weights, by balanced sampling with the cube method.

The size of the mix is the largest at which every source can hold its share without using any document more
often than allowed. Each document of a source is then used a whole number of times, and once more with a
probability; these probabilities are rounded to 0 and 1 by the cube method: they are moved along vectors
that change neither the expected tokens nor the expected number of documents of the source, until no more
than two documents are left undecided. Blocks of documents do so independently, the undecided of all blocks
meet in fewer blocks, and so on; only the last two of a source are landed by choice.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import Workspace

BLOCK = 20_000  #: Documents that one task rounds at a time.
SMALL_TARGETS = 10_000  #: Up to so many targets are broadcast.
_EDGE = 1e-9


def default_tokenizer() -> str:
    try:
        import public_tokenizers
    except ImportError as e:
        raise ValueError("pass the path of a tokenizer's ranks as tokenizer; the default one isn't on this machine") from e
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, keep: list[str], tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """(key, *keep, n_tokens): the tokens of each text, of the tokenizer in that file; 0 of a null text."""
    path = tokenizer or default_tokenizer()
    cols = docs.select(key, *keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    return cols.mapInArrow(run, f"{schema}, n_tokens long")


def fold_source(col: Column) -> Column:
    """One spelling: lower case, no white space around, one underscore for blanks, hyphens and underscores."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")
    return F.when(bare != "", bare)


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Move the chances to 0 or 1, keeping their sum and their size-weighted sum; at most two stay between."""
    p = list(chances)
    active: list[int] = []
    for new in range(len(p)):
        if not _EDGE < p[new] < 1 - _EDGE:
            continue
        active.append(new)
        while True:
            if len(active) == 3:
                a, b, c = active
                u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
                if u == (0, 0, 0):
                    u = (1.0, -1.0, 0.0)
            elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
                u = (1.0, -1.0)
            else:
                break
            up = min(((1 - p[k]) / d if d > 0 else -p[k] / d) for k, d in zip(active, u) if d)
            down = min((p[k] / d if d > 0 else (p[k] - 1) / d) for k, d in zip(active, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for k, d in zip(active, u):
                p[k] += step * d
                if p[k] < _EDGE:
                    p[k] = 0.0
                elif p[k] > 1 - _EDGE:
                    p[k] = 1.0
            active = [k for k in active if 0 < p[k] < 1]
    return p


def land(sizes: list[float], chances: list[float]) -> list[float]:
    """Decide the last ones so that tokens, then documents, are missed by least."""
    open_ = [k for k, p in enumerate(chances) if 0 < p < 1]
    want, many = sum(sizes[k] * chances[k] for k in open_), sum(chances[k] for k in open_)

    def missed(bits: int) -> tuple[float, float, int]:
        chosen = [k for i, k in enumerate(open_) if bits >> i & 1]
        return abs(sum(sizes[k] for k in chosen) - want), abs(len(chosen) - many), bits

    best = min(range(1 << len(open_)), key=missed)
    out = list(chances)
    for i, k in enumerate(open_):
        out[k] = float(best >> i & 1)
    # One exchange of a chosen document for one that isn't closes what gap is left.
    gap = want - sum(sizes[k] for k in open_ if out[k])
    ins = np.array([k for k, p in enumerate(out) if p == 0], dtype=np.int64)
    outs = np.array([k for k, p in enumerate(out) if p == 1], dtype=np.int64)
    if gap and len(ins) and len(outs):
        held = np.asarray(sizes)
        outs = outs[np.argsort(held[outs], kind="stable")]
        at = np.searchsorted(held[outs], held[ins] - gap)
        tries = [(abs(gap - held[ins] + held[outs[np.clip(at + d, 0, len(outs) - 1)]]), np.clip(at + d, 0, len(outs) - 1)) for d in (-1, 0)]
        rest, which = min(((float(r[k]), (int(ins[k]), int(outs[w[k]]))) for r, w in tries for k in [int(np.argmin(r))]), key=lambda x: x[0])
        if rest < abs(gap):
            out[which[0]], out[which[1]] = 1.0, 0.0
    return out


def _round_blocks(seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix", "key"])
        rng = random.Random(f"{seed}/{rows.source.iloc[0]}/{rows.block.iloc[0]}/{last}")
        sizes = rows.n_tokens.astype(float).tolist()
        p = flight(sizes, rows.p.tolist(), rng)
        return rows.assign(p=land(sizes, p) if last else p)

    return run


def plan_sources(counted: DataFrame, targets: DataFrame, size: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, uses): how often a document is used on average.

    ``size`` is the mix's tokens; by default, and at most, what all sources with documents can fill. Sources
    of no share, or without tokens, aren't used; the shares of the others are then relative to each other.
    """
    held = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    goals = targets.select(fold_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = goals.join(held, "source", "left").na.fill({"n_docs": 0, "n_tokens": 0})
    usable = both.where("n_tokens > 0 and target_share > 0 and max_repeats > 0")
    whole, reach = usable.agg(F.sum("target_share"), F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share"))).first()
    total = min(size, reach * whole) if size is not None and reach is not None else (reach or 0.0) * (whole or 0.0)
    uses = F.when((F.col("n_tokens") > 0) & (F.col("target_share") > 0), F.least(F.col("max_repeats").cast("double"), F.lit(total) * F.col("target_share") / F.lit(whole or 1.0) / F.col("n_tokens"))).otherwise(0.0)
    return both.withColumn("uses", uses)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", tokenizer: str | None = None, size: float | None = None, seed: int = 42, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The selection (key, source, n_tokens, repeats) and the report per source of targets.

    Documents of null text, of no token, or of a source without target aren't selected. Of repeated rows of a
    key one counts. The same seed gives the same selection, however the input is partitioned.
    """
    ws = Workspace(docs.sparkSession)
    counted = token_counts(docs.where(f"{key} is not null").withColumn("__source", fold_source(F.col("source"))), key, ["__source"], tokenizer)
    one = counted.where("n_tokens > 0 and __source is not null").groupBy(F.col(key).alias("key")).agg(F.max(F.struct("n_tokens", "__source")).alias("m"))
    counted = ws.table(one.select("key", F.col("m.__source").alias("source"), F.col("m.n_tokens").alias("n_tokens")), "counted")
    plan = ws.table(plan_sources(counted, targets, size), "plan")
    small = plan.count() <= SMALL_TARGETS
    goals = plan.where("uses > 0").select("source", "uses", F.col("n_docs").alias("__n"))
    rows = counted.join(F.broadcast(goals) if small else goals, "source")
    # Averages within a rounding error of a whole number are that number.
    near = F.round("uses")
    whole = F.when(F.abs(F.col("uses") - near) < _EDGE, near).otherwise(F.floor("uses")).cast("int")
    rows = rows.withColumn("base", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("uses") - F.col("base"))).withColumn("mix", F.xxhash64("key", F.lit(seed)))
    cols = ["key", "source", "n_tokens", "base", "p", "mix"]
    decided, pending = [rows.where(f"p <= {_EDGE}").select(*cols)], rows.where(f"p > {_EDGE}").select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pending.schema) + ", block long"
    while True:
        many = pending.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks"))
        most = many.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        last = most <= 1
        placed = pending.join(F.broadcast(many) if small else many, "source").withColumn("block", F.pmod("mix", F.col("blocks"))).select(*cols, "block")
        done = ws.table(placed.groupBy("source", "block").applyInPandas(_round_blocks(seed, last), schema).select(*cols), "rounded")
        decided.append(done.where("p = 0 or p = 1"))
        if last:
            break
        pending = done.where("p > 0 and p < 1").withColumn("mix", F.xxhash64("mix"))
    chosen = reduce(DataFrame.unionByName, decided).withColumn("repeats", F.col("base") + F.col("p").cast("int")).where("repeats > 0")
    chosen = ws.table(chosen.select("key", "source", "n_tokens", "repeats"), "chosen")
    used = chosen.groupBy("source").agg(F.count("*").alias("used_docs"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    total = used.agg(F.sum("used_tokens")).first()[0] or 0
    report = plan.join(used, "source", "left").na.fill({"used_docs": 0, "most_repeats": 0, "used_tokens": 0})
    share = F.col("used_tokens") / F.lit(float(total)) if total else F.lit(0.0)
    report = report.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "used_docs", "most_repeats", "used_tokens", share.alias("share"), (share - F.col("target_share")).alias("deviation"))
    return chosen.withColumnRenamed("key", key), report
