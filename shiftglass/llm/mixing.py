"""Mixing sources to target weights by balanced (cube) sampling.

Every source gets a target number of words; a document of that source is taken
target / source size times on average. The whole part of that number is certain, the
fraction is an inclusion probability. The cube method's flight phase moves the
probabilities of small chunks of documents along vectors that keep both the expected
number of documents and of words, until at most two per chunk are undecided; those of many
chunks meet in the next level. In the last flight of a source some documents of all sizes
but the largest are left open, a small landing problem: of all ways to round them the one is
taken by which the source's words come nearest to the target. A document too large for
those to outweigh is then met by turning a few decided ones over.
"""

from __future__ import annotations

import itertools
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, Scratch

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
CAP = 2
CHUNK = 4096
FAN_IN = 1024
OPEN = 12
TURNS = 32


def word_count(text: str = "text"):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> dict[str | None, Fraction]:
    """Words to take of each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share``
    of all sizes; no target exceeds ``cap`` times its source, the excess is shared anew by
    weight. A source without words gets 0.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > cap * sizes[s] * total]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: Fraction(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = 0) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for two at most, and ``leave`` units of all sizes but the largest that don't take part.

    Three undecided units at a time move along a vector that is orthogonal to (1, 1, 1) and
    to their sizes, in either direction so that expectations stay, until one is decided.
    """
    p, eps = p.tolist(), 1e-9
    undecided = [i for i, x in enumerate(p) if eps < x < 1 - eps]
    sizes, draws, held = size.tolist(), iter(rng.random(len(p) + 8).tolist()), []
    by_size = sorted(undecided, key=lambda i: (sizes[i], i))
    lower = by_size[: -(-9 * len(by_size) // 10)]
    left = {lower[int(x)] for x in np.linspace(0, len(lower) - 1, min(leave, len(lower)))}
    todo = iter([i for i in undecided if i not in left])
    while True:
        while len(held) < 3 and (i := next(todo, None)) is not None:
            held.append(i)
        same = next(((a, b) for a, b in itertools.combinations(held, 2) if sizes[a] == sizes[b]), None)
        if same:
            step = {same[0]: 1.0, same[1]: -1.0}
        elif len(held) == 3:
            a, b, c = held
            step = {a: float(sizes[c] - sizes[b]), b: float(sizes[a] - sizes[c]), c: float(sizes[b] - sizes[a])}
        else:
            break
        up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in step.items())
        down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in step.items())
        move = up if next(draws) * (up + down) < down else -down
        for i, u in step.items():
            p[i] = min(1.0, max(0.0, p[i] + move * u))
            if p[i] < eps or p[i] > 1 - eps:
                p[i] = float(round(p[i]))
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray, want: float, free: np.ndarray) -> np.ndarray:
    """The last undecided units, rounded so that their words come nearest to ``want``; of equal ways the likeliest.

    While that leaves an error, the unit is turned over (if it is ``free``, not certain)
    that lessens it most.
    """
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    ways = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    chance = ways @ np.log(p[open_]) + (1 - ways) @ np.log1p(-p[open_])
    best = ways[np.lexsort((np.arange(len(ways)), -chance, np.abs(ways @ size[open_].astype(np.float64) - want)))[0]]
    out = np.round(p)
    out[open_] = best
    off = float(np.dot(best, size[open_])) - want
    for _ in range(TURNS):
        after = np.where(free, np.abs(off + np.where(out == 0, size, -size)), np.inf)
        if abs(off) < 1 or not len(after) or after.min() >= abs(off):
            break
        i = int(after.argmin())
        off += float(size[i] if out[i] == 0 else -size[i])
        out[i] = 1 - out[i]
    return out


def mix(docs: DataFrame, size: str = "size", source: str = "source", weights=WEIGHTS, share: Fraction = SHARE, cap: int = CAP, seed: int = 1, broadcast_sources: int = 100_000) -> DataFrame:
    """``docs`` with source_size, target, copies (times the mix takes the row) and taken.

    Rows without words are never taken; a row is taken ``cap`` times at most. Equal rows are
    separate documents. Reruns agree: the order within a chunk and the random stream
    depend on the rows alone. Columns of these names in ``docs`` are replaced. An empty
    table gives an empty table. Sources' facts (some 50 bytes each) are broadcast up to
    ``broadcast_sources`` of them, joined otherwise.
    """
    docs = docs.drop("source_size", "target", "copies", "taken")
    spark = docs.sparkSession
    rows = docs.groupBy(source).agg(F.sum(size).alias("s"), F.count("*").alias("n")).collect()  # a row a source
    sizes = {r[0]: r["s"] or 0 for r in rows}
    goal = targets(sizes, weights, share, cap)
    facts = spark.createDataFrame(
        [(r[0], sizes[r[0]], float(goal[r[0]]), float(goal[r[0]] / sizes[r[0]]) if sizes[r[0]] else 0.0, -(-r["n"] // CHUNK)) for r in rows],
        "__source string, source_size long, target double, __rate double, __chunks long",
    )
    keyed = (
        docs.join(F.broadcast(facts) if len(rows) <= broadcast_sources else facts, F.col(source).eqNullSafe(F.col("__source")))
        .withColumn("__order", F.xxhash64(*[F.col(c) for c in docs.columns]))
        .withColumn("__base", F.when(F.col(size) > 0, F.floor("__rate")).otherwise(0).cast("long"))
        .withColumn("__p", F.when(F.col(size) > 0, F.col("__rate") - F.floor("__rate")).otherwise(0.0))
        .withColumn("__bucket", F.pmod("__order", "__chunks"))
        .drop("__rate", "__chunks")
    )
    schema = keyed.schema

    def fly(last: bool):
        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            order = np.lexsort((group.column("__p").to_numpy(), group.column("__order").to_numpy()))
            group = group.take(pa.array(order))
            p, s = group.column("__p").to_numpy(), group.column(size).to_numpy()
            tag = f"{seed}|{key[0].as_py()}|{key[1].as_py()}|{len(p)}".encode()
            q = flight(p, s, np.random.Generator(np.random.PCG64(zlib.crc32(tag))), OPEN if last else 0)
            if last:
                undecided = (q > 0) & (q < 1)
                q = land(q, s, float(np.dot(q[undecided], s[undecided])), (p > 0) & (p < 1))
            return group.set_column(group.schema.get_field_index("__p"), "__p", pa.array(q))

        return run

    chunks, done = max([1, *(-(-r["n"] // CHUNK) for r in rows)]), None
    while True:
        last = chunks == 1
        flown = keyed.groupBy("__source", "__bucket").applyInArrow(fly(last), schema)
        if last:
            done = flown if done is None else done.unionByName(flown)
            break
        chunks = -(-chunks // FAN_IN)
        undecided = (F.col("__p") > 0) & (F.col("__p") < 1)
        flown = Scratch(spark, "mix").keep(flown)
        part = flown.where(~undecided)
        done = part if done is None else done.unionByName(part)
        keyed = flown.where(undecided).withColumn("__bucket", F.floor(F.col("__bucket") / FAN_IN))
    copies = (F.col("__base") + F.round("__p").cast("long")).alias("copies")
    return done.select(*docs.columns, "source_size", "target", copies, (F.col(size) * copies).alias("taken"))
