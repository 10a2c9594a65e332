"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are dealt into groups of bounded size; each cell of the grid (query
group x candidate group) is one small matrix product. Round after round every cell counts
its scores within each query's current interval in a fixed number of bins; the counts of
all cells, added up per query, tell the bin of the kth best score, which is the next
interval. When the interval is one score, that is the kth value: a last pass keeps what
scores more, and of equal scores the smallest ids. The candidates' cells are written once,
bucketed by cell; a round moves the queries and their intervals only.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

QUERY_GROUP = 1 << 19  # components
CANDIDATE_GROUP = 1 << 20
BINS = 512
SLICE = 1 << 21
LARGEST = 1 << 53  # a component's bound
BOUND = (1 << 62) - 1  # a score's
LOWEST = np.iinfo(np.int64).min


def quantise(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id and v = floor(scale * x) per component, x as double, held between -2**53 and 2**53.

    Rows with a null or empty vector or a null, infinite or NaN component are left out; all
    others stay, those of repeated and null ids too.
    """
    x = F.col(vector)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    return vectors.where(good).select(F.col(id_).cast("long").alias("id"), whole.alias("v"))


def matrix(t: pa.Table) -> np.ndarray:
    """The vectors as rows of doubles, exact while inner products stay below 2**53."""
    v = t.column("v").combine_chunks()
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    if len(m) and float(np.abs(m).max()) ** 2 * m.shape[1] >= 2**53:
        return m.astype(object)
    return m.astype(np.float64)


def scores(q: pa.Table, c: pa.Table):
    """Blocks (query slice, scores as int64, a row's with itself the lowest number).

    Scores of huge components are added up as whole numbers and held within ``BOUND``.
    """
    a, b, rows = matrix(q), matrix(c), c.column("row").to_numpy()
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    step = max(1, SLICE // max(1, len(b)))
    for i in range(0, len(a), step):
        s = a[i : i + step] @ b.T
        s = (np.minimum(np.maximum(s, -BOUND), BOUND) if s.dtype == object else s).astype(np.int64)
        s[q.column("row").to_numpy()[i : i + step, None] == rows[None]] = LOWEST
        yield slice(i, i + step), s


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best candidates of every query.

    ``vectors`` has id and v (see ``quantise``); ``is_query`` is a condition on it. Every row
    but the query's own is a candidate, if its vector is as long; of rows that share an id
    each is one, and each query among them gets its own ``k`` rows. Equal scores go to the
    smaller id, a null id last. No vectors: no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    every = scratch.keep(vectors.select("id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")))
    reach = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stats = every.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(reach).alias("top"), F.max("dim").alias("dim")).first()
    if not stats["n"] or not stats["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_groups = -(-stats["q"] * stats["dim"] // QUERY_GROUP)
    c_groups = -(-stats["n"] * stats["dim"] // CANDIDATE_GROUP)
    every_q, every_c = F.sequence(F.lit(0), F.lit(q_groups - 1)), F.sequence(F.lit(0), F.lit(c_groups - 1))
    dealt = every.select("id", "row", "v", "dim", F.explode(every_q).alias("qg"), F.pmod(F.xxhash64("row"), F.lit(c_groups)).cast("int").alias("cg"))
    name, path, buckets = f"topk_{uuid.uuid4().hex}", f"{scratch.root}/cells", min(q_groups * c_groups, 1 << 14)
    cell = ["dim", "qg", "cg"]
    dealt.repartition(buckets, *cell).write.option("compression", "zstd").option("path", path).bucketBy(buckets, *cell).saveAsTable(name)
    candidates = spark.table(name)
    bound = min(int(stats["top"]) + 1, BOUND)
    # lo and hi: the interval of scores still in doubt; above: how many scores exceed it
    own = F.pmod(F.xxhash64("row"), F.lit(q_groups)).cast("int").alias("qg")
    state = every.where(is_query).select("id", "row", "v", "dim", own, F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"), F.lit(0).cast("long").alias("above"))
    width = 2 * bound + 1

    def cells(queries: DataFrame, run, schema: str) -> DataFrame:
        return queries.withColumn("cg", F.explode(every_c)).groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(run, schema)

    def count(q: pa.Table, c: pa.Table) -> pa.Table:
        rows, bins, n = [], [], []
        if len(q) and len(c):
            lo, hi = q.column("lo").to_numpy(), q.column("hi").to_numpy()
            step = (hi - lo) // BINS + 1
            for part, s in scores(q, c):
                ok = (s >= lo[part, None]) & (s <= hi[part, None])
                at = np.where(ok, s - lo[part, None], 0) // step[part, None]
                hits = np.bincount((np.arange(len(s))[:, None] * BINS + at)[ok], minlength=len(s) * BINS)
                found = np.flatnonzero(hits)
                rows.append(q.column("row").to_numpy()[part][found // BINS])
                bins.append(found % BINS)
                n.append(hits[found])
        flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return pa.table({"row": flat(rows), "bin": flat(bins), "n": flat(n)})

    while width > 1:
        counts = cells(state, count, "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        hist = counts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("b"), "n"))).alias("h"))
        # from the highest bin down: the first one at which k scores are reached, else the lowest
        walked = F.aggregate(
            "h",
            F.struct(F.col("above").alias("above"), F.lit(-1).cast("long").alias("bin")),
            lambda s, x: F.when((s["bin"] < 0) & (s["above"] + x["n"] >= k), F.struct(s["above"].alias("above"), (-x["b"]).alias("bin"))).when(s["bin"] >= 0, s).otherwise(F.struct((s["above"] + x["n"]).alias("above"), s["bin"].alias("bin"))),
        )
        step = F.expr(f"(hi - lo) div {BINS} + 1")
        low = F.col("lo") + F.col("w.bin") * step
        found = F.col("w.bin") >= 0
        state = scratch.keep(
            state.join(hist, "row", "left")
            .withColumn("w", F.when(F.col("h").isNotNull(), walked))
            .select(
                "id", "row", "v", "dim", "qg",
                F.when(found, low).otherwise(F.col("lo")).alias("lo"),
                F.when(found, F.col("lo") + F.least(F.col("hi") - F.col("lo"), F.col("w.bin") * step + (step - 1))).otherwise(F.col("lo")).alias("hi"),
                F.when(found, F.col("w.above")).otherwise(F.col("above")).alias("above"),
            )
        )
        width = -(-width // BINS) if width > BINS else 1

    def keep(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(q) and len(c):
            lo, ids = q.column("lo").to_numpy(), c.column("id")
            null, at = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            for part, s in scores(q, c):
                r, col = np.nonzero((s >= lo[part, None]) & (s > LOWEST))
                order = np.lexsort((at[col], null[col], -s[r, col], r))
                r, col = r[order], col[order]
                ok = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, col = r[ok], col[ok]
                for x, y in zip(out, (q.column("row").to_numpy()[part][r], q.column("id").to_numpy()[part][r], col, s[r, col])):
                    x.append(y)
        row, qid, col, score = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"row": row, "query_id": qid, "vec_id": c.column("id").take(pa.array(col)), "score": score})

    best = cells(state, keep, "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = scratch.keep(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    spark.sql(f"DROP TABLE {name}")
    candidates.path = path
    scratch.drop(candidates)
    return found
