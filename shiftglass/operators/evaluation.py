"""Scoring of detectors and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rounding import ratio, rounded
from ..sources.sinks import kept_table


def wilson_upper(k: Column, n: Column, z: float = 1.96) -> Column:
    """Upper end of the Wilson interval; the rule of three where nothing was found."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    wide = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(k == 0, F.least(F.lit(1.0), 3 / n)).otherwise((p + z * z / (2 * n) + wide) / (1 + z * z / n))


def outcomes(rows: DataFrame) -> DataFrame:
    """Of rows (truth, verdict; null abstains): errors of either kind, coverage and error rate."""
    t, v = F.col("truth"), F.col("verdict")
    n = rows.agg(
        F.count("*").alias("n"), F.count_if(t & ~v).alias("missed"), F.count_if(~t & v).alias("false_alarms"), F.count_if(v.isNull()).alias("abstained"), F.count_if(t).alias("positives"), F.count_if(~t).alias("negatives"), F.count_if(t & v).alias("hits")
    )
    wrong, decided = F.col("missed") + F.col("false_alarms"), F.col("n") - F.col("abstained")
    return n.select("*", ratio(decided, F.col("n"), 4).alias("coverage"), ratio(wrong, decided, 4).alias("error_rate"), rounded(wilson_upper(wrong, decided), 6).alias("error_upper"))


def precision_recall(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of score >= threshold by class."""
    at = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    n = rows.select("cls", "truth", "score", at).groupBy("cls", "threshold").agg(F.count_if(F.col("truth") & (F.col("score") >= F.col("threshold"))).alias("tp"), F.count_if(~F.col("truth") & (F.col("score") >= F.col("threshold"))).alias("fp"), F.count_if(F.col("truth") & (F.col("score") < F.col("threshold"))).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("*", ratio(tp, tp + fp, 4).alias("precision"), ratio(tp, tp + fn, 4).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 4).alias("f1"))


def sweep(segments: DataFrame, needs: list[int], presents: list[float], absents: list[float]) -> DataFrame:
    """Errors and coverage of the evidence rule for every combination of parameters, in one pass."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("need"), F.lit(p).alias("present"), F.lit(a).alias("absent")) for n in needs for p in presents for a in absents]))
    rows = segments.select("truth", "n", "seen", "empty", grid.alias("g")).select("truth", "g.*", F.when(F.col("n") < F.col("g.need"), None).when(F.col("seen") >= F.col("g.present"), True).when(F.col("empty") >= F.col("g.absent"), False).alias("verdict"))
    n = rows.groupBy("need", "present", "absent").agg(F.count("*").alias("segments"), F.count("verdict").alias("decided"), F.count_if(F.col("verdict") != F.col("truth")).alias("wrong"))
    return n.select("*", ratio(F.col("decided"), F.col("segments"), 4).alias("coverage"), ratio(F.col("wrong"), F.col("decided"), 4).alias("error_rate"))


def contingency(rows: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Readings by truth under each condition (a row counts under all that hold)."""
    holds = F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in conditions.items()]))).alias("condition")
    return rows.select("truth", "reading", holds).groupBy("condition", "truth").pivot("reading", ["PRESENT", "ABSENT", "UNVERIFIABLE"]).agg(F.count(F.lit(1))).na.fill(0)


def nearest(queries: DataFrame, store: DataFrame, block: int = 1024, store_block: int = 65_536) -> DataFrame:
    """Smallest Hamming distance of each query's 64-bit hash or its mirror image to any row of ``store`` but its own.

    Both sides are dealt into numbered blocks of bounded size; a pair of blocks is joined at a time,
    in a task of its own. Distance and place in the block (by id) are one number, so that the
    pairs are folded into a map of a query's blocks and never sorted.
    """
    n, m = (max(1, -(-rows.count() // size)) for rows, size in ((queries, block), (store, store_block)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = queries.withColumn("qb", F.pmod(F.xxhash64("q_id"), F.lit(n)).cast("int")).withColumn("sb", every(m))
    block_of = store.withColumn("sb", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))
    placed = kept_table(block_of.withColumn("place", F.row_number().over(Window.partitionBy("sb").orderBy("id")).cast("long")))
    against = placed.select("id", "hash", "sb", "place").withColumn("qb", every(n)).repartition(n * m, "qb", "sb")
    pairs = against.join(dealt.repartition(n * m, "qb", "sb").hint("shuffle_hash"), ["qb", "sb"]).where("id <> q_id")
    d = F.least(F.bit_count(F.col("hash").bitwiseXOR(F.col("q_hash"))), F.bit_count(F.col("hash").bitwiseXOR(F.col("q_mirror"))))
    best = pairs.groupBy("q_id", "sb").agg(F.min(F.shiftleft(d.cast("long"), 32) + F.col("place")).alias("best"))
    found = best.select("q_id", "sb", F.shiftright("best", 32).alias("d"), F.col("best").bitwiseAND((1 << 32) - 1).alias("place")).join(placed.select("sb", "place", "id"), ["sb", "place"])
    return found.groupBy("q_id").agg(F.min(F.struct("d", "id")).alias("m")).select("q_id", F.col("m.d").cast("int").alias("distance"), F.col("m.id").alias("nearest_id"))


def near_summary(found: DataFrame) -> DataFrame:
    d = F.col("distance")
    return found.agg(F.count("*").alias("n"), F.count_if(d <= 0).alias("identical"), F.count_if(d <= 6).alias("near"), F.count_if(d <= 10).alias("close"), F.median(d).alias("median"))


def timing(errors: DataFrame, by: str) -> DataFrame:
    """Count, mean size, largest size and mean of timing errors."""
    e = F.col("error")
    return errors.groupBy(by).agg(F.count("*").alias("n"), rounded(F.avg(F.abs(e)), 4).alias("mean_abs"), rounded(F.max(F.abs(e)), 4).alias("max_abs"), rounded(F.avg(e), 4).alias("mean"))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile: the element at floor(0.95 (n - 1)) of the sorted values."""
    n = samples.groupBy(by, value).agg(F.count(value).alias("__n"))
    up_to = F.sum("__n").over(Window.partitionBy(by).orderBy(F.col(value).asc_nulls_first()))
    total = F.sum("__n").over(Window.partitionBy(by))
    at = n.withColumn("__up", up_to).withColumn("__all", total)
    p95 = at.where(F.col("__up") > F.floor(0.95 * (F.col("__all") - 1))).where(F.col("__n") > 0).groupBy(F.col(by).alias("__by")).agg(F.min(value).alias("p95"))
    means = samples.groupBy(by).agg(rounded(F.avg(value), 3).alias("mean"))
    return means.join(p95, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
