"""Streams of telemetry: exact minute buckets, what comes late, idempotent events, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rounding import rounded
from ..operators.buckets import KEY, SETTLE_SECONDS, SMALLINT, minute_buckets
from ..sources import sinks

POSTURES = ("SITTING", "STANDING", "WALKING")
PLACE = KEY[:-1]


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + F.coalesce(value(r), F.lit(0)).cast("long"))


def minute_stream(samples: DataFrame, settle_s: int = SETTLE_SECONDS) -> DataFrame:
    """The rows of ``minute_buckets``, each once, when its minute has been over for ``settle_s`` of the stream's time.

    Two stateful aggregations under one watermark: tracks within a second, and these within a
    minute. The state of a second is a row per person in it, that of a minute what its
    seconds were put together to; both go when the minute is told. All measures are exact: a
    minute's list holds one entry per person and second of one zone, which the measures
    are read from.
    """
    timed = samples.where(F.col("ts").isNotNull()).withWatermark("ts", f"{settle_s} seconds")
    score = F.least(F.greatest(F.col("activity_score"), F.lit(0.0)), F.lit(100.0)).cast("decimal(20,6)")
    fine = timed.groupBy(F.window("ts", "1 second").alias("w"), *PLACE, "track_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), *[F.count_if(F.col("posture_state") == p).alias(p.lower()) for p in POSTURES],
        F.sum(score).alias("score"), F.count("activity_score").alias("scored"),
    )
    entry = F.struct(F.second("w.start").alias("s"), F.col("track_id").cast("string").alias("track"), F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))
    sums = [F.sum(c).alias(c) for c in ("n", *map(str.lower, POSTURES), "score", "scored")]
    minutes = fine.groupBy(F.window(F.window_time("w"), "1 minute").alias("m"), *PLACE).agg(F.collect_list(entry).alias("rows"), *sums)
    rows = F.filter("rows", lambda r: r["track"].isNotNull())
    people = F.filter(F.transform(F.array_distinct(F.transform("rows", lambda r: r["s"])), lambda s: F.size(F.filter(rows, lambda r: r["s"] == s))), lambda n: n > 0)
    tracks = F.array_distinct(F.transform(rows, lambda r: r["track"]))
    span = lambda k: F.filter(rows, lambda r: r["track"] == k)
    stays = F.transform(tracks, lambda k: F.least(F.floor((F.array_max(F.transform(span(k), lambda r: r["last"])) - F.array_min(F.transform(span(k), lambda r: r["first"]))) / 1_000_000), F.lit(60)))
    told = minutes.withColumn("people", people).withColumn("stays", stays)
    small = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(SMALLINT)).cast("int")
    highest = F.coalesce(F.array_max("people"), F.lit(0))
    mean = _total(F.col("people"), lambda n: n) / F.nullif(F.size("people"), F.lit(0))
    return told.select(
        *PLACE, F.col("m.start").alias("bucket_start"), small(highest).alias("occupancy_max"), rounded(F.coalesce(mean, F.lit(0.0)), 4).alias("occupancy_avg"), small(F.array_min("people")).alias("occupancy_min"),
        *[small(F.col(p.lower())).alias(f"{p.lower()}_frames") for p in POSTURES], small(F.col("n")).alias("sample_frames"),
        rounded(F.coalesce(F.col("score") / F.nullif(F.col("scored"), F.lit(0)), F.lit(0)), 2).alias("avg_activity_score"),
        F.least(_total(F.col("stays"), lambda x: x), 60 * F.greatest(highest, F.lit(1))).cast("int").alias("total_dwell_seconds"), small(F.size("stays")).alias("unique_track_count"),
    )


def keep_minutes(samples: DataFrame, table: str, checkpoint: str):
    """A query that appends the minutes of a stream to the day-partitioned bucket table, as they close."""
    days = minute_stream(samples).withColumn("day", F.to_date("bucket_start"))
    return days.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")


def late_minutes(raw: DataFrame, told: DataFrame, late: DataFrame) -> DataFrame:
    """The minutes of late rows anew: all rows of a minute that was told before some of them came.

    ``raw``: every row ever landed, ``told``: the bucket table, ``late``: the rows landed
    since the last repair. A minute is told again only if it holds other numbers now; the
    result is what ``sinks.merge_buckets`` puts in its place.
    """
    minute = F.date_trunc("minute", "ts").alias("bucket_start")
    touched = late.where(F.col("ts").isNotNull()).select(*PLACE, minute).distinct()
    closed = told.agg(F.max("bucket_start").alias("until"))
    again = touched.join(F.broadcast(closed), F.col("bucket_start") <= F.col("until")).drop("until")  # one row
    rows = raw.withColumn("bucket_start", F.date_trunc("minute", "ts")).join(again, KEY, "left_semi").drop("bucket_start")
    anew = minute_buckets(rows)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in anew.columns]
    return anew.alias("n").join(told.alias("o"), same, "left_anti")


def land(samples: DataFrame, raw: str, checkpoint: str):
    """A query that lands a stream's rows as they are, with the micro-batch they came in, for repairs."""

    def batch(df: DataFrame, epoch: int) -> None:
        # a batch that is run again replaces its own rows
        df.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(raw)

    return samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def repair(spark: SparkSession, raw: str, table: str, since: int, target: str) -> DataFrame:
    """The bucket table with minutes set right for the rows that were landed after batch ``since``; written to ``target``."""
    landed, told = spark.read.parquet(raw), spark.read.parquet(table)
    changes = late_minutes(landed.drop("batch"), told.drop("day"), landed.where(F.col("batch") > since).drop("batch"))
    merged = sinks.merge_buckets(told.drop("day"), changes)
    merged.withColumn("day", F.to_date("bucket_start")).repartition("day").write.partitionBy("day").parquet(target)
    return spark.read.parquet(target)


def once(events: DataFrame, key: str = "id", delay: str = "10 minutes") -> DataFrame:
    """Each event once, repeats within the delay dropped."""
    return events.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark([key])


def sessions(samples: DataFrame, gap: str = "8 seconds") -> DataFrame:
    """Presence sessions of a track, ended by a gap."""
    return samples.withWatermark("ts", "2 minutes").groupBy(F.session_window("ts", gap), "track_id").agg(F.count("*").alias("samples")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "track_id", "samples")
