"""Telemetry into minute buckets, and buckets into days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rounding import rounded
from . import tasks

KEY = ["org_id", "camera_id", "zone_id", "bucket_start"]
SETTLE_SECONDS = 120
SMALLINT = 32767
SAMPLE_SECONDS = 5


def closed_window(samples: DataFrame, now, hours: int = 24) -> DataFrame:
    """Samples of the closed minutes before ``now``: none of the last ``SETTLE_SECONDS``, none older than ``hours``."""
    edge = F.date_trunc("minute", F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(SETTLE_SECONDS)))
    return samples.where((F.col("ts") < edge) & (F.col("ts") >= edge - F.make_interval(hours=F.lit(hours))) & F.col("org_id").isNotNull())


def of_window(samples: DataFrame, since, until) -> DataFrame:
    """The samples of all buckets that start within [since, until]: a range of the time column, which prunes the scan."""
    minute = lambda x: F.date_trunc("minute", F.lit(x).cast("timestamp"))
    return samples.where((F.col("ts") >= minute(since)) & (F.col("ts") < minute(until) + F.expr("INTERVAL 1 MINUTE")))


def minute_buckets(samples: DataFrame) -> DataFrame:
    """One row per (org, camera, zone, minute).

    A tracked person counts once a second towards occupancy, over seconds that hold one;
    each one's stay is the whole seconds between first and last sample, 60 at most; the sum
    of stays is at most 60 times the highest occupancy. Rows without a track count as
    samples only, and rows without a score leave the mean alone (0 if there is none).
    """
    # the one shuffle, by bucket: it serves all groupings below, which hold the bucket's key
    rows = samples.where(F.col("ts").isNotNull()).withColumn("bucket_start", F.date_trunc("minute", "ts"))
    rows = tasks.dealt(rows, *KEY)
    fine = rows.groupBy(*KEY, F.second("ts").alias("s"), "track_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"),
        *[F.count_if(F.col("posture_state") == p).alias(p.lower()) for p in ("SITTING", "STANDING", "WALKING")],
        F.sum(F.least(F.greatest(F.col("activity_score"), F.lit(0.0)), F.lit(100.0)).cast("decimal(20,6)")).alias("score"), F.count("activity_score").alias("scored"),
    )
    seconds = fine.groupBy(*KEY, "s").agg(
        F.count("track_id").alias("people"), *[F.sum(c).alias(c) for c in ("n", "sitting", "standing", "walking", "score", "scored")]
    )
    totals = seconds.groupBy(*KEY).agg(
        F.max("people").alias("occupancy_max"),
        F.avg(F.when(F.col("people") > 0, F.col("people"))).alias("occ_avg"),
        F.min(F.when(F.col("people") > 0, F.col("people"))).alias("occ_min"),
        *[F.sum(c).alias(c) for c in ("n", "sitting", "standing", "walking", "score", "scored")],
    )
    tracks = fine.where(F.col("track_id").isNotNull()).groupBy(*KEY, "track_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    stay = F.least(F.floor((F.unix_micros("last") - F.unix_micros("first")) / 1_000_000), F.lit(60))
    stays = tracks.groupBy(*KEY).agg(F.sum(stay).alias("stay"), F.count("*").alias("people_total"))
    small = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(SMALLINT)).cast("int")
    return totals.join(stays, KEY, "left").select(
        *KEY,
        small(F.col("occupancy_max")).alias("occupancy_max"),
        rounded(F.coalesce("occ_avg", F.lit(0.0)), 4).alias("occupancy_avg"),
        small(F.col("occ_min")).alias("occupancy_min"),
        *[small(F.col(c)).alias(f"{c}_frames") for c in ("sitting", "standing", "walking")],
        small(F.col("n")).alias("sample_frames"),
        rounded(F.coalesce(F.col("score") / F.nullif(F.col("scored"), F.lit(0)), F.lit(0)), 2).alias("avg_activity_score"),
        F.least(F.coalesce("stay", F.lit(0)), 60 * F.greatest("occupancy_max", F.lit(1))).cast("int").alias("total_dwell_seconds"),
        small(F.col("people_total")).alias("unique_track_count"),
    )


def day_stats(buckets: DataFrame, tz: str = "UTC", workday_minutes: int = 540) -> DataFrame:
    """One row per (zone, local day): occupied minutes, their share of a workday, peak hour and people."""
    local = F.from_utc_timestamp("bucket_start", tz)
    hours = buckets.groupBy("zone_id", F.to_date(local).alias("stat_date"), F.hour(local).alias("hour")).agg(
        F.countDistinct(F.when(F.col("occupancy_max") > 0, F.col("bucket_start"))).alias("minutes"),
        F.max("occupancy_max").alias("peak"), F.sum("unique_track_count").alias("people"), F.sum("total_dwell_seconds").alias("dwell"), F.sum("sample_frames").alias("samples"),
    )
    return hours.groupBy("zone_id", "stat_date").agg(
        F.sum("minutes").cast("long").alias("occupied_minutes"),
        rounded(F.sum("minutes") * 100.0 / workday_minutes, 1).alias("occupied_pct"),
        F.max("peak").cast("int").alias("peak_occupancy"),
        F.max_by("hour", F.struct("people", -F.col("hour"))).cast("int").alias("peak_hour"),
        F.sum("people").cast("long").alias("people"), F.sum("dwell").cast("long").alias("dwell_seconds"), F.sum("samples").cast("long").alias("sample_frames"),
    )


def floor_heatmap(samples: DataFrame, grid: int = 20) -> DataFrame:
    """Samples per cell of a grid over the unit floor; x and y are cell centres. Off-plan positions do not count."""
    cell = lambda c: F.least(F.floor(F.col(c) * grid), F.lit(grid - 1))
    on = F.col("floor_x").between(0, 1) & F.col("floor_y").between(0, 1)
    centre = lambda c: rounded((F.col(c) + 0.5) / grid, 4)
    return samples.where(on).groupBy(cell("floor_x").alias("cx"), cell("floor_y").alias("cy")).agg(F.count("*").alias("value")).select(centre("cx").alias("x"), centre("cy").alias("y"), "value")
