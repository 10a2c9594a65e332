"""Dashboard questions over minute buckets; windows are closed on both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rounding import exact_sum, ratio, rounded


def within(buckets: DataFrame, since, until) -> DataFrame:
    """Buckets that start in [since, until]; of a table partitioned by day only those days are read."""
    if "day" in buckets.columns:
        buckets = buckets.where(F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    return buckets.where(F.col("bucket_start").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))


def overview(buckets: DataFrame, zones: DataFrame, since, until) -> DataFrame:
    """The headline row, one even without data: people, activity, postures, the busiest zone, the longest stay."""
    weight = F.greatest("sample_frames", F.lit(1))
    per_zone = within(buckets, since, until).groupBy("zone_id").agg(
        F.sum("unique_track_count").alias("people"), exact_sum(F.col("avg_activity_score") * weight).alias("score"), F.sum(weight).alias("weight"),
        *[F.sum(f"{p}_frames").alias(p) for p in ("sitting", "standing", "walking")],
        F.max("total_dwell_seconds").alias("dwell"), F.max("bucket_start").alias("last_seen"), F.sum("sample_frames").alias("samples"),
    )
    named = per_zone.join(zones.select("zone_id", "zone_name"), "zone_id", "left")
    peak = F.max_by(F.struct("zone_name", "people"), F.struct("people", "zone_id"))
    total = named.agg(
        F.count("*").alias("zones_active"), F.sum("people").alias("people"), F.sum("score").alias("score"), F.sum("weight").alias("weight"),
        *[F.sum(p).alias(p) for p in ("sitting", "standing", "walking")],
        peak.alias("peak"), F.max("dwell").alias("dwell"), F.max("last_seen").alias("last_seen"), F.sum("samples").alias("samples"),
    )
    posed = F.col("sitting") + F.col("standing") + F.col("walking")
    return total.select(
        (F.col("zones_active") > 0).alias("has_data"), F.coalesce("people", F.lit(0)).cast("long").alias("people"), "zones_active",
        ratio(F.col("score"), F.col("weight"), 1).alias("avg_activity"),
        *[ratio(100 * F.col(p), posed, 1).alias(f"{p}_pct") for p in ("sitting", "standing", "walking")],
        F.coalesce("peak.zone_name", F.lit("Unnamed zone")).alias("peak_zone_name"), F.col("peak.people").cast("long").alias("peak_zone_people"),
        rounded(F.col("dwell") / 60, 1).alias("longest_dwell_minutes"), "last_seen", F.coalesce("samples", F.lit(0)).cast("long").alias("sample_frames"),
    )


def trend(buckets: DataFrame, since, until, grain: str = "hour") -> DataFrame:
    """Activity, postures, people and mean occupancy by hour, or by day if ``grain`` is day."""
    weight = F.greatest("sample_frames", F.lit(1))
    return within(buckets, since, until).groupBy(F.date_trunc("day" if grain == "day" else "hour", "bucket_start").alias("bucket")).agg(
        ratio(exact_sum(F.col("avg_activity_score") * weight), F.sum(weight), 2).alias("avg_activity_score"),
        *[F.sum(f"{p}_frames").cast("long").alias(f"{p}_count") for p in ("sitting", "standing", "walking")],
        F.sum("unique_track_count").cast("long").alias("people"),
        ratio(exact_sum(F.col("occupancy_avg")), F.count("*"), 2).alias("avg_occupancy"),
    )


def zone_use(buckets: DataFrame, zones: DataFrame, since, until) -> DataFrame:
    """Time, visitors and occupancy of every zone with data."""
    found = within(buckets, since, until).groupBy("zone_id").agg(
        F.sum("total_dwell_seconds").cast("long").alias("seconds"), F.sum("unique_track_count").cast("long").alias("visitors"), F.max("occupancy_max").alias("peak_occupancy"),
        ratio(exact_sum(F.col("occupancy_avg")), F.count("*"), 2).alias("avg_occupancy"), F.count("*").alias("active_minutes"),
    )
    return found.join(zones.select("zone_id", "zone_name"), "zone_id", "left").select(
        "zone_id", F.coalesce("zone_name", F.lit("Unnamed zone")).alias("zone_name"), "seconds", rounded(F.col("seconds") / 60, 1).alias("minutes"), "visitors", "peak_occupancy", "avg_occupancy", "active_minutes"
    )


def coverage(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.min("bucket_start").alias("first_bucket"), F.max("bucket_start").alias("last_bucket"), F.count("*").alias("bucket_count"))
