"""Buckets, days, heatmap and dashboards on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import buckets, dashboards
from ..sources import domain, sinks
from ..streaming import sync

SINCE, UNTIL, NOW = "2024-01-03 00:00:00", "2024-01-20 00:00:00", "2024-01-15 12:34:56"


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    return buckets.minute_buckets(domain.telemetry(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The table of minute buckets that dashboards read."""
    return sinks.stored_buckets(spark, f"{d}/events.parquet", lambda: _buckets(spark, d))


def _late(spark: SparkSession, d: str) -> DataFrame:
    """Buckets that come again with more samples, and some of an hour later that are new."""
    again = _buckets(spark, d).where("sample_frames >= 1 AND minute(bucket_start) % 10 = 3").withColumn("sample_frames", F.col("sample_frames") + 5)
    return again.unionByName(again.where("minute(bucket_start) = 13").withColumn("bucket_start", F.expr("bucket_start + INTERVAL 100 DAYS")))


def _zone_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the zones that have buckets; one zone has none."""
    return _stored(spark, d).select("zone_id").distinct().where("zone_id <> 'error'").withColumn("zone_name", F.initcap("zone_id"))


SYNCED = "2024-02-01 00:00:00"


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    """The local bucket table: organisations with ids of the target's shape, two of three minutes sent; then late changes, and some rows again as they were."""
    org = F.concat(F.lit("00000000-0000-0000-0000-00000000000"), F.substring("org_id", -1, 1))
    now = _buckets(spark, d).withColumn("org_id", F.when(F.col("zone_id") == "error", F.col("org_id")).otherwise(org))
    table = now.withColumn("version", F.lit(1).cast("long")).withColumn("synced_at", F.when(F.minute("bucket_start") % 3 > 0, F.lit(SYNCED).cast("timestamp")))
    late = now.where("minute(bucket_start) % 10 = 3")
    changes = late.withColumn("sample_frames", F.col("sample_frames") + F.when(F.col("sample_frames") % 2 == 0, 5).otherwise(0)).unionByName(late.where("minute(bucket_start) = 13").withColumn("bucket_start", F.expr("bucket_start + INTERVAL 100 DAYS")))
    return sync.upserted(table, changes)


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    """What was unsynced has been sent, but for one camera's rows; some changed in between."""
    table = _versioned(spark, d)
    sent = sync.unsynced(table).where("camera_id <> 'cam-1'").withColumn("version", F.col("version") - F.when(F.col("unique_track_count") % 5 == 0, 1).otherwise(0))
    return sync.stamped(table, sent, "2024-03-01 00:00:00")


NAMES_SQL = "zone_names AS (SELECT DISTINCT event_type AS zone_id, upper(event_type[1]) || event_type[2:] AS zone_name FROM events WHERE event_type <> 'error')"
BUCKETS_SQL = """rows_ AS (SELECT *, date_trunc('minute', ts) AS bucket_start, date_trunc('second', ts) AS s FROM telemetry WHERE ts IS NOT NULL),
sec AS (SELECT org_id, camera_id, zone_id, bucket_start, s, count(DISTINCT track_id) AS people FROM rows_ GROUP BY ALL),
occ AS (SELECT org_id, camera_id, zone_id, bucket_start, max(people) AS hi, avg(people) FILTER (people > 0) AS mid, min(people) FILTER (people > 0) AS lo FROM sec GROUP BY ALL),
trk AS (SELECT org_id, camera_id, zone_id, bucket_start, track_id, least(60, floor(epoch_us(max(ts)) / 1000000.0 - epoch_us(min(ts)) / 1000000.0)) AS stay FROM rows_ WHERE track_id IS NOT NULL GROUP BY ALL),
st AS (SELECT org_id, camera_id, zone_id, bucket_start, sum(stay) AS stay, count(*) AS people FROM trk GROUP BY ALL),
cnt AS (SELECT org_id, camera_id, zone_id, bucket_start, count(*) AS n, count(*) FILTER (posture_state = 'SITTING') AS si, count(*) FILTER (posture_state = 'STANDING') AS sd, count(*) FILTER (posture_state = 'WALKING') AS wa,
  sum(CAST(least(greatest(activity_score, 0), 100) AS DECIMAL(20,6))) / nullif(count(activity_score), 0) AS score FROM rows_ GROUP BY ALL),
buckets AS (SELECT cnt.org_id, cnt.camera_id, cnt.zone_id, cnt.bucket_start, CAST(least(hi, 32767) AS INTEGER) AS occupancy_max, CAST(round(CAST(coalesce(mid, 0) AS DECIMAL(38,10)), 4) AS DOUBLE) AS occupancy_avg,
  CAST(least(coalesce(lo, 0), 32767) AS INTEGER) AS occupancy_min, CAST(least(si, 32767) AS INTEGER) AS sitting_frames, CAST(least(sd, 32767) AS INTEGER) AS standing_frames, CAST(least(wa, 32767) AS INTEGER) AS walking_frames,
  CAST(least(n, 32767) AS INTEGER) AS sample_frames, CAST(round(CAST(coalesce(score, 0) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_activity_score,
  CAST(least(coalesce(stay, 0), 60 * greatest(hi, 1)) AS INTEGER) AS total_dwell_seconds, CAST(least(coalesce(people, 0), 32767) AS INTEGER) AS unique_track_count
  FROM cnt JOIN occ USING (org_id, camera_id, zone_id, bucket_start) LEFT JOIN st USING (org_id, camera_id, zone_id, bucket_start))"""


def _sql(body: str, names: bool = False, more: str = "") -> str:
    return domain.sql(f"WITH {BUCKETS_SQL}{', ' + NAMES_SQL if names else ''}{', ' + more if more else ''} {body}", "telemetry")


def _dec(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


W = f"WHERE bucket_start BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'"
SCORE = "sum(CAST(avg_activity_score * greatest(sample_frames, 1) AS DECIMAL(28,8)))"
OCC = "sum(CAST(occupancy_avg AS DECIMAL(28,8)))"


def _trend_sql(grain: str) -> str:
    return _sql(f"""SELECT CAST(date_trunc('{grain}', bucket_start) AS TIMESTAMP) AS bucket, {_dec(f"CAST({SCORE} AS DOUBLE) / sum(greatest(sample_frames, 1))", 2)} AS avg_activity_score,
CAST(sum(sitting_frames) AS BIGINT) AS sitting_count, CAST(sum(standing_frames) AS BIGINT) AS standing_count, CAST(sum(walking_frames) AS BIGINT) AS walking_count,
CAST(sum(unique_track_count) AS BIGINT) AS people, {_dec(f"CAST({OCC} AS DOUBLE) / count(*)", 2)} AS avg_occupancy FROM buckets {W} GROUP BY 1""")


QUERIES = {
    "minute_buckets": lambda s, d: _buckets(s, d),
    "minute_buckets_closed": lambda s, d: buckets.minute_buckets(buckets.closed_window(domain.telemetry(s, d), NOW)),
    "merged_buckets": lambda s, d: sinks.merge_buckets(_buckets(s, d), _late(s, d)),
    "versioned_buckets": _versioned,
    "unsynced_buckets": lambda s, d: sync.unsynced(_versioned(s, d)),
    "stamped_buckets": lambda s, d: _stamped(s, d).select(*sync.KEY, "version", "synced_at"),
    "dashboard_overview": lambda s, d: dashboards.overview(_stored(s, d), _zone_names(s, d), SINCE, UNTIL),
    "dashboard_trend_hour": lambda s, d: dashboards.trend(_stored(s, d), SINCE, UNTIL),
    "dashboard_trend_day": lambda s, d: dashboards.trend(_stored(s, d), SINCE, UNTIL, "day"),
    "dashboard_zones": lambda s, d: dashboards.zone_use(_stored(s, d), _zone_names(s, d), SINCE, UNTIL),
    "dashboard_coverage": lambda s, d: dashboards.coverage(_stored(s, d)),
    "zone_day_stats": lambda s, d: buckets.day_stats(_buckets(s, d), "Asia/Kolkata"),
    "floor_heatmap": lambda s, d: buckets.floor_heatmap(domain.telemetry(s, d)),
}

VERSIONED = """orgs AS (SELECT * REPLACE (CASE WHEN zone_id = 'error' THEN org_id ELSE '00000000-0000-0000-0000-00000000000' || right(org_id, 1) END AS org_id) FROM buckets),
versioned AS (SELECT * EXCLUDE (hit) REPLACE (CAST(sample_frames + CASE WHEN hit THEN 5 ELSE 0 END AS INTEGER) AS sample_frames), CAST(CASE WHEN hit THEN 2 ELSE 1 END AS BIGINT) AS version,
  CASE WHEN NOT hit AND minute(bucket_start) % 3 > 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS synced_at FROM (SELECT *, minute(bucket_start) % 10 = 3 AND sample_frames % 2 = 0 AS hit FROM orgs)
  UNION ALL SELECT * REPLACE (bucket_start + INTERVAL 100 DAY AS bucket_start), CAST(1 AS BIGINT), NULL FROM orgs WHERE minute(bucket_start) = 13)"""
UNSENT = "synced_at IS NULL AND zone_id <> 'error'"
PCT = "100.0 * sum({p}_frames) / nullif(sum(sitting_frames) + sum(standing_frames) + sum(walking_frames), 0)"
ORACLE_SQL = {
    "minute_buckets": _sql("SELECT * FROM buckets"),
    "minute_buckets_closed": _sql("SELECT * FROM buckets WHERE bucket_start < TIMESTAMP '2024-01-15 12:32:00' AND bucket_start >= TIMESTAMP '2024-01-14 12:32:00'"),
    "merged_buckets": _sql("SELECT * REPLACE (sample_frames + CASE WHEN minute(bucket_start) % 10 = 3 THEN 5 ELSE 0 END AS sample_frames) FROM buckets UNION ALL SELECT * REPLACE (bucket_start + INTERVAL 100 DAY AS bucket_start, sample_frames + 5 AS sample_frames) FROM buckets WHERE minute(bucket_start) = 13"),
    "versioned_buckets": _sql("SELECT * FROM versioned", more=VERSIONED),
    "unsynced_buckets": _sql(f"SELECT * FROM versioned WHERE {UNSENT}", more=VERSIONED),
    "stamped_buckets": _sql(f"""SELECT org_id, camera_id, zone_id, bucket_start, version,
CASE WHEN {UNSENT} AND camera_id <> 'cam-1' AND unique_track_count % 5 <> 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE synced_at END AS synced_at FROM versioned""", more=VERSIONED),
    "dashboard_overview": _sql(
        f"""SELECT count(*) > 0 AS has_data, CAST(coalesce(sum(unique_track_count), 0) AS BIGINT) AS people, count(DISTINCT zone_id) AS zones_active,
{_dec(f"CAST({SCORE} AS DOUBLE) / nullif(sum(greatest(sample_frames, 1)), 0)", 1)} AS avg_activity,
{", ".join(_dec(PCT.format(p=p), 1) + f" AS {p}_pct" for p in ("sitting", "standing", "walking"))},
(SELECT coalesce(max(zone_name), 'Unnamed zone') FROM zone_names WHERE zone_id = (SELECT zone_id FROM buckets {W} GROUP BY zone_id ORDER BY sum(unique_track_count) DESC, zone_id DESC LIMIT 1)) AS peak_zone_name,
(SELECT CAST(sum(unique_track_count) AS BIGINT) FROM buckets {W} GROUP BY zone_id ORDER BY 1 DESC LIMIT 1) AS peak_zone_people,
{_dec("max(total_dwell_seconds) / 60", 1)} AS longest_dwell_minutes, max(bucket_start) AS last_seen, CAST(coalesce(sum(sample_frames), 0) AS BIGINT) AS sample_frames FROM buckets {W}""",
        names=True,
    ),
    "dashboard_trend_hour": _trend_sql("hour"),
    "dashboard_trend_day": _trend_sql("day"),
    "dashboard_zones": _sql(
        f"""SELECT b.*, {_dec("seconds / 60", 1)} AS minutes, coalesce(zone_name, 'Unnamed zone') AS zone_name FROM (
SELECT zone_id, CAST(sum(total_dwell_seconds) AS BIGINT) AS seconds, CAST(sum(unique_track_count) AS BIGINT) AS visitors, max(occupancy_max) AS peak_occupancy, {_dec(f"CAST({OCC} AS DOUBLE) / count(*)", 2)} AS avg_occupancy, count(*) AS active_minutes
FROM buckets {W} GROUP BY zone_id) b LEFT JOIN zone_names USING (zone_id)""",
        names=True,
    ),
    "dashboard_coverage": _sql("SELECT min(bucket_start) AS first_bucket, max(bucket_start) AS last_bucket, count(*) AS bucket_count FROM buckets"),
    "zone_day_stats": _sql(f"""SELECT zone_id, CAST(l AS DATE) AS stat_date, CAST(sum(minutes) AS BIGINT) AS occupied_minutes, {_dec("sum(minutes) * 100.0 / 540", 1)} AS occupied_pct, max(peak) AS peak_occupancy,
CAST(arg_max(h, people * 100 - h) AS INTEGER) AS peak_hour, CAST(sum(people) AS BIGINT) AS people, CAST(sum(dwell) AS BIGINT) AS dwell_seconds, CAST(sum(samples) AS BIGINT) AS sample_frames
FROM (SELECT zone_id, date_trunc('day', l) AS l, hour(l) AS h, count(DISTINCT bucket_start) FILTER (occupancy_max > 0) AS minutes, max(occupancy_max) AS peak, sum(unique_track_count) AS people, sum(total_dwell_seconds) AS dwell, sum(sample_frames) AS samples
FROM (SELECT *, bucket_start + INTERVAL '5 hours 30 minutes' AS l FROM buckets) GROUP BY ALL) GROUP BY zone_id, l"""),
    "floor_heatmap": domain.sql(
        f"""SELECT {_dec("(cx + 0.5) / 20", 4)} AS x, {_dec("(cy + 0.5) / 20", 4)} AS y, value FROM (
SELECT least(floor(floor_x * 20), 19) AS cx, least(floor(floor_y * 20), 19) AS cy, count(*) AS value FROM telemetry WHERE floor_x BETWEEN 0 AND 1 AND floor_y BETWEEN 0 AND 1 GROUP BY ALL)""",
        "telemetry",
    ),
}
