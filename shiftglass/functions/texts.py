"""Text, time and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def duration(seconds: Column) -> Column:
    """Seconds as text: 45 s, 3 min 5 s, 2 h 10 min."""
    s = F.round(seconds).cast("long")
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min %d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def percent(share: Column, places: int = 1) -> Column:
    return F.when(share.isNull(), "–").otherwise(F.concat(F.format_number(share * 100, places), F.lit("%")))


def observed_at(anchor: Column, video_time_s: Column) -> Column:
    """Video time on the clock, to the nearest millisecond."""
    return F.timestamp_micros(F.unix_micros(anchor) + F.round(video_time_s * 1000).cast("long") * 1000)


def frame_time(frame_index: Column, fps: Column) -> Column:
    return frame_index / fps


def utc_iso(at: Column) -> Column:
    """ISO text of the nearest millisecond."""
    near = F.timestamp_micros(F.floor((F.unix_micros(at) + 500) / 1000) * 1000)
    return F.date_format(near, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def recorded_at(text: Column, now: Column) -> Column:
    """A time given as text (UTC unless it says so) of 2000 or later and at most a day ahead, else null."""
    t = F.try_to_timestamp(text)
    return F.when((F.year(t) >= 2000) & (F.unix_micros(t) <= F.unix_micros(now) + 86_400_000_000), t)


def json_number(json: Column, path: str) -> Column:
    """A number inside JSON; null for anything else there."""
    return F.get_json_object(json, path).try_cast("double")


def bounded_json(json: Column, most: int = 65_536) -> Column:
    """JSON no longer than ``most`` bytes, else null."""
    return F.when(F.octet_length(json) <= most, json)


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def worker_label(key: Column) -> Column:
    return F.when(key.startswith("zone-"), "Whole zone").otherwise(F.concat(F.lit("Worker "), F.regexp_extract(key, r"(\d+)$", 1)))


def event_sentence(kind: Column, zone: Column, details: Column) -> Column:
    """What happened, in words."""
    stay = duration(json_number(details, "$.dwell_s"))
    return (
        F.when(kind == "ENTERED_ZONE", F.concat(F.lit("Entered "), zone))
        .when((kind == "EXITED_ZONE") & (F.get_json_object(details, "$.reason") == "LEFT"), F.concat(F.lit("Left "), zone, F.lit(" after "), stay))
        .when(kind == "EXITED_ZONE", F.concat(F.lit("No longer followed in "), zone))
        .when(kind == "LOST_IN_ZONE", F.concat(F.lit("Out of view in "), zone))
        .when(kind == "REAPPEARED", F.concat(F.lit("Back in view in "), zone))
        .otherwise(F.concat(F.lit("Over the time limit in "), zone))
    )


def person_name_ok(name: Column, most: int = 80) -> Column:
    """Not blank, not too long, no control characters."""
    return (F.length(F.trim(name)) > 0) & (F.length(name) <= most) & ~name.rlike(r"\p{C}")
