"""Copies of local rows elsewhere: a cursor that survives restarts, bad rows set aside alone, retirement, versioned buckets, purges.

Local tables are append-only and never rewritten by a pass. What became of their rows is a
table of its own, the ledger (table, id, state, at): SYNCED, REJECTED (may be tried again
when a cooldown is over) or RETIRED (never tried again). A pass reads the rows behind its cursor
that the ledger lets through, sends them and writes the ledger. Sending again what was
sent before a crash is harmless if the target takes each id once; nothing is skipped,
because the cursor moves only after the ledger has told of every row before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import records
from ..sources import sinks

BATCH_ROWS = 500
COOLDOWN_S = 3600
RETIRE_DAYS = 30
LEDGER = "table string, id string, state string, why string, at timestamp"
CURSOR = "table string, created_at timestamp, id string, pass long"
SYNCED, REJECTED, RETIRED = "SYNCED", "REJECTED", "RETIRED"


class Refused(Exception):
    """The target refused rows for a reason about the rows; any other exception is about the target and ends the pass."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def waiting(rows: DataFrame, ledger: DataFrame, now: Column, cooldown_s: float = COOLDOWN_S) -> DataFrame:
    """``rows`` (id, ...) that may be sent: not synced, not retired, not refused a short while ago."""
    last = ledger.groupBy("id").agg(F.bool_or(F.col("state").isin(SYNCED, RETIRED)).alias("done"), F.max(F.when(F.col("state") == REJECTED, F.col("at"))).alias("refused_at"))
    held = last.where(F.col("done") | (F.unix_micros("refused_at") > F.unix_micros(now) - int(cooldown_s * 1_000_000))).select(F.col("id").alias("__id"))
    return rows.join(held, F.col("id").cast("string") == F.col("__id"), "left_anti")


def after(rows: DataFrame, cursor: tuple | None) -> DataFrame:
    """``rows`` behind a keyset cursor (created_at, id)."""
    if cursor is None:
        return rows
    at, last = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
    return rows.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id").cast("string") > last)))


def resolved(rows: DataFrame, cameras: DataFrame, zones: DataFrame) -> DataFrame:
    """``rows`` with the target's camera_key and zone_key: a camera is known by organisation and name, a zone by camera and slug.

    ``cameras``: org_id, name, camera_key; ``zones``: camera_key, slug, zone_key. ``known``:
    the camera is there, and so is the zone if the row has one.
    """
    named = cameras.select(F.col("org_id").alias("__org"), F.col("name").alias("__name"), "camera_key").dropDuplicates(["__org", "__name"])
    slugs = zones.select(F.col("camera_key").alias("__camera"), F.col("slug").alias("__slug"), "zone_key").dropDuplicates(["__camera", "__slug"])
    both = rows.join(named, (F.col("org_id") == F.col("__org")) & (F.col("camera_id") == F.col("__name")), "left").join(slugs, (F.col("camera_key") == F.col("__camera")) & (F.col("zone_id") == F.col("__slug")), "left")
    known = F.col("camera_key").isNotNull() & (F.col("zone_id").isNull() | F.col("zone_key").isNotNull())
    return both.drop("__org", "__name", "__camera", "__slug").withColumn("known", known)


def halved(batch: DataFrame, n: int, send: Callable[[DataFrame], None]) -> list[tuple[int, str]]:
    """Sends the rows of ``batch`` (place: 1 to ``n``); refused batches are halved down to the bad rows, whose places come back."""
    bad, open_ = [], [(1, n)]
    while open_:
        a, b = open_.pop()
        try:
            send(batch.where(F.col("place").between(a, b)).drop("place"))
        except Refused as e:
            if a == b:
                bad.append((a, str(e)[:200]))
            else:
                open_ += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]
    return sorted(bad)


def sync_table(spark: SparkSession, name: str, rows: DataFrame, cameras: DataFrame, zones: DataFrame, send: Callable[[DataFrame], None], root: str, now: str, orgs: DataFrame | None = None,
               limit: int = BATCH_ROWS, cooldown_s: float = COOLDOWN_S, retire_days: int = RETIRE_DAYS) -> dict:
    """One pass over the next ``limit`` rows of a local table; what it did, as counts.

    ``rows``: id, org_id, camera_id, zone_id, created_at and a payload. ``root`` holds the
    tables ledger and cursor. Rows whose organisation can't be an id are invalid; those
    whose camera or zone is unknown are unmapped and wait, as do refused ones; all three are
    retired once they are older than ``retire_days`` (unmapped ones only if their
    organisation is known). At the end of the table the next pass starts from the top.
    """
    moment = F.lit(now).cast("timestamp")
    ledger = _read(spark, f"{root}/ledger", LEDGER).where(F.col("table") == name)
    cursors = _read(spark, f"{root}/cursor", CURSOR).where(F.col("table") == name)
    newest = cursors.orderBy(F.desc("pass")).first()
    cursor = (newest["created_at"], newest["id"]) if newest and newest["id"] is not None else None
    key = F.struct("created_at", F.col("id").cast("string").alias("key"))
    window = after(rows, cursor).where(F.col("id").isNotNull()).orderBy("created_at", F.col("id").cast("string")).limit(limit)
    window = sinks.kept_table(window)  # at most ``limit`` rows
    facts = window.agg(F.count("*").alias("n"), F.max(key).alias("last")).first()
    done = {"examined": facts["n"], SYNCED: 0, REJECTED: 0, RETIRED: 0, "invalid": 0, "unmapped": 0}

    open_ = waiting(window, ledger, moment, cooldown_s)
    shaped = F.coalesce(F.col("org_id").rlike(records.UUID_SHAPE), F.lit(False))
    placed = resolved(open_.where(shaped), cameras, zones)
    good, bad = placed.where("known").drop("known"), placed.where("NOT known")
    order = Window.orderBy("created_at", F.col("id").cast("string"))  # of one bounded batch
    good = sinks.kept_table(good.withColumn("place", F.row_number().over(order)))
    n = good.count()
    refused = halved(good, n, send) if n else []
    why = spark.createDataFrame(refused, "place int, why string")
    sent = good.join(why, "place", "left")
    line = lambda df, state, reason: df.select(F.lit(name).alias("table"), F.col("id").cast("string").alias("id"), F.lit(state).alias("state"), reason.cast("string").alias("why"), moment.alias("at"))
    invalid = open_.where(~shaped)
    known = bad if orgs is None else bad.join(orgs.select("org_id").distinct(), "org_id", "left_semi")
    old = F.col("created_at") < moment - F.make_interval(days=F.lit(retire_days))
    lines = line(sent.where("why IS NULL"), SYNCED, F.lit(None)).unionByName(line(sent.where("why IS NOT NULL"), REJECTED, F.col("why")))
    retired = line(invalid.where(old), RETIRED, F.lit("invalid")).unionByName(line(known.where(old), RETIRED, F.lit("unmapped"))).unionByName(line(sent.where("why IS NOT NULL").where(old), RETIRED, F.col("why")))
    told = sinks.kept_table(lines.unionByName(retired))
    told.coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    done |= {r["state"]: r["n"] for r in told.groupBy("state").agg(F.count("*").alias("n")).collect()}
    done["invalid"], done["unmapped"] = invalid.count(), bad.count()
    # only now: a pass that is cut off before is made again in full
    wrapped = facts["n"] < limit
    step = (newest["pass"] if newest else 0) + 1
    last = (name, None, None, step) if wrapped else (name, facts["last"]["created_at"], facts["last"]["key"], step)
    spark.createDataFrame([last], CURSOR).coalesce(1).write.mode("append").parquet(f"{root}/cursor")
    return done | {"wrapped": wrapped}


def sync_stream(spark: SparkSession, clock: DataFrame, passes: Callable[[str], None], checkpoint: str, every: str = "60 seconds"):
    """A query that makes a pass at every trigger of a rate stream ``clock``; ``passes`` gets the time."""

    def batch(df: DataFrame, _: int) -> None:
        at = df.agg(F.max("timestamp")).first()[0]
        if at is not None:
            passes(str(at))

    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every)


# --------------------------------------------------------------------------- versioned buckets
KEY = ("org_id", "camera_id", "zone_id", "bucket_start")


def upserted(target: DataFrame, changes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``target`` (key, measures, version, synced_at) with the buckets of ``changes`` (key, measures) in their place.

    A bucket whose measures are other than before gets the next version and counts as
    unsynced; one that comes again as it was keeps both. New ones start at version 1. Of
    several changes of a key the one with the greatest measures, field by field, counts.
    """
    measures = [c for c in changes.columns if c not in key]
    newest = changes.groupBy(*key).agg(F.max(F.struct(*measures)).alias("new"))
    was = target.groupBy(*key).agg(F.max_by(F.struct(F.struct(*measures).alias("m"), "version", "synced_at"), "version").alias("old"))
    both = was.join(newest, list(key), "full")
    changed = F.col("new").isNotNull() & ~F.coalesce(F.col("new").eqNullSafe(F.col("old.m")), F.lit(False))
    value = F.when(F.col("new").isNull(), F.col("old.m")).otherwise(F.col("new"))
    return both.withColumn("m", value).select(
        *key, "m.*", (F.coalesce(F.col("old.version"), F.lit(0)) + changed.cast("long")).alias("version"), F.when(~changed, F.col("old.synced_at")).alias("synced_at"),
    )


def unsynced(target: DataFrame, limit: int | None = None, skip: tuple[str, ...] = ("TRANSIT_ZONE",)) -> DataFrame:
    """Buckets whose present version was not sent, oldest first: no synthetic zones, no organisation that can't be an id."""
    rows = target.where(F.col("synced_at").isNull() & F.col("org_id").rlike(records.UUID_SHAPE) & ~F.col("zone_id").isin(*skip))
    return rows if limit is None else rows.orderBy("bucket_start", *KEY[:-1]).limit(limit)


def stamped(target: DataFrame, sent: DataFrame, now: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """``target`` with synced_at of what was ``sent`` (key, version); a bucket that changed meanwhile stays unsynced. Zones that are never sent are stamped too."""
    marks = sent.select(*key, F.col("version").alias("__sent")).distinct()
    both = target.join(marks, list(key), "left")
    done = (F.col("__sent") == F.col("version")) | (F.col("zone_id") == "TRANSIT_ZONE")
    return both.withColumn("synced_at", F.when(F.col("synced_at").isNull() & F.coalesce(done, F.lit(False)), F.lit(now).cast("timestamp")).otherwise(F.col("synced_at"))).drop("__sent")


def changed_since(target: DataFrame, versions: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Buckets of a later version than a reader has seen (``versions``: key, version)."""
    return target.join(versions.select(*key, F.col("version").alias("__seen")), list(key), "left").where(F.col("version") > F.coalesce("__seen", F.lit(0))).drop("__seen")


def purged(rows: DataFrame, now: str, synced_days: int = 7, unsynced_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes of rows (created_at, synced_at): synced ones ``synced_days`` after that; others never, unless ``unsynced_days`` is given (of their creation)."""
    if synced_days < 1 or (unsynced_days is not None and unsynced_days < 1):
        raise ValueError("rows must be kept for a day at least")
    before = lambda days: F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    goes = F.col("synced_at") < before(synced_days)
    if unsynced_days is not None:
        goes = goes | (F.col("synced_at").isNull() & (F.col("created_at") < before(unsynced_days)))
    marked = F.coalesce(goes, F.lit(False))
    return rows.where(~marked), rows.where(marked)
