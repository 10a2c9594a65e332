"""Streams against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shiftglass.operators import buckets
from shiftglass.sources import sinks
from shiftglass.streaming import rollups

SAMPLE = "ts timestamp, org_id string, camera_id string, zone_id string, track_id long, posture_state string, activity_score double"
START = dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc)


def samples(seed, minutes=12, rows=1500):
    rng = random.Random(seed)
    one = lambda: (START + dt.timedelta(seconds=round(rng.uniform(0, 60 * minutes), 3)), "org", rng.choice("ab"), rng.choice(["x", "x", "y"]), rng.choice([None, *range(6)]), rng.choice(["SITTING", "STANDING", "WALKING", "AWAY", None]), rng.choice([None, -5.0, 50.0, 33.3, 150.0]))
    return [one() for _ in range(rows)]


def key(r):
    return tuple(r[c] for c in buckets.KEY)


def rows_of(df):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=str)


def pushed(spark, batches, path):
    """Rows as files, one micro-batch each."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SAMPLE).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None


def test_the_stream_of_minutes_is_the_batch(spark, tmp_path):
    """Rows shuffled within two minutes: every closed minute has the numbers of the batch, once."""
    rng = random.Random(8)
    rows = sorted(samples(7), key=lambda r: r[0].timestamp() + rng.uniform(-50, 50))
    far = (START + dt.timedelta(hours=1), "org", "a", "x", None, None, None)
    stream = pushed(spark, [rows[:400], rows[400:900], rows[900:], [far], [far]], f"{tmp_path}/in")
    drain(rollups.keep_minutes(stream, f"{tmp_path}/minutes", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/minutes").drop("day")
    want = buckets.minute_buckets(spark.createDataFrame(rows, SAMPLE))
    assert rows_of(got.select(want.columns)) == rows_of(want) and got.count() > 30


def test_what_comes_late_is_merged(spark, tmp_path):
    """Rows of closed minutes are dropped by the stream's state, but landed: a repair sets their minutes right, and no others."""
    rows = sorted(samples(9), key=lambda r: r[0])
    late = [r for i, r in enumerate(rows) if r[0] < START + dt.timedelta(minutes=4) and i % 5 == 0]
    first = [r for r in rows if r not in late]
    far = (START + dt.timedelta(hours=1), "org", "a", "x", None, None, None)
    batches = [first[:600], first[600:], [far], [far], late]
    drain(rollups.keep_minutes(pushed(spark, batches, f"{tmp_path}/in"), f"{tmp_path}/minutes", f"{tmp_path}/cp"))
    drain(rollups.land(spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/raw", f"{tmp_path}/cp2"))
    told = spark.read.parquet(f"{tmp_path}/minutes").drop("day")
    want = buckets.minute_buckets(spark.createDataFrame(rows, SAMPLE))
    assert rows_of(told.select(want.columns)) != rows_of(want)
    raw = spark.read.parquet(f"{tmp_path}/raw")
    last = raw.agg(F.max("batch")).first()[0]
    changes = rollups.late_minutes(raw.drop("batch"), told, raw.where(F.col("batch") == last).drop("batch"))
    assert {key(r) for r in changes.collect()} == {(r[1], r[2], r[3], r[0].replace(second=0, microsecond=0, tzinfo=None)) for r in late}
    fixed = rollups.repair(spark, f"{tmp_path}/raw", f"{tmp_path}/minutes", last - 1, f"{tmp_path}/fixed").drop("day")
    assert rows_of(fixed.select(want.columns)) == rows_of(want)
    again = rollups.late_minutes(raw.drop("batch"), fixed, raw.where(F.col("batch") == last).drop("batch"))
    assert again.count() == 0


def test_a_landed_batch_replaces_itself(spark, tmp_path):
    stream = pushed(spark, [samples(1, rows=5), samples(2, rows=6)], f"{tmp_path}/in")
    drain(rollups.land(stream, f"{tmp_path}/raw", f"{tmp_path}/cp"))
    drain(rollups.land(spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/raw", f"{tmp_path}/cp-lost"))
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 11


def test_events_once_and_sessions(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    spark.createDataFrame([(i % 4, at(i)) for i in range(12)], "id long, observed_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("id long, observed_at timestamp").parquet(f"{tmp_path}/in/*")
    drain(rollups.once(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3]
    seen = spark.createDataFrame([(1, at(s)) for s in (0, 5, 10, 30, 33)] + [(2, at(1))], "track_id long, ts timestamp")
    got = sorted((r["track_id"], r["samples"]) for r in rollups.sessions(seen).collect())
    assert got == [(1, 2), (1, 3), (2, 1)]


def test_stored_buckets_follow_their_source(spark, tmp_path):
    """A changed source gives a new table; an unchanged one is not built again, in any session."""
    source, built = f"{tmp_path}/events", []

    def write(n):
        spark.createDataFrame(samples(n, rows=n), SAMPLE).coalesce(1).write.mode("overwrite").parquet(source)

    def stored():
        def make():
            built.append(1)
            return buckets.minute_buckets(spark.read.parquet(source))

        return sinks.stored_buckets(spark, source, make, f"{tmp_path}/store")

    write(200)
    assert stored().agg(F.sum("sample_frames")).first()[0] == 200 and stored().agg(F.sum("sample_frames")).first()[0] == 200 and len(built) == 1
    write(1000)
    assert stored().agg(F.sum("sample_frames")).first()[0] == 1000 and len(built) == 2
