"""Replication: a target that refuses rows, passes that are cut off, buckets by version, purges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftglass.streaming import sync

ORG = "00000000-0000-0000-0000-000000000001"
ROW = "id string, org_id string, camera_id string, zone_id string, created_at timestamp, payload int"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(spark, n=30):
    """Thirty rows, pairs of equal times; some of an unknown camera or zone, one of no organisation's shape."""
    out = []
    for i in range(n):
        org, camera, zone = ("test-org" if i == 7 else ORG), ("attic" if i == 11 else "door"), (None if i % 3 == 0 else "cellar" if i == 13 else "press")
        out.append((f"r{i:02d}", org, camera, zone, DAY + dt.timedelta(hours=i // 2), i))
    return spark.createDataFrame(out, ROW)


class Target:
    """Takes each id once; refuses a batch that holds a bad row; may break in the middle of a pass."""

    def __init__(self, bad=(), breaks=()):
        self.rows, self.bad, self.calls, self.breaks = {}, set(bad), 0, set(breaks)

    def __call__(self, df):
        self.calls += 1
        got = df.collect()
        if self.calls in self.breaks:
            raise ConnectionError("down")
        if any(r["id"] in self.bad for r in got):
            raise sync.Refused("bad value")
        for r in got:
            self.rows.setdefault(r["id"], []).append((r["camera_key"], r["zone_key"], r["payload"]))


@pytest.fixture(scope="module")
def known(spark):
    cameras = spark.createDataFrame([(ORG, "door", 1), ("other", "attic", 2)], "org_id string, name string, camera_key int")
    zones = spark.createDataFrame([(1, "press", 10), (2, "cellar", 20)], "camera_key int, slug string, zone_key int")
    return cameras, zones, spark.createDataFrame([(ORG,)], "org_id string")


def go(spark, target, known, root, now, limit=8, **how):
    return sync.sync_table(spark, "events", rows(spark), known[0], known[1], target, root, now, known[2], limit=limit, **how)


def test_a_bad_row_holds_nobody_back_and_nothing_is_lost(spark, known, tmp_path):
    target, root = Target(bad={"r04", "r05", "r20"}), str(tmp_path)
    passes = [go(spark, target, known, root, "2024-01-03 00:00:00") for _ in range(4)]
    assert [p["examined"] for p in passes] == [8, 8, 8, 6] and [p["wrapped"] for p in passes] == [False] * 3 + [True]
    assert sum(p["SYNCED"] for p in passes) == 24 and sum(p["REJECTED"] for p in passes) == 3
    assert sum(p["invalid"] for p in passes) == 1 and sum(p["unmapped"] for p in passes) == 2
    assert set(target.rows) == {f"r{i:02d}" for i in range(30) if i not in (4, 5, 7, 11, 13, 20)}
    assert target.rows["r00"] == [(1, None, 0)] and target.rows["r01"] == [(1, 10, 1)]
    # a bad row costs as many calls as its batch can be halved, not as many as it has rows
    assert target.calls <= 4 + 2 * 3 * 3
    # within the cooldown nothing is tried again; after it, what was mended goes through
    calls = target.calls
    again = [go(spark, target, known, root, "2024-01-03 00:30:00") for _ in range(4)]
    assert target.calls == calls and sum(p["SYNCED"] for p in again) == 0
    target.bad = {"r20"}
    later = [go(spark, target, known, root, "2024-01-03 01:30:00") for _ in range(4)]
    assert sum(p["SYNCED"] for p in later) == 2 and {"r04", "r05"} <= set(target.rows)
    # after a month refused, invalid and unmapped rows are given up; those of a known organisation only
    late = [go(spark, target, known, root, "2024-03-01 00:00:00") for _ in range(4)]
    assert sum(p["RETIRED"] for p in late) == 4
    target.bad, calls = set(), target.calls
    assert sum(go(spark, target, known, root, "2024-03-02 00:00:00")["SYNCED"] for _ in range(4)) == 0 and target.calls == calls
    assert all(len(v) == 1 for v in target.rows.values())


def test_a_pass_that_is_cut_off_is_made_again(spark, known, tmp_path):
    target, root = Target(bad={"r04"}, breaks={3}), str(tmp_path)
    with pytest.raises(ConnectionError):
        go(spark, target, known, root, "2024-01-03 00:00:00")  # in the middle of the halving
    sent = set(target.rows)
    for _ in range(4):
        go(spark, target, known, root, "2024-01-03 00:00:00")
    assert set(target.rows) == {f"r{i:02d}" for i in range(30) if i not in (4, 7, 11, 13)}
    # what was sent before the break came twice, by the same id: a target that takes ids once has it once
    assert {k for k, v in target.rows.items() if len(v) > 1} <= sent
    ledger = spark.read.parquet(f"{root}/ledger").where("state = 'SYNCED'")
    assert ledger.count() == ledger.select("id").distinct().count() == len(target.rows)


def test_a_ledger_without_its_cursor(spark, known, tmp_path):
    """The driver dies between both writes: the pass is made again and finds nothing to send."""
    target, root = Target(), str(tmp_path / "a")
    go(spark, target, known, root, "2024-01-03 00:00:00")
    spark.read.parquet(f"{root}/ledger").write.parquet(f"{tmp_path}/b/ledger")
    calls = target.calls
    assert go(spark, target, known, f"{tmp_path}/b", "2024-01-03 00:00:00")["SYNCED"] == 0 and target.calls == calls
    assert go(spark, target, known, f"{tmp_path}/b", "2024-01-03 00:00:00")["SYNCED"] > 0


def test_passes_by_trigger(spark, known, tmp_path):
    target, at = Target(), []

    def one(now):
        at.append(now)
        go(spark, target, known, str(tmp_path / "s"), now)

    spark.createDataFrame([(DAY,)], "timestamp timestamp").write.parquet(f"{tmp_path}/in/0")
    query = sync.sync_stream(spark, spark.readStream.schema("timestamp timestamp").parquet(f"{tmp_path}/in/*"), one, f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None and at == ["2024-01-01 00:00:00"] and len(target.rows) == 7


BUCKET = "org_id string, camera_id string, zone_id string, bucket_start timestamp, n int, version long, synced_at timestamp"


def test_versions_of_buckets(spark):
    b = lambda z, n, v, s: (ORG, "c", z, DAY, n, v, s)
    table = spark.createDataFrame([b("same", 1, 3, DAY), b("more", 1, 1, DAY), b("left", 5, 2, None), b("TRANSIT_ZONE", 1, 1, None)], BUCKET)
    changes = spark.createDataFrame([b("same", 1, 0, None), b("more", 4, 0, None), b("more", 2, 0, None), b("new", 7, 0, None)], BUCKET).drop("version", "synced_at")
    got = sync.upserted(table, changes)
    read = lambda df: {r["zone_id"]: (r["n"], r["version"], r["synced_at"] is not None) for r in df.collect()}
    assert read(got) == {"same": (1, 3, True), "more": (4, 2, False), "left": (5, 2, False), "new": (7, 1, False), "TRANSIT_ZONE": (1, 1, False)}
    assert [r["zone_id"] for r in sync.unsynced(got, 2).collect()] == ["left", "more"]
    sent = sync.unsynced(got).withColumn("version", F.col("version") - (F.col("zone_id") == "more").cast("int"))
    assert {k for k, v in read(sync.stamped(got, sent, "2024-02-02 00:00:00")).items() if v[2]} == {"same", "left", "new", "TRANSIT_ZONE"}
    assert {r["zone_id"] for r in sync.changed_since(got, table.select(*sync.KEY, "version")).collect()} == {"more", "new"}
    nothing = table.where("false")
    assert read(sync.upserted(nothing, changes)) == {"same": (1, 1, False), "more": (4, 1, False), "new": (7, 1, False)} and sync.upserted(table, changes.where("false")).count() == 4


def test_purges_spare_what_was_never_sent(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    df = spark.createDataFrame([("old synced", day(0), day(1)), ("lately synced", day(0), day(25)), ("old", day(0), None), ("new", day(29), None)], "id string, created_at timestamp, synced_at timestamp")
    ids = lambda x: {r["id"] for r in x.collect()}
    assert [ids(x) for x in sync.purged(df, "2024-01-31 00:00:00")] == [{"lately synced", "old", "new"}, {"old synced"}]
    assert ids(sync.purged(df, "2024-01-31 00:00:00", 7, 20)[1]) == {"old synced", "old"}
    with pytest.raises(ValueError):
        sync.purged(df, "2024-01-31 00:00:00", 0)
