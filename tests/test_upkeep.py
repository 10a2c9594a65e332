"""Purges in order, reports taken by one of several runners, a buffer before a target that fails."""

import datetime as dt
import threading

from shiftglass.operators import upkeep
from shiftglass.streaming import sync
from shiftglass.streaming.buffer import Buffer, buffered

at = lambda *x: dt.datetime(*x, tzinfo=dt.timezone.utc)
LINKS = {"cameras": ("orgs", "org_id", "id"), "zones": ("cameras", "camera", "id"), "buckets": ("zones", "zone", "id"), "members": ("orgs", "org_id", "id")}


def test_purges_cut_children_first(spark):
    order = upkeep.purge_order(LINKS, "orgs")
    assert order[-1] == "orgs" and all(order.index(c) < order.index(p) for c, (p, _, _) in LINKS.items())
    tables = {
        "orgs": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string"), "members": spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, org_id int"),
        "cameras": spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id int, org_id int"), "zones": spark.createDataFrame([(100, 10), (101, 11), (200, 20), (300, None)], "id int, camera int"),
        "buckets": spark.createDataFrame([(1, 100), (2, 101), (3, 200), (4, 300), (5, 999)], "id int, zone int"),
    }
    gone = tables["orgs"].where("id = 1")
    counts, left = upkeep.purge(tables, LINKS, "orgs", gone, "id")
    assert {r["table"]: (r["purged"], r["kept"]) for r in counts.collect()} == {"orgs": (1, 2), "members": (1, 2), "cameras": (2, 1), "zones": (2, 2), "buckets": (2, 3)}
    assert [r["table"] for r in counts.orderBy("step").collect()] == order
    assert {n: sorted(r["id"] for r in df.collect()) for n, df in left.items()} == {"orgs": [2, 3], "members": [2, 3], "cameras": [20], "zones": [200, 300], "buckets": [3, 4, 5]}
    assert left["zones"].columns == ["id", "camera"]
    nothing, same = upkeep.purge(tables, LINKS, "orgs", gone.where("false"), "id")
    assert all(r["purged"] == 0 for r in nothing.collect()) and same["buckets"].count() == 5
    (r,) = upkeep.purge_audit(tables["orgs"].where("id < 3"), "id", "name").collect()
    assert (r["purged"], r["ids"], r["names"]) == (2, [1, 2], ["a", "b"])


SCHEDULE = "org_id long, schedule string, next_at timestamp, plan string, deleted boolean"
ROWS = [
    (1, "WEEKLY", at(2024, 1, 1, 6), "GROWTH", False), (2, "MONTHLY", at(2024, 1, 31, 6), "GROWTH", False), (3, "MONTHLY", at(2023, 10, 31, 6), "FREE", False), (4, "OFF", at(2024, 1, 1), "GROWTH", False),
    (5, "WEEKLY", at(2024, 3, 4), "GROWTH", False), (6, "WEEKLY", None, "GROWTH", False), (7, "WEEKLY", at(2024, 1, 1), "GROWTH", True), (8, "WEEKLY", at(2024, 3, 1), "ENTERPRISE", False),
]


def test_due_reports_jump_over_missed_runs(spark):
    got = {r["org_id"]: r for r in upkeep.due_reports(spark.createDataFrame(ROWS, SCHEDULE), "2024-03-01 00:00:00").collect()}
    assert set(got) == {1, 2, 3, 8} and [got[i]["made"] for i in (1, 2, 3, 8)] == [True, True, False, True]
    day = lambda x: x.replace(tzinfo=None)
    assert (got[1]["since"], got[1]["until"], got[1]["next_at"]) == (day(at(2023, 12, 25, 6)), day(at(2024, 1, 1, 6)), day(at(2024, 3, 4, 6)))
    assert got[2]["next_at"] == day(at(2024, 3, 29, 6)) and got[3]["next_at"] == day(at(2024, 3, 29, 6))  # cut in February, and so from then on
    assert got[8]["next_at"] == day(at(2024, 3, 8)) and got[1]["title"] == "Scheduled weekly safety report, 25 Dec to 1 Jan 2024"


def test_two_runners_take_every_report_once(spark, tmp_path):
    schedules, meet, took, wrong = spark.createDataFrame(ROWS, SCHEDULE).cache(), threading.Barrier(2, timeout=60), [], []
    first = {"a": True, "b": True}

    def runner(name):
        def wait():
            if first.pop(name, False):
                meet.wait()  # both have read the same state before either commits

        try:
            took.append([(r["org_id"], r["until"]) for r in upkeep.run_due(spark, schedules, str(tmp_path / "log"), "2024-03-01 00:00:00", wait).collect()])
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=runner, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not wrong and sorted(map(len, took)) == [0, 4] and not first
    again = upkeep.run_due(spark, schedules, str(tmp_path / "log"), "2024-03-08 00:00:00").collect()
    assert {r["org_id"] for r in again} == {1, 5, 8} and {r["org_id"]: r["until"] for r in again}[1] == dt.datetime(2024, 3, 4, 6)
    assert upkeep.run_due(spark, schedules, str(tmp_path / "log"), "2024-03-08 00:00:00").count() == 0


class Target:
    def __init__(self, bad=()):
        self.rows, self.bad, self.down, self.calls = [], set(bad), False, 0

    def __call__(self, df):
        self.calls += 1
        got = [r["id"] for r in df.orderBy("created_at", "id").collect()]
        if self.down:
            raise ConnectionError
        if self.bad & set(got):
            raise sync.Refused("bad")
        self.rows += got


def rows(spark, a, b):
    return spark.createDataFrame([(i, at(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(a, b)], "id long, created_at timestamp")


def test_a_buffer_drops_the_oldest_and_counts(spark, tmp_path):
    target = Target(bad={12})
    buffer = Buffer(spark, "events", str(tmp_path), target, cap=8)
    now = lambda s: f"2024-01-01 00:00:{s:02d}"
    assert buffer.take(rows(spark, 0, 5), 0, now(0))["written"] == 5 and target.rows == [0, 1, 2, 3, 4]
    target.down = True
    assert buffer.take(rows(spark, 5, 11), 1, now(1))["waiting"] == 6
    calls = target.calls
    got = buffer.take(rows(spark, 11, 15), 2, now(2))  # still backing off: not even tried
    assert (got["dropped"], got["waiting"], target.calls) == (2, 8, calls)
    target.down = False
    got = buffer.take(rows(spark, 15, 16), 3, now(9))
    assert (got["dropped"], got["written"], got["refused"], got["failures"]) == (1, 7, 1, 0)
    assert sorted(target.rows) == [0, 1, 2, 3, 4, 8, 9, 10, 11, 13, 14, 15]
    assert buffer.take(rows(spark, 15, 16), 3, now(9))["written"] == 12  # the same batch again: nothing is done, counts are told
    s = Buffer(spark, "events", str(tmp_path), target).state()
    assert (s["dropped"], s["written"], s["refused"]) == (3, 12, 1) and s["dropped"] + s["written"] + s["refused"] == 16
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/events/refused").collect()] == [12]
    # two failures in a row: the pause doubles
    target.down = True
    first = buffer.take(rows(spark, 20, 21), 4, now(20))["wait_until"]
    second = buffer.take(rows(spark, 21, 22), 5, now(30))["wait_until"]
    assert (first.second, second.second) == (22, 34)


def test_a_stream_through_a_buffer(spark, tmp_path):
    target = Target()
    for i in range(2):
        rows(spark, i * 3, i * 3 + 3).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("id long, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = buffered(stream, Buffer(spark, "decisions", str(tmp_path / "b"), target), f"{tmp_path}/cp", lambda: "2024-01-01 00:00:00").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None and sorted(target.rows) == list(range(6))
