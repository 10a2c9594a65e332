"""Walks through zones at ten frames a second, in one piece and as a stream."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from shiftglass.config import Config
from shiftglass.streaming import live, zone_visits

A_DASH = [("A" if k % 2 else "-", 0.1) for k in range(80)]
#: (zone, seconds) parts; "-" is no zone, "?" out of view.
WALKS = {
    "two visits": [("-", 2), ("A", 5), ("-", 3), ("B", 4), ("-", 3)],
    "at once": [("-", 1), ("A", 3), ("B", 3)],
    "short B": [("A", 3), ("B", 0.5), ("A", 3)],
    "short out": [("A", 2), ("-", 0.9), ("A", 2)],
    "short gap": [("A", 3), ("?", 2), ("A", 3)],
    "step out": [("A", 2), ("-", 1.1), ("A", 2)],
    "by way of": [("A", 3), ("-", 0.5), ("B", 2)],
    "way broken": [("A", 3), ("-", 0.5), ("?", 2), ("B", 2)],
    "flicker": A_DASH,
    "settled flicker": [("A", 2), *A_DASH, ("A", 2)],
    "lost and back": [("A", 3), ("?", 6), ("A", 3)],
    "lost": [("-", 1), ("A", 3), ("?", 9)],
    "lost, new": [("A", 3), ("?", 9), ("A", 3)],
    "away outside": [("A", 2), ("-", 3), ("?", 20), ("A", 2)],
    "forgotten": [("A", 2), ("-", 3), ("?", 61), ("A", 2)],
    "dwell": [("-", 1), ("C", 12)],
    "dwell unseen": [("-", 1), ("C", 8.5), ("?", 4), ("C", 1)],
    "end": [("-", 1), ("A", 3)],
}
LIMITS = {"C": {10.0: 0.8}}


def walk(name):
    """Rows of one worker, and of another one outside who is seen in every frame."""
    rows, k = [], 0
    for zone, seconds in WALKS[name]:
        for _ in range(round(seconds * 10)):
            if zone != "?":
                rows.append((name, "w", round(k / 10, 3), None if zone == "-" else zone))
            rows.append((name, "other", round(k / 10, 3), None))
            k += 1
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([r for n in WALKS for r in walk(n)], "session string, worker string, t double, zone string").cache()


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["session"], r["t"], -["EXITED_ZONE", "ENTERED_ZONE"].index(r["event_type"]) if "D_ZONE" in r["event_type"] and "TED" in r["event_type"] else 0, r["event_type"])):
        assert r["worker"] == "w"
        out.setdefault(r["session"], []).append((r["event_type"], r["zone_id"], r["t"], json.loads(r["details"])))
    return out


@pytest.fixture(scope="module")
def events(frames):
    return told(zone_visits.zone_events(frames, limits=LIMITS, close=False).collect())


def short(found):
    return {x[:3] for x in found}


def test_two_visits_with_a_walk_between(events):
    found = events["two visits"]
    assert short(found) == {("ENTERED_ZONE", "A", 2.0), ("EXITED_ZONE", "A", 7.0), ("ENTERED_ZONE", "B", 10.0), ("EXITED_ZONE", "B", 14.0)}
    assert next(x[3] for x in found if x[:2] == ("EXITED_ZONE", "A")) == {"reason": "LEFT", "dwell_s": 5.0}
    assert not any("first_sighting" in x[3] for x in found)


def test_from_zone_to_zone_exit_and_entry_are_at_once(events):
    assert short(events["at once"]) == {("ENTERED_ZONE", "A", 1.0), ("EXITED_ZONE", "A", 4.0), ("ENTERED_ZONE", "B", 4.0)}


def test_an_exit_by_way_of_outside_is_dated_to_its_first_frame(events):
    assert ("EXITED_ZONE", "A", 3.0) in short(events["by way of"]) and ("ENTERED_ZONE", "B", 3.5) in short(events["by way of"])
    assert {("EXITED_ZONE", "A", 5.5), ("ENTERED_ZONE", "B", 5.5)} <= short(events["way broken"])


@pytest.mark.parametrize("name", ["short B", "short out", "short gap", "settled flicker"])
def test_short_changes_and_gaps_do_not_count(events, name):
    assert [x[0] for x in events[name]] == ["ENTERED_ZONE"]


def test_a_longer_step_out_is_an_exit(events):
    assert short(events["step out"]) == {("ENTERED_ZONE", "A", 0.0), ("EXITED_ZONE", "A", 2.0), ("ENTERED_ZONE", "A", 3.1)}


def test_flicker_is_nothing(events):
    assert "flicker" not in events


def test_lost_and_back(events):
    found = {x[0]: x for x in events["lost and back"]}
    assert short(found.values()) == {("ENTERED_ZONE", "A", 0.0), ("LOST_IN_ZONE", "A", 2.9), ("REAPPEARED", "A", 9.0)} and len(events["lost and back"]) == 3
    assert found["REAPPEARED"][3]["gap_s"] == 6.1 and found["ENTERED_ZONE"][3] == {"first_sighting": True} and found["LOST_IN_ZONE"][3]["declared_at_s"] == 8.0


def test_lost_for_good_ends_without_a_confirmed_exit(events):
    found = {x[0]: x for x in events["lost"]}
    assert set(found) == {"ENTERED_ZONE", "LOST_IN_ZONE", "EXITED_ZONE"} and found["EXITED_ZONE"][2] == 3.9
    assert found["EXITED_ZONE"][3] == {"reason": "LOST", "unverifiable": True, "dwell_s": 2.9, "last_seen_s": 3.9, "declared_at_s": 12.0}
    again = [x for x in events["lost, new"] if x[0] == "ENTERED_ZONE"]
    assert [x[3] for x in again] == [{"first_sighting": True}] * 2


def test_who_left_is_remembered_for_a_minute(events):
    last = lambda name: [x for x in events[name] if x[0] == "ENTERED_ZONE"][-1][3]
    assert last("away outside") == {} and last("forgotten") == {"first_sighting": True}


def test_dwell_limits_are_told_once_when_they_are_crossed(events):
    assert short(events["dwell"]) == {("ENTERED_ZONE", "C", 1.0), ("DWELL_WARNING", "C", 9.0), ("DWELL_EXCEEDED", "C", 11.0)}
    found = {x[0]: x for x in events["dwell unseen"]}
    assert found["DWELL_EXCEEDED"][2] == 13.5 and found["DWELL_EXCEEDED"][3] == {"limit_s": 10.0, "crossed_unobserved": True}


def test_the_end_of_a_session_closes_visits(frames):
    found = told(zone_visits.zone_events(frames.where("session IN ('end', 'two visits')")).collect())
    assert found["end"][-1][0] == "EXITED_ZONE" and found["end"][-1][3]["reason"] == "SESSION_END" and found["end"][-1][3]["unverifiable"]
    assert len(found["two visits"]) == 4


def test_who_is_inside_but_not_seen_is_hidden(frames):
    got = {(r["session"], r["t"]): r["hidden"] for r in zone_visits.hidden(frames).collect()}
    assert all(got.get(("short gap", round(3 + k / 10, 1))) == 1 for k in range(20)) and ("short gap", 2.9) not in got and ("short gap", 5.0) not in got
    assert ("lost", 11.9) in got and ("lost", 12.0) not in got and ("two visits", 8.0) not in got


def by_hand(rows, limits=None, reason=None):
    """The rows of a session, frame by frame, in this process."""
    session, workers, out = live.Session(Config(), limits), {}, []
    times = sorted({r[2] for r in rows})
    at = {}
    for _, w, t, z in rows:
        if w is not None:
            at.setdefault(t, {})[w] = z or ""
    for t in times:
        out += session.frame(t, at.get(t, {}), workers)
    return out + (session.close(workers, reason) if reason else [])


def same(got, want):
    key = lambda x: (x[0], x[3], x[1], str(x))
    flat = lambda rows: sorted(((w, e, z, t, json.dumps(json.loads(d), sort_keys=True)) for w, e, z, t, d in rows), key=key)
    assert flat(got) == flat(want)


def test_frame_by_frame_is_the_same_as_windows(frames):
    want = {name: [] for name in WALKS}
    for r in zone_visits.zone_events(frames, limits=LIMITS, reason="CAMERA_LOST").collect():
        want[r["session"]].append((r["worker"], r["event_type"], r["zone_id"], r["t"], r["details"]))
    for name in WALKS:
        same(by_hand(walk(name), LIMITS, "CAMERA_LOST"), want[name])


def test_random_walks_frame_by_frame(spark):
    """Forty sessions of random places, gaps and frame rates: windows over all rows and one pass over the frames agree."""
    rng, rows = random.Random(3), []
    for s in range(40):
        t, at = 0.0, {w: ("A", 0.0) for w in "uvw"}
        step = rng.choice([0.1, 0.2, 0.5])
        while t < 90:
            for w in at:
                if t >= at[w][1]:
                    at[w] = (rng.choice(["A", "B", "C", "-", "?", "C"]), t + rng.choice([0.3, 0.8, 1.2, 3, 6, 9, 14, 70 if s % 5 == 0 else 2]))
                if at[w][0] != "?":
                    rows.append((f"s{s}", w, round(t, 3), None if at[w][0] == "-" else at[w][0]))
            rows.append((f"s{s}", "eye", round(t, 3), None))
            t += step * rng.choice([1, 1, 1, 1, 2, 4])
    df = spark.createDataFrame(rows, "session string, worker string, t double, zone string").repartition(4)
    limits = {"A": {5.0: 0.8}, "C": {2.0: 0.5, 6.0: 1.0}}
    want = {}
    for r in zone_visits.zone_events(df, limits=limits).collect():
        want.setdefault(r["session"], []).append((r["worker"], r["event_type"], r["zone_id"], r["t"], r["details"]))
    for s in range(40):
        same(by_hand([r for r in rows if r[0] == f"s{s}"], limits, "SESSION_END"), want[f"s{s}"])


START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def drained(stream, path, **how):
    query = live.run(stream, f"{path}/out", f"{path}/cp", limits=LIMITS, **how).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    return query


def test_a_stream_tells_the_same_and_timers_close_lost_cameras(spark, frames, tmp_path):
    names = ("two visits", "lost and back", "dwell", "end")
    rows = [(*r, START + dt.timedelta(seconds=r[2] + (0 if n == "end" else 3))) for n in names for r in walk(n)]
    rows += [("later", None, float(k), None, START + dt.timedelta(seconds=k)) for k in range(40)]
    table = spark.createDataFrame(rows, live.FRAME)
    for i, (a, b) in enumerate(((0, 6), (6, 11), (11, 99))):
        table.where(f"t >= {a} AND t < {b}").orderBy(F.rand(i)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(live.FRAME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    drained(stream, tmp_path)
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out/events").collect():
        got.setdefault(r["session"], []).append((r["worker"], r["event_type"], r["zone_id"], r["t"], r["details"]))
    # every session but the last fell silent, and its timer ended it with no row of its own
    for n in names:
        same(got[n], by_hand(walk(n), LIMITS, "CAMERA_LOST"))
    assert "later" not in got and sorted(x[1] for x in got["end"]) == ["ENTERED_ZONE", "EXITED_ZONE"]


def test_state_does_not_grow_with_a_session(spark, tmp_path):
    """Ten batches of one session in which workers come and go: rows of state stay those of the workers in view."""
    rows = [("s", f"w{k // 100}", round(k / 10, 1), "A" if k % 100 < 60 else None, START + dt.timedelta(seconds=k / 10)) for k in range(6000)]
    for i in range(10):
        spark.createDataFrame(rows[i * 600 : i * 600 + 600], live.FRAME).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(live.FRAME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = drained(stream, tmp_path)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["numInputRows"]]
    assert len(states) == 10 and max(states[3:]) <= max(states[1:4]) + 2
    assert spark.read.parquet(f"{tmp_path}/out/events").where("event_type = 'ENTERED_ZONE'").count() == 60


def test_the_wall_clock_closes_a_session_without_any_row(spark, tmp_path):
    rows = [(*r, START) for r in walk("end")]
    spark.createDataFrame(rows, live.FRAME).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    query = live.run(spark.readStream.schema(live.FRAME).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp", lost_s=1.0, by_clock=True).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            events = spark.read.schema(zone_visits.SCHEMA).parquet(f"{tmp_path}/out/events").collect() if any((tmp_path / "out" / "events").glob("*.parquet")) else []
            if any("CAMERA_LOST" in r["details"] for r in events):
                break
    finally:
        query.stop()
    assert [r["event_type"] for r in sorted(events, key=lambda r: r["t"])] == ["ENTERED_ZONE", "EXITED_ZONE"] and query.exception() is None
