"""A session from frames to ordered records: jumps, replays and rules against a walk over the frames."""

import json
import random

import pytest

from shiftglass.streaming import session, zone_visits

FPS = 10.0


def shown(plan):
    """Frames (n, t) of a plan of (from, to) seconds at ten frames a second."""
    times = [round(k / 10, 1) for a, b in plan for k in range(round(a * 10), round(b * 10))]
    return list(enumerate(times))


def walk(zones, t):
    """The zone of a walk (zone, until) at ``t``; "?" is out of view."""
    return next((z for z, until in zones if t < until), "?")


def clocked(frames):
    """Generation, replay and reset of every frame, by spans of processed time."""
    out, spans, generation, last = [], [], 0, None
    for n, t in frames:
        reset = last is not None and t < last - 1e-9
        generation += reset
        replay = any(a - 1e-9 <= t <= b + 1e-9 for a, b in spans)
        if not replay:
            if last is not None and not reset and t - last <= 0.15 + 1e-9:
                spans.append((last, t))
            spans.append((t, t))
        last = t
        out.append((n, t, generation, replay))
    return out


SESSIONS = {
    "plain": ([(0, 12)], {"w": [("-", 1), ("A", 8), ("-", 12)], "v": [("A", 12)]}),
    "back": ([(0, 8), (3, 14)], {"w": [("-", 1), ("A", 20)], "v": [("-", 2), ("B", 6), ("A", 20)]}),
    "back twice": ([(0, 8), (2, 6), (5, 12)], {"w": [("-", 3), ("A", 20)], "v": [("B", 20)]}),
    "only replay": ([(0, 8), (1, 7), (0, 3)], {"w": [("-", 2), ("A", 20)]}),
    "skip and visit": ([(0, 4), (10, 14), (4, 10)], {"w": [("A", 20)], "v": [("-", 5), ("B", 9), ("-", 20)]}),
    "lost": ([(0, 20), (6, 20)], {"w": [("A", 5), ("?", 30)], "v": [("A", 12), ("?", 14), ("A", 30)]}),
}
DWELL = {"A": 5.0, "B": 3.0}


@pytest.fixture(scope="module")
def told(spark):
    frames = [(s, n, t) for s, (plan, _) in SESSIONS.items() for n, t in shown(plan)]
    seen = [(s, n, w, None if z == "-" else z, True) for s, n, t in frames for w, zones in SESSIONS[s][1].items() if (z := walk(zones, t)) != "?"]
    f = spark.createDataFrame(frames, "session string, n long, t double").repartition(3)
    g = spark.createDataFrame(seen, "session string, n long, worker string, zone string, clear boolean").repartition(3)
    return session.records(f, g, fps=FPS, dwell=DWELL).orderBy("session", "place").collect()


def parts(spark, name):
    """Zone records of each generation on its own, and what its frames are."""
    plan, zones = SESSIONS[name]
    frames, out = clocked(shown(plan)), []
    for g in sorted({x[2] for x in frames}):
        mine = [x for x in frames if x[2] == g]
        rows = [(str(g), w, t, None if z == "-" else z) for _, t, _, _ in mine for w, walk_ in zones.items() if (z := walk(walk_, t)) != "?"]
        times = spark.createDataFrame([(str(g), t) for _, t, _, _ in mine], "session string, t double")
        df = spark.createDataFrame(rows, "session string, worker string, t double, zone string")
        reason = "TIME_REGRESSED" if any(x[2] > g for x in frames) else "SESSION_END"
        limits = {z: {s: 0.8} for z, s in DWELL.items()}
        got = zone_visits.zone_records(df, None, limits, reason=reason, tracked=zone_visits.track(df, None, times)).collect()
        out.append((g, mine, sorted(got, key=lambda r: (r["when"], r["worker"], r["rank"], r["t"]))))
    return frames, out


@pytest.mark.parametrize("name", SESSIONS)
def test_a_session_is_told_in_order(spark, told, name):
    frames, generations = parts(spark, name)
    want = []
    for g, mine, records in generations:
        following, fresh = [x[0] for x in frames if x[2] == g + 1], [n for n, _, _, r in mine if not r]
        began, heard, judged, last = {}, {}, set(), mine[-1][1]
        for r in records:
            pair, details = (r["worker"], r["zone_id"]), json.loads(r["details"])
            closes = r["when"] == float("inf")
            n, _, _, replay = (following[0] if following else None, None, None, False) if closes else next(x for x in mine if x[1] >= r["when"] - 1e-6)
            if r["event_type"] == "ENTERED_ZONE":
                began[pair] = (n, replay)
                if not replay:
                    heard[pair] = (r["t"], details.get("first_sighting", False))
            since, partial = began.get(pair, (None, False))
            spoken = (not partial or any(k > since for k in fresh)) if closes else not replay
            if partial and not replay:
                details["visit_started_in_replay"] = True
            if spoken:
                want.append((n, g, not closes, "EVENT", r["event_type"], *pair, r["t"], details))
            if r["event_type"] == "DWELL_EXCEEDED" and not replay and not closes:
                judged.add(pair)
                want.append((n, g, True, "COMPLIANCE", "MAX_DWELL", *pair, r["t"], "EXCEEDED"))
            if r["event_type"] == "EXITED_ZONE" and not closes and not replay and pair in heard:
                t, first = heard.pop(pair)
                if pair not in judged:
                    want.append((n, g, True, "COMPLIANCE", "MAX_DWELL", *pair, t, "LOST" if details["reason"] == "LOST" else "PARTIAL" if first else "WITHIN_LIMIT"))
                judged.discard(pair)
        for pair, (t, _) in heard.items():
            if pair not in judged:
                want.append((following[0] if following else None, g, False, "COMPLIANCE", "MAX_DWELL", *pair, t, "INCOMPLETE"))
        assert last is not None
    got = []
    for r in (r for r in told if r["session"] == name):
        details = json.loads(r["details"])
        closes = details.get("reason") in ("TIME_REGRESSED", "SESSION_END") or "INCOMPLETE" in r["details"]
        got.append((r["n"], r["generation"], not closes, r["stage"], r["kind"], r["worker"], r["zone"], r["t"], details if r["stage"] == "EVENT" else json.loads(details["evidence"])["outcome"]))
    key = lambda x: (x[0] if x[0] is not None else 10**9, x[2], x[3] != "EVENT", x[5], str(x))
    assert sorted(got, key=key) == sorted(want, key=key)
    order = [(x[0] if x[0] is not None else 10**9, x[2], x[3] != "EVENT", x[5]) for x in got]
    assert order == sorted(order) and [r["place"] for r in told if r["session"] == name] == list(range(1, len(got) + 1))


def test_replays_are_silent_and_marked(told):
    back = [r for r in told if r["session"] == "back twice"]
    starts = [json.loads(r["details"]).get("visit_started_in_replay", False) for r in back if r["stage"] == "EVENT" and r["generation"] == 2]
    assert starts and all(starts)  # entries of the last generation fell into footage that was seen
    silent = [r for r in told if r["session"] == "only replay" and r["generation"] > 0]
    assert not silent  # it never reached anything new, so not even its visits' ends are told
    assert any(json.loads(r["details"]).get("reason") == "TIME_REGRESSED" for r in told if r["session"] == "back" and r["stage"] == "EVENT")


def test_all_rules_follow_the_events_of_their_frame(spark):
    rng = random.Random(1)
    frames = [("s", n, t) for n, t in shown([(0, 30), (10, 45)])]
    seen = [("s", n, w, "A" if w == "w" or t < 20 else None, True) for _, n, t in frames for w in ("w", "v") if w == "w" or t < 25]
    looks = [("s", n, w, "helmet", "ABSENT" if w == "w" else "PRESENT", 0.9, 0.9, 1.0) for _, n, w, z, _ in seen]
    bodies = [("s", n, w, 100.0 + (0 if n > 50 else rng.random() * 90), 100.0, 150.0, 80.0, 1.5, False, False, False) for _, n, w, _, _ in seen if w == "w"]
    got = session.records(
        spark.createDataFrame(frames, "session string, n long, t double"), spark.createDataFrame(seen, "session string, n long, worker string, zone string, clear boolean"),
        spark.createDataFrame(looks, "session string, n long, worker string, item string, state string, seen_fraction double, empty_fraction double, recent_fraction double"),
        spark.createDataFrame(bodies, "session string, n long, worker string, cx double, cy double, size double, angle double, aspect double, legs_up boolean, collapsed boolean, allowed boolean"),
        fps=FPS, dwell={"A": 6.0}, entry=["A"], least=2,
    ).orderBy("place").collect()
    status = lambda kind: [(r["worker"], json.loads(r["details"])["status"]) for r in got if r["kind"] == kind]
    assert set(status("PPE_ENTRY")) == {("w", "POTENTIAL_VIOLATION"), ("v", "COMPLIANT")}
    assert ("w", "POTENTIAL_VIOLATION") in status("MAN_DOWN") and ("zone-A", "POTENTIAL_VIOLATION") in status("OCCUPANCY") and ("w", "POTENTIAL_VIOLATION") in status("MAX_DWELL")
    replayed = {n for n, _, _, r in clocked([(n, t) for _, n, t in frames]) if r}
    assert all(r["n"] not in replayed or json.loads(r["details"]).get("reason") == "TIME_REGRESSED" or "INCOMPLETE" in r["details"] or "footage ended" in r["details"] for r in got)
    by_frame = {}
    for r in got:
        by_frame.setdefault(r["n"], []).append(session.STAGES.index(r["stage"]))
    assert all(v == sorted(v) for k, v in by_frame.items() if k not in replayed)


def test_records_of_nothing(spark):
    f = spark.createDataFrame([], "session string, n long, t double")
    g = spark.createDataFrame([], "session string, n long, worker string, zone string, clear boolean")
    assert session.records(f, g, dwell=DWELL, entry=["A"], least=2).count() == 0
    some = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 0.1)], "session string, n long, t double")
    assert session.records(some, g, dwell=DWELL).count() == 0
