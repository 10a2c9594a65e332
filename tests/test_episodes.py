"""Head counts, people down, equipment and sampling, frame by frame."""

import json

import random
from statistics import median

from shiftglass.config import Config
from shiftglass.streaming import episodes, equipment
from shiftglass.streaming.episodes import Sampler


def run(m, rows, close=False):
    s, out = m.start(), []
    for r in rows:
        out += m.step(s, r)
    return out + (m.finish(s) if close else [])


def heads(name, *parts):
    rows, k = [], 0
    for seen, clear, seconds in parts:
        for _ in range(round(seconds * 10)):
            rows.append((name, k / 10, seen, clear, 0))
            k += 1
    return rows


def counted(spark, rows, **rule):
    df = spark.createDataFrame(rows, "zone string, t double, seen int, clear int, hidden int")
    out = {}
    for r in sorted(episodes.occupancy(df, ["zone"], **rule).collect(), key=lambda r: r["t"]):
        out.setdefault(r["zone"], []).append((r["status"], r["t"], r["confidence"], json.loads(r["evidence"])))
    return out


def test_too_few_people(spark):
    rows = heads("lone", (2, 2, 2), (1, 1, 12)) + heads("enough", (2, 2, 30)) + heads("short", (2, 2, 2), (1, 1, 8), (2, 2, 5), (1, 1, 8)) + heads("dip", (2, 2, 2), (1, 1, 6), (2, 2, 0.5), (1, 1, 6))
    rows += heads("again", (2, 2, 2), (1, 1, 12), (2, 2, 3), (1, 1, 12), (2, 2, 40), (1, 1, 12)) + [("hid", k / 10, 1, 1, 1) for k in range(200)]
    got = counted(spark, rows, least=2)
    assert set(got) == {"lone", "dip", "again"}
    ((status, t, _, why),) = got["lone"]
    assert status == "POTENTIAL_VIOLATION" and abs(t - 2.1) <= 1.3 and why["outcome"] == "LONE_WORKER" and why["people_seen"] == 1 and why["clear_fraction"] == 1.0
    assert len(got["dip"]) == 1 and len(got["again"]) == 2  # flags a minute apart


def test_an_unclear_picture_is_said_once_and_read_afresh(spark):
    got = counted(spark, heads("a", (3, 0, 12), (3, 3, 15)) + heads("b", (3, 0, 40)), most=1)
    assert [x[0] for x in got["a"]] == ["UNVERIFIABLE", "POTENTIAL_VIOLATION"] and got["a"][0][2] == 0.0 and got["a"][1][3]["outcome"] == "OVER_CAPACITY"
    assert [x[0] for x in got["b"]] == ["UNVERIFIABLE"]


def test_an_empty_zone_is_flagged_if_asked(spark):
    assert counted(spark, heads("a", (0, 0, 14)), least=1)["a"][0][3]["outcome"] == "EMPTY_ZONE"
    assert counted(spark, heads("a", (0, 0, 14)), least=1, flag_empty=False) == {}
    assert counted(spark, heads("a", (0, 0, 6)) + [("a", 20 + k / 10, 0, 0, 0) for k in range(60)], least=1) == {}  # a gap begins anew


def body(name, seconds, angle, aspect, move=0.0, start=0.0, legs_up=False, collapsed=False, allowed=False):
    return [(name, start + k / 10, 100.0 + move * k, 50.0, 150.0, angle, aspect, legs_up, collapsed, allowed) for k in range(round(seconds * 10))]


def test_people_lying_still(spark):
    rows = body("lies", 8, 85.0, 1.8) + body("moves", 8, 85.0, 1.8, move=20.0) + body("bent", 8, 85.0, 0.5) + body("stands", 8, 5.0, 0.4) + body("weak", 15, None, 1.8)
    rows += body("legs", 8, 85.0, 1.8, legs_up=True) + body("bed", 8, 85.0, 1.8, allowed=True) + body("toward", 8, 5.0, 0.4, collapsed=True) + body("unsure", 12, 85.0, 1.0) + body("unsure", 8, 85.0, 1.8, start=12.0)
    rows += body("rises", 4, 85.0, 1.8) + body("rises", 1.5, 5.0, 0.4, start=4.0) + body("rises", 4, 85.0, 1.8, start=5.5)
    rows += body("blink", 3, 85.0, 1.8) + body("blink", 0.5, 5.0, 0.4, start=3.0) + body("blink", 4, 85.0, 1.8, start=3.5)
    rows += body("gone", 4, 85.0, 1.8) + body("gone", 4, 85.0, 1.8, start=6.0)
    df = spark.createDataFrame(rows, "who string, t double, cx double, cy double, size double, angle double, aspect double, legs_up boolean, collapsed boolean, allowed boolean")
    got = {}
    for r in sorted(episodes.man_down(df, ["who"]).collect(), key=lambda r: r["t"]):
        got.setdefault(r["who"], []).append((r["status"], r["t"], r["confidence"]))
    assert set(got) == {"lies", "weak", "toward", "unsure", "blink"}
    assert got["lies"][0][0] == "POTENTIAL_VIOLATION" and 5.0 <= got["lies"][0][1] <= 5.8 and len(got["lies"]) == 1
    assert [x[0] for x in got["weak"]] == ["UNVERIFIABLE"] and got["weak"][0][2] == 0.0
    assert [x[0] for x in got["unsure"]] == ["UNVERIFIABLE", "POTENTIAL_VIOLATION"]


def test_a_fall_along_the_line_of_sight(spark):
    stand, fall = (60.0, 80.0, 180.0, 300.0), (20.0, 30.0, 90.0, 310.0)
    rows = [("a", k / 10, *stand, True) for k in range(20)] + [("a", 2 + k / 10, *fall, False) for k in range(150)]
    rows += [("b", k / 10, *fall, False) for k in range(20)] + [("c", k / 10, *stand, True) for k in range(20)] + [("c", 2.0, *[x / 2 for x in stand], False)]
    df = spark.createDataFrame(rows, "who string, t double, torso double, legs double, height double, feet double, upright boolean")
    got = {(r["who"], r["t"]) for r in episodes.collapsed(df, ["who"]).where("collapsed").collect()}
    assert got == {("a", 2 + k / 10) for k in range(150)}  # the measure is kept while nothing upright follows


def test_the_standing_measure_frame_by_frame(spark):
    """A walk over the frames that keeps the last ten seconds of reference frames gives the same."""
    rng = random.Random(2)
    rows, want = [], []
    for who in range(12):
        held, scale = [], 1.0
        for k in range(90):
            if rng.random() < 0.08:
                scale = rng.choice([1.0, 1.0, 0.9, 0.7, 0.5, 0.3])
            t, body = k * rng.choice([0.2, 0.4]) + who if k % 30 else k * 0.5 + who, None
            t = round(max(t, rows[-1][1] + 0.1) if k and rows else t, 3)
            if rng.random() < 0.95:
                body = (60 * scale * rng.uniform(0.8, 1.1), 80 * scale * rng.uniform(0.8, 1.1), 180 * rng.choice([scale, scale**0.5]), 300 + rng.uniform(-30, 30))
            upright = rng.random() < 0.7
            fallen = False
            if body:
                usual = [median(x[i] for x in held) for i in range(1, 5)] if len(held) >= 5 else None
                if usual:
                    torso, legs, box = (body[i] / usual[i] for i in range(3))
                    fallen = torso < 0.5 and torso < 0.8 * box and legs < 0.75 and box < 0.65 and abs(body[3] - usual[3]) < 0.25 * usual[2]
                if upright and not fallen and not (usual and body[2] < 0.85 * usual[2]):
                    held = [x for x in held if t - x[0] <= 10 + 1e-9] + [(t, *body)]
            rows.append((who, t, *(body or (None,) * 4), upright))
            want.append((who, t, fallen))
    df = spark.createDataFrame(rows, "who int, t double, torso double, legs double, height double, feet double, upright boolean")
    got = sorted((r["who"], r["t"], r["collapsed"]) for r in episodes.collapsed(df, ["who"]).collect())
    assert got == sorted(want) and 5 < sum(x[2] for x in want)
    assert episodes.collapsed(df.where("false"), ["who"]).count() == 0


VISIT = "who string, entered double, left double, reason string, ends double"
LOOK = "who string, t double, item string, state string, seen_fraction double, empty_fraction double, recent_fraction double"


def looked(who, t, state, recent=1.0, item="helmet", support=0.95):
    return (who, float(t), item, state, support, support, recent)


def test_entry_outcomes(spark):
    cases = {
        "bare": ([(0, None)], [looked("", 0.5, "ABSENT")], ["POTENTIAL_VIOLATION"]),
        "worn": ([(0, None)], [looked("", 0.5, "PRESENT")], ["COMPLIANT"]),
        "at once": ([(1, None)], [looked("", 1, "PRESENT")], ["COMPLIANT"]),
        "newest differ": ([(0, None)], [looked("", 0.5, "PRESENT", 0.1), looked("", 4, "PRESENT", 0.1)], ["UNVERIFIABLE"]),
        "left": ([(0, 2)], [looked("", 1, "UNVERIFIABLE"), looked("", 2, "ABSENT")], ["UNVERIFIABLE"]),
        "no looks": ([(0, None)], [], ["UNVERIFIABLE"]),
        "weak, then sure": ([(0, None)], [looked("", 1, "ABSENT", support=0.5), looked("", 2, "ABSENT")], ["POTENTIAL_VIOLATION"]),
        "weak to the end": ([(0, None)], [looked("", t, "ABSENT", support=0.5) for t in (1, 3, 5)], ["UNVERIFIABLE"]),
        "one of two": ([(0, None)], [looked("", 1, "PRESENT"), looked("", 1, "ABSENT", item="safety_vest")], ["POTENTIAL_VIOLATION"]),
        "one unclear": ([(0, None)], [looked("", t, "PRESENT") for t in (1, 4)] + [looked("", t, "UNVERIFIABLE", item="safety_vest") for t in (1, 4)], ["UNVERIFIABLE"]),
        "late claim": ([(0, None)], [looked("", 4.5, "PRESENT")], ["COMPLIANT"]),
        "soon again": ([(0, 10), (30, 40), (90, None)], [looked("", t, "ABSENT") for t in (1, 31, 91)], ["POTENTIAL_VIOLATION"] * 2),
        "unsure, again": ([(0, 1), (30, 40)], [looked("", 31, "ABSENT")], ["UNVERIFIABLE", "POTENTIAL_VIOLATION"]),
    }
    visits = [(k, float(a), None if b is None else float(b), "LEFT", 100.0) for k, (v, _, _) in cases.items() for a, b in v]
    looks = [(k, *x[1:]) for k, (_, v, _) in cases.items() for x in v]
    got = {}
    for r in equipment.entry_decisions(spark.createDataFrame(visits, VISIT), spark.createDataFrame(looks, LOOK), ["who"]).orderBy("t").collect():
        got.setdefault(r["who"], []).append((r["status"], json.loads(r["evidence"])["why"], r["decided"]))
    assert {k: [x[0] for x in v] for k, v in got.items()} == {k: v[2] for k, v in cases.items()}
    assert got["one of two"] == [("POTENTIAL_VIOLATION", "no hi-vis vest seen", 1.0)] and got["worn"][0][1] == "hard hat seen" and got["left"][0][1:] == ("left before it could be judged", 2.0)
    assert got["one unclear"][0][1] == "could not be told in time (safety_vest: not seen clearly enough)" and got["newest differ"][0][1] == "could not be told in time (helmet: not in the newest frames)"
    assert got["weak to the end"][0][1:] == ("too little support for a claim", 5.0) and got["no looks"][0][1:] == ("the footage ended", 100.0)


def test_entries_frame_by_frame(spark):
    """Random looks: a walk over each worker's visits and frames says the same."""
    rng, c = random.Random(6), Config()
    visits, looks, want = [], [], []
    for who in map(str, range(25)):
        t, ends, mine = 0.0, 300.0, []
        while t < ends - 20:
            entered = round(t + rng.choice([1, 5, 20]), 1)
            left = round(entered + rng.choice([0.5, 3, 6, 20]), 1)
            mine.append((entered, left if left < ends else None))
            t = left
        frames = {round(x / 2, 1): [(i, rng.choice(["PRESENT", "ABSENT", "UNVERIFIABLE"]), rng.choice([0.5, 0.7, 0.9]), rng.choice([0.5, 0.7]), rng.choice([None, 0.4, 0.8])) for i in ("helmet", "safety_vest")] for x in range(600) if rng.random() < 0.5}
        visits += [(who, a, b, "LEFT", ends) for a, b in mine]
        looks += [(who, x, *v) for x, two in frames.items() for v in two]
        claimed = None
        for a, b in mine:
            if claimed is not None and a - claimed < c.realert_after_s:
                continue
            said = ("UNVERIFIABLE", b if b is not None else ends)
            for x in sorted(frames):
                if x < a or (b is not None and x >= b):
                    continue
                absent = [v[3] for v in frames[x] if v[1] == "ABSENT"]
                if absent and min(absent) >= 0.6:
                    said = ("POTENTIAL_VIOLATION", x)
                elif not absent and all(v[1] == "PRESENT" and (v[4] is None or v[4] >= 0.6) for v in frames[x]) and min(v[2] for v in frames[x]) >= 0.6:
                    said = ("COMPLIANT", x)
                elif x - a < 4 - 1e-9:
                    continue
                else:
                    said = ("UNVERIFIABLE", x)
                break
            want.append((who, a, *said))
            claimed = a if said[0] != "UNVERIFIABLE" else claimed
    got = equipment.entry_decisions(spark.createDataFrame(visits, VISIT), spark.createDataFrame(looks, LOOK).repartition(3), ["who"]).collect()
    assert sorted((r["who"], r["t"], r["status"], r["decided"]) for r in got) == sorted(want) and len({w[2] for w in want}) == 3


def test_continuous_absence(spark):
    def looks(name, *parts):
        rows, k = [], 0
        for state, support, seconds in parts:
            for _ in range(round(seconds * 10)):
                rows.append((name, k / 10, state, support, True))
                k += 1
        return rows

    rows = looks("once", ("PRESENT", 1.0, 1), ("ABSENT", 0.9, 5), ("PRESENT", 1.0, 4))
    rows += looks("unclear between", ("ABSENT", 0.9, 4), ("UNVERIFIABLE", 0.0, 1), ("ABSENT", 0.9, 70))  # one episode
    rows += looks("weak", ("ABSENT", 0.3, 10)) + looks("broken", ("ABSENT", 0.9, 2), (None, None, 0.1), ("ABSENT", 0.9, 2))
    rows += looks("soon again", ("ABSENT", 0.9, 4), ("PRESENT", 1.0, 1), ("ABSENT", 0.9, 80)) + looks("later", ("ABSENT", 0.9, 4), ("PRESENT", 1.0, 60), ("ABSENT", 0.9, 4))
    rows += [(w, t + (3600 if t > 2 else 0), *x) for w, t, *x in looks("out of view", ("ABSENT", 0.9, 4))]
    rows += [(w, t + (1 if t > 1.05 else 0), *x) for w, t, *x in looks("away a moment", ("ABSENT", 0.9, 5))]
    df = spark.createDataFrame(rows, "who string, t double, state string, support double, agrees boolean")
    got = {}
    for r in equipment.continuous(df, ["who"]).collect():
        got.setdefault(r["who"], []).append(r["t"])
    assert {k: sorted(v) for k, v in got.items()} == {"once": [1.0], "unclear between": [0.0], "soon again": [0.0], "later": [0.0, 64.0], "away a moment": [2.1]}


def test_sampling_keeps_changes_and_every_five_seconds():
    rows = [{"t": float(k), "posture": "SITTING" if k < 7 else "WALKING", "sample_id": k} for k in range(12)]
    assert [r["sample_id"] for r in run(Sampler(), rows)] == [0, 5, 7]
