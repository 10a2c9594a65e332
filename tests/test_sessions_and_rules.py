"""Session order and replay, rule keys and references, governance rows, exports: hand-computed cases."""

import datetime as dt

from pyspark.sql import functions as F

from shiftglass.functions import geometry
from shiftglass.operators import frames, governance, platform, records
from shiftglass.sources import sinks
from shiftglass.streaming import session

NOW = "2024-03-01 00:00:00"


def test_a_jump_back_begins_anew_and_what_was_shown_is_replay(spark):
    # 10 fps: 0.0-0.4, back to 0.2-0.6, ahead to 2.0-2.1, back to 1.0 (never shown) and 2.05 (between two shown ones)
    times = [0.0, 0.1, 0.2, 0.3, 0.4, 0.2, 0.3, 0.4, 0.5, 0.6, 2.0, 2.1, 1.0, 2.05]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(times)], "session string, n int, t double")
    got = {r["n"]: r for r in session.replayed(session.generations(df), 10).collect()}
    assert [got[i]["generation"] for i in range(14)] == [0] * 5 + [1] * 7 + [2] * 2
    assert [i for i in range(14) if got[i]["replay"]] == [5, 6, 7, 13]
    arrived = spark.createDataFrame([("s", i, float(i), dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate((0, 1, 9, 10))], "session string, n int, t double, arrived timestamp")
    assert [r["reset"] for r in session.generations(arrived, 5.0).orderBy("n").collect()] == [None, None, "CAMERA_LOST", None]


def test_speed_and_failures(spark):
    df = spark.range(9).withColumnRenamed("id", "frame")
    assert [r["frame"] for r in session.skipped(df, 2.0).orderBy("frame").collect()] == [0, 2, 4, 6, 8]
    assert session.skipped(df, 0.5).count() == 9 and [r["frame"] for r in session.skipped(df, 1.5).orderBy("frame").collect()] == [0, 2, 3, 5, 6, 8]
    runs = spark.createDataFrame([("s", i, f) for i, f in enumerate([True, True, False, True, True, True, False])], "session string, n int, failed boolean")
    assert [r["available"] for r in session.available(runs).orderBy("n").collect()] == [True] * 5 + [False] * 2


def test_helmets_beside_the_person_are_not_worn(spark):
    people = spark.createDataFrame([(1, 1, [200.0, 100.0, 300.0, 400.0]), (1, 2, [280.0, 100.0, 380.0, 400.0])], "frame int, person int, bbox array<double>")
    box = lambda x, y: [x - 10, y - 10, x + 10, y + 10]
    items = [(1, 1, "helmet", box(296.0, 120.0), 0.9), (1, 2, "helmet", box(195.0, 120.0), 0.8), (1, 3, "helmet", box(250.0, 280.0), 0.7)]
    df = spark.createDataFrame([(f, i, c, [float(v) for v in b], x) for f, i, c, b, x in items], "frame int, item int, cls string, item_box array<double>, item_conf double")
    assert [(r["person"], r["conf"]) for r in frames.worn(people, df).collect()] == [(2, 0.9)]


def looks(spark, name, parts):
    rows, k = [], 0
    for posture, score, n in parts:
        for _ in range(n):
            rows.append((name, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), posture, score))
            k += 1
    df = spark.createDataFrame(rows, "track_id string, sample_id int, ts timestamp, posture_state string, activity_score double")
    return frames.evidence(df, 20.0).orderBy("sample_id").collect()[-1]


def test_evidence_is_all_clear_fresh_frames(spark):
    assert looks(spark, "worn", [("STANDING", 90.0, 30)])["state"] == "PRESENT"
    assert looks(spark, "bare", [("STANDING", 0.0, 30)])["state"] == "ABSENT"
    assert looks(spark, "unclear", [("AWAY", 90.0, 30)])["state"] == "UNVERIFIABLE"
    r = looks(spark, "taken off", [("STANDING", 90.0, 13), ("STANDING", 0.0, 8)])  # 21 s: the first is stale
    assert (r["clear_frames"], r["seen_fraction"], r["recent_fraction"], r["mean_conf"], r["state"]) == (21, round(13 / 21, 3), 0.0, 90.0, "PRESENT")
    assert looks(spark, "few", [("AWAY", 90.0, 22), ("STANDING", 90.0, 7)])["state"] == "UNVERIFIABLE"


def test_exits_and_where_people_went(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    leaves = [("in time", 1), ("late", 2), ("elsewhere", 3), ("home", 4), ("by way of", 5), ("stands", 6), ("gone", 7)]
    came = [("in time", 20, "wash"), ("late", 31, "wash"), ("elsewhere", 9, "press2"), ("home", 5, "press"), ("by way of", 4, "walk"), ("by way of", 25, "wash"), ("stands", 40, "wash")]
    kinds = {"wash": "EXIT", "press2": "RESTRICTED", "press": "RESTRICTED", "walk": "APPROACH"}
    got = frames.exit_decisions(
        spark.createDataFrame([(k, i, at(0), "press") for k, i in leaves], "who string, id int, at timestamp, home string"),
        spark.createDataFrame([(k, at(s), z, kinds[z]) for k, s, z in came], "who string, at timestamp, zone string, zone_type string"),
        spark.createDataFrame([("stands", at(30.5)), ("gone", at(12))], "who string, at timestamp"), "who", "wash", 30.0,
    ).collect()
    assert {r["who"]: (r["outcome"], r["status"]) for r in got} == {
        "in time": ("REACHED_EXIT", "COMPLIANT"), "late": ("REACHED_EXIT_LATE", "POTENTIAL_VIOLATION"), "elsewhere": ("OTHER_ZONE", "POTENTIAL_VIOLATION"), "by way of": ("REACHED_EXIT", "COMPLIANT"),
        "stands": ("NOT_REACHED", "POTENTIAL_VIOLATION"), "gone": ("OUT_OF_VIEW", "UNVERIFIABLE"),
    }


def test_bent_and_lying_bodies(spark):
    def pose(hip, shoulder, ankle):
        pts = [(0.0, 0.0, 0.0)] * 17
        for i, p in ((5, shoulder), (6, shoulder), (11, hip), (12, hip), (15, ankle), (16, ankle)):
            pts[i] = (*map(float, p), 0.9)
        return pts

    rows = [("lies", pose((100, 100), (40, 105), (170, 100)), [30.0, 80.0, 180.0, 120.0]), ("bends", pose((100, 100), (50, 90), (100, 180)), [40.0, 60.0, 120.0, 190.0]), ("stands", pose((100, 100), (100, 40), (100, 180)), [80.0, 20.0, 120.0, 190.0])]
    df = spark.createDataFrame(rows, "who string, kp array<struct<x:double,y:double,conf:double>>, box array<double>")
    shaped = df.withColumn("shape", geometry.body_shape(F.col("kp"), F.col("box")))
    got = {r["who"]: (r["s"], r["l"]) for r in shaped.select("who", geometry.posture_note(F.col("shape")).alias("s"), geometry.on_feet(F.col("shape")).alias("l")).collect()}
    assert got == {"lies": ("LYING", False), "bends": ("BENDING", True), "stands": (None, True)}
    stands = shaped.where("who = 'stands'").select("shape", geometry.standing(F.col("shape")).alias("up")).first()
    assert stands["up"] and {k: stands["shape"][k] for k in ("lean", "torso", "legs", "height", "feet", "splay", "drop")} == {"lean": 0.0, "torso": 60.0, "legs": 80.0, "height": 170.0, "feet": 180.0, "splay": 0.0, "drop": 80.0}
    knees = [(0.0, 0.0, 0.0)] * 17
    for i, q in ((5, (100, 40)), (6, (100, 40)), (11, (100, 100)), (12, (100, 100)), (13, (100, 125)), (14, (100, 125))):
        knees[i] = (*map(float, q), 0.9)
    kp = "who string, kp array<struct<x:double,y:double,conf:double>>, box array<double>"
    few = spark.createDataFrame([("knees", knees, [60.0, 20.0, 140.0, 190.0]), ("none", [(0.0, 0.0, 0.0)] * 17, [60.0, 20.0, 140.0, 20.0])], kp).withColumn("s", geometry.body_shape(F.col("kp"), F.col("box")))
    got = {r["who"]: r for r in few.select("who", "s", geometry.on_feet(F.col("s")).alias("l"), geometry.standing(F.col("s")).alias("up"), geometry.posture_note(F.col("s")).alias("n")).collect()}
    assert got["knees"]["l"] is False and got["knees"]["s"]["legs"] is None and got["none"]["l"] is None and not got["none"]["up"] and got["none"]["n"] is None and got["none"]["s"]["height"] is None


def test_slugs_meet_each_other(spark):
    slugs = lambda names: [r["slug"] for r in governance.unique_slugs(spark.createDataFrame(list(enumerate(names)), "id int, name string"), "name", "id").orderBy("id").collect()]
    assert slugs(["a", "A!", "a-1"]) == ["a", "a-1", "a-1-1"]
    assert slugs(["a-1", "a", "a", "a"]) == ["a-1", "a", "a-2", "a-3"]
    assert slugs(["!!", "??", "Acme Ltd."]) == ["org", "-1", "acme-ltd"]


def test_rule_keys_and_references(spark):
    key = records.rule_key(F.col("id"), F.lit("default"), F.lit("PPE_ENTRY"), F.lit("press"), F.lit(records.ENTRY_DEFAULT))
    got = [r[0] for r in spark.createDataFrame([("7",), (None,)], "id string").select(key).collect()]
    import hashlib
    import json

    digest = hashlib.sha1(json.dumps({"required_ppe": ["helmet", "safety_vest"], "mode": "AT_ENTRY"}, sort_keys=True).encode()).hexdigest()[:8]
    assert got == ["7", f"default:PPE_ENTRY:press:{digest}"]
    rules = spark.createDataFrame([("r", {"exit_zone_id": "1", "mode": "2"}, {"lying_allowed_zone_ids": ["1", "9"]})], "rule_id string, params map<string,string>, lists map<string,array<string>>")
    (r,) = records.slug_params(rules, spark.createDataFrame([("1", "wash"), ("2", "gate")], "zone_id string, slug string")).collect()
    assert r["params"] == {"exit_zone_id": "wash", "mode": "2"} and r["lists"] == {"lying_allowed_zone_ids": ["wash", "9"]}


def test_rows_that_change(spark):
    old = spark.createDataFrame([(1, "a", "ann", "ann", None), (2, "b", "ann", "ann", None)], "id int, name string, created_by string, updated_by string, updated_at timestamp")
    got = {r["id"]: r for r in governance.stamped(old, spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, name string"), "bob", NOW).collect()}
    assert [(got[i]["created_by"], got[i]["updated_by"], got[i]["updated_at"] is not None) for i in (1, 2, 3)] == [("ann", "ann", False), ("ann", "bob", True), ("bob", "bob", True)]
    rules = spark.createDataFrame([(1, True, None), (2, True, None)], "id int, enabled boolean, deleted_at timestamp")
    assert {r["id"]: r["enabled"] for r in governance.soft_deleted(rules, [2], NOW).collect()} == {1: True, 2: False}
    kept = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a.jpg"), (2, dt.datetime(2024, 2, 28), "b.jpg"), (3, dt.datetime(2023, 1, 1), None)], "id int, observed_at timestamp, snapshot_ref string")
    refs, rest = governance.without_evidence(kept, NOW, 30)
    assert [r["snapshot_ref"] for r in refs.collect()] == ["a.jpg"] and {r["id"]: r["snapshot_ref"] for r in rest.collect()} == {1: None, 2: "b.jpg", 3: None}


def test_zones_and_organisations_are_made(spark):
    zones = spark.createDataFrame([("c1", "z1", "Press")], "camera_id string, zone_id string, zone_name string")
    wanted = [("c1", "z2", " press ", "EXIT", [1, 2, 3]), ("c1", "z3", "Dock", None, [1, 2, 3]), ("c1", "z4", "dock", "EXIT", [1, 2, 3]), ("c1", "z5", "Wash", "pool", [1, 2, 3]), ("c2", "z6", "Press", "exit", [1, 2]), ("c2", "z7", "", "EXIT", [1, 2, 3]), ("c1", "z1", "PRESS", "EXIT", [1, 2, 3])]
    good, bad = governance.zone_changes(zones, spark.createDataFrame(wanted, "camera_id string, zone_id string, zone_name string, zone_type string, points array<int>"))
    assert {r["zone_id"]: r["zone_type"] for r in good.collect()} == {"z3": "GENERAL", "z1": "EXIT"} or {r["zone_id"] for r in good.collect()} == {"z3", "z1"}
    assert {r["zone_id"]: r["why"] for r in bad.collect()} == {"z2": "name taken", "z4": "name taken", "z5": "unknown type", "z6": "too few points", "z7": "name missing"}
    made = governance.created(spark.createDataFrame([(1, "Acme")], "org_id int, name string"), spark.createDataFrame([(1, "Acme", "x"), (2, "ACME", "eve")], "org_id int, name string, owner string"), NOW)
    assert [(r["org_id"], r["slug"]) for r in made["organisations"].collect()] == [(2, "acme-1")] and {k: v.count() for k, v in made.items()} == {"organisations": 1, "sites": 1, "members": 1, "audit": 1}


def test_what_staff_and_members_see(spark):
    cams = spark.createDataFrame([("c", "rtsp://secret", [1.0]), ("d", " ", None)], "camera_id string, rtsp_url string, homography array<double>")
    assert [tuple(r) for r in platform.safe_cameras(cams).collect()] == [("c", True, True), ("d", False, False)]
    rows = spark.createDataFrame([("ann", "x", dt.datetime(2024, 1, 1, 23)), ("bob", "x", dt.datetime(2024, 1, 2, 1)), ("ann", "y", dt.datetime(2024, 1, 3))], "actor string, action string, at timestamp")
    assert platform.audit(rows, action="x", since="2024-01-01", until="2024-01-01").count() == 1 and platform.audit(rows, actor="ann").count() == 2


def test_reports_as_lines_and_json(spark):
    a = spark.createDataFrame([(2, "=x"), (1, 'say "a,b"')], "n int, name string")
    got = [r["text"] for r in sinks.csv_blocks([("Zones", a), ("None", a.where("false"))]).orderBy("block", "line").collect()]
    assert got == ["Zones", "n,name", '1,"say ""a,b"""', "2,'=x", "", "None", "n,name", ""]
    assert sinks.json_rows(a.withColumn("z", F.lit(None).cast("int")), ["n"], "doc").first()["doc"] == '[{"n":1,"name":"say \\"a,b\\"","z":null},{"n":2,"name":"=x","z":null}]'
