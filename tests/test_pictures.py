"""Postures of ideal poses, windows around small people, boxes shown twice, the report of nothing."""

import json

import pytest
from pyspark.sql import functions as F

from shiftglass.functions import crops, posture
from shiftglass.operators import frames, report

POSE = "who string, kp array<struct<x:double,y:double,conf:double>>, box array<double>, speed double"


def pose(shoulder=100.0, hip=200.0, knee=300.0, ankle=400.0, dx=0.0, foot=0.0, missing=(), knee_dx=0.0):
    """A person seen from the front, 100 px from shoulders to hips; ``dx`` apart at the ankles, ``foot`` sideways."""
    pts = [(0.0, 0.0, 0.0)] * 17
    for name, i, y, half, side in (("shoulder", 5, shoulder, 30, 0), ("hip", 11, hip, 20, 0), ("knee", 13, knee, 20, knee_dx), ("ankle", 15, ankle, 20 + dx, foot)):
        if name not in missing:
            pts[i], pts[i + 1] = (200.0 - half + side, y, 0.9), (200.0 + half + side, y, 0.9)
    return pts


TALL, WIDE = [150.0, 60.0, 250.0, 420.0], [100.0, 60.0, 300.0, 260.0]
CASES = {
    "stands": (pose(), TALL, 0.0, "STANDING"),
    "seated, seen from the front": (pose(knee=212.0, ankle=300.0), TALL, 0.0, "SITTING"),  # the thigh points at the camera
    "seated, from the side": (pose(knee=205.0, ankle=300.0, knee_dx=90.0, foot=90.0), WIDE, 0.0, "SITTING"),
    "seated, rolling": (pose(knee=212.0, ankle=300.0, dx=60.0), TALL, 9.0, "SITTING"),
    "stands at a desk": (pose(missing=("ankle",)), WIDE, 0.0, "STANDING"),
    "seated at a desk": (pose(knee=215.0, missing=("ankle",)), WIDE, 0.0, "SITTING"),
    "walks": (pose(dx=25.0), TALL, 6.0, "WALKING"),
    "slow": (pose(dx=25.0), TALL, 3.0, "STANDING"),
    "feet together": (pose(dx=-10.0), TALL, 6.0, "STANDING"),
    "head and shoulders": (pose(missing=("hip", "knee", "ankle")), WIDE, 0.0, "UNKNOWN"),
    "nothing": ([(0.0, 0.0, 0.0)] * 17, TALL, 9.0, "UNKNOWN"),
    "only hips": (pose(missing=("shoulder", "knee", "ankle")), TALL, 0.0, "UNKNOWN"),
    "knees alone, tall": (pose(missing=("shoulder", "hip", "ankle")), TALL, 0.0, "STANDING"),
    "knees alone, wide": (pose(missing=("shoulder", "hip", "ankle")), WIDE, 0.0, "SITTING"),
}


def test_postures_of_ideal_poses(spark):
    df = spark.createDataFrame([(k, *v[:3]) for k, v in CASES.items()], POSE)
    got = {r["who"]: r["p"] for r in df.select("who", posture.posture(F.col("kp"), F.col("box"), F.col("speed")).alias("p")).collect()}
    assert {k: v["posture"] for k, v in got.items()} == {k: v[3] for k, v in CASES.items()}
    assert (got["stands"]["sits"], got["stands"]["stands"]) == (0.0, 13.6)  # two straight knees and hips, span, drop
    assert (got["seated, seen from the front"]["sits"], got["nothing"]["stands"]) == (16.0, 1.5)  # both thighs short, no drop; a tall box alone is no posture
    one = df.where("who = 'stands'").select(posture.posture(F.col("kp"), F.col("box")).alias("p")).first()["p"]
    assert one["posture"] == "STANDING"


def test_every_cue_has_a_feature(spark):
    df = spark.createDataFrame([("x", *CASES["stands"][:3])], POSE)
    names = df.select(posture.features(posture.joints(F.col("kp")), F.col("box")).alias("f")).select("f.*").columns
    assert {c[0] for c in posture.CUES} <= set(names)


@pytest.mark.parametrize("box, size, win, picture", [
    ([100.0, 100.0, 150.0, 200.0], (640, 360), [85.0, 80.0, 165.0, 208.0], (320, 512)),  # four times at most
    ([0.0, 0.0, 60.0, 300.0], (640, 360), [0.0, 0.0, 78.0, 324.0], (154, 640)),  # cut at the frame
    ([10.0, 10.0, 600.0, 60.0], (640, 360), [0.0, 0.0, 640.0, 64.0], (1280, 128)),  # the long side is bounded
    ([0.0, 0.0, 480.0, 500.0], (480, 640), [0.0, 0.0, 480.0, 540.0], (569, 640)),
    ([10.0, 10.0, 10.5, 60.0], (640, 360), None, None),
    ([700.0, 10.0, 740.0, 60.0], (640, 360), None, None),
])
def test_windows_go_there_and_back(spark, box, size, win, picture):
    df = spark.createDataFrame([(box,)], "box array<double>").withColumn("win", crops.window(F.col("box"), *size)).withColumn("p", crops.scaled(F.col("win")))
    r = df.withColumn("back", crops.to_frame(crops.to_picture(F.col("box"), F.col("win"), F.col("p")), F.col("win"), F.col("p"))).first()
    assert r["win"] == win and (picture is None or (r["p"]["width"], r["p"]["height"]) == picture)
    if win:
        assert r["back"] == pytest.approx(box, abs=1e-9)


def test_close_ups_show_a_helmet_once(spark):
    people = spark.createDataFrame([(1, 1, [100.0, 100.0, 150.0, 200.0]), (1, 2, [130.0, 100.0, 180.0, 200.0]), (1, 3, [0.0, 0.0, 200.0, 400.0])], "frame int, person int, bbox array<double>")
    # the same helmet at (140..150, 100..110) in both windows (a scale of 4); a vest; one of a person who is not small
    at = lambda x0, y0: [(140 - x0) * 4.0, (100 - y0) * 4.0, (150 - x0) * 4.0, (110 - y0) * 4.0]
    found = [(1, 1, "helmet", at(85, 80), 0.6), (1, 2, "helmet", at(115, 80), 0.8), (1, 2, "vest", at(115, 80), 0.5), (1, 3, "helmet", at(0, 0), 0.9)]
    df = frames.found_close_up(people, spark.createDataFrame(found, "frame int, person int, cls string, box array<double>, conf double"), 640, 360)
    assert {(r["person"], r["cls"]): [round(x, 6) for x in r["box"]] for r in df.collect()} == {(1, "helmet"): [140.0, 100.0, 150.0, 110.0], (2, "helmet"): [140.0, 100.0, 150.0, 110.0], (2, "vest"): [140.0, 100.0, 150.0, 110.0]}
    assert {(r["person"], r["cls"]) for r in frames.once_each(df).collect()} == {(2, "helmet"), (2, "vest")}
    # a chain: the middle box goes, so both ends stay
    chain = [(1, 1, "c", [0.0, 0.0, 10.0, 10.0], 0.9), (1, 2, "c", [4.0, 0.0, 14.0, 10.0], 0.8), (1, 3, "c", [8.0, 0.0, 18.0, 10.0], 0.7), (2, 1, "c", [0.0, 0.0, 10.0, 10.0], 0.1)]
    kept = frames.once_each(spark.createDataFrame(chain, "frame int, person int, cls string, box array<double>, conf double"), 0.4)
    assert sorted((r["frame"], r["person"]) for r in kept.collect()) == [(1, 1), (1, 3), (2, 1)]
    assert frames.once_each(df.where("false")).count() == 0


def test_the_report_of_an_empty_window(spark):
    from shiftglass.plans import reports
    from shiftglass.sources import domain

    sf = "/root/testdata/sf0.001"
    none = lambda f: f(spark, sf).where("false")
    doc = report.document(none(domain.decisions), none(domain.safety_events), none(domain.actions), none(domain.zones), none(domain.cameras), "2024-01-01 00:00:00", "2024-01-03 00:00:00", "UTC", reports.TODAY).first()["doc"]
    got = json.loads(doc)
    assert got["headline"]["decisions"] == 0 and got["headline"]["compliance_rate"] is None and got["by_rule"] == [] and got["zone_time"]["average_seconds"] is None
    assert [h["decisions"] for h in got["by_hour"]] == [0] * 24 and [d["day"] for d in got["by_day"]] == ["2024-01-01", "2024-01-02"] and got["events_recorded"] == 0
    assert got["ppe"]["missing_both"] == 0 and got["actions"]["average_days_to_close"] is None and got["zone_time_by_zone"] == []
