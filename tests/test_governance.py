"""Rules, roles, configuration, reviews, expressions and sinks."""

import pytest
from pyspark.sql import functions as F

from shiftglass import config
from shiftglass.functions import geometry as g, texts
from shiftglass.operators import evaluation, frames, governance, platform
from shiftglass.sources import sinks

ZONES = {"press": "RESTRICTED", "gate": "PPE_CHECKPOINT", "walk": "APPROACH", "wash": "EXIT", "lawn": "GENERAL"}


@pytest.mark.parametrize(
    "kind, zone, params, ok",
    [
        ("PPE_ENTRY", "press", {}, True), ("PPE_ENTRY", "gate", {}, False), ("PPE_ENTRY", "press", {"required_ppe": []}, False), ("PPE_ENTRY", "press", {"mode": "VIA_CHECKPOINT"}, False),
        ("PPE_ENTRY", "press", {"mode": "VIA_CHECKPOINT", "checkpoint_zone_id": "gate"}, True), ("MAX_DWELL", "walk", {}, False), ("MAX_DWELL", "walk", {"max_seconds": 9}, False), ("MAX_DWELL", "walk", {"max_seconds": 10}, True),
        ("MAX_DWELL", "lawn", {"max_seconds": 60}, False), ("REQUIRED_EXIT", "press", {"exit_zone_id": "wash"}, True), ("REQUIRED_EXIT", "press", {"exit_zone_id": "gate"}, False), ("OCCUPANCY", "walk", {}, False),
        ("OCCUPANCY", "walk", {"min_people": 3, "max_people": 2}, False), ("OCCUPANCY", "walk", {"max_people": 0}, True), ("OCCUPANCY", "walk", {"min_people": True}, False), ("MAN_DOWN", None, {}, True), ("MAN_DOWN", None, {"min_seconds_down": 2}, False), ("DANCE", "press", {}, False),
    ],
)
def test_rule_parameters(kind, zone, params, ok):
    good, bad = governance.parse_rules([{"id": 1, "type": kind, "zone_id": zone, "params": params}], ZONES)
    assert (len(good), len(bad)) == ((1, 0) if ok else (0, 1))


def test_roles_fail_closed():
    assert governance.can("ADMIN", "org.settings") and not governance.can("MANAGER", "org.settings")
    assert not governance.can(None, "dashboard.view") and not governance.can("ADMIN", "typo")


def test_config_keeps_defaults_of_bad_values_and_pairs():
    c, wrong = config.load({"SAFETY_ENTER_CONFIRM_S": "0.9", "SAFETY_EXIT_CONFIRM_S": "x", "SAFETY_LOST_GRACE_S": "9"})
    assert c.enter_confirm_s == 0.9 and c.exit_confirm_s == 1.0 and c.lost_grace_s == 5.0 and len(wrong) == 2


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_polygon_edges_are_outside(spark):
    tri = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (0, 10))])
    at = lambda x, y: g.inside_polygon(F.lit(float(x)), F.lit(float(y)), tri)
    assert tuple(one(spark, at(2, 2).alias("a"), at(5, 5).alias("b"), at(0, 3).alias("c"), at(8, 8).alias("d"))) == (True, False, False, False)


def test_posture_expressions(spark):
    points = {5: (0, 0), 6: (2, 0), 11: (0, 10), 12: (2, 10)}
    kp = F.array(*[F.struct(F.lit(float(points.get(i, (0, 0))[0])).alias("x"), F.lit(float(points.get(i, (0, 0))[1])).alias("y"), F.lit(0.9 if i in points else 0.1).alias("conf")) for i in range(17)])
    box = F.array(*[F.lit(float(v)) for v in (0, 0, 30, 10)])
    r = one(spark, g.torso_angle(kp).alias("angle"), g.skeleton(kp)["knee"].alias("none"), g.skeleton(kp)["shoulder"].alias("mid"), g.iou(box, box).alias("same"))
    assert r["angle"] < 10 and r["none"] is None and r["mid"]["x"] == 1.0 and r["same"] == 1.0


def test_text_expressions(spark):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    r = one(spark, texts.duration(F.lit(65.2)).alias("d"), texts.recorded_at(F.lit("1999-01-01"), now).alias("old"), texts.recorded_at(F.lit("2024-04-30T10:00:00Z"), now).alias("ok"), texts.json_number(F.lit('{"a": "x"}'), "$.a").alias("n"), texts.finite(F.lit(float("nan"))).alias("nan"))
    assert r["d"] == "1 min 5 s" and r["old"] is None and r["ok"] is not None and r["n"] is None and r["nan"] is None


def test_wilson_upper_uses_the_rule_of_three_for_none(spark):
    r = one(spark, evaluation.wilson_upper(F.lit(0), F.lit(300)).alias("none"), evaluation.wilson_upper(F.lit(6), F.lit(321)).alias("some"))
    assert r["none"] == 0.01 and 0.03 < r["some"] < 0.05


def test_greedy_matches_take_each_truth_once(spark):
    box = lambda x: [float(x), 0.0, float(x + 10), 10.0]
    pred = spark.createDataFrame([("i", 0, 1, 0.9, box(0)), ("i", 0, 2, 0.8, box(1)), ("i", 0, 3, 0.7, box(50))], "image string, cls int, pred long, conf double, pred_box array<double>")
    truth = spark.createDataFrame([("i", 0, 7, box(1)), ("i", 0, 8, box(51))], "image string, cls int, truth long, true_box array<double>")
    assert {(r["pred"], r["truth"]) for r in frames.match_truth(pred, truth).collect()} == {(1, 7), (3, 8)}


def test_schedules_jump_over_missed_runs(spark):
    d = lambda x: F.lit(x).cast("date")
    r = one(spark, platform.schedule_runs(d("2024-01-01"), d("2024-01-20"), F.lit(7)).alias("n"), platform.term_end(d("2024-01-31"), F.lit("MONTHLY")).alias("m"))
    assert r["n"] == 3 and str(r["m"]) == "2024-02-29"


def test_repeated_appends_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    for _ in range(2):
        sinks.append_new(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_days_are_replaced_alone(spark, tmp_path):
    make = lambda day, n: spark.createDataFrame([(f"{day} 10:00:00", n)], "bucket_start string, n long").withColumn("bucket_start", F.to_timestamp("bucket_start"))
    sinks.replace_days(make("2024-01-01", 1).unionByName(make("2024-01-02", 1)), f"{tmp_path}/b")
    sinks.replace_days(make("2024-01-02", 5), f"{tmp_path}/b")
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/b").collect()) == [1, 5]


def test_label_lines_become_boxes(spark, tmp_path):
    (tmp_path / "img7.txt").write_text("1 0.5 0.5 0.2 0.4\nbad line\n")
    (r,) = sinks.yolo_labels(spark, str(tmp_path), 100, 50).collect()
    assert (r["image"], r["cls"], r["bbox"]) == ("img7", 1, [40.0, 15.0, 60.0, 35.0])
