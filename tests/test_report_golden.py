"""The hand-computed week: sixteen decisions, their events and actions, and every figure of the report."""

import datetime as dt
import json

import pytest

from shiftglass.operators import report

DAY = dt.datetime(2024, 5, 6)
SINCE, UNTIL, TODAY = "2024-05-01 00:00:00", "2024-05-08 00:00:00", "2024-05-07"


def ppe(helmet, vest):
    return json.dumps({"items": {"helmet": {"state": helmet}, "safety_vest": {"state": vest}}})


def told(outcome):
    return json.dumps({"outcome": outcome})


P, A, U = "PRESENT", "ABSENT", "UNVERIFIABLE"
FLAG, FINE = "POTENTIAL_VIOLATION", "COMPLIANT"
DECISIONS = [
    *[("A", "Press", "PPE_ENTRY", FINE, "NOT_REQUIRED", None, 9, ppe(P, P))] * 3,
    ("A", "Press", "PPE_ENTRY", FLAG, "CONFIRMED", "CORRECT", 10, ppe(A, P)),
    ("A", "Press", "PPE_ENTRY", FLAG, "DISMISSED", "PPE_PRESENT", 10, ppe(A, A)),
    ("B", "Furnace", "PPE_ENTRY", FLAG, "PENDING", None, 10, ppe(P, A)),
    ("A", "Press", "PPE_ENTRY", U, "CONFIRMED", "CORRECT", 10, ppe(U, P)),
    ("A", "Press", "PPE_CONTINUOUS", FLAG, "PENDING", None, 10, ppe(A, P)),
    ("A", "Press", "MAX_DWELL", FINE, "NOT_REQUIRED", None, 10, told("WITHIN_LIMIT")),
    ("A", "Press", "MAX_DWELL", FLAG, "CONFIRMED", "CORRECT", 10, told("EXCEEDED")),
    ("B", None, "MAN_DOWN", FLAG, "CONFIRMED", "CORRECT", 14, told("LYING_STILL")),
    ("B", None, "MAN_DOWN", FLAG, "DISMISSED", "OTHER", 14, told("LYING_STILL")),
    ("B", None, "MAN_DOWN", U, "DISMISSED", "BAD_PICTURE", 14, told("UNCLEAR")),
    ("B", "Furnace", "OCCUPANCY", FLAG, "PENDING", None, 14, told("LONE_WORKER")),
    ("B", "Furnace", "OCCUPANCY", FLAG, "CONFIRMED", "CORRECT", 14, told("OVER_CAPACITY")),
    ("B", "Furnace", "OCCUPANCY", U, "NOT_REQUIRED", None, 14, told("CROWDED")),
]
LEFT = {"reason": "LEFT"}
EVENTS = [
    *[("Press", "EXITED_ZONE", LEFT | {"dwell_s": s}) for s in (60, 120, 30)],
    ("Press", "EXITED_ZONE", LEFT | {"dwell_s": 500, "first_sighting": True}),
    ("Press", "EXITED_ZONE", {"reason": "LOST", "dwell_s": 40, "unverifiable": True}),
    ("Press", "EXITED_ZONE", LEFT | {"dwell_s": 99, "visit_started_in_replay": True}),
    ("Dock", "EXITED_ZONE", LEFT | {"dwell_s": 1000}),
    ("Furnace", "EXITED_ZONE", LEFT | {"dwell_s": 90}),
    ("Dock", "ENTERED_ZONE", {}),
    ("Dock", "ENTERED_ZONE", {}),
]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, "org", c, z, r, s, v, why, DAY + dt.timedelta(hours=h, minutes=10), e) for i, (c, z, r, s, v, why, h, e) in enumerate(DECISIONS)]
    old = DAY - dt.timedelta(days=40)
    rows += [(90, "org", "A", "Press", "PPE_ENTRY", FLAG, "PENDING", None, old, ppe(A, A)), (91, "other", "A", "Press", "PPE_ENTRY", FLAG, "PENDING", None, DAY, ppe(A, A))]
    d = spark.createDataFrame(rows, "id long, org_id string, camera_id string, zone_id string, rule_type string, status string, review_state string, review_reason string, observed_at timestamp, evidence string")
    events = [("org", z, k, json.dumps(x), DAY) for z, k, x in EVENTS] + [("org", "Press", "EXITED_ZONE", json.dumps(LEFT | {"dwell_s": 5000}), old), ("other", "Press", "EXITED_ZONE", json.dumps(LEFT | {"dwell_s": 7}), DAY)]
    e = spark.createDataFrame(events, "org_id string, zone_id string, event_type string, details string, observed_at timestamp")
    day = dt.date(2024, 5, 7)
    ago = lambda n: None if n is None else day - dt.timedelta(days=n)
    acts = [("OPEN", 1, 2, None), ("IN_PROGRESS", -1, 2, None), ("CLOSED", 0, 3, 1), ("CLOSED", 0, 5, 2), ("CANCELLED", 0, 2, 1), ("OPEN", -1, 40, None), ("CLOSED", 0, 40, 30)]
    a = spark.createDataFrame([("org", s, ago(due), ago(made), ago(shut)) for s, due, made, shut in acts], "org_id string, status string, due_on date, created_on date, closed_on date")
    zones = spark.createDataFrame([("Press", "Press line", "RESTRICTED"), ("Dock", "Dock", "APPROACH"), ("Furnace", "Furnace", "RESTRICTED")], "zone_id string, zone_name string, zone_type string")
    cameras = spark.createDataFrame([("A", "Cam A"), ("B", "Cam B")], "camera_id string, camera_name string")
    return report.report(d, e, a, zones, cameras, "org", SINCE, UNTIL, "UTC", TODAY)


def only(parts, name):
    return parts[name].first().asDict()


def test_headline(parts):
    assert only(parts, "headline") == {
        "decisions": 16, "compliant": 4, "flagged_by_system": 9, "insufficient_evidence": 3, "confirmed": 4, "dismissed": 2, "pending": 3, "insufficient_confirmed": 1, "insufficient_dismissed": 1,
        "events_recorded": 10, "compliance_rate": 0.3077, "unverifiable_rate": 0.1875, "confirmed_share_of_reviewed": 0.667,
    }


def test_reasons(parts):
    assert {(r["state"], r["reason"]): r["n"] for r in parts["review_reasons"].collect()} == {("CONFIRMED", "CORRECT"): 5, ("DISMISSED", "PPE_PRESENT"): 1, ("DISMISSED", "OTHER"): 1, ("DISMISSED", "BAD_PICTURE"): 1}


def test_breakdowns(parts):
    measures = ("decisions", "compliant", "flagged", "confirmed", "dismissed", "pending", "insufficient")
    assert {r["rule_type"]: tuple(r[m] for m in measures) for r in parts["by_rule"].collect()} == {
        "PPE_ENTRY": (7, 3, 3, 1, 1, 1, 1), "PPE_CONTINUOUS": (1, 0, 1, 0, 0, 1, 0), "MAX_DWELL": (2, 1, 1, 1, 0, 0, 0), "MAN_DOWN": (3, 0, 2, 1, 1, 0, 1), "OCCUPANCY": (3, 0, 2, 1, 0, 1, 1),
    }
    assert {r["zone_name"]: (r["decisions"], r["flagged"]) for r in parts["by_zone"].collect()} == {"Press line": (9, 4), "Furnace": (4, 3), "No zone": (3, 2)}
    assert {r["camera_name"]: (r["decisions"], r["flagged"]) for r in parts["by_camera"].collect()} == {"Cam A": (9, 4), "Cam B": (7, 5)}


def test_times(parts, spark):
    hours = {r["hour"]: (r["decisions"], r["flagged"]) for r in parts["by_hour"].collect()}
    assert len(hours) == 24 and {h: v for h, v in hours.items() if v[0]} == {9: (3, 0), 10: (7, 5), 14: (6, 4)}
    days = {str(r["day"]): r["decisions"] for r in parts["by_day"].collect()}
    assert len(days) == 7 and days["2024-05-06"] == 16 and sum(days.values()) == 16


def test_equipment_and_incidents(parts):
    assert only(parts, "ppe") == {"flagged": 4, "missing_helmet": 3, "missing_vest": 2, "missing_both": 1, "could_not_verify": 1, "compliant": 3}
    m = only(parts, "man_down")
    assert (m["flagged"], m["confirmed"], m["dismissed"], m["could_not_verify"]) == (2, 1, 1, 1)
    o = only(parts, "occupancy")
    assert (o["lone_worker_flagged"], o["lone_worker_pending"], o["over_capacity_flagged"], o["over_capacity_confirmed"], o["could_not_verify"]) == (1, 1, 1, 1, 1)


def test_time_in_zones(parts):
    z = only(parts, "zone_time")
    assert (z["visits_timed"], z["visits_partial"], z["average_seconds"], z["max_seconds"], z["partial_max_seconds"], z["longest_seen_seconds"], z["longest_seen_is_complete"]) == (4, 3, 75.0, 120.0, 500.0, 500.0, False)
    by = {r["zone_name"]: (r["visits_timed"], r["average_seconds"], r["max_seconds"], r["visits_partial"], r["longest_seen_seconds"]) for r in parts["zone_time_by_zone"].collect()}
    assert by == {"Press line": (3, 70.0, 120.0, 3, 500.0), "Furnace": (1, 90.0, 90.0, 0, 90.0)}


def test_actions(parts):
    assert only(parts, "actions") == {"opened": 5, "closed": 2, "open": 3, "overdue": 1, "average_days_to_close": 2.5}
