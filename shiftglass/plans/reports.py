"""The safety report and summary on the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import report
from ..sources import domain

ORG, SINCE, UNTIL, TODAY, TZ = "org-1", "1996-01-01 00:00:00", "1998-01-01 00:00:00", "1998-01-01", "Asia/Kolkata"
E_SINCE, E_UNTIL = "2024-01-02 00:00:00", "2024-01-25 00:00:00"


def d(s, p):
    return report.window(domain.decisions(s, p), ORG, SINCE, UNTIL)


def e(s, p):
    return report.window(domain.safety_events(s, p), ORG, E_SINCE, E_UNTIL)


QUERIES = {
    "report_headline": lambda s, p: report.headline(d(s, p), e(s, p)),
    "report_review_reasons": lambda s, p: report.review_reasons(d(s, p)),
    "report_by_rule": lambda s, p: report.by_rule(d(s, p)),
    "report_by_zone": lambda s, p: report.by_zone(d(s, p), domain.zones(s, p)),
    "report_by_camera": lambda s, p: report.by_camera(d(s, p), domain.cameras(s, p)),
    "report_breakdown": lambda s, p: report.breakdown(d(s, p), domain.zones(s, p)),
    "report_by_hour": lambda s, p: report.by_hour(d(s, p), TZ),
    "report_by_day": lambda s, p: report.by_day(d(s, p), SINCE, UNTIL, TZ),
    "report_ppe": lambda s, p: report.ppe(d(s, p)),
    "report_zone_time": lambda s, p: report.zone_time(e(s, p), domain.zones(s, p)),
    "report_zone_time_by_zone": lambda s, p: report.zone_time_by_zone(e(s, p), domain.zones(s, p)),
    "report_man_down": lambda s, p: report.man_down(d(s, p)),
    "report_occupancy": lambda s, p: report.occupancy(d(s, p)),
    "report_actions": lambda s, p: report.corrective_actions(domain.actions(s, p).where(F.col("org_id") == ORG), SINCE, UNTIL, TODAY),
    "safety_report": lambda s, p: report.document(d(s, p), e(s, p), domain.actions(s, p).where(F.col("org_id") == ORG), domain.zones(s, p), domain.cameras(s, p), SINCE, UNTIL, TZ, TODAY),
    "safety_summary_headline": lambda s, p: report.summary(d(s, p)),
    "safety_summary_by_zone": lambda s, p: report.by_zone(d(s, p), domain.zones(s, p), 50),
}

D = f"d AS (SELECT * FROM decisions WHERE org_id = '{ORG}' AND observed_at >= TIMESTAMP '{SINCE}' AND observed_at < TIMESTAMP '{UNTIL}')"
EV = f"e AS (SELECT * FROM safety_events WHERE org_id = '{ORG}' AND observed_at >= TIMESTAMP '{E_SINCE}' AND observed_at < TIMESTAMP '{E_UNTIL}')"
FLAG, UNSURE, FINE = "status = 'POTENTIAL_VIOLATION'", "status = 'UNVERIFIABLE'", "status = 'COMPLIANT'"
YES, NO, OPEN = "review_state = 'CONFIRMED'", "review_state = 'DISMISSED'", "review_state = 'PENDING'"


def cnt(**which: str) -> str:
    return ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in which.items())


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


MEASURES = cnt(decisions="true", compliant=FINE, flagged=FLAG, confirmed=f"{FLAG} AND {YES}", dismissed=f"{FLAG} AND {NO}", pending=f"{FLAG} AND {OPEN}", insufficient=UNSURE, insufficient_confirmed=f"{UNSURE} AND {YES}")
NAMED = "n AS (SELECT d.*, CASE WHEN d.zone_id IS NULL THEN 'No zone' ELSE coalesce(zone_name, '(zone no longer available)') END AS zone_name FROM d LEFT JOIN zones USING (zone_id))"
STAYS = f"s AS (SELECT zone_id, zone_name, dwell_s AS s, reason = 'LEFT' AND NOT first_sighting AND NOT in_replay AS timed FROM e JOIN zones USING (zone_id) WHERE event_type = 'EXITED_ZONE' AND zone_type = 'RESTRICTED')"
STAY = f"""count(*) FILTER (timed) AS visits_timed, count(*) FILTER (NOT timed) AS visits_partial, count(*) FILTER (s IS NULL) AS visits_not_timed, {rnd("sum(s) FILTER (timed) / nullif(count(*) FILTER (timed), 0)", 1)} AS average_seconds,
{rnd("max(s) FILTER (timed)", 1)} AS max_seconds, {rnd("max(s) FILTER (NOT timed)", 1)} AS partial_max_seconds, {rnd("max(s)", 1)} AS longest_seen_seconds, arg_max(timed, s * 10 + CAST(timed AS INTEGER) * 0.001) AS longest_seen_is_complete"""
both = {f"{n}_{k}": f"{FLAG} AND outcome = '{o}' AND {c}" for n, o in (("lone_worker", "LONE_WORKER"), ("over_capacity", "OVER_CAPACITY")) for k, c in (("flagged", "true"), ("confirmed", YES), ("dismissed", NO), ("pending", OPEN))}
q = partial(domain.sql)
LOCAL = "observed_at + INTERVAL '5 hours 30 minutes'"
ZONE_SQL = "SELECT zone_id, zone_name, {m} FROM n GROUP BY ALL ORDER BY decisions DESC, zone_id NULLS LAST LIMIT {k}"

ORACLE_SQL = {
    "report_headline": q(
        f"""WITH {D}, {EV}, c AS (SELECT {cnt(decisions="true", compliant=FINE, flagged_by_system=FLAG, insufficient_evidence=UNSURE, confirmed=f"{FLAG} AND {YES}", dismissed=f"{FLAG} AND {NO}", pending=f"{FLAG} AND {OPEN}", insufficient_confirmed=f"{UNSURE} AND {YES}", insufficient_dismissed=f"{UNSURE} AND {NO}")} FROM d)
SELECT *, (SELECT count(*) FROM e) AS events_recorded, {rnd("compliant / nullif(compliant + flagged_by_system, 0)", 4)} AS compliance_rate, {rnd("insufficient_evidence / nullif(decisions, 0)", 4)} AS unverifiable_rate, {rnd("confirmed / nullif(confirmed + dismissed, 0)", 3)} AS confirmed_share_of_reviewed FROM c""",
        "decisions", "safety_events",
    ),
    "report_review_reasons": q(f"WITH {D} SELECT review_state AS state, coalesce(review_reason, 'NONE') AS reason, count(*) AS n FROM d WHERE {YES} OR {NO} GROUP BY ALL", "decisions"),
    "report_by_rule": q(f"WITH {D} SELECT rule_type, {MEASURES} FROM d GROUP BY ALL", "decisions"),
    "report_by_zone": q(f"WITH {D}, {NAMED} " + ZONE_SQL.format(m=MEASURES, k=100), "decisions", "zones"),
    "report_by_camera": q(f"WITH {D} SELECT camera_id, coalesce(camera_name, '(camera no longer available)') AS camera_name, {MEASURES} FROM d LEFT JOIN cameras USING (camera_id) GROUP BY ALL ORDER BY decisions DESC, camera_id LIMIT 100", "decisions", "cameras"),
    "report_breakdown": q(f"WITH {D}, {NAMED} " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {c} AS value, {MEASURES} FROM n GROUP BY ALL" for k, c in (("rule", "rule_type"), ("zone", "zone_name"), ("camera", "camera_id"))), "decisions", "zones"),
    "report_by_hour": q(f"WITH {D} SELECT CAST(h AS INTEGER) AS hour, count(d.id) AS decisions, count(d.id) FILTER ({FLAG}) AS flagged FROM range(24) t(h) LEFT JOIN d ON hour({LOCAL}) = h GROUP BY ALL", "decisions"),
    "report_by_day": q(
        f"WITH {D} SELECT CAST(t.day AS DATE) AS day, count(d.id) AS decisions, count(d.id) FILTER ({FINE}) AS compliant, count(d.id) FILTER ({FLAG}) AS flagged, count(d.id) FILTER ({UNSURE}) AS insufficient FROM generate_series(DATE '1996-01-01', DATE '1998-01-01', INTERVAL 1 DAY) t(day) LEFT JOIN d ON CAST({LOCAL} AS DATE) = t.day GROUP BY ALL",
        "decisions",
    ),
    "report_ppe": q(f"""WITH {D} SELECT {cnt(flagged=FLAG, missing_helmet=f"{FLAG} AND helmet = 'ABSENT'", missing_vest=f"{FLAG} AND vest = 'ABSENT'", missing_both=f"{FLAG} AND helmet = 'ABSENT' AND vest = 'ABSENT'", could_not_verify=UNSURE, compliant=FINE)} FROM d WHERE rule_type IN ('PPE_ENTRY', 'PPE_CONTINUOUS')""", "decisions"),
    "report_zone_time": q(f"WITH {EV}, {STAYS} SELECT {STAY} FROM s", "safety_events", "zones"),
    "report_zone_time_by_zone": q(f"WITH {EV}, {STAYS} SELECT zone_id, zone_name, {STAY} FROM s GROUP BY zone_id, zone_name", "safety_events", "zones"),
    "report_man_down": q(f"""WITH {D} SELECT {cnt(flagged=FLAG, confirmed=f"{FLAG} AND {YES}", dismissed=f"{FLAG} AND {NO}", pending=f"{FLAG} AND {OPEN}", could_not_verify=UNSURE)} FROM d WHERE rule_type = 'MAN_DOWN'""", "decisions"),
    "report_occupancy": q(f"WITH {D} SELECT {cnt(**both, could_not_verify=UNSURE)} FROM d WHERE rule_type = 'OCCUPANCY'", "decisions"),
    "report_actions": q(
        f"""WITH a AS (SELECT *, status IN ('OPEN', 'IN_PROGRESS') AS live, status = 'CLOSED' AND closed_on >= DATE '1996-01-01' AND closed_on < DATE '1998-01-01' AS shut FROM actions WHERE org_id = '{ORG}')
SELECT {cnt(opened="created_on >= DATE '1996-01-01' AND created_on < DATE '1998-01-01'", closed="shut", open="live", overdue=f"live AND due_on < DATE '{TODAY}'")}, {rnd("avg(closed_on - created_on) FILTER (shut)", 1)} AS average_days_to_close FROM a""",
        "actions",
    ),
    "safety_summary_headline": q(
        f"""WITH {D}, c AS (SELECT {cnt(total="true", compliant=FINE, potential_violations=FLAG, abstentions=UNSURE, open_alerts=f"{FLAG} AND {OPEN}", confirmed=f"{FLAG} AND {YES}", dismissed=f"{FLAG} AND {NO}")} FROM d)
SELECT *, {rnd("confirmed / nullif(confirmed + dismissed, 0)", 3)} AS confirmed_share_of_reviewed FROM c""",
        "decisions",
    ),
    "safety_summary_by_zone": q(f"WITH {D}, {NAMED} " + ZONE_SQL.format(m=MEASURES, k=50), "decisions", "zones"),
}

LISTED = "'decisions': decisions, 'compliant': compliant, 'flagged': flagged, 'insufficient_evidence': insufficient, 'confirmed': confirmed, 'dismissed': dismissed, 'pending': pending"
HEAD = ", ".join(f"'{c}': {c}" for c in ("decisions", "compliant", "flagged_by_system", "insufficient_evidence", "confirmed", "dismissed", "pending", "insufficient_confirmed", "insufficient_dismissed", "compliance_rate", "unverifiable_rate", "confirmed_share_of_reviewed"))
STAYED = ", ".join(f"'{c}': {c}" for c in ("visits_timed", "visits_partial", "visits_not_timed", "average_seconds", "max_seconds", "partial_max_seconds", "longest_seen_seconds", "longest_seen_is_complete"))


def _objects(name: str, fields: str, order: str) -> str:
    return f"(SELECT coalesce(list({{{fields}}} ORDER BY {order}), []) FROM ({ORACLE_SQL[name]}))"


def _object(name: str, fields: str = "") -> str:
    return f"(SELECT {'{' + fields + '}' if fields else 't'} FROM ({ORACLE_SQL[name]}) t)"


MOST = "flagged DESC, decisions DESC"
ORACLE_SQL["safety_report"] = f"""SELECT to_json({{
'headline': {_object("report_headline", f"'since': '{SINCE}', 'until': '{UNTIL}', 'time_zone': '{TZ}', {HEAD}")},
'review_reasons': {_objects("report_review_reasons", "'state': state, 'reason': reason, 'count': n", "state, n DESC, reason")},
'by_rule': {_objects("report_by_rule", f"'rule_type': rule_type, {LISTED}", f"{MOST}, rule_type")},
'by_zone': {_objects("report_by_zone", f"'zone': zone_name, {LISTED}", f"{MOST}, zone_name, zone_id")},
'by_camera': {_objects("report_by_camera", f"'camera': camera_name, {LISTED}", f"{MOST}, camera_name, camera_id")},
'by_hour': {_objects("report_by_hour", "'hour': hour, 'decisions': decisions, 'flagged': flagged", "hour")},
'by_day': {_objects("report_by_day", "'day': day, 'decisions': decisions, 'compliant': compliant, 'flagged': flagged, 'insufficient': insufficient", "day")},
'ppe': {_object("report_ppe")}, 'man_down': {_object("report_man_down")}, 'occupancy': {_object("report_occupancy")},
'zone_time': {_object("report_zone_time", STAYED)}, 'zone_time_by_zone': {_objects("report_zone_time_by_zone", f"'zone_name': zone_name, {STAYED}", "longest_seen_seconds DESC NULLS LAST, zone_id")},
'events_recorded': {_object("report_headline", "'n': events_recorded").replace("SELECT {'n': events_recorded}", "SELECT events_recorded")}, 'actions': {_object("report_actions")}
}})::VARCHAR AS doc"""
