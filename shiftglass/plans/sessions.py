"""Session order, changed rows and platform views on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import governance, platform
from ..sources import domain
from ..sources.domain import sql
from ..sources.sinks import kept_table
from ..streaming import session
from . import live

NOW = "1998-06-01 00:00:00"
D, E, O = domain.decisions, domain.safety_events, domain.organisations


def shown(s, p):
    """Frames at ten a second, four minutes a session, that jump back or ahead every thirty frames."""
    e = F.col("event_id")
    t = F.pmod(e + F.floor(e / 30) * 47 - F.floor(e / 90) * 160, F.lit(2400)) / 10
    return domain.read(s, p, "events").select(domain.numbered("cam-", F.floor(e / 1000)).alias("session"), e.alias("n"), t.alias("t"))


def replayed(s, p):
    return session.replayed(session.generations(shown(s, p)), 10.0).select("session", "n", "generation", "replay")


def footage(s, p):
    """Every session's frames as they are shown: most of it once, then back to see what was skipped and some minutes again."""
    return shown_again(live.presence(s, p))


def shown_again(presence):
    times = presence.select("session", "t").distinct()
    minute = F.floor(F.col("t") / 60)
    skipped = minute % 7 == 3
    twice = times.where(~skipped).withColumn("turn", F.lit(0)).unionByName(times.where(skipped | (minute % 3 == 1)).withColumn("turn", F.lit(1)))
    return twice.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("turn", "t")).cast("long")).select("session", "n", "t")


def told(s, p):
    here = kept_table(live.presence(s, p))
    frames = kept_table(shown_again(here))
    shown = lambda df: df.join(frames, ["session", "t"]).drop("t")
    seen = shown(here.withColumn("clear", F.substring("worker", -1, 1) != "7"))
    return session.records(frames, seen, shown(live.looks(s, p, here)), shown(live.bodies(s, p, here)), fps=2.0, dwell={"click": 5.0}, entry=["view", "purchase"], least=2)


def told_events(s, p):
    here = kept_table(live.presence(s, p))
    frames = kept_table(shown_again(here))
    return session.records(frames, here.join(frames, ["session", "t"]).drop("t").withColumn("clear", F.lit(True)), fps=2.0, dwell={"click": 5.0})


def changed(s, p):
    old = O(s, p).select(F.col("org_id").alias("id"), "name", "plan", F.lit("ann").alias("created_by"), F.lit("ann").alias("updated_by"), F.lit("1998-01-01").cast("timestamp").alias("updated_at")).where("id % 4 <> 0")
    new = O(s, p).select(F.col("org_id").alias("id"), "name", F.when(F.col("org_id") % 3 == 1, "FREE").otherwise(F.col("plan")).alias("plan"))
    return governance.stamped(old, new, "bob", NOW)


def trail(s, p):
    return E(s, p).select("id", F.col("worker_key").alias("actor"), F.col("event_type").alias("action"), F.col("observed_at").alias("at"))


def cameras(s, p):
    k = F.col("r_regionkey")
    return domain.read(s, p, "region").select(k.alias("camera_id"), F.when(k % 2 == 0, F.concat(F.lit("rtsp://"), "r_name")).otherwise(" ").alias("rtsp_url"), F.when(k % 3 == 0, F.array(F.lit(1.0))).alias("homography"))


QUERIES = {
    "replayed_frames": replayed,
    "session_records": told,
    "session_events": told_events,
    "played_frames": lambda s, p: session.skipped(domain.read(s, p, "events").select(F.col("event_id").alias("frame")), 2.5),
    "stamped_rows": lambda s, p: changed(s, p).select("id", "plan", "created_by", "updated_by", "updated_at"),
    "purged_evidence": lambda s, p: governance.without_evidence(D(s, p), NOW, 60)[0],
    "kept_evidence": lambda s, p: governance.without_evidence(D(s, p), NOW, 60)[1].select("id", "snapshot_ref"),
    "platform_audit": lambda s, p: platform.audit(trail(s, p), "REAPPEARED", None, "2024-01-05", "2024-01-12"),
    "safe_cameras": lambda s, p: platform.safe_cameras(cameras(s, p)),
}

ORACLE_SQL = {
    "replayed_frames": """WITH f AS (SELECT 'cam-' || CAST(floor(event_id / 1000) AS BIGINT) AS session, event_id AS n, CAST(((event_id + CAST(floor(event_id / 30) AS BIGINT) * 47 - CAST(floor(event_id / 90) AS BIGINT) * 160) % 2400 + 2400) % 2400 AS BIGINT) / 10 AS t FROM events),
j AS (SELECT *, CAST(coalesce(t < lag(t) OVER (PARTITION BY session ORDER BY n), false) AS INT) AS back FROM f),
g AS (SELECT session, n, t, sum(back) OVER (PARTITION BY session ORDER BY n) AS generation FROM j),
h AS (SELECT *, lag(t) OVER (PARTITION BY session, generation ORDER BY n) AS b FROM g),
k AS (SELECT session, n, CASE WHEN t - b <= 0.15 + 1e-9 THEN b ELSE t END AS a, t AS z FROM h)
SELECT g.session, g.n, CAST(g.generation AS BIGINT) AS generation, EXISTS (SELECT 1 FROM k WHERE k.session = g.session AND k.n < g.n AND g.t BETWEEN k.a - 1e-9 AND k.z + 1e-9) AS replay FROM g""",
    "played_frames": "SELECT event_id AS frame FROM events WHERE event_id = 0 OR floor(event_id / 2.5::DOUBLE) > floor((event_id - 1) / 2.5::DOUBLE)",
    "stamped_rows": sql(f"""SELECT org_id AS id, CASE WHEN org_id % 3 = 1 THEN 'FREE' ELSE plan END AS plan, CASE WHEN org_id % 4 = 0 THEN 'bob' ELSE 'ann' END AS created_by,
CASE WHEN org_id % 4 = 0 OR (org_id % 3 = 1 AND plan <> 'FREE') THEN 'bob' ELSE 'ann' END AS updated_by, CASE WHEN org_id % 4 = 0 OR (org_id % 3 = 1 AND plan <> 'FREE') THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '1998-01-01' END AS updated_at FROM organisations""", "organisations"),
    "purged_evidence": sql(f"SELECT id, snapshot_ref FROM decisions WHERE snapshot_ref IS NOT NULL AND observed_at < TIMESTAMP '{NOW}' - INTERVAL 60 DAY", "decisions"),
    "kept_evidence": sql(f"SELECT id, CASE WHEN NOT (snapshot_ref IS NOT NULL AND observed_at < TIMESTAMP '{NOW}' - INTERVAL 60 DAY) THEN snapshot_ref END AS snapshot_ref FROM decisions", "decisions"),
    "platform_audit": sql("SELECT id, worker_key AS actor, event_type AS action, observed_at AS at FROM safety_events WHERE event_type = 'REAPPEARED' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-13'", "safety_events"),
    "safe_cameras": "SELECT r_regionkey AS camera_id, r_regionkey % 2 = 0 AS has_rtsp_url, r_regionkey % 3 = 0 AS is_calibrated FROM region",
}

#: The footage frame by frame: a jump back begins a generation, a time shown before is a replay; zone visits are walked within each generation.
FOOTAGE = live.PRESENCE.replace("pres AS", "pres0 AS", 1) + """, times AS (SELECT DISTINCT session, t, floor(t / 60) AS m FROM pres0),
shown AS (SELECT session, t, row_number() OVER (PARTITION BY session ORDER BY turn, t) AS n FROM (SELECT *, 0 AS turn FROM times WHERE m % 7 <> 3 UNION ALL SELECT *, 1 FROM times WHERE m % 7 = 3 OR m % 3 = 1)),
jumps AS (SELECT *, coalesce(t < lag(t) OVER (PARTITION BY session ORDER BY n), false) AS jump, row_number() OVER (PARTITION BY session, t ORDER BY n) > 1 AS replay FROM shown),
ft AS (SELECT *, sum(CAST(jump AS INT)) OVER (PARTITION BY session ORDER BY n) AS generation FROM jumps),
pres AS (SELECT DISTINCT f.session || '/' || generation AS session, worker, f.t, zone FROM pres0 p JOIN ft f ON f.session = p.session AND f.t = p.t)"""
_VISITS = live.ZONE_VISITS.replace(live.PRESENCE, FOOTAGE, 1).replace("\n DWELL)", "\n" + live.DWELL + ")")
ORACLE_SQL["session_events"] = f"""WITH RECURSIVE telemetry AS ({domain.VIEWS["telemetry"]}), {_VISITS},
fr AS (SELECT session || '/' || generation AS part, session, generation, n, t, replay FROM ft),
mo AS (SELECT part, t, min(n) AS n, arg_min(replay, n) AS replay FROM fr GROUP BY ALL),
pa AS (SELECT part, session, generation, min(n) AS opens, max(n) FILTER (NOT replay) AS fresh, max(t) AS ends FROM fr GROUP BY ALL),
pn AS (SELECT *, lead(opens) OVER (PARTITION BY session ORDER BY generation) AS next FROM pa),
hd AS (SELECT u.session AS part, u.worker, u.heard, u.rank, u.event_type, u.zone_id, round(u.t, 6) AS t, u.details, isinf(u.heard) AS closes, u.heard - 1e-6 AS since FROM un u WHERE other),
hf AS (SELECT h.*, f.n AS fn, f.replay AS fr, f.t AS ft FROM hd h ASOF LEFT JOIN mo f ON f.part = h.part AND f.t >= h.since),
hn AS (SELECT h.*, session, generation, next, fresh, ends, CASE WHEN closes THEN next ELSE fn END AS n, NOT closes AND fr AS replay FROM hf h JOIN pn ON pn.part = h.part),
vi AS (SELECT *, count(*) FILTER (event_type = 'ENTERED_ZONE') OVER w AS visit FROM hn WINDOW w AS (PARTITION BY part, worker ORDER BY heard, rank, t, event_type ROWS UNBOUNDED PRECEDING)),
bg AS (SELECT *, bool_or(replay) FILTER (event_type = 'ENTERED_ZONE') OVER v AS partial, max(n) FILTER (event_type = 'ENTERED_ZONE') OVER v AS began FROM vi WINDOW v AS (PARTITION BY part, worker, visit)),
sp AS (SELECT *, CASE WHEN closes THEN NOT coalesce(partial, false) OR coalesce(fresh > began, false) ELSE NOT replay END AS spoken,
 CASE WHEN coalesce(partial, false) AND NOT replay THEN left(said, length(said) - 1) || CASE WHEN length(said) > 2 THEN ',' ELSE '' END || '"visit_started_in_replay":true}}' ELSE said END AS told
 FROM (SELECT *, CASE WHEN closes AND next IS NOT NULL THEN replace(details, 'SESSION_END', 'TIME_REGRESSED') ELSE details END AS said FROM bg)),
ck AS (SELECT * FROM bg WHERE zone_id = 'click'),
ov AS (SELECT * FROM ck WHERE event_type = 'DWELL_EXCEEDED' AND NOT replay AND NOT closes),
vs AS (SELECT part, worker, visit, max(t) FILTER (event_type = 'ENTERED_ZONE' AND NOT replay) AS entered, max(CAST(details LIKE '%first_sighting%' AS INT)) FILTER (event_type = 'ENTERED_ZONE' AND NOT replay) AS sighted,
 max(heard) FILTER (event_type = 'EXITED_ZONE' AND NOT replay AND NOT closes) AS left_heard, max(t) FILTER (event_type = 'EXITED_ZONE' AND NOT replay AND NOT closes) AS left_t, max(details ->> 'reason') FILTER (event_type = 'EXITED_ZONE' AND NOT replay AND NOT closes) AS reason,
 max(t) FILTER (event_type = 'EXITED_ZONE') AS closed, any_value(ends) AS ends, any_value(next) AS next FROM ck GROUP BY ALL),
vl AS (SELECT *, lead(visit) OVER (PARTITION BY part, worker ORDER BY visit) AS again FROM vs WHERE entered IS NOT NULL),
dw AS (SELECT v.*, CASE WHEN left_heard IS NULL THEN 'INCOMPLETE' WHEN reason = 'LOST' THEN 'LOST' WHEN sighted = 1 THEN 'PARTIAL' ELSE 'WITHIN_LIMIT' END AS outcome FROM vl v ANTI JOIN ov USING (part, worker, visit) WHERE left_heard IS NOT NULL OR again IS NULL),
de AS (SELECT part, worker, 'EXCEEDED' AS outcome, t, 5.0::DOUBLE AS dwell, n, 0 AS turn FROM ov
 UNION ALL SELECT d.part, worker, outcome, entered, coalesce(left_t, greatest(coalesce(closed, d.ends), entered)) - entered, CASE WHEN outcome = 'INCOMPLETE' THEN next ELSE f.n END, CASE WHEN outcome = 'INCOMPLETE' THEN -1 ELSE 0 END FROM dw d LEFT JOIN mo f ON f.part = d.part AND f.t = d.left_heard),
al_ AS (SELECT part, n, CASE WHEN closes THEN -1 ELSE 0 END AS turn, 1 AS stage, 'EVENT' AS stage_name, event_type AS kind, worker, zone_id AS zone, t, told AS details, rank FROM sp WHERE spoken
 UNION ALL SELECT part, n, turn, 2, 'COMPLIANCE', 'MAX_DWELL', worker, 'click', round(t, 6), to_json({{'status': CASE outcome WHEN 'EXCEEDED' THEN 'POTENTIAL_VIOLATION' WHEN 'WITHIN_LIMIT' THEN 'COMPLIANT' ELSE 'UNVERIFIABLE' END,
  'confidence': CASE WHEN outcome IN ('EXCEEDED', 'WITHIN_LIMIT') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 'evidence': to_json({{'dwell_seconds': round(CAST(dwell AS DOUBLE), 3), 'outcome': outcome}})::VARCHAR}})::VARCHAR, 9 FROM de)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY n NULLS LAST, turn, stage, worker, rank, a.t, zone, kind, details) AS INTEGER) AS place, n, CAST(generation AS BIGINT) AS generation, stage_name AS stage, kind, worker, zone, a.t AS t, details FROM al_ a JOIN pn ON pn.part = a.part"""
