"""State machines and checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import buckets, frames, governance, records, tasks
from ..sources import domain
from ..sources.domain import sql
from ..sources.sinks import kept_table
from ..streaming import episodes, equipment, zone_visits
from ..streaming.machine import run_batch
from . import rollups

T, D = domain.telemetry, domain.decisions
FRAMES_A_SAMPLE = 13


def presence(s, p):
    """Frames twice a second while a sample lasts: sessions are camera hours, no zone where the type is error."""
    start = F.unix_micros("ts") % 3_600_000_000 / 1e6
    steps = F.sequence(F.lit(0), F.least(F.floor(F.col("activity_score") / 4), F.lit(24)).cast("int"))
    samples = T(s, p)
    rows = samples.select(
        F.concat_ws("/", "camera_id", F.date_format("ts", "yyyyMMddHH")).alias("session"), F.concat(F.lit("trk-"), "track_id").alias("worker"), F.when(F.col("zone_id") != "error", F.col("zone_id")).alias("zone"), F.floor(start * 2).alias("half"), steps.alias("steps")
    )
    # samples are dealt, not their frames: all that is asked of a worker follows without a shuffle
    rows = tasks.dealt(rows, "session", "worker", n=samples.count() * FRAMES_A_SAMPLE).sortWithinPartitions("session", "worker", "half").withColumn("k", F.explode("steps"))
    # the first zone of each time, by the sort that windows over a worker's times need anyway; frames of sorted samples are nearly sorted
    w = Window.partitionBy("session", "worker").orderBy("t", F.col("zone").asc_nulls_last())
    frames_ = rows.select("session", "worker", ((F.col("half") + F.col("k")) / 2).alias("t"), "zone")
    return frames_.withColumn("__again", F.lag(F.lit(True)).over(w) & F.lag("t").over(w).eqNullSafe(F.col("t"))).where("NOT coalesce(__again, false)").drop("__again")


def occupancy(s, p):
    frames_ = kept_table(presence(s, p))
    heads = frames_.where("zone IS NOT NULL").groupBy("session", "zone", "t").agg(F.count("*").alias("seen"), F.count_if(F.substring("worker", -1, 1) != "7").alias("clear"))
    heads = heads.join(zone_visits.hidden(frames_, tracked=zone_visits.track(frames_, keep=kept_table)), ["session", "zone", "t"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))
    return episodes.occupancy(kept_table(heads), ["session", "zone"], least=2)


def bodies(s, p, here=None):
    """Tracked bodies: walking until they lie down three seconds in, some bent or with weak keypoints, some up again."""
    w = Window.partitionBy("session", "worker").orderBy("t")
    rows = (here or presence(s, p)).withColumn("n", F.row_number().over(w)).withColumn("kind", F.substring("worker", -1, 1).cast("int"))
    lying = (F.col("n") > 6) & ~((F.col("kind") == 3) & (F.col("n") % 19 > 15))
    return rows.select(
        "session", "worker", "t", F.when(lying, 100.0).otherwise(F.col("n") * 40.0).alias("cx"), F.lit(200.0).alias("cy"), F.lit(150.0).alias("size"),
        F.when(F.col("kind") == 5, None).when(lying, 80.0).otherwise(10.0).alias("angle"), F.when(F.col("kind") == 4, 1.0).when(lying, 1.5).otherwise(0.4).alias("aspect"),
        ((F.col("kind") == 6) & lying).alias("legs_up"), F.lit(False).alias("collapsed"), (F.col("kind") == 8).alias("allowed"),
    )


def man_down(s, p):
    return episodes.man_down(bodies(s, p), ["session", "worker"])


def looks(s, p, here=None):
    """Two items looked at in every frame; what is seen changes by worker and every few seconds."""
    phase, kind = F.floor(F.col("t") / 4), F.substring("worker", -1, 1).cast("int")
    rows = (here or presence(s, p)).select("session", "worker", "t", F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.lit(k).alias("k")) for k, n in enumerate(("helmet", "safety_vest"))])).alias("i")).select("session", "worker", "t", "i.*")
    turn = F.pmod(phase + kind * (F.col("k") + 1), F.lit(7))
    return rows.select(
        "session", "worker", "t", "item", F.when(turn < 3, "PRESENT").when((turn == 3) | (kind == 4), "ABSENT").otherwise("UNVERIFIABLE").alias("state"),
        (0.5 + turn / 12).alias("seen_fraction"), (0.55 + kind / 20).alias("empty_fraction"), F.when(F.col("k") == 1, (turn + 2) / 4).alias("recent_fraction"),
    )


def stayed(s, p):
    """Stays in a zone as (session, worker, zone_id, entered, left, reason, ends): unbroken stretches of presence there."""
    w = Window.partitionBy("session", "worker").orderBy("t")
    here = presence(s, p)
    rows = here.withColumn("new", ~F.coalesce(F.lag("zone").over(w).eqNullSafe(F.col("zone")) & (F.col("t") - F.lag("t").over(w) <= 0.5), F.lit(False)))
    rows = rows.withColumn("stay", F.sum(F.col("new").cast("int")).over(w))
    # a session is a camera's hour: their ends are few, while a window over sessions would shuffle every frame
    ends = here.groupBy("session").agg(F.max("t").alias("ends"))
    stays = rows.where("zone IS NOT NULL").groupBy("session", "worker", "stay").agg(F.first("zone").alias("zone_id"), F.min("t").alias("entered"), F.max("t").alias("last")).join(F.broadcast(ends), "session")
    return stays.select("session", "worker", "zone_id", "entered", F.when(F.col("last") < F.col("ends"), F.col("last") + 0.5).alias("left"), F.when(F.floor("entered") % 2 == 0, "LOST").otherwise("LEFT").alias("reason"), "ends")


def entries(s, p):
    return equipment.entry_decisions(stayed(s, p).drop("zone_id"), looks(s, p), ["session", "worker"])


def continuous(s, p):
    one = looks(s, p).where("item = 'helmet'").select("session", "worker", "t", "state", F.col("empty_fraction").alias("support"), (F.col("seen_fraction") > 0.6).alias("agrees"))
    return equipment.continuous(one, ["session", "worker"], grace_s=1.5)


def sampled(s, p):
    rows = T(s, p).select("track_id", "sample_id", (F.unix_micros("ts") / 1e6).alias("t"), F.col("posture_state").alias("posture"))
    return run_batch(rows, episodes.Sampler(), ["track_id"], ["t", "sample_id"], "track_id long, sample_id long, t double").select("track_id", "sample_id")


def broken(s, p):
    """Minute buckets of which some break an invariant each: a start within a minute, more postures than samples, too few people, a score or a stay too high."""
    m = F.minute("bucket_start")
    hit = lambda k, value, c: F.when(m % k == 0, value).otherwise(F.col(c))
    b = buckets.minute_buckets(T(s, p))
    return b.select(
        "org_id", "camera_id", "zone_id", F.when(m % 11 == 3, F.col("bucket_start") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("bucket_start")).alias("bucket_start"),
        hit(13, F.lit(0), "occupancy_max").alias("occupancy_max"), "occupancy_avg", "occupancy_min", hit(7, F.col("sample_frames") + 1, "sitting_frames").alias("sitting_frames"), "standing_frames", "walking_frames", "sample_frames",
        hit(17, F.lit(100.5), "avg_activity_score").alias("avg_activity_score"), hit(19, F.lit(100_000), "total_dwell_seconds").alias("total_dwell_seconds"),
    )


ROLES_OF = sorted({r for roles in governance.CAPABILITIES for r in roles})


def allowed(s, p):
    """How many members of every organisation (customers of a nation) may do what, by their role; some have a role nobody knows."""
    members = domain.read(s, p, "customer").select(F.col("c_nationkey").alias("org_id"), domain.one_of((*ROLES_OF, "GUEST"), F.col("c_custkey") % (len(ROLES_OF) + 1)).alias("role"))
    return members.join(F.broadcast(governance.capabilities(s)), "role").groupBy("org_id", "capability").agg(F.count("*").alias("n"))  # a row a capability and role


QUERIES = {
    "zone_events": lambda s, p: zone_visits.zone_events(presence(s, p), limits={"click": {5.0: 0.8}}),
    "zone_stays": lambda s, p: zone_visits.stays(zone_visits.zone_events(presence(s, p))),
    "occupancy_episodes": occupancy,
    "man_down_episodes": man_down,
    "ppe_entry_decisions": entries,
    "ppe_continuous_decisions": continuous,
    "sampled_telemetry": sampled,
    "invalid_decisions": lambda s, p: governance.invalid_decisions(D(s, p).withColumn("confidence", F.col("confidence") + F.when(F.col("id") % 50 == 2, 0.6).otherwise(0.0))).groupBy("broken").agg(F.count("*").alias("n")),
    "invalid_buckets": lambda s, p: governance.invalid_buckets(broken(s, p)).select("org_id", "camera_id", "zone_id", "bucket_start"),
    "reviewed_decisions": lambda s, p: governance.review(D(s, p), D(s, p).where("id % 40 = 1").select("id", F.lit("CONFIRMED").alias("state"), F.lit("CORRECT").alias("reason")), "2024-01-01")[0].groupBy("review_state", "review_reason").agg(F.count("*").alias("n"), F.count("reviewed_at").alias("reviewed")),
    "refused_reviews": lambda s, p: governance.review(D(s, p), D(s, p).where("id % 40 = 1").select((F.col("id") * 3).alias("id"), F.when(F.col("id") % 3 == 0, "PENDING").otherwise("DISMISSED").alias("state"), F.lit("OTHER").alias("reason")), "2024-01-01")[1],
    "unique_slugs": lambda s, p: governance.unique_slugs(domain.read(s, p, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "slug"),
    "capabilities": allowed,
}

ROLES = " UNION ALL ".join(f"SELECT '{c}' AS capability, '{r}' AS role" for roles, held in governance.CAPABILITIES.items() for c in held for r in roles)
ORACLE_SQL = {
    "invalid_decisions": sql("SELECT broken, count(*) AS n FROM (SELECT CASE WHEN c < 0 OR c > 1 THEN 'confidence' WHEN status = 'UNVERIFIABLE' AND c <> 0 THEN 'unverifiable confidence' WHEN status = 'COMPLIANT' AND review_state <> 'NOT_REQUIRED' THEN 'compliant review' END AS broken FROM (SELECT *, confidence + CASE WHEN id % 50 = 2 THEN 0.6 ELSE 0 END AS c FROM decisions)) WHERE broken IS NOT NULL GROUP BY 1", "decisions"),
    "invalid_buckets": domain.sql(f"""WITH {rollups.BUCKETS_SQL}, b AS (SELECT *, minute(bucket_start) AS m FROM buckets),
c AS (SELECT * REPLACE (CASE WHEN m % 11 = 3 THEN bucket_start + INTERVAL 1 SECOND ELSE bucket_start END AS bucket_start, CASE WHEN m % 13 = 0 THEN 0 ELSE occupancy_max END AS occupancy_max, CASE WHEN m % 7 = 0 THEN sample_frames + 1 ELSE sitting_frames END AS sitting_frames,
 CASE WHEN m % 17 = 0 THEN 100.5 ELSE avg_activity_score END AS avg_activity_score, CASE WHEN m % 19 = 0 THEN 100000 ELSE total_dwell_seconds END AS total_dwell_seconds) FROM b)
SELECT org_id, camera_id, zone_id, bucket_start FROM c WHERE second(bucket_start) <> 0 OR occupancy_min > occupancy_max OR occupancy_avg > occupancy_max OR sitting_frames + standing_frames + walking_frames > sample_frames
 OR avg_activity_score NOT BETWEEN 0 AND 100 OR total_dwell_seconds > 60 * greatest(occupancy_max, 1)""", "telemetry"),
    "reviewed_decisions": sql("WITH r AS (SELECT *, id % 40 = 1 AND status <> 'COMPLIANT' AS hit FROM decisions) SELECT CASE WHEN hit THEN 'CONFIRMED' ELSE review_state END AS review_state, CASE WHEN hit THEN 'CORRECT' ELSE review_reason END AS review_reason, count(*) AS n, count(*) FILTER (hit) AS reviewed FROM r GROUP BY 1, 2", "decisions"),
    "refused_reviews": sql("SELECT * FROM (SELECT v.id, state, CASE WHEN state = 'PENDING' THEN 'not a verdict' WHEN d.id IS NULL THEN 'not found' WHEN d.status = 'COMPLIANT' THEN 'nothing to review' END AS why FROM (SELECT id * 3 AS id, CASE WHEN id % 3 = 0 THEN 'PENDING' ELSE 'DISMISSED' END AS state FROM decisions WHERE id % 40 = 1) v LEFT JOIN decisions d ON v.id = d.id) WHERE why IS NOT NULL", "decisions"),
    "unique_slugs": "WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM s) SELECT p_partkey, CASE WHEN n > 1 THEN s || '-' || (n - 1) ELSE s END AS slug FROM n",
    "capabilities": f"WITH c(capability, role) AS ({ROLES}), m AS (SELECT c_nationkey AS org_id, list_extract({[*ROLES_OF, 'GUEST']}, CAST(c_custkey % {len(ROLES_OF) + 1} + 1 AS BIGINT)) AS role FROM customer) SELECT org_id, capability, count(*) AS n FROM m JOIN c USING (role) GROUP BY ALL",
    "sampled_telemetry": f"""WITH RECURSIVE telemetry AS ({domain.VIEWS["telemetry"]}), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts, sample_id) AS n FROM telemetry),
w AS (SELECT track_id, n, sample_id, true AS kept, ts AS at, posture_state AS posture FROM r WHERE n = 1
UNION ALL SELECT track_id, n, sample_id, kept, CASE WHEN kept THEN ts ELSE last END, CASE WHEN kept THEN posture_state ELSE posture END
FROM (SELECT r.*, w.at AS last, w.posture, r.posture_state <> w.posture OR epoch_us(r.ts) - epoch_us(w.at) >= 5000000 AS kept FROM w JOIN r ON r.track_id = w.track_id AND r.n = w.n + 1))
SELECT track_id, sample_id FROM w WHERE kept""",
}


# --------------------------------------------------------------------------- oracles of the equipment rules
PRESENCE = """pres AS (SELECT camera_id || '/' || strftime(ts, '%Y%m%d%H') AS session, 'trk-' || track_id AS worker, (half + k) / 2 AS t, min(zone) AS zone
 FROM (SELECT *, floor((epoch_us(ts) % 3600000000) / 1000000.0 * 2) AS half, CASE WHEN zone_id <> 'error' THEN zone_id END AS zone, unnest(range(0, CAST(least(floor(activity_score / 4), 24) AS BIGINT) + 1)) AS k FROM telemetry) GROUP BY ALL)"""
LOOKS = """seen AS (SELECT session, worker, t, CAST(right(worker, 1) AS INTEGER) AS kind, k, CASE WHEN k = 0 THEN 'helmet' ELSE 'safety_vest' END AS item, (CAST(floor(t / 4) AS BIGINT) + CAST(right(worker, 1) AS INTEGER) * (k + 1)) % 7 AS turn FROM pres, (SELECT unnest([0, 1]) AS k)),
looks AS (SELECT session, worker, t, item, CASE WHEN turn < 3 THEN 'PRESENT' WHEN turn = 3 OR kind = 4 THEN 'ABSENT' ELSE 'UNVERIFIABLE' END AS state, 0.5 + turn / 12 AS seen_fraction, 0.55 + kind / 20 AS empty_fraction, CASE WHEN k = 1 THEN (turn + 2) / 4 END AS recent_fraction FROM seen)"""
#: Which of a worker's due streaks are flagged is a walk over them, in order.
ORACLE_SQL["ppe_continuous_decisions"] = f"""WITH RECURSIVE telemetry AS ({domain.VIEWS["telemetry"]}), {PRESENCE}, {LOOKS},
a AS (SELECT *, state = 'ABSENT' AND empty_fraction >= 0.6 AS absent, coalesce(t - lag(t) OVER w > 0.5 + 1e-9, false) AS away FROM looks WHERE item = 'helmet' WINDOW w AS (PARTITION BY session, worker ORDER BY t)),
r AS (SELECT *, count(*) FILTER (state = 'PRESENT' AND seen_fraction > 0.6) OVER w AS episode, sum(CAST(NOT absent AS INT) + CAST(away AS INT)) OVER w AS streak FROM a WINDOW w AS (PARTITION BY session, worker ORDER BY t)),
s AS (SELECT *, min(t) OVER (PARTITION BY session, worker, streak) AS since FROM r WHERE absent),
d AS (SELECT session, worker, episode, since, min(t) AS due, arg_min(empty_fraction, t) AS support FROM s WHERE t - since >= 1.5 - 1e-9 GROUP BY session, worker, episode, streak, since),
n AS (SELECT *, row_number() OVER (PARTITION BY session, worker ORDER BY due, since, episode) AS n FROM d),
f AS (SELECT session, worker, n, true AS kept, due AS last, episode AS flagged FROM n WHERE n = 1
 UNION ALL SELECT session, worker, n, ok, CASE WHEN ok THEN due ELSE last END, CASE WHEN ok THEN episode ELSE flagged END FROM (SELECT n.*, f.last, f.flagged, n.episode <> f.flagged AND n.since - f.last >= 60 AS ok FROM f JOIN n ON n.session = f.session AND n.worker = f.worker AND n.n = f.n + 1))
SELECT n.session, n.worker, 'POTENTIAL_VIOLATION' AS status, round(since, 6) AS t, round(least(1, support), 3) AS confidence, to_json({{'decided_video_time_s': round(due, 3), 'run_seconds': round(due - since, 3)}})::VARCHAR AS evidence, round(due, 6) AS decided
FROM n JOIN f ON f.session = n.session AND f.worker = n.worker AND f.n = n.n AND f.kept"""
#: Visits and looks meet by a range join; the first look that decides, else the first four seconds on, else how the visit ended.
ORACLE_SQL["ppe_entry_decisions"] = f"""WITH RECURSIVE telemetry AS ({domain.VIEWS["telemetry"]}), {PRESENCE}, {LOOKS},
p AS (SELECT *, NOT coalesce(lag(zone) OVER w IS NOT DISTINCT FROM zone AND t - lag(t) OVER w <= 0.5, false) AS new FROM pres WINDOW w AS (PARTITION BY session, worker ORDER BY t)),
q AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY session, worker ORDER BY t) AS stay, max(t) OVER (PARTITION BY session) AS ends FROM p),
v AS (SELECT session, worker, min(t) AS entered, CASE WHEN max(t) < any_value(ends) THEN max(t) + 0.5 END AS left_at, CASE WHEN floor(min(t)) % 2 = 0 THEN 'LOST' ELSE 'LEFT' END AS reason, any_value(ends) AS ends FROM q WHERE zone IS NOT NULL GROUP BY session, worker, stay),
g AS (SELECT session, worker, t, coalesce(list(item ORDER BY item) FILTER (state = 'ABSENT'), []) AS missing, bool_and(state = 'PRESENT') AS worn, bool_and(coalesce(recent_fraction >= 0.6, true)) AS agree, min(empty_fraction) FILTER (state = 'ABSENT') AS gap, min(seen_fraction) AS support,
  string_agg(item || CASE WHEN state = 'PRESENT' AND recent_fraction < 0.6 THEN ': not in the newest frames' WHEN state = 'UNVERIFIABLE' THEN ': not seen clearly enough' END, '; ' ORDER BY item) AS doubt FROM looks GROUP BY ALL),
h AS (SELECT *, CASE WHEN len(missing) > 0 AND gap >= 0.6 THEN 'POTENTIAL_VIOLATION' WHEN len(missing) = 0 AND worn AND agree AND support >= 0.6 THEN 'COMPLIANT' END AS says FROM g),
m AS (SELECT v.*, h.t, h.says, h.missing, h.gap, h.support, h.doubt FROM v LEFT JOIN h ON h.session = v.session AND h.worker = v.worker AND h.t >= entered AND (left_at IS NULL OR h.t < left_at)),
c AS (SELECT session, worker, entered, left_at, reason, ends, min(t) FILTER (says IS NOT NULL) AS claim, min(t) FILTER (t - entered >= 4 - 1e-9) AS late FROM m GROUP BY ALL),
o AS (SELECT c.*, claim IS NOT NULL AND claim <= coalesce(late, claim) AS claimed, CASE WHEN claim IS NOT NULL AND claim <= coalesce(late, claim) THEN claim ELSE late END AS look FROM c),
j AS (SELECT o.*, h.missing, h.gap, h.support, h.doubt, CASE WHEN claimed THEN h.says ELSE 'UNVERIFIABLE' END AS status, coalesce(look, left_at, ends) AS decided,
  list_transform(CASE WHEN len(h.missing) > 0 THEN h.missing ELSE ['helmet', 'safety_vest'] END, lambda i: CASE i WHEN 'helmet' THEN 'hard hat' ELSE 'hi-vis vest' END) AS called FROM o LEFT JOIN h ON h.session = o.session AND h.worker = o.worker AND h.t = o.look),
n AS (SELECT *, row_number() OVER (PARTITION BY session, worker ORDER BY entered) AS n FROM j),
f AS (SELECT session, worker, n, true AS kept, CASE WHEN status <> 'UNVERIFIABLE' THEN entered END AS last FROM n WHERE n = 1
 UNION ALL SELECT session, worker, n, ok, CASE WHEN ok AND status <> 'UNVERIFIABLE' THEN entered ELSE last END FROM (SELECT n.*, f.last, coalesce(n.entered - f.last >= 60, true) AS ok FROM f JOIN n ON n.session = f.session AND n.worker = f.worker AND n.n = f.n + 1)),
w AS (SELECT n.*, CASE status WHEN 'POTENTIAL_VIOLATION' THEN 'no ' || array_to_string(called, ' and ') || ' seen' WHEN 'COMPLIANT' THEN array_to_string(called, ' and ') || ' seen'
  ELSE CASE WHEN look IS NOT NULL AND doubt <> '' THEN 'could not be told in time (' || doubt || ')' WHEN look IS NOT NULL THEN 'too little support for a claim' WHEN left_at IS NULL THEN 'the footage ended' WHEN reason = 'LOST' THEN 'lost from view before it could be judged' ELSE 'left before it could be judged' END END AS why
  FROM n JOIN f ON f.session = n.session AND f.worker = n.worker AND f.n = n.n AND f.kept)
SELECT session, worker, status, round(entered, 6) AS t, CASE status WHEN 'POTENTIAL_VIOLATION' THEN round(gap, 3) WHEN 'COMPLIANT' THEN round(support, 3) ELSE 0.0 END AS confidence,
 '{{"entered_video_time_s":' || to_json(round(entered, 3)) || CASE WHEN look IS NULL THEN '' ELSE ',"missing":' || to_json(missing) END || ',"waited_seconds":' || to_json(round(decided - entered, 3)) || ',"why":' || to_json(why) || '}}' AS evidence, round(decided, 6) AS decided FROM w"""


# --------------------------------------------------------------------------- oracle of zone visits
def _json(**fields: str) -> str:
    """An object of the fields that are not null, keys in order."""
    parts = [f"""coalesce('"{k}":' || to_json({v})::VARCHAR || ',', '')""" for k, v in sorted(fields.items())]
    return f"'{{' || rtrim({' || '.join(parts)}, ',') || '}}'"


#: A worker's own frames are walked one by one (``st``): spells, what is settled, the way out; what absence means is looked up among the session's frames.
ZONE_VISITS = f"""{PRESENCE}, ses AS (SELECT DISTINCT session, t FROM pres), gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS gap FROM ses),
tol AS (SELECT session, t, greatest(0.5, coalesce(2.5 * median(gap) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0)) AS tol FROM gaps), fin AS (SELECT session, max(t) AS ends FROM ses GROUP BY session),
own AS (SELECT p.session, worker, p.t, coalesce(zone, '') AS place, p.t - lag(p.t) OVER w AS gap, tol, row_number() OVER w AS n FROM pres p JOIN tol ON tol.session = p.session AND tol.t = p.t WINDOW w AS (PARTITION BY p.session, worker ORDER BY p.t)),
st AS (SELECT session, worker, n, t, 1 AS presence, t AS first, true AS fresh, place, t AS spell, false AS sure, '' AS home, CAST(NULL AS DOUBLE) AS since, false AS sighted, CASE WHEN place = '' THEN t END AS way, false AS moved, '' AS was, CAST(NULL AS DOUBLE) AS was_since, false AS was_sighted, CAST(NULL AS DOUBLE) AS out, true AS unwatched FROM own WHERE n = 1
UNION ALL SELECT session, worker, n, t, presence, first, fresh, place, spell, sure OR settles, CASE WHEN moved THEN place ELSE home END, CASE WHEN moved THEN spell ELSE since END, CASE WHEN moved THEN fresh AND spell <= first + 1e-9 ELSE sighted END, way, moved, home, since, sighted, coalesce(way, spell), unwatched
FROM (SELECT *, settles AND place <> home AS moved FROM (SELECT *, NOT sure AND t - spell >= CASE WHEN place = '' THEN 1.0 ELSE 0.7 END - 1e-9 AS settles
FROM (SELECT session, worker, n, t, place, presence, first, fresh, spell, sure, home, since, sighted, unwatched, CASE WHEN place = '' THEN least(coalesce(way, spell), spell) ELSE way END AS way
FROM (SELECT o.session, o.worker, o.n, o.t, o.place, s.presence + CAST(o.gap > 8 + 1e-9 AS INT) AS presence, CASE WHEN o.gap > 8 + 1e-9 THEN o.t ELSE s.first END AS first, CASE WHEN o.gap > 8 + 1e-9 THEN s.home <> '' OR o.gap > 60 ELSE s.fresh END AS fresh,
  CASE WHEN o.gap > 8 + 1e-9 OR o.gap > o.tol OR o.place <> s.place THEN o.t ELSE s.spell END AS spell, NOT (o.gap > 8 + 1e-9 OR o.gap > o.tol OR o.place <> s.place) AND s.sure AS sure,
  CASE WHEN o.gap > 8 + 1e-9 THEN '' ELSE s.home END AS home, CASE WHEN o.gap <= 8 + 1e-9 THEN s.since END AS since, o.gap <= 8 + 1e-9 AND s.sighted AS sighted, o.gap > o.tol AS unwatched,
  CASE WHEN o.gap > 8 + 1e-9 OR o.gap > o.tol OR o.place = s.home OR s.moved THEN NULL ELSE s.way END AS way
  FROM st s JOIN own o ON o.session = s.session AND o.worker = s.worker AND o.n = s.n + 1))))),
nx AS (SELECT st.*, lead(t) OVER (PARTITION BY st.session, worker ORDER BY n) AS back, ends FROM st JOIN fin ON fin.session = st.session),
ab AS (SELECT *, t + 5 + 1e-9 AS g, t + 8 + 1e-9 AS e, coalesce(back, ends) - t AS away FROM nx WHERE home <> '' AND coalesce(back, ends) - t > 5 + 1e-9),
al AS (SELECT ab.*, a.t AS declared FROM ab ASOF LEFT JOIN ses a ON a.session = ab.session AND a.t >= ab.g), ae AS (SELECT al.*, b.t AS ended FROM al ASOF LEFT JOIN ses b ON b.session = al.session AND b.t >= al.e),
mv AS (SELECT session, worker, presence, t AS told, place AS zone, since AS entered, sighted, lead(out) OVER w AS left_at, lead(t) OVER w AS left_told FROM st WHERE moved WINDOW w AS (PARTITION BY session, worker, presence ORDER BY n)),
pe AS (SELECT session, worker, presence, max(t) AS last, bool_or(coalesce(back, ends) - t > 8 + 1e-9) FILTER (back IS NULL OR back - t > 8 + 1e-9) AS lost FROM nx GROUP BY ALL),
sy AS (SELECT mv.*, last, lost, CASE WHEN left_told IS NOT NULL THEN left_at WHEN lost THEN last ELSE greatest(last, entered) END AS until FROM mv JOIN pe USING (session, worker, presence) WHERE zone <> ''),
mk AS (SELECT sy.*, kind, entered + at_s AS due FROM sy, (VALUES ('DWELL_WARNING', 4.0), ('DWELL_EXCEEDED', 5.0)) m(kind, at_s) WHERE zone = 'click' AND entered + at_s <= until + 1e-9),
mb AS (SELECT mk.*, b.t AS back, b.unwatched AND due > b.t - b.gap + 1e-9 AS unseen FROM mk ASOF LEFT JOIN (SELECT own.*, own.gap IS NULL OR own.gap > own.tol AS unwatched FROM own) b ON b.session = mk.session AND b.worker = mk.worker AND b.t >= mk.due - 1e-9),
ev AS (
 SELECT session, worker, presence, told AS heard, 5 AS rank, 'ENTERED_ZONE' AS event_type, zone AS zone_id, entered AS t, {_json(first_sighting="CASE WHEN sighted THEN true END")} AS details FROM mv WHERE zone <> ''
 UNION ALL SELECT session, worker, presence, t, 4, 'EXITED_ZONE', was, out, {_json(reason="'LEFT'", dwell_s="round(greatest(out - was_since, 0), 3)", first_sighting="CASE WHEN was_sighted THEN true END")} FROM st WHERE moved AND was <> ''
 UNION ALL SELECT session, worker, presence, declared, 1, 'LOST_IN_ZONE', home, t, {_json(last_seen_s="round(t, 3)", declared_at_s="round(declared, 3)")} FROM ae
 UNION ALL SELECT session, worker, presence, back, 2, 'REAPPEARED', home, back, {_json(gap_s="round(away, 3)", last_seen_s="round(t, 3)")} FROM ae WHERE back IS NOT NULL AND away <= 8 + 1e-9
 UNION ALL SELECT session, worker, presence, ended, 4, 'EXITED_ZONE', home, t, {_json(reason="'LOST'", unverifiable="true", dwell_s="round(greatest(t - since, 0), 3)", last_seen_s="round(t, 3)", declared_at_s="round(ended, 3)")} FROM ae WHERE away > 8 + 1e-9
 UNION ALL SELECT session, worker, presence, CAST('infinity' AS DOUBLE), 4, 'EXITED_ZONE', zone, until, {_json(reason="'SESSION_END'", unverifiable="true", dwell_s="round(until - entered, 3)", last_seen_s="round(until, 3)")} FROM sy WHERE left_told IS NULL AND NOT coalesce(lost, false)
 DWELL),
un AS (SELECT *, lag([event_type, zone_id, details]) OVER (PARTITION BY session, worker, presence ORDER BY heard, rank, t, event_type, details) IS DISTINCT FROM [event_type, zone_id, details] AS other FROM ev),
events_ AS (SELECT session, worker, event_type, zone_id, round(t, 6) AS t, details FROM un WHERE other)"""
DWELL = f""" UNION ALL SELECT session, worker, presence, CASE WHEN unseen THEN back ELSE due END, 3, kind, zone, CASE WHEN unseen THEN back ELSE due END,
 {_json(limit_s="5.0::DOUBLE", warn_fraction="CASE WHEN kind = 'DWELL_WARNING' THEN 0.8::DOUBLE END", crossed_unobserved="CASE WHEN unseen THEN true END")} FROM mb"""
_WALK = f"WITH RECURSIVE telemetry AS ({domain.VIEWS['telemetry']}), "
ORACLE_SQL["zone_events"] = _WALK + ZONE_VISITS.replace("\n DWELL)", "\n" + DWELL + ")") + " SELECT * FROM events_"
ORACLE_SQL["zone_stays"] = _WALK + ZONE_VISITS.replace("\n DWELL)", ")") + """,
k AS (SELECT *, lag(event_type) OVER w AS before, lag(t) OVER w AS began FROM events_ WHERE event_type IN ('ENTERED_ZONE', 'EXITED_ZONE') WINDOW w AS (PARTITION BY session, worker ORDER BY t, event_type DESC))
SELECT session, worker, zone_id, CASE WHEN before = 'ENTERED_ZONE' THEN began END AS entered, t AS "left", details ->> 'reason' AS reason, details ->> 'reason' = 'LEFT' AND (details ->> 'first_sighting') IS NULL AS whole FROM k WHERE event_type = 'EXITED_ZONE'"""
