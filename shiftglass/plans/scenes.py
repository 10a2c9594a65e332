"""Frame joins, windows, as-of joins, platform and evaluation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crops, geometry as g, posture
from ..operators import evaluation, frames, platform
from ..sources import domain
from ..sources.domain import sql

T, D, E, O = domain.telemetry, domain.decisions, domain.safety_events, domain.organisations
TODAY = "2024-03-01"


# --------------------------------------------------------------------------- frames out of line items
def camera(frame):
    """Frames come from three cameras, which look at zones of the same names."""
    return domain.numbered("cam-", frame % 3)


def people(s, p):
    k, u, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    x, y, w, h = (k * 7 % 400).cast("double"), (u * 11 % 120).cast("double"), 24 + q * 2, (60 + k % 150).cast("double")
    return domain.read(s, p, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity")).select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("person"), F.array(x, y, x + w, y + h).alias("bbox"), (0.3 + u % 60 / 100).alias("conf"), camera(F.col("l_orderkey")).alias("camera_id")
    )


def items(s, p):
    b, n = F.col("bbox"), F.col("person")
    cx, cy = (b[0] + b[2]) / 2 + n % 5 * 6 - 12, b[1] + (b[3] - b[1]) * F.when(n % 2 == 0, 0.12).otherwise(0.40)
    return people(s, p).where("person < 6").select("frame", n.alias("item"), F.when(n % 2 == 0, "helmet").otherwise("safety_vest").alias("cls"), F.array(cx - 6, cy - 5, cx + 6, cy + 5).alias("item_box"), cx.alias("cx"), cy.alias("cy"), (F.col("conf") / 2 + 0.3).alias("item_conf"))


def poses(s, p):
    b, n = F.col("bbox"), F.col("person")
    return people(s, p).where("person % 3 <> 0").select("frame", n.alias("pose"), F.array(b[0] + n * 3, b[1], b[2] + n * 3, b[3]).alias("pose_box"))


def skeletons(s, p):
    """Synthetic poses in the people's boxes: legs hang, point at the camera or fold; some joints are not seen; some move."""
    k, f = F.col("person") * 7 + F.col("frame"), F.col("frame")
    b = F.col("bbox")
    w, h, cx = b[2] - b[0], b[3] - b[1], (b[0] + b[2]) / 2
    seen = lambda i: F.when((k + i) % 9 == 0, 0.1).otherwise(0.9)
    thigh, side, shin = F.pmod(k, F.lit(6)) * 0.055, F.pmod(k, F.lit(5)) * 0.09, 0.05 + F.pmod(f, F.lit(4)) * 0.07
    sh, hip = b[1] + 0.18 * h, b[1] + 0.48 * h
    knee = hip + thigh * h
    step = F.pmod(f, F.lit(3)) * 0.12 * w
    at = lambda x, y, i: F.struct(x.alias("x"), y.alias("y"), seen(i).alias("conf"))
    pairs = {5: (cx - 0.2 * w, cx + 0.2 * w, sh, sh), 11: (cx - 0.12 * w, cx + 0.12 * w, hip, hip), 13: (cx - 0.12 * w + side * w, cx + 0.12 * w + side * w, knee, knee + 0.02 * h), 15: (cx - 0.12 * w - step, cx + 0.12 * w + step, knee + shin * h, knee + shin * h)}
    points = {}
    for i, (x1, x2, y1, y2) in pairs.items():
        points |= {i: at(x1, y1, i), i + 1: at(x2, y2, i + 1)}
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("conf"))
    return people(s, p).select("frame", "person", "bbox", F.array(*[points.get(i, none) for i in range(17)]).alias("keypoints"), F.pmod(f, F.lit(7)).cast("double").alias("speed"))


def postures(s, p):
    judged = skeletons(s, p).withColumn("p", posture.posture(F.col("keypoints"), F.col("bbox"), F.col("speed")))
    return judged.select("frame", "person", "p.*")


FRAME_SIZE = (640, 360)


def windows(s, p):
    """Windows of small people, the picture's size, and a box that goes there and back."""
    found = people(s, p).where(crops.wants_close_up(F.col("bbox"), 150.0)).withColumn("win", crops.window(F.col("bbox"), *FRAME_SIZE)).where("win IS NOT NULL").withColumn("picture", crops.scaled(F.col("win")))
    back = crops.to_frame(crops.to_picture(F.col("bbox"), F.col("win"), F.col("picture")), F.col("win"), F.col("picture"))
    parts = [F.col("win")[i].cast("long").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return found.select("frame", "person", *parts, F.col("picture.width").cast("long").alias("width"), F.col("picture.height").cast("long").alias("height"), F.round(back[0], 6).alias("back_x"), F.round(back[3], 6).alias("back_y"))


def close_up_boxes(s, p):
    """A helmet in the upper part of every small person's picture; people stand close, so that windows show one helmet twice."""
    small = people(s, p).where(crops.wants_close_up(F.col("bbox"), 150.0)).withColumn("win", crops.window(F.col("bbox"), *FRAME_SIZE)).where("win IS NOT NULL").withColumn("picture", crops.scaled(F.col("win")))
    w, h = F.col("picture.width"), F.col("picture.height")
    return small.select("frame", "person", F.lit("helmet").alias("cls"), F.array(w * 0.3, h * 0.1, w * 0.7, h * 0.5).alias("box"), F.round(0.3 + F.col("conf") / 2 + F.col("person") / 1000, 6).alias("conf"))


def close_up_finds(s, p):
    found = frames.once_each(frames.found_close_up(people(s, p), close_up_boxes(s, p), *FRAME_SIZE, below=150.0), 0.3)
    return found.select("frame", "person", F.round("conf", 6).alias("conf"), F.round(F.col("box")[0], 4).alias("x1"), F.round(F.col("box")[3], 4).alias("y2"))


def truths(s, p):
    """Labelled boxes of a frame, and predictions moved against them, some twice."""
    b, k = F.col("bbox"), F.col("person") + F.col("frame")
    known = people(s, p).select(F.col("frame").alias("image"), (k % 2).alias("cls"), F.col("person").alias("truth"), b.alias("true_box"))
    move = lambda d: F.array(b[0] + d, b[1] + d / 2, b[2] + d, b[3] + d / 2)
    twice = F.explode(F.array(F.struct(F.lit(0).alias("n"), move((k % 5) * 4.0).alias("box")), F.struct(F.lit(1).alias("n"), move((k % 4) * 9.0).alias("box"))))
    guessed = people(s, p).select(F.col("frame").alias("image"), (k % 2).alias("cls"), "person", "conf", twice.alias("g")).select("image", "cls", (F.col("person") * 2 + F.col("g.n")).alias("pred"), (F.col("conf") - F.col("g.n") * 0.1 + F.col("person") / 1000).alias("conf"), F.col("g.box").alias("pred_box"))
    return guessed, known


ZONES = (("press", 1, 0, 0, 150, 200), ("gate", 2, 100, 50, 300, 320), ("walk", 3, 250, 100, 420, 260))


def rectangles(s):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    rows = [F.struct(F.lit(z).alias("zone_id"), F.lit(o).alias("ord"), F.array(corner(a, b), corner(c, b), corner(c, d), corner(a, d)).alias("polygon")) for z, o, a, b, c, d in ZONES]
    return s.range(3).select(camera(F.col("id")).alias("camera_id"), F.explode(F.array(*rows)).alias("z")).select("camera_id", "z.*")


PEOPLE = """people AS (SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS person, CAST(max(l_partkey) * 7 % 400 AS DOUBLE) AS x1, CAST(max(l_suppkey) * 11 % 120 AS DOUBLE) AS y1,
 x1 + 24 + max(l_quantity) * 2 AS x2, y1 + CAST(60 + max(l_partkey) % 150 AS DOUBLE) AS y2, 0.3 + max(l_suppkey) % 60 / 100 AS conf FROM lineitem GROUP BY ALL)"""
PEOPLE = PEOPLE.replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber")
INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
IOU = f"({INTER} / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {INTER}, 0))"
CROWD = f"crowd AS (SELECT DISTINCT a.frame, a.person FROM people a JOIN people b ON a.frame = b.frame AND a.person <> b.person AND {IOU} >= 0.3)"
ZONE_SQL = "zones AS (SELECT * FROM (VALUES " + ", ".join(f"('{z}', {o}, {a}, {b}, {c}, {d})" for z, o, a, b, c, d in ZONES) + ") t(zone_id, ord, a, b, c, d))"
IN_ZONE = "inz AS (SELECT frame, person, coalesce(arg_min(zone_id, ord), 'TRANSIT_ZONE') AS zone_id FROM people LEFT JOIN zones ON (x1 + x2) / 2 > a AND (x1 + x2) / 2 < c AND y2 > b AND y2 < d GROUP BY ALL)"
ITEMS = "items AS (SELECT frame, person AS item, CASE WHEN person % 2 = 0 THEN 'helmet' ELSE 'safety_vest' END AS cls, (x1 + x2) / 2 + person % 5 * 6 - 12 AS cx, y1 + (y2 - y1) * CASE WHEN person % 2 = 0 THEN 0.12 ELSE 0.40 END AS cy, conf / 2 + 0.3 AS item_conf FROM people WHERE person < 6)"
CONT = "greatest(0, least(x2, cx + 6) - greatest(x1, cx - 6)) * greatest(0, least(y2, cy + 5) - greatest(y1, cy - 5)) / (((cx + 6) - (cx - 6)) * ((cy + 5) - (cy - 5)))"
WORN = f"""pairs AS (SELECT p.*, i.item, i.cls, i.item_conf, power(cx - (x1 + x2) / 2, 2) + power(cy - (y1 + CASE WHEN cls = 'helmet' THEN 0.12 ELSE 0.40 END * (y2 - y1)), 2) AS near FROM people p JOIN items i USING (frame)
WHERE CASE WHEN cls = 'helmet' THEN cx BETWEEN x1 AND x2 AND cy BETWEEN y1 - 0.1 * (y2 - y1) AND y1 + 0.35 * (y2 - y1) ELSE cy BETWEEN y1 + 0.12 * (y2 - y1) AND y1 + 0.72 * (y2 - y1) AND {CONT} >= 0.5 END),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY frame, item ORDER BY near, person) = 1)"""


# --------------------------------------------------------------------------- as-of inputs
def passes(s, p):
    return E(s, p).where("event_type = 'ENTERED_ZONE'").select("worker_key", "id", F.col("observed_at").alias("at"))


def exits(s, p):
    return E(s, p).where("event_type = 'EXITED_ZONE'").select("worker_key", "id", F.col("observed_at").alias("at"))


ASOF = "SELECT worker_key, id, CASE WHEN t0 - passed <= INTERVAL 6 HOUR THEN passed END AS passed_at FROM (SELECT e.worker_key, e.id, e.observed_at AS t0, p.observed_at AS passed FROM (SELECT *, observed_at + INTERVAL 1 SECOND AS edge FROM safety_events WHERE event_type = 'EXITED_ZONE') e ASOF LEFT JOIN (SELECT * FROM safety_events WHERE event_type = 'ENTERED_ZONE') p ON e.worker_key = p.worker_key AND e.edge >= p.observed_at)"
AFTER = "SELECT worker_key, id, CASE WHEN nxt - t0 <= INTERVAL 6 HOUR THEN nxt END AS arrived_at FROM (SELECT e.worker_key, e.id, e.observed_at AS t0, p.observed_at AS nxt FROM (SELECT * FROM safety_events WHERE event_type = 'EXITED_ZONE') e ASOF LEFT JOIN (SELECT * FROM safety_events WHERE event_type = 'ENTERED_ZONE') p ON e.worker_key = p.worker_key AND e.observed_at <= p.observed_at)"


STALE_S = 15 * 86_400.0


def verdicts(s, p):
    """Helmet by the samples as they are, vest by mirrored scores: one verdict a sample."""
    helmet = frames.evidence(T(s, p), STALE_S)
    vest = frames.evidence(T(s, p).withColumn("activity_score", 100 - F.col("activity_score")), STALE_S, seen=60.0)
    both = helmet.withColumn("item", F.lit("helmet")).unionByName(vest.withColumn("item", F.lit("safety_vest")))
    return frames.verdicts(both, ["sample_id"])


def stayed(s, p):
    """Stays with how they ended; every fifth was inside when first seen."""
    n = F.col("visit") + F.col("track_id")
    return frames.visits(T(s, p), 36_000).withColumn("reason", F.when(n % 4 == 0, "LOST").when(n % 7 == 0, "SESSION_END").otherwise("LEFT")).withColumn("first_sighting", n % 5 == 0)


def leaves(s, p):
    out = E(s, p).where("event_type = 'EXITED_ZONE' AND get_json_object(details, '$.reason') = 'LEFT'")
    return out.select("worker_key", "id", F.col("observed_at").alias("at"), F.col("zone_id").alias("home"))


def arrivals(s, p):
    """Zones of the arrivals vary within a worker, so that every outcome occurs."""
    zone = domain.numbered("zone-", F.col("id") % 25)
    came = E(s, p).where("event_type = 'ENTERED_ZONE'").select("worker_key", F.col("observed_at").alias("at"), F.when(F.col("id") % 3 == 0, F.col("zone_id")).otherwise(zone).alias("zone"))
    return came.join(domain.zones(s, p).select(F.col("zone_id").alias("zone"), "zone_type"), "zone", "left")


def exits_judged(s, p):
    seen = E(s, p).where("event_type = 'REAPPEARED'").select("worker_key", F.col("observed_at").alias("at"))
    return frames.exit_decisions(leaves(s, p), arrivals(s, p), seen, "worker_key", "zone-3", 172_800.0, 3_600.0, 43_200.0)


def adoption(s, p):
    """Odd persons of a frame are lost, even ones are new; times by person and frame."""
    who, t = people(s, p), F.col("person") * 0.4 + F.col("frame") % 3 * 0.3
    lost = who.where("person % 2 = 1").select("frame", F.col("person").alias("lost_id"), t.alias("lost_at"), F.col("bbox").alias("lost_box"))
    return frames.adopted(lost, who.where("person % 2 = 0").select("frame", F.col("person").alias("new_id"), t.alias("new_at"), F.col("bbox").alias("new_box")), least=0.05)


# --------------------------------------------------------------------------- evaluation inputs
def judged(s, p):
    """Labels against a length heuristic that abstains in between."""
    n = F.col("n_chars")
    return domain.read(s, p, "labels").join(domain.read(s, p, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select(
        F.col("lang").alias("cls"), (F.col("quality") == 1).alias("truth"), F.when(n > 1500, True).when(n < 600, False).alias("verdict"), F.least(F.lit(1.0), n / 4000).alias("score"), "doc_id", "n_chars"
    )


JUDGED = "j AS (SELECT lang AS cls, quality = 1 AS truth, CASE WHEN n_chars > 1500 THEN true WHEN n_chars < 600 THEN false END AS verdict, least(1.0, n_chars / 4000) AS score, doc_id, n_chars FROM labels JOIN documents USING (doc_id))"


def segments(s, p):
    return judged(s, p).select("truth", (F.col("n_chars") % 20).cast("int").alias("n"), F.col("score").alias("seen"), (1 - F.col("score")).alias("empty"))


def readings(s, p):
    n = F.col("n_chars")
    return judged(s, p).select("truth", F.when(n > 1500, "PRESENT").when(n < 600, "ABSENT").otherwise("UNVERIFIABLE").alias("reading"), "n_chars", "doc_id")


CONDITIONS = {"all": "true", "short": "n_chars < 1000", "even": "doc_id % 2 = 0"}


def hashes(s, p):
    """62 sign bits of the embeddings, and mirrored."""
    v = F.col("embedding")
    bits = lambda order: F.aggregate(F.sequence(F.lit(0), F.lit(61)), F.lit(0).cast("long"), lambda a, i: a * 2 + F.when(v[order(i)] > 0, 1).otherwise(0))
    return domain.read(s, p, "embeddings").select(F.col("vec_id").alias("id"), bits(lambda i: i).alias("hash"), bits(lambda i: 61 - i).alias("mirror"))


def nearest(s, p):
    """Every hundredth vector against all others."""
    h = hashes(s, p)
    return evaluation.nearest(h.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("hash").alias("q_hash"), F.col("mirror").alias("q_mirror")), h)


HASH = "h AS (SELECT vec_id AS id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[1:62], lambda x: CAST(x > 0 AS BIGINT))), lambda a, b: a * 2 + b) AS hash, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_reverse(embedding[1:62]), lambda x: CAST(x > 0 AS BIGINT))), lambda a, b: a * 2 + b) AS mirror FROM embeddings)"
NEAR = "near AS (SELECT q.id AS q_id, min(least(bit_count(xor(s.hash, q.hash)), bit_count(xor(s.hash, q.mirror)))) AS distance, arg_min(s.id, least(bit_count(xor(s.hash, q.hash)), bit_count(xor(s.hash, q.mirror))) * 1000000 + s.id) AS nearest_id FROM h q JOIN h s ON q.id % 100 = 0 AND s.id <> q.id GROUP BY q.id)"


def org_names(s, p):
    return D(s, p).withColumn("org_id", F.col("worker_key")), E(s, p).withColumn("org_id", F.col("worker_key"))


def _overview(s, p, some="true"):
    d, e = org_names(s, p)
    orgs = O(s, p).where(some).select(domain.numbered("trk-", F.col("org_id")).alias("org_id"))
    return platform.overview(orgs, d, e)


QUERIES = {
    "postures": postures,
    "crop_windows": windows,
    "close_up_finds": close_up_finds,
    "truth_matches": lambda s, p: frames.match_truth(*truths(s, p)),
    "point_in_zone": lambda s, p: frames.in_zone(people(s, p), rectangles(s)),
    "zone_head_counts": lambda s, p: frames.zone_counts(people(s, p), rectangles(s)),
    "wide_scenes": lambda s, p: frames.wide_scenes(people(s, p), 640.0),
    "close_ups": lambda s, p: frames.close_ups(people(s, p), 3),
    "iou_overlaps": lambda s, p: frames.overlaps(people(s, p), 0.3),
    "clear_people": lambda s, p: frames.clear_people(people(s, p)).select("frame", "person", "clear"),
    "countable_people": lambda s, p: frames.countable(people(s, p)).select("frame", "person", "countable"),
    "ppe_association": lambda s, p: frames.worn(people(s, p), items(s, p)),
    "keypoint_alignment": lambda s, p: frames.keypoints_for(people(s, p), poses(s, p)),
    "posture_transitions": lambda s, p: frames.posture_changes(T(s, p)),
    "dwell_running": lambda s, p: frames.dwell_so_far(T(s, p)),
    "recent_speed": lambda s, p: frames.recent_speed(T(s, p)).withColumn("speed", F.round("speed", 6)),
    "activity_score": lambda s, p: frames.activity(T(s, p)).withColumn("score", F.round("score", 5)),
    "sliding_median": lambda s, p: frames.sliding_median(T(s, p)),
    "gap_tolerance": lambda s, p: frames.gap_tolerance(T(s, p)),
    "evidence_window": lambda s, p: frames.evidence(T(s, p), STALE_S),
    "evidence_verdicts": lambda s, p: verdicts(s, p),
    "absent_streaks": lambda s, p: frames.streaks(T(s, p)),
    "session_visits": lambda s, p: frames.visits(T(s, p)),
    "max_dwell_decisions": lambda s, p: frames.dwell_decisions(stayed(s, p), 3_600),
    "interval_union": lambda s, p: frames.union_of_spans(T(s, p).select("track_id", F.unix_micros("ts").alias("start"), (F.unix_micros("ts") + F.col("sample_id") % 7 * 1_800_000_000).alias("end")), "track_id", 60_000_000),
    "checkpoint_asof": lambda s, p: frames.last_before(exits(s, p), passes(s, p), "worker_key", 6 * 3600, 1.0),
    "required_exit": lambda s, p: frames.first_after(exits(s, p), passes(s, p), "worker_key", 6 * 3600),
    "frame_cadence": lambda s, p: frames.cadence(T(s, p)),
    "majority_posture": lambda s, p: frames.majority_posture(T(s, p), domain.POSTURE),
    "track_adoption": adoption,
    "checkpoint_decisions": lambda s, p: frames.checkpoint_entries(exits(s, p), passes(s, p).withColumn("state", domain.one_of(("PRESENT", "ABSENT", "UNVERIFIABLE"), F.col("id") % 3)), "worker_key", 6 * 3600),
    "orgs_to_purge": lambda s, p: platform.purgeable(O(s, p), TODAY),
    "plans_renewed": lambda s, p: platform.renewed(O(s, p), TODAY),
    "open_invitations": lambda s, p: platform.invitations(O(s, p).select((F.col("org_id") * 10).alias("invite_id"), "org_id", F.concat(F.lit(" User"), F.col("org_id") % 5, F.lit("@Example.com ")).alias("email"), F.lit("VIEWER").alias("role")), O(s, p), "user3@example.com"),
    "plan_usage": lambda s, p: platform.plan_usage(O(s, p), TODAY),
    "required_exit_decisions": lambda s, p: exits_judged(s, p),
    "attention_list": lambda s, p: platform.attention(O(s, p)),
    "org_health": lambda s, p: platform.health(O(s, p)),
    "signup_series": lambda s, p: platform.signups(O(s, p), "2024-01-20", "2024-03-15"),
    "platform_totals": lambda s, p: platform.totals(O(s, p)),
    "platform_overview": _overview,
    "platform_first_pages": lambda s, p: platform.first_page(O(s, p).where("NOT deleted").join(platform.attention(O(s, p)).select("org_id", "score"), "org_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))),
    "platform_search": lambda s, p: platform.sort(platform.search(O(s, p), " 00 ", "attention"), "newest").select("org_id", "name", "created_on"),
    "action_histogram": lambda s, p: platform.histogram(D(s, p), "rule_type"),
    "outcome_scores": lambda s, p: evaluation.outcomes(judged(s, p)),
    "precision_recall": lambda s, p: evaluation.precision_recall(judged(s, p), [0.1, 0.25, 0.35, 0.5]),
    "threshold_sweep": lambda s, p: evaluation.sweep(segments(s, p), [2, 5, 8, 12], [0.3, 0.5, 0.6, 0.8], [0.5, 0.7, 0.9, 0.95]),
    "reading_contingency": lambda s, p: evaluation.contingency(readings(s, p), CONDITIONS),
    "nearest_hash": nearest,
    "near_duplicate_summary": lambda s, p: evaluation.near_summary(nearest(s, p)),
    "timing_errors": lambda s, p: evaluation.timing(T(s, p).select("zone_id", ((F.col("sample_id") % 13 - 6) / 10).alias("error")), "zone_id"),
    "stage_latency": lambda s, p: evaluation.latency(T(s, p), "zone_id", "activity_score"),
    "floor_projection": lambda s, p: people(s, p).select("frame", "person", *[F.round(c, 6).alias(n) for c, n in zip(g.project(F.array(*[F.array(*map(F.lit, r)) for r in ((1.0, 0.1, 5.0), (0.2, 1.1, -3.0), (0.001, 0.0005, 1.0))]), *g.ground_point(F.col("bbox"))), "xy")]),
}

W = "OVER (PARTITION BY track_id ORDER BY ts, sample_id{r})"
w = W.format(r="")
rows = lambda a: W.format(r=f" ROWS BETWEEN {a} PRECEDING AND CURRENT ROW")
so_far = W.format(r=" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
US = "epoch_us"
SHIFTS = f"sh AS (SELECT *, sum(coalesce(CAST(posture_state <> lag_p AS INTEGER), 0)) {so_far} AS shifts FROM (SELECT *, lag(posture_state) {w} AS lag_p FROM telemetry))"
VISITS = "v0 AS (SELECT *, CAST(coalesce(lag(zone_id) " + w + " <> zone_id, true) OR epoch_us(ts) - epoch_us(lag(ts) " + w + ") > CAST({gap} AS BIGINT) * 1000000 AS INTEGER) AS fresh FROM telemetry), v1 AS (SELECT *, sum(fresh) " + so_far + " AS visit FROM v0), v AS (SELECT track_id, CAST(visit AS BIGINT) AS visit, min(zone_id) AS zone_id, min(ts) AS entered, max(ts) AS \"left\", count(*) AS samples FROM v1 GROUP BY ALL)"
VISITS = VISITS.replace("GROUP BY ALL)", "GROUP BY track_id, visit)")
PLAN = f"pl AS (SELECT *, CASE WHEN term_ends_on <= DATE '{TODAY}' THEN 'FREE' ELSE plan END AS plan_in_force FROM organisations)"
LIM = lambda i: "CASE plan_in_force " + " ".join(f"WHEN '{k}' THEN {'NULL' if v[i] is None else v[i]}" for k, v in platform.LIMITS.items()) + " END"
USE = f"us AS (SELECT *, {LIM(0)} AS cameras_limit, {LIM(1)} AS sites_limit, {LIM(2)} AS seats_limit, {LIM(3)} AS history_days_limit, coalesce(cameras > cameras_limit, false) OR coalesce(sites > sites_limit, false) OR coalesce(seats > seats_limit, false) AS over_limit FROM pl)"
WHY = {"camera_error": "cameras_in_error > 0", "failed_session": "failed_sessions > 0", "no_zones": "cameras > 0 AND zones = 0", "no_cameras": "cameras = 0", "no_members": "members = 0"}
PLURAL = "CASE WHEN {0} > 1 THEN 's' ELSE '' END"
SAID = {"camera_error": f"cameras_in_error || ' camera' || {PLURAL.format('cameras_in_error')} || ' in error'", "failed_session": f"failed_sessions || ' failed run' || {PLURAL.format('failed_sessions')}", "no_zones": "'cameras configured but no zones drawn'", "no_cameras": "'no cameras added yet'", "no_members": "'no active members'"}
ATT = "att AS (SELECT org_id, name, created_on, concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {SAID[k]} END" for k, c in WHY.items()) + ") AS reasons, CAST(greatest(" + ", ".join(f"CASE WHEN {c} THEN {platform.REASONS[k][1]} ELSE 0 END" for k, c in WHY.items()) + ") AS INTEGER) AS severity, CAST(" + " + ".join(f"CASE WHEN {c} THEN {platform.REASONS[k][0]} ELSE 0 END" for k, c in WHY.items()) + " AS INTEGER) AS score FROM organisations WHERE NOT deleted)"
HEALTH = f"""SELECT org_id, CAST(cameras_in_error * 100 + failed_sessions * 80 + CASE WHEN cameras > 0 AND zones = 0 THEN 70 ELSE 0 END + CASE WHEN cameras = 0 THEN 40 ELSE 0 END + CASE WHEN members = 0 THEN 30 ELSE 0 END AS BIGINT) AS score,
CASE WHEN suspended THEN 'suspended' WHEN cameras_in_error > 0 OR failed_sessions > 0 THEN 'error' WHEN (cameras > 0 AND zones = 0) OR cameras = 0 OR members = 0 THEN 'warn' WHEN running_sessions > 0 THEN 'live' ELSE 'ok' END AS level,
CASE WHEN suspended THEN 'Suspended' WHEN cameras_in_error > 0 THEN cameras_in_error || ' camera' || {PLURAL.format('cameras_in_error')} || ' down' WHEN failed_sessions > 0 THEN failed_sessions || ' failed run' || {PLURAL.format('failed_sessions')} WHEN cameras > 0 AND zones = 0 THEN 'No zones drawn' WHEN cameras = 0 THEN 'No cameras' WHEN members = 0 THEN 'No members' WHEN running_sessions > 0 THEN 'Processing' ELSE 'Healthy' END AS label FROM organisations WHERE NOT deleted"""
EVIDENCE = """SELECT sample_id, len(l) AS n, len(list_filter(l, lambda o: o.v >= {seen})) AS s, len(list_filter(l, lambda o: o.v < 20)) AS e, list_sum(list_transform(list_filter(l, lambda o: o.v >= {seen}), lambda o: CAST(o.v AS DECIMAL(28,8)))) AS t,
len(list_filter(l[-8:], lambda o: o.v >= {seen})) AS r, len(l[-8:]) AS m, track_id FROM (SELECT *, list_filter(w, lambda o: o.c AND epoch_us(ts) - epoch_us(o.ts) <= 1296000000000) AS l FROM (SELECT *, list({{'c': posture_state <> 'AWAY', 'v': {score}, 'ts': ts}}) {rows} AS w FROM telemetry))"""
STATE = "CASE WHEN n < 8 THEN 'UNVERIFIABLE' WHEN s / n >= 0.6 THEN 'PRESENT' WHEN e / n >= 0.9 THEN 'ABSENT' ELSE 'UNVERIFIABLE' END"
EXITS = """WITH l AS (SELECT worker_key, id, observed_at AS t0, zone_id AS home, observed_at + INTERVAL 49 HOUR AS due FROM safety_events WHERE event_type = 'EXITED_ZONE' AND reason = 'LEFT'),
a AS (SELECT e.worker_key, e.observed_at AS t0, CASE WHEN e.id % 3 = 0 THEN e.zone_id ELSE 'zone-' || (e.id % 25) END AS zone FROM safety_events e WHERE event_type = 'ENTERED_ZONE'),
b AS (SELECT a.* FROM a LEFT JOIN zones z ON a.zone = z.zone_id WHERE a.zone = 'zone-3' OR coalesce(z.zone_type NOT IN ('APPROACH', 'PPE_CHECKPOINT'), true)),
n AS (SELECT l.*, b.t0 AS came, b.zone FROM l LEFT JOIN b ON l.worker_key = b.worker_key AND b.t0 >= l.t0 AND b.t0 < l.due QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY b.t0 NULLS LAST, b.zone) = 1),
v AS (SELECT n.*, (SELECT max(observed_at) FROM safety_events s WHERE s.worker_key = n.worker_key AND s.event_type = 'REAPPEARED' AND s.observed_at <= n.due) AS last FROM n),
o AS (SELECT *, CASE WHEN zone = home THEN NULL WHEN zone = 'zone-3' AND came - t0 <= INTERVAL 48 HOUR THEN 'REACHED_EXIT' WHEN zone = 'zone-3' THEN 'REACHED_EXIT_LATE' WHEN zone IS NOT NULL THEN 'OTHER_ZONE' WHEN due - last <= INTERVAL 12 HOUR THEN 'NOT_REACHED' ELSE 'OUT_OF_VIEW' END AS outcome FROM v)
SELECT worker_key, id, outcome, CASE outcome WHEN 'REACHED_EXIT' THEN 'COMPLIANT' WHEN 'OUT_OF_VIEW' THEN 'UNVERIFIABLE' ELSE 'POTENTIAL_VIOLATION' END AS status, round_even((epoch_us(coalesce(came, due)) - epoch_us(t0)) / 1e6, 3) AS elapsed_seconds FROM o WHERE outcome IS NOT NULL"""
R = lambda x, n: f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"
BOX = sql  # plain text without views
plain = lambda body: "WITH " + body

ORACLE_SQL = {
    "point_in_zone": plain(f"{PEOPLE}, {ZONE_SQL}, {IN_ZONE} SELECT * FROM inz"),
    "zone_head_counts": plain(f"{PEOPLE}, {ZONE_SQL}, {IN_ZONE} SELECT f.frame, z.zone_id, count(i.person) AS n FROM (SELECT DISTINCT frame FROM people) f CROSS JOIN zones z LEFT JOIN inz i ON i.frame = f.frame AND i.zone_id = z.zone_id GROUP BY ALL"),
    "wide_scenes": plain(f"{PEOPLE} SELECT frame, count(*) AS people FROM people GROUP BY 1 HAVING count(*) BETWEEN 3 AND 8 AND max(y2 - y1) < 192"),
    "close_ups": plain(f"{PEOPLE} SELECT frame, person, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y2 - y1 DESC, person) AS r FROM people) WHERE r <= 3"),
    "iou_overlaps": plain(f"{PEOPLE}, {CROWD} SELECT * FROM crowd"),
    "clear_people": plain(f"{PEOPLE}, {CROWD} SELECT p.frame, p.person, y2 - y1 >= 90 AND x2 - x1 >= 28 AND y1 > 3 AND c.person IS NULL AS clear FROM people p LEFT JOIN crowd c ON p.frame = c.frame AND p.person = c.person"),
    "countable_people": plain(f"{PEOPLE}, {CROWD} SELECT p.frame, p.person, conf >= 0.4 AND y2 - y1 >= 60 AND c.person IS NULL AS countable FROM people p LEFT JOIN crowd c ON p.frame = c.frame AND p.person = c.person"),
    "ppe_association": plain(f"{PEOPLE}, {ITEMS}, {WORN} SELECT frame, person, cls, max(item_conf) AS conf FROM best GROUP BY ALL"),
    "keypoint_alignment": plain(f"{PEOPLE}, b AS (SELECT frame, person AS pose, x1 + person * 3 AS x1, y1, x2 + person * 3 AS x2, y2 FROM people WHERE person % 3 <> 0), m AS (SELECT a.frame, a.person, b.pose, {IOU} AS v FROM people a JOIN b ON a.frame = b.frame WHERE {IOU} >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.frame, a.person ORDER BY {IOU} DESC, b.pose) = 1) SELECT p.frame, p.person, m.pose FROM people p LEFT JOIN m ON p.frame = m.frame AND p.person = m.person"),
    "posture_transitions": sql(f"WITH {SHIFTS} SELECT sample_id, track_id, CAST(shifts AS BIGINT) AS shifts FROM sh", "telemetry"),
    "dwell_running": sql(f"SELECT sample_id, track_id, CAST(floor((epoch_us(ts) - epoch_us(min(ts) {so_far})) / 1000000) AS BIGINT) AS dwell_s FROM telemetry", "telemetry"),
    "recent_speed": sql(f"WITH s AS (SELECT *, sqrt(power(floor_x - lag(floor_x) {w}, 2) + power(floor_y - lag(floor_y) {w}, 2)) AS step FROM telemetry) SELECT sample_id, track_id, round(CASE WHEN count(step) {rows(4)} >= 2 THEN avg(step) {rows(4)} ELSE 0 END, 6) AS speed FROM s", "telemetry"),
    "activity_score": sql(f"WITH {SHIFTS} SELECT sample_id, track_id, round(CASE WHEN count(*) {rows(29)} < 2 THEN 50 ELSE 0.75 * least(100, (stddev_pop(floor_x * 1000) {rows(29)} + stddev_pop(floor_y * 1000) {rows(29)}) / 2 / 15 * 100) + least(25, 8.0 * shifts) END, 5) AS score FROM sh", "telemetry"),
    "sliding_median": sql(f"SELECT sample_id, track_id, median(activity_score) {rows(8)} AS median FROM telemetry", "telemetry"),
    "gap_tolerance": sql(f"WITH g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) {w})) / 1e6 AS gap FROM telemetry) SELECT sample_id, track_id, greatest(0.5, coalesce(2.5 * median(gap) {rows(8)}, 0.5)) AS tolerance FROM g", "telemetry"),
    "evidence_window": sql(f"""WITH x AS ({EVIDENCE.format(seen=45, score="activity_score", rows=rows(29))})
SELECT sample_id, track_id, CAST(n AS INTEGER) AS clear_frames, CASE WHEN n > 0 THEN round_even(s / n, 3) ELSE 0 END AS seen_fraction, CASE WHEN n > 0 THEN round_even(e / n, 3) ELSE 0 END AS empty_fraction, CASE WHEN s > 0 THEN {R("CAST(t AS DOUBLE) / s", 3)} ELSE 0 END AS mean_conf, CASE WHEN m > 0 THEN round_even(r / m, 3) ELSE 0 END AS recent_fraction, {STATE} AS state FROM x""", "telemetry"),
    "evidence_verdicts": sql(f"""WITH h AS ({EVIDENCE.format(seen=45, score="activity_score", rows=rows(29))}), v AS ({EVIDENCE.format(seen=60, score="100 - activity_score", rows=rows(29))}),
i AS (SELECT sample_id, {STATE} AS state FROM h UNION ALL SELECT sample_id, {STATE} FROM v)
SELECT sample_id, CASE WHEN bool_or(state = 'ABSENT') THEN 'NON_COMPLIANT' WHEN bool_and(state = 'PRESENT') THEN 'COMPLIANT' ELSE 'UNVERIFIABLE' END AS verdict FROM i GROUP BY 1""", "telemetry"),
    "absent_streaks": sql(f"WITH a AS (SELECT *, row_number() {w} AS n FROM telemetry), b AS (SELECT *, n - row_number() {w} AS island FROM a WHERE posture_state = 'AWAY') SELECT track_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS samples FROM b GROUP BY track_id, island", "telemetry"),
    "session_visits": sql("WITH " + VISITS.format(gap=3600) + " SELECT * FROM v", "telemetry"),
    "max_dwell_decisions": sql("WITH " + VISITS.format(gap=36000) + """, r AS (SELECT *, CASE WHEN (visit + track_id) % 4 = 0 THEN 'LOST' WHEN (visit + track_id) % 7 = 0 THEN 'SESSION_END' ELSE 'LEFT' END AS reason, epoch_us("left") - epoch_us(entered) >= 3600000000 AS over FROM v),
o AS (SELECT *, CASE WHEN over THEN 'EXCEEDED' WHEN reason = 'LEFT' AND (visit + track_id) % 5 <> 0 THEN 'WITHIN_LIMIT' WHEN reason = 'LEFT' THEN 'PARTIAL' WHEN reason = 'LOST' THEN 'LOST' ELSE 'INCOMPLETE' END AS outcome FROM r)
SELECT track_id, visit, zone_id, outcome, CASE outcome WHEN 'EXCEEDED' THEN 'POTENTIAL_VIOLATION' WHEN 'WITHIN_LIMIT' THEN 'COMPLIANT' ELSE 'UNVERIFIABLE' END AS status, CASE WHEN over THEN entered + INTERVAL 1 HOUR ELSE entered END AS judged_at FROM o""", "telemetry"),
    "required_exit_decisions": sql(EXITS, "safety_events", "zones"),
    "interval_union": sql("""WITH s AS (SELECT track_id, epoch_us(ts) AS start, epoch_us(ts) + sample_id % 7 * 1800000000 AS "end" FROM telemetry),
m AS (SELECT *, CAST(start > max("end") OVER (PARTITION BY track_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60000000 AS INTEGER) AS fresh FROM s),
n AS (SELECT *, sum(coalesce(fresh, 1)) OVER (PARTITION BY track_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m) SELECT track_id, min(start) AS start, max("end") AS "end" FROM n GROUP BY track_id, g""", "telemetry"),
    "checkpoint_asof": sql(ASOF, "safety_events"),
    "required_exit": sql(AFTER, "safety_events"),
    "frame_cadence": sql(f"WITH g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) {w})) / 1e6 AS gap, row_number() {w} AS n FROM telemetry), m AS (SELECT *, median(gap) {rows(8)} AS m FROM g) SELECT sample_id, track_id, coalesce(m >= 0.4, false) OR n % 2 = 1 AS looked_at, greatest(10.0, coalesce(10 * m, 10.0)) AS stale_s FROM m", "telemetry"),
    "majority_posture": sql("WITH c AS (SELECT sample_id, track_id, " + ", ".join(f"count(*) FILTER (posture_state = '{p}') {rows(6)} AS n{i}" for i, p in enumerate(domain.POSTURE)) + " FROM telemetry) SELECT sample_id, track_id, CASE greatest(n0, n1, n2, n3) " + " ".join(f"WHEN n{i} THEN '{p}'" for i, p in enumerate(domain.POSTURE)) + " END AS posture FROM c", "telemetry"),
    "track_adoption": plain(f"{PEOPLE}, t AS (SELECT *, person * 0.4::DOUBLE + frame % 3 * 0.3::DOUBLE AS t FROM people) SELECT b.frame, b.person AS new_id, arg_max(a.person, {IOU} * 1e6 - a.person) AS lost_id FROM t a JOIN t b ON a.frame = b.frame AND a.person % 2 = 1 AND b.person % 2 = 0 AND b.t BETWEEN a.t AND a.t + 1.5 AND {IOU} >= 0.05 GROUP BY b.frame, b.person"),
    "checkpoint_decisions": sql("SELECT a.worker_key, a.id, CASE WHEN passed_at IS NULL THEN 'AT_ENTRY' WHEN m.s = 1 THEN 'COMPLIANT' WHEN m.s = 0 THEN 'POTENTIAL_VIOLATION' ELSE 'UNVERIFIABLE' END AS status FROM (" + ASOF + ") a LEFT JOIN (SELECT worker_key, observed_at, min(CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END) AS s FROM safety_events WHERE event_type = 'ENTERED_ZONE' GROUP BY ALL) m ON a.worker_key = m.worker_key AND a.passed_at = m.observed_at", "safety_events"),
    "orgs_to_purge": sql(f"SELECT org_id, coalesce(term_ends_on, created_on) AS gone_on FROM organisations WHERE deleted AND coalesce(term_ends_on, created_on) + 30 < DATE '{TODAY}'", "organisations"),
    "plans_renewed": sql(f"SELECT org_id, plan, CAST(greatest(coalesce(term_ends_on, DATE '{TODAY}'), DATE '{TODAY}') + INTERVAL 1 MONTH AS DATE) AS term_ends_on FROM organisations WHERE plan <> 'FREE'", "organisations"),
    "open_invitations": sql("SELECT org_id * 10 AS invite_id, org_id, name, 'VIEWER' AS role FROM organisations WHERE NOT deleted AND org_id % 5 = 3", "organisations"),
    "plan_usage": sql(f"WITH {PLAN}, {USE} SELECT org_id, plan_in_force, cameras, sites, seats, cameras_limit, sites_limit, seats_limit, history_days_limit, over_limit FROM us", "organisations"),
    "attention_list": sql(f"WITH {ATT} SELECT org_id, reasons, severity, score FROM att WHERE score > 0", "organisations"),
    "org_health": sql(HEALTH, "organisations"),
    "signup_series": sql("SELECT CAST(t.day AS DATE) AS day, (SELECT count(*) FROM organisations WHERE created_on = t.day) AS signups, (SELECT count(*) FROM organisations WHERE created_on <= t.day) AS total FROM generate_series(DATE '2024-01-20', DATE '2024-03-15', INTERVAL 1 DAY) t(day)", "organisations"),
    "platform_totals": sql("SELECT count(*) AS organisations, count(*) FILTER (suspended) AS suspended, CAST(sum(cameras) AS BIGINT) AS cameras, CAST(sum(sites) AS BIGINT) AS sites, CAST(sum(seats) AS BIGINT) AS seats FROM organisations WHERE NOT deleted", "organisations"),
    "platform_overview": sql("""WITH d AS (SELECT worker_key, count(*) AS decisions, count(*) FILTER (review_state = 'PENDING') AS open_alerts, max(observed_at) AS last_decision FROM decisions GROUP BY 1), e AS (SELECT worker_key, count(*) AS events FROM safety_events GROUP BY 1)
SELECT 'trk-' || org_id AS org_id, coalesce(decisions, 0) AS decisions, coalesce(open_alerts, 0) AS open_alerts, coalesce(events, 0) AS events, last_decision FROM organisations o LEFT JOIN d ON d.worker_key = 'trk-' || o.org_id LEFT JOIN e ON e.worker_key = 'trk-' || o.org_id""", "decisions", "safety_events", "organisations"),
    "platform_search": sql(f"WITH {ATT} SELECT org_id, name, created_on FROM att WHERE score > 0 AND contains(lower(name), '00')", "organisations"),
    "action_histogram": sql("SELECT rule_type, count(*) AS n FROM (SELECT * FROM decisions ORDER BY observed_at DESC, id DESC LIMIT 2000) GROUP BY 1", "decisions"),
    "outcome_scores": plain(f"""{JUDGED}, c AS (SELECT count(*) AS n, count(*) FILTER (truth AND NOT verdict) AS missed, count(*) FILTER (NOT truth AND verdict) AS false_alarms, count(*) FILTER (verdict IS NULL) AS abstained, count(*) FILTER (truth) AS positives, count(*) FILTER (NOT truth) AS negatives, count(*) FILTER (truth AND verdict) AS hits FROM j),
e AS (SELECT *, missed + false_alarms AS k, n - abstained AS m, (missed + false_alarms) / nullif(n - abstained, 0) AS r FROM c) SELECT n, missed, false_alarms, abstained, positives, negatives, hits, {R("m / nullif(n, 0)", 4)} AS coverage, {R("r", 4)} AS error_rate,
{R("CASE WHEN k = 0 THEN least(1, 3 / m) ELSE (r + 3.8416 / (2 * m) + 1.96 * sqrt(r * (1 - r) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m) END", 6)} AS error_upper FROM e"""),
    "precision_recall": plain(f"""{JUDGED}, c AS (SELECT cls, threshold, count(*) FILTER (truth AND score >= threshold) AS tp, count(*) FILTER (NOT truth AND score >= threshold) AS fp, count(*) FILTER (truth AND score < threshold) AS fn FROM j CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.25, 0.35, 0.5]) AS threshold) GROUP BY ALL)
SELECT *, {R("tp / nullif(tp + fp, 0)", 4)} AS precision, {R("tp / nullif(tp + fn, 0)", 4)} AS recall, {R("2 * tp / nullif(2 * tp + fp + fn, 0)", 4)} AS f1 FROM c"""),
    "threshold_sweep": plain(f"""{JUDGED}, g AS (SELECT truth, need, present, absent, CASE WHEN n_chars % 20 < need THEN NULL WHEN score >= present THEN true WHEN 1 - score >= absent THEN false END AS verdict FROM j CROSS JOIN (SELECT unnest([2, 5, 8, 12]) AS need) CROSS JOIN (SELECT unnest([0.3::DOUBLE, 0.5, 0.6, 0.8]) AS present) CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.7, 0.9, 0.95]) AS absent)),
c AS (SELECT need, present, absent, count(*) AS segments, count(verdict) AS decided, count(*) FILTER (verdict <> truth) AS wrong FROM g GROUP BY ALL) SELECT *, {R("decided / nullif(segments, 0)", 4)} AS coverage, {R("wrong / nullif(decided, 0)", 4)} AS error_rate FROM c"""),
    "reading_contingency": plain(f"""{JUDGED}, r AS (SELECT *, CASE WHEN n_chars > 1500 THEN 'PRESENT' WHEN n_chars < 600 THEN 'ABSENT' ELSE 'UNVERIFIABLE' END AS reading FROM j),
c AS ({" UNION ALL ".join(f"SELECT '{k}' AS condition, * FROM r WHERE {v}" for k, v in CONDITIONS.items())}) SELECT condition, truth, count(*) FILTER (reading = 'PRESENT') AS "PRESENT", count(*) FILTER (reading = 'ABSENT') AS "ABSENT", count(*) FILTER (reading = 'UNVERIFIABLE') AS "UNVERIFIABLE" FROM c GROUP BY ALL"""),
    "nearest_hash": plain(f"{HASH}, {NEAR} SELECT q_id, CAST(distance AS INTEGER) AS distance, nearest_id FROM near"),
    "near_duplicate_summary": plain(f"{HASH}, {NEAR} SELECT count(*) AS n, count(*) FILTER (distance <= 0) AS identical, count(*) FILTER (distance <= 6) AS near, count(*) FILTER (distance <= 10) AS close, median(distance) AS median FROM near"),
    "timing_errors": sql(f"WITH e AS (SELECT zone_id, (sample_id % 13 - 6) / 10 AS error FROM telemetry) SELECT zone_id, count(*) AS n, {R('avg(abs(error))', 4)} AS mean_abs, {R('max(abs(error))', 4)} AS max_abs, {R('avg(error)', 4)} AS mean FROM e GROUP BY 1", "telemetry"),
    "stage_latency": sql(f"SELECT zone_id, {R('avg(activity_score)', 3)} AS mean, list_sort(list(activity_score))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM telemetry GROUP BY 1", "telemetry"),
    "floor_projection": plain(f"{PEOPLE}, q AS (SELECT frame, person, (x1 + x2) / 2 AS gx, y2 AS gy FROM people) SELECT frame, person, round((gx + 0.1 * gy + 5) / (0.001 * gx + 0.0005 * gy + 1), 6) AS x, round((0.2 * gx + 1.1 * gy - 3) / (0.001 * gx + 0.0005 * gy + 1), 6) AS y FROM q"),
}


def _angle(a: str, b: str, c: str) -> str:
    ux, uy, vx, vy = (f"({p}{x} - {b}{x})" for p, x in ((a, "x"), (a, "y"), (c, "x"), (c, "y")))
    size = f"sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy})"
    return f"CASE WHEN {a}x IS NOT NULL AND {b}x IS NOT NULL AND {c}x IS NOT NULL THEN coalesce(degrees(acos(greatest(-1, least(1, ({ux} * {vx} + {uy} * {vy}) / nullif({size}, 0))))), 0) END"


def _joint(name: str, i: int, x: str, y: str) -> str:
    return f"CASE WHEN (k + {i}) % 9 <> 0 THEN {x} END AS {name}x, CASE WHEN (k + {i}) % 9 <> 0 THEN {y} END AS {name}y"


_MID = ", ".join(f"coalesce((l{n}{c} + r{n}{c}) / 2, l{n}{c}, r{n}{c}) AS m{n}{c}" for n in "shka" for c in "xy")
#: From the rules in words: how folded joints, thigh drop, span and box speak for sitting (s) or standing (t).
_SITS = """5 * knee_bent + 4.5 * hip_bent + CASE WHEN hips = 0 AND mh <= 128 THEN 4 ELSE 0 END + 4 * thigh_short + CASE WHEN span < 0.55 AND NOT coalesce(tall, false) THEN 2.5 ELSE 0 END
 + CASE WHEN fold <= 125 THEN 6 ELSE 0 END + CASE WHEN drop_ <= 0.30 THEN 8 WHEN drop_ < 0.55 THEN 2 ELSE 0 END + CASE WHEN blind AND box < 1.35 THEN 1.5 ELSE 0 END"""
_STANDS = """1.0 * knee_open + 0.8 * hip_open + CASE WHEN hips = 0 AND mh >= 148 THEN 0.8 ELSE 0 END + CASE WHEN coalesce(tall, false) THEN 3 ELSE 0 END + CASE WHEN drop_ >= 0.55 THEN 7 ELSE 0 END + CASE WHEN blind AND box >= 1.65 THEN 1.5 ELSE 0 END"""
ORACLE_SQL["postures"] = f"""WITH {PEOPLE}, b AS (SELECT *, person * 7 + frame AS k, frame AS f, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx FROM people),
c AS (SELECT *, y1 + 0.18 * h AS sh, y1 + 0.48 * h AS hip, y1 + 0.48 * h + k % 6 * 0.055 * h AS knee, k % 5 * 0.09 AS side, 0.05 + f % 4 * 0.07 AS shin, f % 3 * 0.12 * w AS step FROM b),
j AS (SELECT frame, person, f, w, h, {_joint("ls", 5, "cx - 0.2 * w", "sh")}, {_joint("rs", 6, "cx + 0.2 * w", "sh")}, {_joint("lh", 11, "cx - 0.12 * w", "hip")}, {_joint("rh", 12, "cx + 0.12 * w", "hip")},
 {_joint("lk", 13, "cx - 0.12 * w + side * w", "knee")}, {_joint("rk", 14, "cx + 0.12 * w + side * w", "knee + 0.02 * h")}, {_joint("la", 15, "cx - 0.12 * w - step", "knee + shin * h")}, {_joint("ra", 16, "cx + 0.12 * w + step", "knee + shin * h")} FROM c),
m AS (SELECT *, {_MID} FROM j),
a AS (SELECT *, {_angle("lh", "lk", "la")} AS lka, {_angle("rh", "rk", "ra")} AS rka, {_angle("ls", "lh", "lk")} AS lha, {_angle("rs", "rh", "rk")} AS rha, {_angle("mh", "mk", "ma")} AS mk, {_angle("ms", "mh", "mk")} AS mh FROM m),
v AS (SELECT *, [x FOR x IN [lka, rka] IF x IS NOT NULL] AS knees0, [x FOR x IN [lha, rha] IF x IS NOT NULL] AS hips0, abs(may - msy) / greatest(h, 1) AS span, greatest(h, 1) / greatest(w, 1) AS box,
 CASE WHEN sqrt((msx - mhx) * (msx - mhx) + (msy - mhy) * (msy - mhy)) > 8 THEN (mky - mhy) / sqrt((msx - mhx) * (msx - mhx) + (msy - mhy) * (msy - mhy)) END AS drop_,
 [x FOR x IN [CASE WHEN abs(lhy - lsy) > 10 THEN abs(lky - lhy) / abs(lhy - lsy) END, CASE WHEN abs(rhy - rsy) > 10 THEN abs(rky - rhy) / abs(rhy - rsy) END] IF x IS NOT NULL] AS thighs FROM a),
u AS (SELECT *, CASE WHEN len(knees0) > 0 THEN knees0 WHEN mk IS NOT NULL THEN [mk] ELSE [] END AS knees, len(hips0) AS hips, mhx IS NULL AND (mkx IS NULL OR max_ IS NULL) AS blind FROM (SELECT *, max AS max_ FROM (SELECT * RENAME (max AS max) FROM v))),
n AS (SELECT *, len([x FOR x IN knees IF x <= 138]) AS knee_bent, len([x FOR x IN knees IF x >= 155]) AS knee_open, len([x FOR x IN hips0 IF x <= 128]) AS hip_bent, len([x FOR x IN hips0 IF x >= 148]) AS hip_open, len([x FOR x IN thighs IF x < 0.8]) AS thigh_short,
 len(knees) > 0 AND len([x FOR x IN knees IF x < 155]) = 0 AND span >= 0.70 AS tall, coalesce(list_max(hips0), mh) AS fold FROM u),
s AS (SELECT *, {_SITS} AS sits, {_STANDS} AS stands, coalesce(abs(lax - rax), abs(lkx - rkx), 0) / greatest(10, coalesce(sqrt((lsx - rsx) * (lsx - rsx) + (lsy - rsy) * (lsy - rsy)), greatest(w, 1) * 0.4)) AS stride FROM n)
SELECT frame, person, CASE WHEN (mhx IS NULL AND mkx IS NULL AND max_ IS NULL) OR (sits = 0 AND stands = 0) THEN 'UNKNOWN' WHEN sits > stands THEN 'SITTING'
 WHEN f % 7 >= 4.5 AND (stride > 0.52 OR (coalesce(abs(lka - rka), 0) > 30 AND stride > 0.35)) AND coalesce(mk >= 142, true) AND coalesce(mh >= 138, true) THEN 'WALKING' ELSE 'STANDING' END AS posture,
 round(CAST(sits AS DOUBLE), 3) AS sits, round(CAST(stands AS DOUBLE), 3) AS stands FROM s""".replace("(SELECT *, max AS max_ FROM (SELECT * RENAME (max AS max) FROM v))", "(SELECT *, max AS max_ FROM v)")
_WIN = f"""{PEOPLE}, r AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM people WHERE y2 - y1 > 0 AND y2 - y1 < 150),
e AS (SELECT *, greatest(0, x1 - 0.3 * w) AS a, greatest(0, y1 - 0.2 * h) AS b, least({FRAME_SIZE[0]}, x2 + 0.3 * w) AS c, least({FRAME_SIZE[1]}, y2 + 0.08 * h) AS d FROM r),
i AS (SELECT *, round_even(a, 0) AS wa, round_even(b, 0) AS wb, round_even(c, 0) AS wc, round_even(d, 0) AS wd FROM e WHERE w > 1 AND h > 1 AND c - a >= 2 AND d - b >= 2),
z AS (SELECT *, least(4, 640 / (wd - wb), 1280 / greatest(wc - wa, wd - wb)) AS zoom FROM i),
win AS (SELECT *, CASE WHEN abs(zoom - 1) <= 0.02 THEN wc - wa ELSE greatest(1, round_even((wc - wa) * zoom, 0)) END AS pw, CASE WHEN abs(zoom - 1) <= 0.02 THEN wd - wb ELSE greatest(1, round_even((wd - wb) * zoom, 0)) END AS ph FROM z)"""
ORACLE_SQL["crop_windows"] = f"""WITH {_WIN} SELECT frame, person, CAST(wa AS BIGINT) AS x0, CAST(wb AS BIGINT) AS y0, CAST(wc AS BIGINT) AS x1, CAST(wd AS BIGINT) AS y1, CAST(pw AS BIGINT) AS width, CAST(ph AS BIGINT) AS height, round(win.x1, 6) AS back_x, round(win.y2, 6) AS back_y FROM win"""
#: The greedy choice, one box a step: the surest of the rest stays and takes away what it meets.
ORACLE_SQL["close_up_finds"] = f"""WITH RECURSIVE {_WIN},
q AS (SELECT frame, person, round(0.3 + conf / 2 + person / 1000, 6) AS conf, wa + 0.3 * (wc - wa) AS x1, wb + 0.1 * (wd - wb) AS y1, wa + 0.7 * (wc - wa) AS x2, wb + 0.5 * (wd - wb) AS y2 FROM win),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, person) AS n FROM q),
x AS (SELECT a.frame, a.n AS a, b.n AS b FROM o a JOIN o b ON a.frame = b.frame AND a.n < b.n AND {IOU} >= 0.3),
t AS (SELECT frame, CAST(1 AS BIGINT) AS n, CAST([1] AS BIGINT[]) AS kept FROM o WHERE n = 1
 UNION ALL SELECT t.frame, t.n + 1, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.frame = t.frame AND x.b = t.n + 1 AND list_contains(t.kept, x.a)) THEN t.kept ELSE list_append(t.kept, t.n + 1) END FROM t JOIN o ON o.frame = t.frame AND o.n = t.n + 1),
f AS (SELECT frame, arg_max(kept, n) AS kept FROM t GROUP BY frame)
SELECT o.frame, o.person, o.conf, round(o.x1, 4) AS x1, round(o.y2, 4) AS y2 FROM o JOIN f ON f.frame = o.frame AND list_contains(f.kept, o.n)"""
ORACLE_SQL["truth_matches"] = f"""WITH RECURSIVE {PEOPLE}, k AS (SELECT *, (person + frame) % 2 AS cls, person + frame AS k FROM people),
g AS (SELECT frame, cls, person * 2 + n AS pred, conf - n * 0.1 + person / 1000 AS conf, x1 + d AS x1, y1 + d / 2 AS y1, x2 + d AS x2, y2 + d / 2 AS y2 FROM (SELECT *, CASE WHEN n = 0 THEN k % 5 * 4.0 ELSE k % 4 * 9.0 END AS d FROM k, (SELECT unnest([0, 1]) AS n))),
c AS (SELECT a.frame, a.cls, a.pred, a.conf, b.person AS truth, {IOU} AS v FROM g a JOIN k b ON a.frame = b.frame AND a.cls = b.cls),
o AS (SELECT *, row_number() OVER (PARTITION BY frame, cls ORDER BY conf DESC, pred, v DESC, truth) AS n FROM c WHERE v >= 0.5),
t AS (SELECT frame, cls, n, [pred] AS preds, [truth] AS truths FROM o WHERE n = 1
 UNION ALL SELECT t.frame, t.cls, t.n + 1, CASE WHEN list_contains(t.preds, o.pred) OR list_contains(t.truths, o.truth) THEN t.preds ELSE list_append(t.preds, o.pred) END, CASE WHEN list_contains(t.preds, o.pred) OR list_contains(t.truths, o.truth) THEN t.truths ELSE list_append(t.truths, o.truth) END
 FROM t JOIN o ON o.frame = t.frame AND o.cls = t.cls AND o.n = t.n + 1),
f AS (SELECT frame, cls, arg_max(preds, n) AS p, arg_max(truths, n) AS q FROM t GROUP BY frame, cls)
SELECT frame AS image, cls, unnest(p) AS pred, unnest(q) AS truth FROM f"""
ORACLE_SQL["platform_first_pages"] = sql(f"WITH {ATT}, o AS (SELECT organisations.* , coalesce(att.score, 0) AS score FROM organisations LEFT JOIN att USING (org_id) WHERE NOT organisations.deleted) " + " UNION ALL ".join(
    f"SELECT '{k}' AS sort, row_number() OVER (ORDER BY {c}, org_id) AS place, org_id FROM o QUALIFY place <= 20"
    for k, c in {"name": "name", "newest": "created_on DESC", "oldest": "created_on", "cameras": "cameras DESC", "members": "members DESC", "zones": "zones DESC", "health": "score DESC"}.items()
), "organisations")
