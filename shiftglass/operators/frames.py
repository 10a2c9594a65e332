"""Joins within a frame: zones, overlaps, equipment on persons, keypoints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import crops, geometry as g
from ..functions.rounding import rounded
from ..vocabulary import TRANSIT

#: Where equipment is worn, as shares of a person's height or width.
HEAD_SLACK, HEAD_BOTTOM, VEST_TOP, VEST_BOTTOM, HELD = 0.10, 0.35, 0.12, 0.72, 0.50
TARGET = {"helmet": 0.12, "safety_vest": 0.40}


def in_zone(people: DataFrame, zones: DataFrame) -> DataFrame:
    """Every person with the first zone (by ``ord``) of the frame's camera that holds the feet, else TRANSIT_ZONE."""
    x, y = g.ground_point(F.col("bbox"))
    inside = (people["camera_id"] == zones["camera_id"]) & g.inside_polygon(x, y, F.col("polygon"))
    return people.join(zones, inside, "left").groupBy("frame", "person").agg(F.coalesce(F.min_by("zone_id", "ord"), F.lit(TRANSIT)).alias("zone_id"))


def crowded(people: DataFrame, least: float) -> DataFrame:
    """``people`` with crowded: another person of the frame overlaps by ``least`` IoU or more. A frame's boxes meet once, in one window."""
    others = F.collect_list(F.struct("person", "bbox")).over(Window.partitionBy("frame"))
    near = F.exists("__all", lambda o: (o["person"] != F.col("person")) & (g.iou(F.col("bbox"), o["bbox"]) >= least))
    return people.withColumn("__all", others).withColumn("crowded", near).drop("__all")


def overlaps(people: DataFrame, least: float) -> DataFrame:
    """Persons that another person of the frame overlaps by ``least`` IoU or more."""
    return crowded(people, least).where("crowded").select("frame", "person").distinct()


def clear_people(people: DataFrame, least: float = 0.30) -> DataFrame:
    """``people`` with whether each is clear enough to be judged."""
    return crowded(people, least).withColumn("clear", g.clear_person(F.col("bbox"), F.col("crowded"))).drop("crowded")


def countable(people: DataFrame, conf: float = 0.4, height: float = 60.0, least: float = 0.3) -> DataFrame:
    """``people`` with whether each surely counts as one."""
    b = F.col("bbox")
    return crowded(people, least).withColumn("countable", (F.col("conf") >= conf) & (b[3] - b[1] >= height) & ~F.col("crowded")).drop("crowded")


def wide_scenes(people: DataFrame, height: float, least: int = 3, most: int = 8, share: float = 0.30) -> DataFrame:
    """Frames of ``least`` to ``most`` people who are each lower than ``share`` of the frame's height."""
    b = F.col("bbox")
    return people.groupBy("frame").agg(F.count("*").alias("people"), F.max(b[3] - b[1]).alias("tallest")).where(F.col("people").between(least, most) & (F.col("tallest") < share * height)).select("frame", "people")


def close_ups(people: DataFrame, most: int = 10) -> DataFrame:
    """The tallest people of every frame: whom a closer look is worth."""
    b = F.col("bbox")
    w = Window.partitionBy("frame").orderBy(F.desc(b[3] - b[1]), "person")
    return people.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("frame", "person", "rank")


def worn(people: DataFrame, items: DataFrame) -> DataFrame:
    """Each item goes to at most one person: of those in whose head or torso region it is, the one
    whose target point is nearest (then the first); a person keeps the best confidence per kind.

    ``items``: frame, item, cls, item_box, item_conf[, cx, cy]. Where the centre is given it is not
    taken from the box again: the box's rounded edges move it by the last digit, which decides near ties.
    """
    p, i = F.col("bbox"), F.col("item_box")
    h = F.greatest(F.lit(1.0), p[3] - p[1])
    cx, cy = (F.col("cx"), F.col("cy")) if {"cx", "cy"} <= set(items.columns) else g.centre(i)
    head = (cx >= p[0]) & (cx <= p[2]) & (cy >= p[1] - HEAD_SLACK * h) & (cy <= p[1] + HEAD_BOTTOM * h)
    torso = (cy >= p[1] + VEST_TOP * h) & (cy <= p[1] + VEST_BOTTOM * h) & (g.containment(i, p) >= HELD)
    target = F.when(F.col("cls") == "helmet", TARGET["helmet"]).otherwise(TARGET["safety_vest"])
    near = F.pow(cx - (p[0] + p[2]) / 2, 2) + F.pow(cy - (p[1] + target * h), 2)
    pairs = people.join(items, "frame").where(F.when(F.col("cls") == "helmet", head).otherwise(torso))
    best = pairs.groupBy("frame", "item", "cls").agg(F.min_by(F.struct("person", "item_conf"), F.struct(near, F.col("person"))).alias("m"))
    return best.groupBy("frame", F.col("m.person").alias("person"), "cls").agg(F.max("m.item_conf").alias("conf"))


def keypoints_for(people: DataFrame, poses: DataFrame, least: float = 0.3) -> DataFrame:
    """Every person with the pose whose box overlaps best, null below ``least``."""
    pairs = people.join(poses, "frame", "left").withColumn("v", g.iou(F.col("bbox"), F.col("pose_box")))
    return pairs.groupBy("frame", "person").agg(F.max_by("pose", F.when(F.col("v") >= least, F.struct(F.col("v"), -F.col("pose")))).alias("pose"))


def zone_counts(people: DataFrame, zones: DataFrame) -> DataFrame:
    """Heads per frame and zone of its camera, 0 for zones without anyone."""
    every = people.select("frame", "camera_id").distinct().join(zones.select("camera_id", "zone_id"), "camera_id").select("frame", "zone_id")
    found = in_zone(people, zones).groupBy("frame", "zone_id").agg(F.count("*").alias("n"))
    return every.join(found, ["frame", "zone_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def match_truth(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches per image and class: surest prediction first, each truth once.

    Both sides come sorted out of one window, truths first; the boxes of many images are compared, and their pairs decided, side by side.
    """

    def rows(df, side, conf, name, box):
        corners = [F.col(box)[i].cast("double").alias(f"b{i}") for i in range(4)]
        return df.select("image", "cls", F.lit(side).alias("side"), conf.cast("double").alias("c"), F.col(name).cast("long").alias("id"), *corners).na.drop(subset=["image", "cls", "b0", "b1", "b2", "b3"])

    order = Window.partitionBy("image", "cls").orderBy("side", "c", "id")
    both = rows(truth, 0, F.lit(None), "truth", "true_box").unionByName(rows(predicted, 1, -F.col("conf"), "pred", "pred_box"))
    placed = both.select("image", "cls", "side", "id", "b0", "b1", "b2", "b3", F.row_number().over(order).alias("n"), F.dense_rank().over(order).alias("place"))
    schema = placed.select("image", "cls", F.col("id").alias("pred"), F.col("id").alias("truth")).schema
    kinds = {f.name: f.dataType for f in predicted.select("image", "cls").schema}

    def matched(batches):
        return _matched(batches, least)

    found = placed.mapInArrow(matched, schema)
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds], "pred", "truth")


PAIRS = 1 << 20


def _matched(batches, least: float):
    """The matches of sorted rows, numbered from 1 in their group; groups are kept whole."""
    held = []
    for b in batches:
        starts = np.flatnonzero(np.asarray(b.column("n")) == 1)
        if len(starts):
            yield from _taken([*held, b.slice(0, starts[-1])], least)
            held, b = [], b.slice(starts[-1])
        held.append(b)
    yield from _taken(held, least)


def _met(boxes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``geometry.iou`` of the boxes ``p`` and ``q``; as there, NaN is the largest number."""
    a, b = boxes[:, p], boxes[:, q]
    side = lambda i: np.maximum(0.0, np.fmin(a[i + 2], b[i + 2]) - np.maximum(a[i], b[i]))
    inter, area = side(0) * side(1), (boxes[2] - boxes[0]) * (boxes[3] - boxes[1])
    union = area[p] + area[q] - inter
    return np.divide(inter, union, out=np.zeros(len(p)), where=~(union <= 0))


def _taken(batches, least: float):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    get = lambda name: t.column(name).to_numpy()
    boxes, place, guess = np.stack([get(f"b{i}") for i in range(4)]), get("place"), get("side") == 1
    starts = np.flatnonzero(get("n") == 1)
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(guess)]))
    truths = np.bincount(group[~guess], minlength=len(starts))
    guesses = np.flatnonzero(guess)
    # every guess with all truths of its group, so many pairs at a time; a group's truths are its first rows
    many = truths[group[guesses]]
    ends, p, q, v = np.cumsum(many), [], [], []
    for lo in range(0, int(many.sum()), PAIRS):
        at = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
        g = np.searchsorted(ends, at, side="right")
        i, j = guesses[g], starts[group[guesses[g]]] + at - (ends - many)[g]
        met = _met(boxes, i, j)
        near = ~(met < least)
        p.append(i[near]), q.append(j[near]), v.append(met[near])
    if not p:
        return
    p, q, v = map(np.concatenate, (p, q, v))
    order = np.lexsort((q, -v, place[p], group[p]))
    p, q = p[order], q[order]

    def numbers(rows):
        """A number for each id of a group; null is equal to nothing."""
        null = t.column("id").is_null().to_numpy()[rows]
        value = np.unique(t.column("id").fill_null(0).to_numpy()[rows], return_inverse=True)[1]
        return np.unique(np.where(null, -1 - np.arange(len(rows)), group[rows] * len(rows) + value), return_inverse=True)[1]

    a, b = numbers(p), numbers(q)
    rest, chosen = np.arange(len(a)), np.zeros(len(a), bool)
    first_a, first_b, done_a, done_b = (np.zeros(len(a), kind) for kind in (np.int64, np.int64, bool, bool))
    while len(rest):  # a pair that comes first on both its sides is taken whatever the others are
        back = rest[::-1]
        first_a[a[back]], first_b[b[back]] = back, back
        won = rest[(first_a[a[rest]] == rest) & (first_b[b[rest]] == rest)]
        chosen[won] = done_a[a[won]] = done_b[b[won]] = True
        rest = rest[~(done_a[a[rest]] | done_b[b[rest]])]
    p, q = p[chosen], q[chosen]
    yield from pa.table([t.column("image").take(p), t.column("cls").take(p), t.column("id").take(p), t.column("id").take(q)], names=["image", "cls", "pred", "truth"]).to_batches()


def found_close_up(people: DataFrame, found: DataFrame, width: int, height: int, below: float = crops.SMALL) -> DataFrame:
    """Detections of the windows around small people, in frame pixels: frame, person, cls, box, conf.

    ``people``: frame, person, bbox; ``found``: frame, person, cls, box (in the window's
    picture), conf. What lies in no window is left out.
    """
    shown = people.where(crops.wants_close_up(F.col("bbox"), below)).withColumn("win", crops.window(F.col("bbox"), width, height)).where("win IS NOT NULL").withColumn("picture", crops.scaled(F.col("win")))
    both = found.join(shown.select("frame", "person", "win", "picture"), ["frame", "person"])
    return both.select("frame", "person", "cls", crops.to_frame(F.col("box"), F.col("win"), F.col("picture")).alias("box"), "conf")


def once_each(found: DataFrame, least: float = 0.5) -> DataFrame:
    """``found`` (frame, cls, box, conf, ...) without what windows that overlap show again: of a class in a frame, surest first, a box that meets a
    kept one by ``least`` or more goes. The order decides: a fold over one frame's boxes inside an expression."""
    others = [c for c in found.columns if c not in ("frame", "cls")]
    rows = found.groupBy("frame", "cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("__sure"), *others))).alias("rows"))
    # indexes of the kept ones, so that the fold carries no rows
    meets = lambda acc, r: F.exists(acc, lambda k: g.iou(F.get("rows", k)["box"], F.get("rows", r)["box"]) >= least)
    kept = F.aggregate(F.sequence(F.lit(0), F.size("rows") - 1), F.array().cast("array<int>"), lambda acc, r: F.when(meets(acc, r), acc).otherwise(F.concat(acc, F.array(r.cast("int")))))
    return rows.withColumn("kept", kept).select("frame", "cls", F.explode(F.transform("kept", lambda k: F.get("rows", k))).alias("r")).select("frame", "cls", *[f"r.{c}" for c in others]).select(*found.columns)


# --------------------------------------------------------------------------- ordered state over samples
def order(key: str, rows: tuple[int, int] | None = None):
    w = Window.partitionBy(key).orderBy("ts", "sample_id")
    return w.rowsBetween(*rows) if rows else w


def posture_changes(samples: DataFrame) -> DataFrame:
    """Running number of changes of posture of every track."""
    before = F.lag("posture_state").over(order("track_id"))
    changed = samples.withColumn("changed", F.coalesce((before != F.col("posture_state")).cast("int"), F.lit(0)))
    return changed.withColumn("shifts", F.sum("changed").over(order("track_id", (Window.unboundedPreceding, 0)))).select("sample_id", "track_id", "shifts")


def dwell_so_far(samples: DataFrame) -> DataFrame:
    """Whole seconds since a track was first seen."""
    first = F.min("ts").over(order("track_id", (Window.unboundedPreceding, 0)))
    return samples.select("sample_id", "track_id", F.floor((F.unix_micros("ts") - F.unix_micros(first)) / 1_000_000).alias("dwell_s"))


def recent_speed(samples: DataFrame, places: int = 6) -> DataFrame:
    """Mean step between the last ``places`` positions; 0 below three."""
    w = order("track_id")
    step = F.sqrt(F.pow(F.col("floor_x") - F.lag("floor_x").over(w), 2) + F.pow(F.col("floor_y") - F.lag("floor_y").over(w), 2))
    recent = order("track_id", (-(places - 2), 0))
    n = F.count("step").over(recent)
    return samples.withColumn("step", step).select("sample_id", "track_id", F.when(n >= 2, F.avg("step").over(recent)).otherwise(0.0).alias("speed"))


def activity(samples: DataFrame, places: int = 30) -> DataFrame:
    """0.75 of the spread of recent positions (15 and more count as 100) and 8 a posture change, 25 at most; 50 with one position."""
    recent = order("track_id", (-(places - 1), 0))
    n = F.count("*").over(recent)
    spread = (F.stddev_pop(F.col("floor_x") * 1000).over(recent) + F.stddev_pop(F.col("floor_y") * 1000).over(recent)) / 2
    score = 0.75 * F.least(F.lit(100.0), spread / 15 * 100) + F.least(F.lit(25.0), 8.0 * F.col("shifts"))
    return samples.join(posture_changes(samples).drop("track_id"), "sample_id").select("sample_id", "track_id", F.when(n < 2, 50.0).otherwise(score).alias("score"))


def median_of(values: Column) -> Column:
    """Median of an array column, null for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n == 0, None).otherwise((F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def sliding_median(samples: DataFrame, value: str = "activity_score", rows: int = 9) -> DataFrame:
    """Median of the last ``rows`` values of a track."""
    values = F.collect_list(value).over(order("track_id", (-(rows - 1), 0)))
    return samples.withColumn("v", values).select("sample_id", "track_id", median_of(F.col("v")).alias("median"))


def gap_tolerance(samples: DataFrame, least: float = 0.5, factor: float = 2.5, rows: int = 9) -> DataFrame:
    """``factor`` times the median of the last ``rows`` gaps between samples, ``least`` at least."""
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order("track_id")))) / 1e6
    gaps = samples.withColumn("gap", gap).withColumn("v", F.collect_list("gap").over(order("track_id", (-(rows - 1), 0))))
    return gaps.select("sample_id", "track_id", F.greatest(F.lit(least), F.coalesce(factor * median_of(F.col("v")), F.lit(least))).alias("tolerance"))


def evidence(samples: DataFrame, stale_s: float, window: int = 30, need: int = 8, seen: float = 45.0, weak: float = 20.0, present: float = 0.60, absent: float = 0.90) -> DataFrame:
    """PRESENT, ABSENT or UNVERIFIABLE after every sample, of all clear ones among the last ``window`` that are ``stale_s`` old at most.

    Also the shares that show the item and that show nothing, the mean confidence of the
    first, and the share of the newest ``need`` clear samples that show it. The score serves as
    confidence in percent; AWAY samples are not clear.
    """
    seen_so = F.collect_list(F.struct("ts", (F.col("posture_state") != "AWAY").alias("clear"), F.col("activity_score").alias("conf"))).over(order("track_id", (-(window - 1), 0)))
    fresh = F.filter("w", lambda o: o["clear"] & (F.unix_micros(F.col("ts")) - F.unix_micros(o["ts"]) <= int(stale_s * 1_000_000)))
    shows = F.filter("c", lambda o: o["conf"] >= seen)
    rows = samples.withColumn("w", seen_so).withColumn("c", fresh).withColumn("n", F.size("c")).withColumn("shown", F.size(shows)).withColumn("empty", F.size(F.filter("c", lambda o: o["conf"] < weak)))
    share = lambda x, n: F.when(n > 0, F.bround(x / n, 3)).otherwise(0.0)
    total = F.aggregate(shows, F.lit(0).cast("decimal(28,8)"), lambda a, o: (a + o["conf"].cast("decimal(28,8)")).cast("decimal(28,8)"))
    newest = F.slice("c", F.greatest(F.lit(1), F.col("n") - need + 1), need)
    return rows.select(
        "sample_id", "track_id", F.col("n").alias("clear_frames"), share(F.col("shown"), F.col("n")).alias("seen_fraction"), share(F.col("empty"), F.col("n")).alias("empty_fraction"),
        F.when(F.col("shown") > 0, rounded(total.cast("double") / F.col("shown"), 3)).otherwise(0.0).alias("mean_conf"),
        share(F.size(F.filter(newest, lambda o: o["conf"] >= seen)), F.size(newest)).alias("recent_fraction"),
        F.when(F.col("n") < need, "UNVERIFIABLE").when(F.col("shown") / F.col("n") >= present, "PRESENT").when(F.col("empty") / F.col("n") >= absent, "ABSENT").otherwise("UNVERIFIABLE").alias("state"),
    )


def verdicts(items: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict of all required items' states: any surely ABSENT is a violation, all PRESENT comply, else it cannot be told."""
    states = F.collect_set("state")
    return items.groupBy(*keys).agg(F.when(F.array_contains(states, "ABSENT"), "NON_COMPLIANT").when(F.size(states) > 1, "UNVERIFIABLE").when(F.array_contains(states, "PRESENT"), "COMPLIANT").otherwise("UNVERIFIABLE").alias("verdict"))


def streaks(samples: DataFrame, state: str = "AWAY", least_s: float = 0.0) -> DataFrame:
    """Unbroken runs of one posture: start, end, samples (gaps and islands)."""
    w = order("track_id")
    marked = samples.withColumn("n", F.row_number().over(w)).where(F.col("posture_state") == state).withColumn("island", F.col("n") - F.row_number().over(w))
    found = marked.groupBy("track_id", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("samples"))
    return found.where((F.unix_micros("end") - F.unix_micros("start")) / 1e6 >= least_s).select("track_id", "start", "end", "samples")


def visits(samples: DataFrame, gap_s: int = 3600) -> DataFrame:
    """Visits of a track to a zone: samples no more than ``gap_s`` apart in the same zone."""
    w = order("track_id")
    new = (F.coalesce(F.lag("zone_id").over(w) != F.col("zone_id"), F.lit(True)) | ((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > gap_s * 1_000_000)).cast("int")
    numbered = samples.withColumn("new", new).withColumn("visit", F.sum("new").over(order("track_id", (Window.unboundedPreceding, 0))))
    return numbered.groupBy("track_id", "visit").agg(F.min("zone_id").alias("zone_id"), F.min("ts").alias("entered"), F.max("ts").alias("left"), F.count("*").alias("samples"))


def dwell_decisions(found: DataFrame, limit_s: float) -> DataFrame:
    """MAX_DWELL on stays (entered, left, reason, first_sighting): the limit reached is flagged at that time; of the others only those seen
    from entry to exit comply, who was inside when first seen, was lost or still inside at the end cannot be told."""
    entered = F.unix_micros("entered")
    over = F.unix_micros("left") - entered >= int(limit_s * 1_000_000)
    whole = (F.col("reason") == "LEFT") & ~F.col("first_sighting")
    outcome = F.when(over, "EXCEEDED").when(whole, "WITHIN_LIMIT").when(F.col("reason") == "LEFT", "PARTIAL").when(F.col("reason") == "LOST", "LOST").otherwise("INCOMPLETE")
    at = F.timestamp_micros(F.when(over, entered + int(limit_s * 1_000_000)).otherwise(entered))
    return found.withColumn("outcome", outcome).select("track_id", "visit", "zone_id", "outcome", F.when(F.col("outcome") == "EXCEEDED", "POTENTIAL_VIOLATION").when(F.col("outcome") == "WITHIN_LIMIT", "COMPLIANT").otherwise("UNVERIFIABLE").alias("status"), at.alias("judged_at"))


def exit_decisions(leaves: DataFrame, arrivals: DataFrame, seen: DataFrame, key: str, exit_zone: str, within_s: float, wait_s: float = 1.2, slack_s: float = 1.5) -> DataFrame:
    """REQUIRED_EXIT: whether who left a zone came to the exit in time.

    ``leaves``: key, id, at, home (exits that were seen, LEFT); ``arrivals``: key, at, zone,
    zone_type; ``seen``: key, at. The first arrival settles it, unless it is on the way (an
    approach or a checkpoint); back home is no decision. Without one by the deadline and
    ``wait_s``, who was seen in the last ``slack_s`` did not reach it; anybody else cannot be told.
    """
    us = lambda s: int(s * 1_000_000)
    t = F.unix_micros("at")
    settles = arrivals.where((F.col("zone") == exit_zone) | ~F.coalesce(F.col("zone_type").isin("APPROACH", "PPE_CHECKPOINT"), F.lit(False)))
    both = leaves.select(key, "id", t.alias("t"), "home", F.lit(0).alias("kind")).unionByName(settles.select(key, t.alias("t"), "zone", F.lit(1).alias("kind")), allowMissingColumns=True)
    # backwards, as a window up to the last row is worked out anew for every row
    w = Window.partitionBy(key).orderBy(F.desc("t"), F.desc("kind"), F.desc("zone")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("kind") == 1, F.struct("t", "zone")), ignorenulls=True).over(w)
    open_ = both.withColumn("next", after).where("kind = 0").withColumn("due", F.col("t") + us(within_s + wait_s))
    marks = open_.select(key, "id", F.col("due").alias("s"), F.lit(1).alias("asks")).unionByName(seen.select(key, t.alias("s"), F.lit(0).alias("asks")), allowMissingColumns=True)
    last = F.last(F.when(F.col("asks") == 0, F.col("s")), ignorenulls=True).over(Window.partitionBy(key).orderBy("s", "asks").rowsBetween(Window.unboundedPreceding, 0))
    viewed = marks.withColumn("last", last).where("asks = 1").select(key, "id", "last")
    rows = open_.join(viewed, [key, "id"])
    settled = F.coalesce(F.col("next.t") < F.col("due"), F.lit(False))
    outcome = (
        F.when(settled & (F.col("next.zone") == F.col("home")), None).when(settled & (F.col("next.zone") == exit_zone) & (F.col("next.t") - F.col("t") <= us(within_s)), "REACHED_EXIT")
        .when(settled & (F.col("next.zone") == exit_zone), "REACHED_EXIT_LATE").when(settled, "OTHER_ZONE").when(F.col("due") - F.col("last") <= us(slack_s), "NOT_REACHED").otherwise("OUT_OF_VIEW")
    )
    status = F.when(F.col("outcome") == "REACHED_EXIT", "COMPLIANT").when(F.col("outcome") == "OUT_OF_VIEW", "UNVERIFIABLE").otherwise("POTENTIAL_VIOLATION")
    return rows.withColumn("outcome", outcome).where("outcome IS NOT NULL").select(key, "id", "outcome", status.alias("status"), F.bround((F.when(settled, F.col("next.t")).otherwise(F.col("due")) - F.col("t")) / 1e6, 3).alias("elapsed_seconds"))


def union_of_spans(spans: DataFrame, key: str, tolerance_us: int) -> DataFrame:
    """Intervals [start, end] in microseconds of a key, merged where they touch within a tolerance."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach + tolerance_us).cast("int"), F.lit(1))
    return spans.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def last_before(entries: DataFrame, passes: DataFrame, key: str, within_s: float, slack_s: float = 0.0) -> DataFrame:
    """As-of join: every entry with the last pass of its key up to ``slack_s`` later and ``within_s`` old, else null.

    One sort per key instead of a range join: passes and entries are merged in time order
    and each entry looks back to the last pass.
    """
    shift = int(slack_s * 1_000_000)
    both = entries.select(key, "id", F.unix_micros("at").alias("t"), F.lit(1).alias("kind")).unionByName(
        passes.select(key, F.lit(None).cast("long").alias("id"), (F.unix_micros("at") - shift).alias("t"), F.lit(0).alias("kind"))
    )
    w = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("kind") == 0, F.col("t") + shift), ignorenulls=True).over(w)
    rows = both.withColumn("pass", seen).where("kind = 1")
    return rows.select(key, "id", F.when(F.col("t") - F.col("pass") <= int(within_s * 1_000_000), F.timestamp_micros("pass")).alias("passed_at"))


def first_after(leaves: DataFrame, arrivals: DataFrame, key: str, within_s: float) -> DataFrame:
    """Forward as-of join: every leave with the next arrival of its key within ``within_s``, else null."""
    both = leaves.select(key, "id", F.unix_micros("at").alias("t"), F.lit(0).alias("kind")).unionByName(arrivals.select(key, F.lit(None).cast("long").alias("id"), F.unix_micros("at").alias("t"), F.lit(1).alias("kind")))
    # backwards, as a window up to the last row is worked out anew for every row
    w = Window.partitionBy(key).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("kind") == 1, F.col("t")), ignorenulls=True).over(w)
    rows = both.withColumn("next", seen).where("kind = 0")
    return rows.select(key, "id", F.when(F.col("next") - F.col("t") <= int(within_s * 1_000_000), F.timestamp_micros("next")).alias("arrived_at"))


def cadence(samples: DataFrame, slow_s: float = 0.4, rows: int = 9) -> DataFrame:
    """Whether each sample is looked at: every one where the recent gaps are slow, else every second.

    Also the age up to which evidence counts: ten times the median of the last ``rows`` gaps, 10 s at least.
    """
    w = order("track_id")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    found = samples.withColumn("gap", gap).withColumn("v", F.collect_list("gap").over(order("track_id", (-(rows - 1), 0)))).withColumn("m", median_of(F.col("v"))).withColumn("n", F.row_number().over(w))
    return found.select("sample_id", "track_id", (F.coalesce(F.col("m") >= slow_s, F.lit(False)) | (F.col("n") % 2 == 1)).alias("looked_at"), F.greatest(F.lit(10.0), F.coalesce(10 * F.col("m"), F.lit(10.0))).alias("stale_s"))


def majority_posture(samples: DataFrame, names: tuple[str, ...], rows: int = 7) -> DataFrame:
    """The most frequent of the last ``rows`` postures; ties go to the one named first."""
    recent = order("track_id", (-(rows - 1), 0))
    votes = F.array(*[F.struct(F.count_if(F.col("posture_state") == p).over(recent).alias("n"), F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(names)])
    return samples.select("sample_id", "track_id", F.array_max(votes)["p"].alias("posture"))


def adopted(lost: DataFrame, new: DataFrame, within_s: float = 1.5, least: float = 0.3) -> DataFrame:
    """New tracks that are a person lost a moment before: the lost box that overlaps most, then the smaller id.

    ``lost``: frame, lost_id, lost_at, lost_box; ``new``: frame, new_id, new_at, new_box. A lost
    person's time goes to its slot and the next, so that the join is an equality.
    """
    slot = lambda t: F.floor(t / within_s)
    a = lost.withColumn("slot", F.explode(F.array(slot(F.col("lost_at")), slot(F.col("lost_at")) + 1)))
    pairs = new.withColumn("slot", slot(F.col("new_at"))).join(a, ["frame", "slot"]).withColumn("v", g.iou(F.col("new_box"), F.col("lost_box")))
    near = pairs.where(F.col("new_at").between(F.col("lost_at"), F.col("lost_at") + within_s) & (F.col("v") >= least))
    return near.groupBy("frame", "new_id").agg(F.max_by("lost_id", F.struct("v", -F.col("lost_id"))).alias("lost_id"))


def checkpoint_entries(entries: DataFrame, passes: DataFrame, key: str, within_s: float) -> DataFrame:
    """Entries by way of a checkpoint: judged by what was seen at the last pass within the time, else at the entry itself."""
    judged = last_before(entries, passes, key, within_s, 1.0)
    state = passes.select(key, F.col("at").alias("passed_at"), "state").groupBy(key, "passed_at").agg(F.min("state").alias("state"))
    found = judged.join(state, [key, "passed_at"], "left")
    return found.select(key, "id", F.when(F.col("passed_at").isNull(), "AT_ENTRY").when(F.col("state") == "PRESENT", "COMPLIANT").when(F.col("state") == "ABSENT", "POTENTIAL_VIOLATION").otherwise("UNVERIFIABLE").alias("status"))
