"""A session's clock and order: jumps back, footage shown again, lost cameras, and the order of what is said.

Rows come with n, their place in the order of arrival, and t, the time in the footage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config
from ..sources.sinks import kept_table
from . import episodes, equipment, zone_visits

#: Fixed order of a frame's records: events first, then rules on equipment and stays, people down, head counts.
STAGES = ("EVENT", "COMPLIANCE", "MAN_DOWN", "OCCUPANCY")


def generations(frames: DataFrame, lost_s: float | None = None) -> DataFrame:
    """``frames`` (session, n, t[, arrived]) with generation and reset: each jump back in time begins a new one (TIME_REGRESSED), and
    so does a pause of over ``lost_s`` between arrivals (CAMERA_LOST). State never reaches over a generation's start."""
    w = Window.partitionBy("session").orderBy("n")
    back = F.coalesce(F.col("t") < F.lag("t").over(w), F.lit(False))
    reset = F.when(back, "TIME_REGRESSED")
    if lost_s is not None:
        pause = F.unix_micros("arrived") - F.unix_micros(F.lag("arrived").over(w))
        reset = reset.when(pause > int(lost_s * 1_000_000), "CAMERA_LOST")
    marked = frames.withColumn("reset", reset)
    return marked.withColumn("generation", F.count("reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def replayed(frames: DataFrame, fps: float) -> DataFrame:
    """``frames`` (session, n, t, generation) with replay: whether the time was already processed when the frame came.

    Two frames in a row process the time between them if they are 1.5 frames apart at most;
    footage that was skipped and is visited later is new. A step is no longer than a slot,
    so that it touches two slots and meets only their frames.
    """
    reach = 1.5 / fps
    w = Window.partitionBy("session", "generation").orderBy("n")
    slot = lambda x: F.floor(x / reach).cast("long")
    before = F.lag("t").over(w)
    steps = frames.withColumn("a", F.when(F.col("t") - before <= reach + 1e-9, before).otherwise(F.col("t"))).select("session", F.col("n").alias("seen"), "a", F.col("t").alias("b"))
    steps = steps.withColumn("slot", F.explode(F.sequence(slot(F.col("a")), slot(F.col("b")))))
    first = frames.select("session", "n", "t", slot(F.col("t")).alias("slot")).join(steps, ["session", "slot"]).where((F.col("t") >= F.col("a") - 1e-9) & (F.col("t") <= F.col("b") + 1e-9)).groupBy("session", "n").agg(F.min("seen").alias("seen"))
    return frames.join(first, ["session", "n"], "left").withColumn("replay", F.coalesce(F.col("seen") < F.col("n"), F.lit(False))).drop("seen")


def skipped(frames: DataFrame, speed: float) -> DataFrame:
    """The frames that are shown at ``speed``: at more than 1, each whose share of the debt makes a whole frame."""
    whole = lambda i: F.floor(i / F.lit(max(speed, 1.0)))
    return frames.where((F.col("frame") == 0) | (whole(F.col("frame")) > whole(F.col("frame") - 1)))


def zone_sets(frames: DataFrame) -> DataFrame:
    """``frames`` (worker's zone in the picture, home: where the tracker has them) as one row for each of both, once: who stands on a zone's edge is still there."""
    both = F.explode(F.array_distinct(F.array_compact(F.array("zone", "home"))))
    return frames.withColumn("in_zone", both).drop("zone", "home").withColumnRenamed("in_zone", "zone")


def heads(seen: DataFrame, tracked: zone_visits.Track, asked: DataFrame | None = None) -> DataFrame:
    """Head counts for the occupancy rules: session, zone, t, seen, clear, hidden. A zone in use is counted in every frame of its session, or those ``asked`` for.

    ``seen``: session, worker, t, zone, clear (whether the person can be counted with
    certainty); ``tracked``: the same frames by ``zone_visits.track``.
    """
    home = F.when(F.col("home") != zone_visits.OUTSIDE, F.col("home"))
    inside = zone_sets(zone_visits.at_home(seen.where("worker IS NOT NULL"), tracked.rows).withColumn("home", home).withColumn("stays", home))
    here = inside.groupBy("session", "zone", "t").agg(F.count("*").alias("seen"), F.count_if("clear").alias("clear"), F.count_if(F.col("stays") == F.col("zone")).alias("here"))
    return zone_visits.counted(tracked, kept_table(here), asked)


def records(frames: DataFrame, seen: DataFrame, looks: DataFrame | None = None, bodies: DataFrame | None = None, fps: float = 10.0, lost_s: float | None = None,
            dwell: dict[str, float] | None = None, entry: list[str] | None = None, least: int | None = None, most: int | None = None, config: Config | None = None) -> DataFrame:
    """All that sessions tell, in order: session, place, n (the frame it is told with, null after the last), generation, stage, kind, worker, zone, t, details.

    ``frames``: session, n, t[, arrived], every frame in order of arrival. ``seen``: session, n,
    worker, zone, clear. ``looks``: session, n, worker, item and a verdict (see
    ``equipment.frame_looks``); ``bodies``: session, n, worker and a body (see
    ``episodes.postures``). Rules: ``dwell`` zone -> seconds, ``entry`` zones where equipment is
    judged, ``least`` and ``most`` people of a zone.

    A jump back in time, and a pause of over ``lost_s``, ends a generation: what is open is
    closed, told with the next frame before anything else, and nothing is remembered. In
    frames that were processed before, workers are followed but nothing is told and no rule
    is asked. A visit that began in such a frame is marked as one that started in a replay;
    if the generation ends before it was followed into new footage, it is not told at all.
    Zone events feed the rules on equipment and stays; these, people lying still and head
    counts follow the events of their frame in the order of ``STAGES``.
    """
    c = config or Config()
    clocked = replayed(generations(frames, lost_s), fps)
    part = F.concat_ws("/", F.col("session"), F.col("generation").cast("string"))
    clocked = kept_table(clocked.select(part.alias("part"), "session", "generation", "n", F.col("t").cast("double").alias("t"), "replay", "reset"))
    moments = clocked.groupBy("part", "t").agg(F.min("n").alias("n"), F.min_by("replay", "n").alias("replay"))
    # why generations end, and the frame that tells it: the first of the next one
    w = Window.partitionBy("session").orderBy("generation")
    parts = clocked.groupBy("part", "session", "generation").agg(F.min("n").alias("first"), F.max("t").alias("ends"), F.max(F.when(~F.col("replay"), F.col("n"))).alias("fresh"), F.first("reset", True).alias("why"))
    parts = kept_table(parts.select("part", "session", "generation", "ends", "fresh", F.lead("first").over(w).alias("next"), F.lead("why").over(w).alias("why")))
    times = clocked.select(F.col("part").alias("session"), "t")
    frame = clocked.select("session", "n", "part", "t", "replay")
    at = lambda rows: rows.join(frame, ["session", "n"]).withColumn("session", F.col("part")).drop("part", "n")
    people = kept_table(at(seen).dropDuplicates(["session", "worker", "t"]))

    limits = {z: {float(s): c.dwell_warn_fraction} for z, s in (dwell or {}).items()}
    tracked = zone_visits.track(people.select("session", "worker", "t", "zone"), c, times, kept_table)
    told = zone_visits.zone_records(people, c, limits, reasons=parts.where("why IS NOT NULL").select(F.col("part").alias("session"), "why"), tracked=tracked)
    events = kept_table(_heard(told, moments, parts))
    spoken = events.where("spoken").select(
        "part", F.col("n"), F.when(F.col("at_end"), -1).otherwise(0).alias("order"), F.lit(STAGES[0]).alias("stage"), F.col("event_type").alias("kind"), "worker", F.col("zone_id").alias("zone"), "t", "details", "rank",
    )

    decisions = []
    if dwell:
        decisions.append(_dwell(events, parts, dwell))
    if entry and looks is not None:
        here = events.where(F.col("zone_id").isin(list(entry)))
        visits = _visits(here).join(parts.select("part", "ends"), "part").withColumnRenamed("part", "session").select("session", "worker", "zone_id", "entered", "left", "reason", "ends")
        shown = at(looks).where("NOT replay").drop("replay")
        shown = shown.join(visits.select("session", "worker", "zone_id").distinct(), ["session", "worker"])
        judged = equipment.entry_decisions(visits, shown, ["session", "worker", "zone_id"], config=c)
        decisions.append(judged.select(F.col("session").alias("part"), F.lit("PPE_ENTRY").alias("kind"), "worker", F.col("zone_id").alias("zone"), "status", "t", "confidence", "evidence", "decided"))
    if bodies is not None:
        lying = episodes.man_down(at(bodies).where("NOT replay").drop("replay"), ["session", "worker"], config=c)
        decisions.append(lying.select(F.col("session").alias("part"), F.lit("MAN_DOWN").alias("kind"), "worker", F.lit(None).cast("string").alias("zone"), "status", "t", "confidence", "evidence", "decided"))
    if least is not None or most is not None:
        counted = heads(people.select("session", "worker", "t", "zone", "clear"), tracked, clocked.where("NOT replay").select(F.col("part").alias("session"), "t").distinct())
        crowds = episodes.occupancy(counted, ["session", "zone"], least=least, most=most, flag_empty=False, config=c)
        decisions.append(crowds.select(F.col("session").alias("part"), F.lit("OCCUPANCY").alias("kind"), F.concat(F.lit("zone-"), "zone").alias("worker"), "zone", "status", "t", "confidence", "evidence", "decided"))
    stage_of = {"MAX_DWELL": "COMPLIANCE", "PPE_ENTRY": "COMPLIANCE"}
    for d in decisions:
        stage = F.lit("COMPLIANCE") if "session" in d.columns else F.coalesce(F.create_map(*[F.lit(x) for kv in stage_of.items() for x in kv])[F.col("kind")], F.col("kind"))
        placed = kept_table(d).withColumn("decided", F.round("decided", 6)).join(parts.select("part", "next"), "part").join(moments.select("part", F.round("t", 6).alias("decided"), "n"), ["part", "decided"], "left")
        details = F.to_json(F.struct("status", "confidence", F.col("evidence").alias("evidence")))
        closes = F.get_json_object("evidence", "$.why") == "the footage ended"
        closes = F.coalesce(closes, F.lit(False)) | F.coalesce(F.get_json_object("evidence", "$.outcome") == "INCOMPLETE", F.lit(False))
        spoken = spoken.unionByName(placed.select("part", F.when(closes, F.col("next")).otherwise(F.col("n")).alias("n"), F.when(closes, -1).otherwise(0).alias("order"), stage.alias("stage"), "kind", "worker", "zone", "t", details.alias("details"), F.lit(9).alias("rank")))
    order = Window.partitionBy("session").orderBy(
        F.col("n").asc_nulls_last(), "order", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), "worker", "rank", "t", "zone", "kind", "details"
    )
    return spoken.join(parts.select("part", "session", "generation"), "part").withColumn("place", F.row_number().over(order)).select("session", "place", "n", "generation", "stage", "kind", "worker", "zone", "t", "details")


def _heard(told: DataFrame, moments: DataFrame, parts: DataFrame) -> DataFrame:
    """Zone records with the frame they are told with, whether that is a replay, their visit, and whether they are spoken."""
    # the first frame at or after the time of an event: one sort of both
    both = told.withColumnRenamed("session", "part").withColumn("s", F.col("when") - 1e-6).unionByName(moments.select("part", F.col("t").alias("s"), F.struct("n", "replay", "t").alias("f")), allowMissingColumns=True)
    # backwards, as a window up to the last row is worked out anew for every row
    w = Window.partitionBy("part").orderBy(F.desc("s"), F.col("f").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("f", F.last("f", ignorenulls=True).over(w)).where("event_type IS NOT NULL").withColumn("at_end", F.col("when") == float("inf"))
    found = found.join(parts.select("part", "next", "fresh"), "part")
    found = found.withColumn("n", F.when(F.col("at_end"), F.col("next")).otherwise(F.col("f.n"))).withColumn("replay", ~F.col("at_end") & F.coalesce(F.col("f.replay"), F.lit(False)))
    mine = Window.partitionBy("part", "worker").orderBy("when", "rank", "t", "event_type").rowsBetween(Window.unboundedPreceding, 0)
    enters = F.col("event_type") == "ENTERED_ZONE"
    found = found.withColumn("visit", F.sum(enters.cast("int")).over(mine)).withColumn("began", F.last(F.when(enters, F.struct(F.col("replay").alias("replay"), F.col("n").alias("n"))), ignorenulls=True).over(mine))
    partial = F.coalesce(F.col("began.replay"), F.lit(False))
    reached_new = F.coalesce(F.col("fresh") > F.col("began.n"), F.lit(False))
    spoken = F.when(F.col("at_end"), ~partial | reached_new).otherwise(~F.col("replay"))
    marked = F.when(partial & ~F.col("replay"), F.concat(F.expr("left(details, length(details) - 1)"), F.when(F.length("details") > 2, ",").otherwise(""), F.lit('"visit_started_in_replay":true}'))).otherwise(F.col("details"))
    return found.select("part", "worker", "when", "rank", "event_type", "zone_id", "t", marked.alias("details"), "at_end", "n", F.col("f.t").alias("shown"), "replay", "visit", spoken.alias("spoken"))


def _visits(events: DataFrame) -> DataFrame:
    """Visits whose entry the rules heard of: part, worker, visit, zone_id, entered, told (of the entry), left and reason (null while open), exit's frame."""
    heard = ~F.col("replay") & ~F.col("at_end")
    enters, leaves = (F.col("event_type") == "ENTERED_ZONE") & heard, (F.col("event_type") == "EXITED_ZONE") & heard
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    found = events.groupBy("part", "worker", "visit", "zone_id").agg(
        pick(enters, "t").alias("entered"), pick(enters, "when").alias("told"), pick(leaves, "when").alias("left"), pick(leaves, "t").alias("left_t"), pick(leaves, "details").alias("exit"), pick(enters, "details").alias("entry"), pick(F.col("event_type") == "EXITED_ZONE", "t").alias("closed"),
    )
    return found.where("entered IS NOT NULL").withColumn("reason", F.get_json_object("exit", "$.reason"))


def _dwell(events: DataFrame, parts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Stays against their zone's limit: over it at the time it is reached; within it, or why that cannot be told, at the end."""
    limit = F.coalesce(*[F.when(F.col("zone_id") == z, F.lit(float(s))) for z, s in limits.items()])
    here = events.where(F.col("zone_id").isin(list(limits)))
    over = here.where((F.col("event_type") == "DWELL_EXCEEDED") & ~F.col("replay") & ~F.col("at_end"))
    flags = over.select("part", "worker", "visit", F.col("zone_id").alias("zone"), F.lit("EXCEEDED").alias("outcome"), "t", F.col("shown").alias("decided"), limit.alias("dwell"))
    # a later entry that was heard replaces one whose exit was not
    w = Window.partitionBy("part", "worker", "zone_id").orderBy("visit")
    stays = _visits(here).withColumn("again", F.lead("visit").over(w)).join(over.select("part", "worker", "visit"), ["part", "worker", "visit"], "left_anti").join(parts.select("part", "ends"), "part")
    stays = stays.where("left IS NOT NULL OR again IS NULL")
    first = F.coalesce(F.get_json_object("entry", "$.first_sighting") == "true", F.lit(False))
    outcome = F.when(F.col("left").isNull(), "INCOMPLETE").when(F.col("reason") == "LOST", "LOST").when(first, "PARTIAL").otherwise("WITHIN_LIMIT")
    stayed = F.coalesce(F.col("left_t"), F.greatest(F.coalesce("closed", "ends"), F.col("entered"))) - F.col("entered")
    ended = stays.select("part", "worker", "visit", F.col("zone_id").alias("zone"), outcome.alias("outcome"), F.col("entered").alias("t"), F.coalesce("left", "ends").alias("decided"), stayed.alias("dwell"))
    every = flags.unionByName(ended)
    status = F.when(F.col("outcome") == "EXCEEDED", "POTENTIAL_VIOLATION").when(F.col("outcome") == "WITHIN_LIMIT", "COMPLIANT").otherwise("UNVERIFIABLE")
    evidence = F.to_json(F.struct(F.round("dwell", 3).alias("dwell_seconds"), "outcome"))
    return every.select("part", F.lit("MAX_DWELL").alias("kind"), "worker", "zone", status.alias("status"), F.round("t", 6).alias("t"), F.when(F.col("outcome").isin("EXCEEDED", "WITHIN_LIMIT"), 1.0).otherwise(0.0).alias("confidence"), evidence.alias("evidence"), "decided")


def available(results: DataFrame, limit: int = 3) -> DataFrame:
    """``results`` (session, n, failed) of a model with available: not after ``limit`` failures in a row, for good."""
    w = Window.partitionBy("session").orderBy("n")
    run = F.sum(F.col("failed").cast("int")).over(w.rowsBetween(1 - limit, 0))
    marked = results.withColumn("over", F.coalesce(run >= limit, F.lit(False)))
    return marked.withColumn("available", ~F.max("over").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("over")
