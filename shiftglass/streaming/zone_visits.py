"""Zone visits: debounced entries and exits, losses, returns and dwell limits, as windows over presence rows.

A spell is a stretch of one worker's frames in one place without an unwatched gap; it counts
(is settled) once it has lasted the confirm time of its kind. A settled spell elsewhere than
the one settled before is a move, dated back to the first frame of the spell or, if the
worker was outside on the way, to the first of those frames. A gap over the time to live
cuts a worker's frames into presences, whatever the frame rate; what was open ends there as lost. Everything else
(losses within a presence, returns, limits crossed, workers inside but out of sight) follows
from moves and gaps. Windows are per worker; absence is read from the session's frame times
by as-of look-ups, so that frames are never multiplied by workers.

Workers of one session are independent, and what is told of a session's first part does
not change with the rest: a stream recomputes the sessions a micro-batch touches and
appends what is new (see ``live``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Config
from ..operators import tasks
from ..sources.sinks import kept_table
from ..vocabulary import TRANSIT

EPS = 1e-9
OUTSIDE = ""
WHO = ["session", "worker"]
SCHEMA = "session string, worker string, event_type string, zone_id string, t double, details string"


def clock(frames: DataFrame, config: Config | None = None) -> DataFrame:
    """Every session's frame times and the gap between a worker's frames that a change survives there.

    It is 2.5 times the median of the last nine intervals between frames, at least the configured one.
    """
    c = config or Config()
    w = Window.partitionBy("session").orderBy("t")
    gaps = frames.select("session", "t").distinct().withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("v", F.sort_array(F.collect_list("gap").over(w.rowsBetween(-8, 0))))
    n = F.size("v")
    middle = F.when(n > 0, (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor(n / 2).cast("int") + 1)) / 2)
    return gaps.select("session", "t", F.greatest(F.lit(c.gap_tolerance_s), F.coalesce(2.5 * middle, F.lit(0.0))).alias("tolerance"))


def _running(w, f: Column) -> Column:
    return f.over(w.rowsBetween(Window.unboundedPreceding, 0))


def _confirm(c: Config) -> Column:
    return F.when(F.col("place") == OUTSIDE, c.exit_confirm_s).otherwise(c.enter_confirm_s) - EPS


def stretched(frames: DataFrame, config: Config | None = None) -> DataFrame:
    """A worker's frames with prior (the frame before), the first frame of their stretch and whether it ``bridges``.

    A stretch is frames in one place with no gap that could mean anything; one that bridges follows
    such a gap in the same place, so that it may go on with the spell before.
    """
    c = config or Config()
    w = Window.partitionBy(*WHO).orderBy("t")
    place = F.when(F.col("zone") == TRANSIT, OUTSIDE).otherwise(F.coalesce("zone", F.lit(OUTSIDE)))
    rows = frames.where("session IS NOT NULL AND t IS NOT NULL").select(*WHO, "t", place.alias("place")).withColumn("prior", F.lag("t").over(w)).withColumn("__same", F.lag("place").over(w) == F.col("place"))
    far = F.col("t") - F.col("prior") > min(c.gap_tolerance_s, c.lost_grace_s, c.lost_ttl_s)
    begins = F.coalesce(far | ~F.col("__same"), F.lit(True))
    of = lambda x: _running(w, F.last(F.when(begins, x), True))
    return rows.select(*WHO, "t", "place", "prior", of(F.col("t")).alias("first"), of(F.coalesce("__same", F.lit(False))).alias("bridges"))


def _stretches(frames: DataFrame, c: Config) -> DataFrame:
    """Stretches: place, first and last frame, prior (the frame before) and sure (the first frame by which the stretch alone counts).

    One that bridges may count from earlier on, so the frames up to the first by which it counts alone come as stretches of their own.
    """
    confirm = _confirm(c)
    whole = frames.groupBy(*WHO, "place", "first").agg(
        F.max("t").alias("last"), F.max(F.when(F.col("t") == F.col("first"), F.col("prior"))).alias("prior"), F.min(F.when(F.col("t") - F.col("first") >= confirm, F.col("t"))).alias("sure"),
    )
    early = frames.where(F.col("bridges") & (F.col("t") > F.col("first")) & (F.col("prior") - F.col("first") < confirm))
    return whole.unionByName(early.select(*WHO, "place", F.col("t").alias("first"), F.col("t").alias("last"), "prior", F.lit(None).cast("double").alias("sure")))


def placed(frames: DataFrame, times: DataFrame, config: Config | None = None, keep=None) -> DataFrame:
    """A worker's stretches (of ``stretched`` frames) with presence, spell (place, start, ``way``: when the way there began) and what is settled after each.

    ``move`` marks the stretch in which a move counts, from the frame ``told`` on; ``home`` and ``since`` are the zone settled in and
    from when, ``home_before`` and ``since_before`` those before the stretch; ``opens`` and ``fresh`` belong to the presence, whose last stretch ``closes``.
    """
    c, keep = config or Config(), keep or (lambda df: df)
    last_of = lambda cond, *x: F.last(F.when(cond, F.struct(*x)), True)
    parts = keep(_stretches(frames, c)).withColumn("gap", F.col("first") - F.col("prior"))
    # only a gap between the least tolerance and a loss asks for the tolerance of its time
    asks = F.coalesce((F.col("gap") > c.gap_tolerance_s) & (F.col("gap") <= c.lost_ttl_s + EPS), F.lit(False))
    asked = parts.where(asks).join(times.select("session", F.col("t").alias("first"), "tolerance"), ["session", "first"], "left").withColumn("unwatched", F.coalesce(F.col("gap") > F.col("tolerance"), F.lit(False))).drop("tolerance")
    rows = parts.where(~asks).withColumn("unwatched", F.coalesce(F.col("gap") > c.lost_ttl_s + EPS, F.lit(True))).unionByName(asked)
    rows = tasks.dealt(rows, *WHO, n=parts.count()).withColumn("cut", F.coalesce(F.col("gap") > c.lost_ttl_s + EPS, F.lit(False)))
    w = Window.partitionBy(*WHO).orderBy("first")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__from", F.lag("place").over(w)).withColumn("next", F.lead("first").over(w)).withColumn("closes", F.coalesce(F.lead("cut").over(w), F.lit(True)))
    rows = rows.withColumn("presence", _running(w, F.sum(F.col("cut").cast("int")))).withColumn("last", _running(w, F.max("last")))
    rows = rows.withColumn("start", _running(w, F.last(F.when(F.col("unwatched") | (F.col("__from") != F.col("place")), F.col("first")), True)))
    rows = rows.withColumn("told", F.when(F.col("first") - F.col("start") >= _confirm(c), F.col("first")).when(F.col("first") == F.col("start"), F.col("sure")))
    # what was settled before, in this presence
    rows = rows.withColumn("__settled", last_of(F.col("told").isNotNull(), "presence", "place", "start").over(before))
    known = F.coalesce(F.col("__settled.presence") == F.col("presence"), F.lit(False))
    rows = rows.withColumn("home_before", F.when(known, F.col("__settled.place")).otherwise(F.lit(OUTSIDE)))
    settles = F.col("told").isNotNull() & ~(known & (F.col("__settled.start") == F.col("start")))
    rows = rows.withColumn("settles", settles).withColumn("move", F.col("settles") & (F.col("place") != F.col("home_before"))).withColumn("home", F.when(F.col("settles"), F.col("place")).otherwise(F.col("home_before")))
    rows = rows.withColumn("__moved", last_of(F.col("move"), "presence", "start").over(before)).withColumn("__after", F.lag("move").over(w)).withColumn("__home", F.lag("home").over(w))
    rows = rows.withColumn("since_before", F.when(F.col("__moved.presence") == F.col("presence"), F.col("__moved.start"))).withColumn("since", F.when(F.col("move"), F.col("start")).otherwise(F.col("since_before")))
    # nothing is known of who was settled inside when last seen, or has been away for long
    opens = F.col("cut") | F.col("prior").isNull()
    fresh = F.coalesce((F.col("__home") != OUTSIDE) | (F.col("gap") > c.forget_after_s), F.lit(True))
    # the way to a move: stretches elsewhere since the settled zone was left, unbroken
    breaks = F.col("unwatched") | (F.col("place") == F.col("home_before")) | F.coalesce(F.col("__after"), F.lit(True))
    rows = rows.withColumn("trip", _running(w, F.sum(breaks.cast("int")))).withColumn("__opened", _running(w, last_of(opens, F.col("first").alias("at"), fresh.alias("fresh"))))
    trip = Window.partitionBy(*WHO, "trip").orderBy("first")
    rows = rows.withColumn("way", F.coalesce(_running(trip, F.min(F.when(F.col("place") == OUTSIDE, F.col("start")))), F.col("start")))
    return rows.select(
        *WHO, "presence", "place", "first", "last", "prior", "gap", "unwatched", "start", "told", "move", "way", "home", "since", "home_before", "since_before", "next", "closes",
        opens.alias("begins"), F.col("__opened.at").alias("opens"), F.col("__opened.fresh").alias("fresh"),
    )


def presences(rows: DataFrame, times: DataFrame, config: Config | None = None) -> DataFrame:
    """First and last frame of every presence, the place settled in at its end, whether it is cut by a loss, and whether it is ``fresh``:
    nothing was known of the worker when it began."""
    c = config or Config()
    ends = kept_table(times.groupBy("session").agg(F.max("t").alias("ends")))
    found = rows.where("closes").select(*WHO, "presence", F.col("opens").alias("first"), "last", "home", "since", F.when(F.col("place") == F.col("home"), F.col("last")).otherwise(F.col("way")).alias("told_until"), "next", "fresh")
    return found.join(ends, "session").withColumn("until", F.coalesce("next", "ends")).withColumn("lost", F.col("until") - F.col("last") > c.lost_ttl_s + EPS).drop("next")


def visits(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Stays: zone, entered, when each was told, exit (null while open) with reason, and whether the worker was first seen inside."""
    moves = rows.where("move").select(*WHO, "presence", "place", "start", "way", "told", (F.col("fresh") & (F.col("start") <= F.col("opens") + EPS)).alias("first_sighting"))
    # a presence's end comes after its moves: no join
    w = Window.partitionBy(*WHO, "presence").orderBy(F.col("told").asc_nulls_last())
    both = moves.unionByName(known.select(*WHO, "presence", F.struct("last", "told_until", "lost").alias("end")), allowMissingColumns=True)
    both = both.withColumn("left", F.lead("way").over(w)).withColumn("left_told", F.lead("told").over(w)).withColumn("end", F.lead("end").over(w)).where(F.col("place") != OUTSIDE)
    return both.select(
        *WHO, "presence", F.col("place").alias("zone_id"), F.col("start").alias("entered"), "told", "first_sighting",
        F.when(F.col("left_told").isNotNull(), F.col("left")).when(F.col("end.lost"), F.col("end.last")).alias("left"), "left_told",
        F.when(F.col("left_told").isNotNull(), "LEFT").when(F.col("end.lost"), "LOST").alias("reason"), F.col("end.last").alias("last"), F.col("end.told_until").alias("told_until"),
    )


def _next_time(asked: DataFrame, times: DataFrame, after: str, name: str, keys: list[str] = ["session"], of: str = "t") -> DataFrame:  # noqa: B006
    """``asked`` with the first frame time (or its column ``of``) of its session later than ``after``: one sort of both, no range join."""
    both = asked.withColumn("__at", F.col(after) + EPS).withColumn("__asks", F.lit(True)).unionByName(times.select(*keys, F.col("t").alias("__at"), F.col(of).alias("__t")), allowMissingColumns=True)
    # backwards, as a window up to the last row is worked out anew for every row
    w = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.asc_nulls_first("__asks")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__t", True).over(w)).where("__asks").drop("__at", "__asks", "__t")


def told(**fields) -> Column:
    """Details as JSON, keys in order, nulls left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))


def zone_events(frames: DataFrame, config: Config | None = None, limits: dict[str, dict[float, float]] | None = None, close: bool = True, reason: str = "SESSION_END") -> DataFrame:
    """Events of all workers: session, worker, event_type, zone_id, t and details.

    ``frames``: session, worker, t, zone (null outside). ``limits``: zone -> {seconds: warn
    fraction}. With ``close``, what is still open at a session's end is ended there, for
    ``reason``, without a confirmed exit. An event that only repeats the worker's last one is dropped.
    """
    return zone_records(frames, config, limits, close, reason).select(*WHO, "event_type", "zone_id", "t", "details")


def zone_records(frames: DataFrame, config: Config | None = None, limits: dict[str, dict[float, float]] | None = None, close: bool = True, reason: str = "SESSION_END",
                 reasons: DataFrame | None = None, tracked: Track | None = None) -> DataFrame:
    """``zone_events`` with when and rank: at what time an event is told (infinity: at the end) and its order there.

    ``reasons`` (session, why) says why a session ended, where it is not ``reason``; ``tracked``
    is what ``track`` gives for the same frames. What several kinds of events rest on is stored,
    so that no plan holds it more than once.
    """
    c, seconds = config or Config(), lambda x: F.round(x, 3)
    times, _, rows = tracked or track(frames.select(*WHO, "t", "zone"), c, keep=kept_table)
    known = kept_table(presences(rows, times, c))
    stays_ = kept_table(visits(rows, known).where("worker IS NOT NULL"))
    event = lambda kind, zone, t, details: (F.lit(kind).alias("event_type"), zone.alias("zone_id"), F.round(t, 6).alias("t"), details.alias("details"))
    col = F.col

    entered = stays_.select(*WHO, "presence", col("told").alias("when"), F.lit(5).alias("rank"), *event("ENTERED_ZONE", col("zone_id"), col("entered"), told(first_sighting=F.when(col("first_sighting"), True))))
    stay = seconds(F.greatest(col("left") - col("entered"), F.lit(0.0)))
    left = stays_.where("reason = 'LEFT'").select(*WHO, "presence", col("left_told").alias("when"), F.lit(4).alias("rank"), *event("EXITED_ZONE", col("zone_id"), col("left"), told(reason=col("reason"), dwell_s=stay, first_sighting=F.when(col("first_sighting"), True))))

    # out of sight: gaps within a presence, and what follows its last frame
    inner = rows.where(~col("begins") & (col("gap") > c.lost_grace_s + EPS)).select(*WHO, "presence", col("prior").alias("last"), col("home_before").alias("home"), col("first").alias("back"), col("since_before").alias("since"))
    outer = known.where(col("until") - col("last") > min(c.lost_grace_s, c.lost_ttl_s) + EPS).select(*WHO, "presence", "last", "home", F.lit(None).cast("double").alias("back"), "since", "lost")
    gaps = inner.withColumn("lost", F.lit(False)).unionByName(outer).where(col("home") != OUTSIDE)
    gaps = gaps.withColumn("grace", col("last") + c.lost_grace_s).withColumn("ttl", col("last") + c.lost_ttl_s)
    gaps = kept_table(_next_time(_next_time(gaps, times, "grace", "declared"), times, "ttl", "ended"))
    lost = gaps.select(*WHO, "presence", col("declared").alias("when"), F.lit(1).alias("rank"), *event("LOST_IN_ZONE", col("home"), col("last"), told(last_seen_s=seconds(col("last")), declared_at_s=seconds(col("declared")))))
    back = gaps.where("back IS NOT NULL").select(*WHO, "presence", col("back").alias("when"), F.lit(2).alias("rank"), *event("REAPPEARED", col("home"), col("back"), told(gap_s=seconds(col("back") - col("last")), last_seen_s=seconds(col("last")))))
    gone = gaps.where("lost").select(
        *WHO, "presence", col("ended").alias("when"), F.lit(4).alias("rank"),
        *event("EXITED_ZONE", col("home"), col("last"), told(reason=F.lit("LOST"), unverifiable=F.lit(True), dwell_s=seconds(F.greatest(col("last") - col("since"), F.lit(0.0))), last_seen_s=seconds(col("last")), declared_at_s=seconds(col("ended")))),
    )
    found = [entered, left, lost, back, gone]

    end = F.greatest("last", "entered")
    if close:
        left_open = stays_.where("reason IS NULL")
        left_open = left_open.withColumn("why", F.lit(reason)) if reasons is None else left_open.join(reasons, "session", "left").withColumn("why", F.coalesce("why", F.lit(reason)))
        found.append(left_open.select(
            *WHO, "presence", F.lit(float("inf")).alias("when"), F.lit(4).alias("rank"),
            *event("EXITED_ZONE", col("zone_id"), end, told(reason=col("why"), unverifiable=F.lit(True), dwell_s=seconds(end - col("entered")), last_seen_s=seconds(end))),
        ))
    marks = [(zone, float(limit), kind, share, at) for zone, of in (limits or {}).items() for limit, share in of.items() for kind, at in (("DWELL_WARNING", share * limit), ("DWELL_EXCEEDED", float(limit))) if kind == "DWELL_EXCEEDED" or share < 1]
    if marks:
        spark = frames.sparkSession
        until = F.when(col("reason").isNotNull(), col("left")).otherwise(end if close else col("told_until"))
        marked = stays_.join(F.broadcast(spark.createDataFrame(marks, "zone_id string, limit_s double, kind string, share double, after double")), "zone_id")
        crossed = marked.withColumn("at", col("entered") + col("after")).where(col("at") <= until + EPS).select(*WHO, "presence", "zone_id", "kind", "limit_s", "share", "at")
        # not seen is a limit that lies in an unwatched gap: the first such gap that ends after it
        ended = rows.where(col("unwatched") & col("prior").isNotNull()).select(*WHO, col("first").alias("t"), F.struct(col("first").alias("t"), col("prior").alias("p")).alias("of"))
        crossed = _next_time(crossed.withColumn("just", col("at") - 2 * EPS), ended, "just", "back", WHO, "of")
        unseen = F.coalesce((col("at") > col("back.p") + EPS) & (col("back.p") < col("just") + EPS), F.lit(False))
        at = F.when(unseen, col("back.t")).otherwise(col("at"))
        found.append(crossed.select(*WHO, "presence", at.alias("when"), F.lit(3).alias("rank"), col("kind").alias("event_type"), "zone_id", F.round(at, 6).alias("t"), told(limit_s=col("limit_s"), warn_fraction=F.when(col("kind") == "DWELL_WARNING", col("share")), crossed_unobserved=F.when(unseen, True)).alias("details")))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    order = Window.partitionBy(*WHO, "presence").orderBy("when", "rank", "t", "event_type", "details")
    this = F.struct("event_type", "zone_id", "details")
    return every.withColumn("same", F.coalesce(F.lag(this).over(order) == this, F.lit(False))).where("NOT same").select(*WHO, "when", "rank", "event_type", "zone_id", "t", "details")


def at_home(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """``frames`` (WHO, t and more) with the zone their worker is settled in (OUTSIDE for none): one sort of frames and changes."""
    opened = rows.where("begins").select(*WHO, F.col("first").alias("t"), F.lit(0).alias("__rank"), F.lit(OUTSIDE).alias("home"))
    moved = rows.where("move").select(*WHO, F.col("told").alias("t"), F.lit(1).alias("__rank"), F.col("place").alias("home"))
    w = Window.partitionBy(*WHO).orderBy("t", "__rank")
    both = frames.withColumn("__rank", F.lit(2)).unionByName(opened, allowMissingColumns=True).unionByName(moved, allowMissingColumns=True)
    return both.withColumn("home", _running(w, F.last("home", True))).where("__rank = 2").drop("__rank")


def turns(tracked: Track, config: Config | None = None) -> DataFrame:
    """session, zone, t, by: how many more workers are settled inside a zone from a time on, seen or not."""
    c = config or Config()
    times, _, rows = tracked
    ends = kept_table(times.groupBy("session").agg(F.max("t").alias("ends")))
    stays_ = visits(rows, presences(rows, times, c)).join(ends, "session")
    until = F.coalesce("left_told", F.least(F.col("ends"), F.col("last") + c.lost_ttl_s) + 2 * EPS)
    turn = lambda at, by: F.struct(at.alias("t"), F.lit(by).cast("long").alias("by"))
    each = stays_.select("session", F.col("zone_id").alias("zone"), F.explode(F.array(turn(F.col("told"), 1), turn(until, -1))).alias("x"))
    return each.groupBy("session", "zone", "x.t").agg(F.sum("x.by").alias("by"))


def counted(tracked: Track, here: DataFrame, asked: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """``here`` (session, zone, t, here: who is settled there and seen, and more counts) at all ``asked`` times (session, t) of every zone
    that is used in the session, counts of nobody 0, with hidden: who is settled inside but not seen.

    Stays begin and end at a time each, so that those open at a frame are a running sum: no frame meets a gap.
    """
    times = tracked.times.select("session", "t") if asked is None else asked.select("session", "t")
    zones = here.groupBy("session").agg(F.collect_set("zone").alias("zones"))
    every = tasks.dealt(times, "session", "t").join(zones, "session").select("session", F.explode("zones").alias("zone"), "t", F.lit(True).alias("asked"))
    more = [x for x in here.columns if x not in ("session", "zone", "t")]
    met = turns(tracked, config).unionByName(here, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    met = met.groupBy("session", "zone", "t").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("by", *more)], F.max("asked").alias("asked"))
    inside = _running(Window.partitionBy("session", "zone").orderBy("t"), F.sum("by"))
    return met.withColumn("hidden", F.greatest(inside - F.col("here"), F.lit(0))).where("asked").drop("by", "asked", "here")


def hidden(frames: DataFrame, config: Config | None = None, tracked: Track | None = None) -> DataFrame:
    """session, zone, t, hidden: how many workers are settled inside a zone but not seen in a frame."""
    tracked = tracked or track(frames, config)
    shown = tracked.frames.where("prior IS NULL OR t > prior").select(*WHO, "t")
    here = at_home(shown, tracked.rows).where(F.col("home") != OUTSIDE).groupBy("session", F.col("home").alias("zone"), "t").agg(F.count("*").alias("here"))
    return counted(tracked, kept_table(here), config=config).where("hidden > 0")


class Track(NamedTuple):
    """The ``clock`` of the frames, the ``stretched`` frames and the stretches ``placed``."""

    times: DataFrame
    frames: DataFrame
    rows: DataFrame


def track(frames: DataFrame, config: Config | None = None, times: DataFrame | None = None, keep=None) -> Track:
    """What is known of the frames. ``times`` (session, t) are all frames' times, where some show nobody;
    ``keep`` stores what is read more than once."""
    c, keep = config or Config(), keep or (lambda df: df)
    seen = keep(stretched(frames, c))
    clocked = keep(clock(seen if times is None else times, c))
    return Track(clocked, seen, keep(placed(seen, clocked, c, keep)))


def stays(events: DataFrame) -> DataFrame:
    """Visits out of events: entry, exit, how it ended and whether its length is whole."""
    w = Window.partitionBy("session", "worker").orderBy("t", F.desc("event_type"))
    kinds = events.where(F.col("event_type").isin("ENTERED_ZONE", "EXITED_ZONE"))
    entered = F.when(F.lag("event_type").over(w) == "ENTERED_ZONE", F.lag("t").over(w))
    reason = F.get_json_object("details", "$.reason")
    whole = (reason == "LEFT") & F.get_json_object("details", "$.first_sighting").isNull()
    return kinds.withColumn("entered", entered).where("event_type = 'EXITED_ZONE'").select("session", "worker", "zone_id", "entered", F.col("t").alias("left"), reason.alias("reason"), whole.alias("whole"))
