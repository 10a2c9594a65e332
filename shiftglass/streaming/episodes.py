"""Episodes of head counts and people lying still as windows; sampling as a machine.

An episode is a stretch that a short break does not end (gaps and islands); what is said of
it follows from its first frames at which a rule is due. Only what depends on what was
said before is folded: flags a minute apart, sampled telemetry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Config
from ..operators import tasks
from ..operators.frames import median_of
from ..sources.sinks import kept_table
from .machine import Machine

FLAG, UNSURE, FINE = "POTENTIAL_VIOLATION", "UNVERIFIABLE", "COMPLIANT"

DECISION = "status string, t double, confidence double, evidence string"


# --------------------------------------------------------------------------- episodes as windows
def _marked(rows: DataFrame, keys: list[str], on: Column, recover_s: float) -> DataFrame:
    """``rows`` where ``on`` holds or that lie between such rows, with the number of their episode.

    An episode goes on over stretches where ``on`` does not hold, unless one lasts ``recover_s``.
    ``rows`` has t and part (windows never reach over a part's start).
    """
    w = Window.partitionBy(*keys, "part").orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # all by one order of the rows: runs and episodes are never partitions of their own
    run = rows.withColumn("on", on).withColumn("turned", F.coalesce(F.lag("on").over(w) != F.col("on"), F.lit(True)))
    run = run.withColumn("off", F.last(F.when(F.col("turned"), F.col("t")), ignorenulls=True).over(so_far))
    over = ~F.col("on") & (F.col("t") - F.col("off") >= recover_s)
    known = run.withColumn("over", over.cast("int")).withColumn("recovered", F.sum("over").over(so_far))
    begun = F.coalesce(F.last(F.when(F.col("on"), F.coalesce("recovered", F.lit(0))), ignorenulls=True).over(so_far) == F.coalesce("recovered", F.lit(0)), F.lit(False))
    return known.withColumn("begun", begun).where("begun AND over = 0").withColumn("episode", F.struct("part", "recovered")).drop("turned", "off", "over", "recovered", "begun")


def _parts(rows: DataFrame, keys: list[str], gap_s: float) -> DataFrame:
    """Numbers the stretches of a key's rows between gaps of over ``gap_s``."""
    w = Window.partitionBy(*keys).orderBy("t")
    return rows.withColumn("part", F.sum(F.coalesce(F.col("t") - F.lag("t").over(w) > gap_s, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _spaced(flags: DataFrame, keys: list[str], at: str, apart_s: float) -> DataFrame:
    """Of a key's few flags those that come ``apart_s`` or more after the last one kept: each depends on those before."""
    empty = F.array().cast("array<double>")
    kept = F.aggregate(F.array_sort(F.collect_list(F.col(at).cast("double"))), empty, lambda s, x: F.when((F.size(s) == 0) | (x - F.element_at(s, -1) >= apart_s), F.concat(s, F.array(x))).otherwise(s))
    return flags.join(flags.groupBy(*keys).agg(kept.alias("__kept")), keys).where(F.array_contains("__kept", F.col(at))).drop("__kept")


def _judged(status: str, t: Column, confidence: Column, **evidence: Column) -> list[Column]:
    told = F.to_json(F.struct(*[v.alias(k) for k, v in sorted(evidence.items())]))
    return [F.lit(status).alias("status"), F.round(t, 6).alias("t"), F.round(F.least(F.lit(1.0), confidence), 3).alias("confidence"), told.alias("evidence")]


def _at(t: Column) -> Column:
    """When a decision fell, beside the time it is about."""
    return F.round(t, 6).alias("decided")


KINDS = ("LONE_WORKER", "OVER_CAPACITY", "EMPTY_ZONE")


def _middle(name: str) -> Column:
    """Median of an array column without nulls, sorted in compiled code."""
    s, n = F.sort_array(name), F.size(name)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def occupancy(heads: DataFrame, keys: list[str], least: int | None = None, most: int | None = None, flag_empty: bool | None = None, config: Config | None = None) -> DataFrame:
    """Too few or too many people in a zone, by the median of a short window: keys, status, t, confidence, evidence, decided.

    ``heads``: keys, t, seen, clear, hidden (head counts of the zone in a frame). A situation
    must last the grace time and hold in the frame that judges it; if too few of the heads
    were clear it is said once to be untellable, and read afresh from then on. Flags of a
    kind come a minute apart at least.
    """
    c, empty = config or Config(), least is not None and (flag_empty is None or flag_empty)
    rows = _parts(heads.withColumn("hidden", F.greatest(F.coalesce("hidden", F.lit(0)), F.lit(0))).withColumn("ms", F.round(F.col("t") * 1000).cast("long")), keys, max(5.0, 3 * c.occupancy_window_s))
    w = Window.partitionBy(*keys, "part").orderBy("ms")
    by_time, rows = w.rangeBetween(-round(c.occupancy_window_s * 1000), 0), rows.withColumn("within", F.col("seen") + F.col("hidden"))
    # the window's rows, or the newest ones where it holds too few
    enough = F.count("*").over(by_time) >= c.occupancy_samples
    newest = lambda x: F.array(*[F.lag(x, i).over(w) if i else F.col(x) for i in range(c.occupancy_samples)])
    first = F.lag("t", c.occupancy_samples - 1).over(w) if c.occupancy_samples > 1 else F.col("t")
    rows = rows.withColumn("oldest", F.when(enough, F.min("t").over(by_time)).otherwise(first)).withColumn("heads", F.when(enough, F.collect_list("seen").over(by_time)).otherwise(newest("seen"))).withColumn("persons", F.when(enough, F.collect_list("within").over(by_time)).otherwise(newest("within")))
    n, span = F.size("heads"), F.col("t") - F.col("oldest")
    told = F.col("oldest").isNotNull() & ((span >= c.occupancy_window_s / 2) | (n >= 2 * c.occupancy_samples))
    rows = rows.where(told).withColumn("typical", _middle("heads")).withColumn("inside", _middle("persons")).drop("oldest", "heads", "persons", "within")
    off, seen = F.lit(False), F.col("seen")
    holds = {
        "LONE_WORKER": ((F.col("typical") >= 1) & (F.col("inside") < least) if least is not None else off, seen >= 1),
        "OVER_CAPACITY": (F.col("typical") > most if most is not None else off, seen > most if most is not None else off),
        "EMPTY_ZONE": (F.col("inside") == 0 if empty else off, (seen == 0) & (F.col("hidden") == 0)),
    }
    # rows are multiplied by the kinds that are asked for, not by those that never hold
    asked = {"LONE_WORKER": least is not None, "OVER_CAPACITY": most is not None, "EMPTY_ZONE": empty}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), on.alias("holds"), now.alias("now")) for k, (on, now) in holds.items() if asked[k] or not any(asked.values())]))
    each = rows.withColumn("k", kinds).select("*", "k.*").drop("k", "typical", "inside")
    by = [*keys, "kind"]
    one = [*by, "episode"]
    marked = _marked(each, by, F.col("holds"), c.recover_s).where("holds")
    e = Window.partitionBy(*one)
    first = marked.withColumn("since", F.min("t").over(e))
    judge = lambda since: F.min(F.when(F.col("now") & (F.col("t") - since >= c.occupancy_grace_s), F.col("t"))).over(e)
    first = first.withColumn("judged", judge(F.col("since"))).where("judged IS NOT NULL")
    second = first.withColumn("again", judge(F.col("judged")))
    share = F.when(F.col("kind") == "EMPTY_ZONE", 1.0).otherwise(F.coalesce(F.sum("clear") / F.nullif(F.sum("seen"), F.lit(0)), F.lit(0.0)))

    def read(part: DataFrame) -> DataFrame:
        return part.groupBy(*one, "since", "judged").agg(share.alias("share"), F.rint(median_of(F.collect_list("seen"))).cast("int").alias("people"), F.max("hidden_so_far").alias("hidden"))

    so_far = F.max("hidden").over(e.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    # stored, as what follows reads it more than once
    second = kept_table(second.withColumn("hidden_so_far", so_far))
    early = kept_table(read(second.where("t <= judged")))
    unclear = early.where(F.col("share") < c.occupancy_clear)
    late = read(second.where("t > judged AND t <= again").withColumn("since", F.col("judged")).withColumn("judged", F.col("again")))
    late = late.join(unclear.select(*one), one, "left_semi")
    flags = _spaced(kept_table(early.where(F.col("share") >= c.occupancy_clear).unionByName(late.where(F.col("share") >= c.occupancy_clear))), by, "judged", c.realert_after_s)
    evidence = {"people_seen": F.col("people"), "seconds": F.round(F.col("judged") - F.col("since"), 1), "clear_fraction": F.round("share", 3), "hidden_people": F.col("hidden"), "min_people": F.lit(least).cast("int"), "max_people": F.lit(most).cast("int")}
    return flags.select(*keys, *_judged(FLAG, F.col("since"), F.col("share"), outcome=F.col("kind"), **evidence), _at(F.col("judged"))).unionByName(unclear.select(*keys, *_judged(UNSURE, F.col("since"), F.lit(0.0), outcome=F.lit("CROWDED"), **evidence), _at(F.col("judged"))))


def postures(bodies: DataFrame, keys: list[str], config: Config | None = None) -> DataFrame:
    """``bodies`` with speed (sizes a second, null without a history) and lies: UP, DOWN or UNCLEAR.

    ``bodies``: keys, t, cx, cy, size, angle (of the torso, null if weak), aspect, legs_up,
    sitting, collapsed, allowed. Speed is the farthest that any place of 0.3 to 0.6 s ago is
    from here, by its age; at a slow frame rate the place before serves.
    """
    c = config or Config()
    rows = _parts(bodies.withColumn("ms", F.round(F.col("t") * 1000).cast("long")), keys, c.lost_s)
    w = Window.partitionBy(*keys, "part").orderBy("ms")
    width = round(c.motion_window_s * 1000)
    spot = F.struct("t", "cx", "cy")
    past = F.collect_list(spot).over(w.rangeBetween(-width, -(width // 2)))
    step = F.lag(spot).over(w)
    alone = F.when(F.col("t") - step["t"] >= c.motion_window_s / 2, F.array(step)).otherwise(F.array())
    rows = rows.withColumn("past", F.when(F.size(past) > 0, past).otherwise(alone))
    pace = F.array_max(F.transform("past", lambda p: F.hypot(F.col("cx") - p["cx"], F.col("cy") - p["cy"]) / F.greatest(F.col("t") - p["t"], F.lit(1e-6))))
    rows = rows.withColumn("speed", F.when(F.col("size") > 0, pace / F.col("size"))).drop("past", "ms")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    flat = F.col("angle") > c.man_down_angle
    still = F.coalesce(F.col("speed") < c.still_speed, F.lit(False)) & ~flag("allowed")
    down = flag("collapsed") | (flat & (F.col("aspect") >= c.lying_aspect) & ~flag("legs_up"))
    unclear = (flat & F.col("aspect").between(c.upright_aspect, c.lying_aspect) & ~flag("legs_up")) | (F.col("angle").isNull() & (F.col("aspect") > c.down_aspect))
    return rows.withColumn("lies", F.when(~still, "UP").when(down, "DOWN").when(unclear, "UNCLEAR").otherwise("UP"))


def man_down(bodies: DataFrame, keys: list[str], seconds: float | None = None, config: Config | None = None) -> DataFrame:
    """People lying still: keys, status, t, confidence, evidence, decided.

    An episode is flagged at the first frame ``seconds`` after its start by which 60 % of its frames
    are clearly down; if there is none within twice that time it is said once that it cannot be
    told, and the episode is read afresh from then on.
    """
    c = config or Config()
    seconds = c.man_down_s if seconds is None else seconds
    one = [*keys, "episode"]
    rows = _marked(postures(bodies, keys, c), keys, F.col("lies") != "UP", c.recover_s)
    e = Window.partitionBy(*one)
    so_far = lambda cond=None: F.count_if(F.lit(True) if cond is None else cond).over(e.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    judges = F.col("lies") != "UP"
    rows = rows.withColumn("since", F.min("t").over(e)).withColumn("n", so_far()).withColumn("down", so_far(F.col("lies") == "DOWN"))
    clear = judges & (F.col("t") - F.col("since") >= seconds) & (F.col("down") / F.col("n") >= c.clear_fraction)
    rows = rows.withColumn("flagged", F.min(F.when(clear, F.col("t"))).over(e)).withColumn("unsure", F.min(F.when(judges & (F.col("t") - F.col("since") >= 2 * seconds), F.col("t"))).over(e))
    told_first = F.col("flagged") <= F.coalesce(F.col("unsure"), F.col("flagged"))
    rows = rows.withColumn("unsure", F.when(~F.coalesce(told_first, F.lit(False)), F.col("unsure"))).withColumn("flagged", F.when(told_first, F.col("flagged")))
    # the frames of the episodes of which something is said; stored, as that reads them three times
    rows = kept_table(rows.select(*one, "t", "lies", "angle", "since", "n", "down", "flagged", "unsure").where("flagged IS NOT NULL OR unsure IS NOT NULL"))
    rows = tasks.dealt(rows, *keys)
    later = rows.where("t > unsure").withColumn("since", F.col("unsure")).withColumn("n", so_far()).withColumn("down", so_far(F.col("lies") == "DOWN"))
    later = later.withColumn("flagged", F.min(F.when(clear, F.col("t"))).over(e))

    def read(part: DataFrame, at: str) -> DataFrame:
        upto = part.where(F.col("t") <= F.col(at)).groupBy(*one, "since", at).agg(F.max("n").alias("n"), F.max("down").alias("down"), F.collect_list(F.when(F.col("lies") == "DOWN", F.col("angle"))).alias("angles"))
        return upto.withColumn("share", F.col("down") / F.col("n"))

    def said(found: DataFrame, at: str, status: str, outcome: str) -> DataFrame:
        evidence = {"outcome": F.lit(outcome), "seconds_down": F.round(F.col(at) - F.col("since"), 2), "frames": F.col("n"), "lying_fraction": F.round("share", 3), "torso_angle_deg": F.round(median_of(F.col("angles")), 1)}
        return found.select(*keys, *_judged(status, F.col(at), F.col("share") if status == FLAG else F.lit(0.0), **evidence), _at(F.col(at)))

    flags = read(rows, "flagged").unionByName(read(later, "flagged"))
    return said(flags, "flagged", FLAG, "LYING_STILL").unionByName(said(read(rows, "unsure"), "unsure", UNSURE, "UNCLEAR"))


#: A fall along the line of sight, as shares of the standing measure: torso, torso against box, legs, box, feet.
SHRUNK_TORSO, TORSO_TO_BOX, SHRUNK_LEGS, SHRUNK_BOX, SAME_FEET = 0.50, 0.80, 0.75, 0.65, 0.25
STANDING_S, STANDING_FRAMES, STANDING_BOX = 10.0, 5, 0.85
MEASURED = ("torso", "legs", "height", "feet")


def collapsed(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``bodies`` with collapsed: much shorter than the person stood before, on the same feet.

    ``bodies``: keys, t, torso, legs, height, feet (null if weak) and upright. The standing
    measure at a frame is the median, field by field, of the reference frames of the 10 s up
    to the last one before it. Reference frames are upright, not collapsed and not short
    against the measure so far: a fixed point, reached by marking all upright frames and
    taking back those that fail until none does. Every round settles at least the first
    frames still wrong, so it ends; it takes one round more than falls that were marked.
    """
    w = Window.partitionBy(*keys).orderBy("ms")
    middle_of = lambda c: median_of(F.transform("lately", lambda x: x[c].cast("double"))).alias(c)
    whole = F.coalesce(F.least(*[F.col(c).isNotNull().cast("int") for c in MEASURED]) == 1, F.lit(False)) & (F.col("height") > 0)
    rows = bodies.withColumn("ms", F.round(F.col("t") * 1000).cast("long")).withColumn("able", whole & F.col("upright")).withColumn("marked", whole & F.col("upright"))
    while True:
        lately = F.collect_list(F.when(F.col("marked"), F.struct(*MEASURED))).over(w.rangeBetween(-round(STANDING_S * 1000), 0))
        middle = F.struct(*map(middle_of, MEASURED))
        measured = rows.withColumn("lately", F.when(F.col("marked"), lately))
        measured = measured.withColumn("now", F.when(F.col("marked"), F.struct((F.size("lately") >= STANDING_FRAMES).alias("told"), middle.alias("usual"))))
        last = F.last("now", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        seen = measured.withColumn("last", last).withColumn("u", F.when(F.col("last.told"), F.col("last.usual"))).drop("lately", "now", "last")
        share = lambda c: F.when(F.least("u.torso", "u.legs", "u.height") > 0, F.col(c) / F.col(f"u.{c}"))
        fallen = (
            (share("torso") < F.least(F.lit(SHRUNK_TORSO), TORSO_TO_BOX * share("height"))) & (share("legs") < SHRUNK_LEGS)
            & (share("height") < SHRUNK_BOX) & (F.abs(F.col("feet") - F.col("u.feet")) < SAME_FEET * F.col("u.height"))
        )
        judged = seen.withColumn("collapsed", whole & F.coalesce(fallen, F.lit(False)))
        holds = F.col("able") & ~F.col("collapsed") & F.coalesce(F.col("height") >= STANDING_BOX * F.col("u.height"), F.lit(True))
        judged = kept_table(judged.withColumn("holds", holds).drop("u"))
        if judged.where("holds <> marked").isEmpty():
            return judged.drop("ms", "able", "marked", "holds")
        rows = judged.withColumn("marked", F.col("holds")).drop("holds", "collapsed")


class Sampler(Machine):
    """Telemetry worth keeping. Rows: t, posture, sample_id. The first of a track, a change of posture, or 5 s since the last one kept."""

    def __init__(self, config: Config | None = None):
        self.c = config or Config()

    def start(self) -> dict:
        return {"t": None, "posture": None}

    def step(self, s: dict, row: dict) -> list[dict]:
        if s["t"] is not None and row["posture"] == s["posture"] and row["t"] - s["t"] < self.c.sample_every_s:
            return []
        s.update(t=row["t"], posture=row["posture"])
        return [{"sample_id": row["sample_id"], "t": row["t"]}]
