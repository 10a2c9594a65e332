"""Equipment rules: what a worker's looks say of the required items at an entry and throughout a stay.

A look is one frame's verdict on one item (see ``frames.evidence``). Looks of one frame are
put together first: what is missing and how surely, whether all is worn and the newest
frames agree. An entry is then judged by the first look that decides within its visit; the
visit of a look is found by an as-of window, so that looks and visits are never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Config
from .episodes import FINE, FLAG, UNSURE, _at, _judged

EPS = 1e-9
#: How items are called in sentences.
NAMES = {"helmet": "hard hat", "safety_vest": "hi-vis vest"}


def named(items: Column) -> Column:
    """Items in a sentence: "hard hat", "hard hat and hi-vis vest", "a, b and c"."""
    names = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])
    called = F.transform(items, lambda i: F.coalesce(names[i], i))
    n = F.size(called)
    return F.when(n <= 1, F.array_join(called, "")).otherwise(F.concat(F.array_join(F.slice(called, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(called, -1)))


def frame_looks(looks: DataFrame, keys: list[str], config: Config | None = None) -> DataFrame:
    """Looks of one frame together: keys, t, missing, worn, agree, gap (support of the missing), seen (of the worn), doubt.

    ``looks``: keys, t, item, state, clear_frames, seen_fraction, empty_fraction, recent_fraction. An item of unknown
    newest frames is taken to agree; ``doubt`` holds why items can't be told.
    """
    c = config or Config()
    absent, present = F.col("state") == "ABSENT", F.col("state") == "PRESENT"
    newest = F.col("recent_fraction").isNull() | (F.col("recent_fraction") >= c.ppe_presence_fraction)
    why = F.when(present & ~newest, F.lit("not in the newest frames")).when(~F.coalesce(present | absent, F.lit(False)), F.lit("not seen clearly enough"))
    gathered = looks.groupBy(*keys, "t").agg(
        F.array_sort(F.collect_set(F.when(absent, F.col("item")))).alias("missing"), F.bool_and(F.coalesce(present, F.lit(False))).alias("worn"), F.bool_and(newest).alias("agree"),
        F.min(F.when(absent, F.col("empty_fraction"))).alias("gap"), F.min("seen_fraction").alias("seen"), F.array_sort(F.collect_set(F.col("item"))).alias("items"),
        F.array_sort(F.collect_set(F.when(why.isNotNull(), F.concat("item", F.lit(": "), why)))).alias("doubt"),
    )
    return gathered


def entry_decisions(visits: DataFrame, looks: DataFrame, keys: list[str], floor: float | None = None, config: Config | None = None) -> DataFrame:
    """What is said of the equipment at each entry: keys, status, t (the entry), confidence, evidence, decided.

    ``visits``: keys, entered, left (null if the stay outlasts the footage), reason, ends (the
    footage's last time); ``looks`` as in ``frame_looks``. An item missing with enough support
    is flagged, all worn (also in the newest frames) with enough support complies. A claim
    with too little support does not count, the next looks may bring it. From the first look
    4 s after the entry on, and when the visit or the footage ends before, it cannot be told.
    After a claim, a worker's entries of the next minute pass unjudged.
    """
    c = config or Config()
    floor = c.support_floor if floor is None else floor
    seen = frame_looks(looks, keys, c)
    flag = (F.size("missing") > 0) & (F.col("gap") >= floor)
    fine = (F.size("missing") == 0) & F.col("worn") & F.col("agree") & (F.col("seen") >= floor)
    seen = seen.withColumn("says", F.when(flag, FLAG).when(fine, FINE)).withColumn("support", F.when(flag, F.col("gap")).when(fine, F.col("seen")))
    visit = F.struct(F.col("entered").cast("double").alias("entered"), F.col("left").cast("double").alias("left"))
    both = visits.select(*keys, F.col("entered").cast("double").alias("t"), visit.alias("visit"), F.lit(0).alias("rank")).unionByName(
        seen.select(*keys, F.col("t").cast("double").alias("t"), "says", "support", "missing", "items", "doubt", "seen", "gap", F.lit(1).alias("rank")), allowMissingColumns=True
    )
    # entries at one time: the last one opened; a look at the time of an entry belongs to it
    upto = Window.partitionBy(*keys).orderBy("t", "rank", F.col("visit.left").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    mine = both.withColumn("visit", F.last("visit", ignorenulls=True).over(upto)).where("rank = 1")
    mine = mine.where(F.col("visit").isNotNull() & (F.col("visit.left").isNull() | (F.col("t") < F.col("visit.left"))))
    late = F.col("t") - F.col("visit.entered") >= c.evidence_wait_s - EPS
    told = F.struct("t", "support", "missing", "items", F.array_join("doubt", "; ").alias("doubt"), F.coalesce(F.when(F.size("missing") > 0, F.col("gap")), F.col("seen")).alias("weak"))
    first = mine.groupBy(*keys, F.col("visit.entered").alias("entered")).agg(
        F.min_by(F.struct("says", told.alias("look")), F.when(F.col("says").isNotNull(), F.col("t"))).alias("claim"), F.min_by(told, F.when(late, F.col("t"))).alias("late"),
    )
    every = visits.select(*keys, F.col("entered").cast("double").alias("entered"), F.col("left").cast("double").alias("left"), "reason", F.col("ends").cast("double").alias("ends"))
    rows = every.join(first, [*keys, "entered"], "left")
    claimed = F.coalesce(F.col("claim.look.t") <= F.coalesce("late.t", F.col("claim.look.t")), F.lit(False))
    overdue = ~claimed & F.col("late").isNotNull()
    rows = rows.withColumn("status", F.when(claimed, F.col("claim.says")).otherwise(UNSURE)).withColumn("look", F.when(claimed, F.col("claim.look")).when(overdue, F.col("late")))
    rows = rows.withColumn("decided", F.coalesce("look.t", "left", "ends"))
    why = (
        F.when(F.col("status") == FLAG, F.concat(F.lit("no "), named(F.col("look.missing")), F.lit(" seen")))
        .when(F.col("status") == FINE, F.concat(named(F.col("look.items")), F.lit(" seen")))
        .when(overdue & (F.length("look.doubt") > 0), F.concat(F.lit("could not be told in time ("), F.col("look.doubt"), F.lit(")")))
        .when(overdue, F.lit("too little support for a claim"))
        .when(F.col("left").isNull(), F.lit("the footage ended")).when(F.col("reason") == "LOST", F.lit("lost from view before it could be judged")).otherwise(F.lit("left before it could be judged"))
    )
    rows = rows.withColumn("why", why)
    # whether an entry is judged depends on the claims before it: a fold over a worker's entries
    order = F.array_sort(F.collect_list(F.struct("entered", (F.col("status") != UNSURE).alias("claims"), *[c for c in rows.columns if c not in (*keys, "entered")])))
    none = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))
    heard = lambda a, x: a["last"].isNull() | (x["entered"] - a["last"] >= c.realert_after_s)
    fold = F.aggregate("order", none, lambda a, x: F.when(heard(a, x), F.struct(F.when(x["claims"], x["entered"]).otherwise(a["last"]).alias("last"), F.concat(a["kept"], F.array(x["entered"])).alias("kept"))).otherwise(a))
    # the rows come along: a join with what is kept would work all of this out again
    told_of = rows.groupBy(*keys).agg(order.alias("order")).withColumn("kept", fold["kept"])
    rows = told_of.select(*keys, F.explode(F.filter("order", lambda x: F.array_contains("kept", x["entered"]))).alias("r")).select(*keys, "r.*").drop("claims")
    evidence = {"why": F.col("why"), "missing": F.col("look.missing"), "entered_video_time_s": F.round("entered", 3), "waited_seconds": F.round(F.col("decided") - F.col("entered"), 3)}
    judged = rows.select("*", *_judged(UNSURE, F.col("entered"), F.when(F.col("status") == UNSURE, F.lit(0.0)).otherwise(F.col("look.support")), **evidence)[1:])
    return judged.select(*keys, "status", "t", "confidence", "evidence", F.round("decided", 6).alias("decided"))


def continuous(looks: DataFrame, keys: list[str], grace_s: float | None = None, floor: float | None = None, config: Config | None = None, gap_s: float | None = None) -> DataFrame:
    """Equipment missing without a break: keys, status, t (the streak's start), confidence, evidence, decided.

    ``looks``: keys, t, state, support (of the absence), agrees (the newest frames too). A streak
    is unbroken looks that are ABSENT with enough support; anything else breaks it, and so do
    ``gap_s`` without a look, when the worker is out of view. A streak that lasts the grace
    time is flagged, unless the episode was (it ends when everything is surely seen again) or
    its start lies within a minute of the last flag.
    """
    c = config or Config()
    grace_s, floor = c.ppe_grace_s if grace_s is None else grace_s, c.support_floor if floor is None else floor
    gap_s = c.gap_tolerance_s if gap_s is None else gap_s
    w = Window.partitionBy(*keys).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    absent = (F.col("state") == "ABSENT") & (F.col("support") >= floor)
    rows = looks.withColumn("absent", F.coalesce(absent, F.lit(False))).withColumn("away", F.coalesce(F.col("t") - F.lag("t").over(w) > gap_s + EPS, F.lit(False)))
    rows = rows.withColumn("episode", F.sum(F.coalesce((F.col("state") == "PRESENT") & F.col("agrees"), F.lit(False)).cast("int")).over(upto))
    rows = rows.withColumn("streak", F.sum((~F.col("absent")).cast("int") + F.col("away").cast("int")).over(upto)).where("absent")
    rows = rows.withColumn("since", F.min("t").over(Window.partitionBy(*keys, "streak")))
    due = rows.where(F.col("t") - F.col("since") >= grace_s - EPS)
    first = due.groupBy(*keys, "episode", "streak", "since").agg(F.min("t").alias("at"), F.min_by("support", "t").alias("support"))
    # which streaks are flagged depends on the flags before: a fold over the few streaks that are due
    order = F.array_sort(F.collect_list(F.struct("at", "since", "episode", "support")))
    none = F.struct(F.lit(None).cast("double").alias("last"), F.lit(-1).cast("long").alias("episode"), F.array().cast("array<double>").alias("kept"))
    take = lambda a, x: (x["episode"] != a["episode"]) & (a["last"].isNull() | (x["since"] - a["last"] >= c.realert_after_s))
    fold = F.aggregate("order", none, lambda a, x: F.when(take(a, x), F.struct(x["at"].cast("double").alias("last"), x["episode"].cast("long").alias("episode"), F.concat(a["kept"], F.array(x["at"].cast("double"))).alias("kept"))).otherwise(a))
    # the streaks come along: a join with what is kept would work all of this out again
    kept = first.groupBy(*keys).agg(order.alias("order")).withColumn("kept", fold["kept"])
    flags = kept.select(*keys, F.explode(F.filter("order", lambda x: F.array_contains("kept", x["at"]))).alias("r")).select(*keys, "r.*")
    return flags.select(*keys, *_judged(FLAG, F.col("since"), F.col("support"), run_seconds=F.round(F.col("at") - F.col("since"), 3), decided_video_time_s=F.round("at", 3)), _at(F.col("at")))
