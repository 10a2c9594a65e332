"""The safety report and summary: honest categories over a tenant's decisions and events.

Windows are half-open. A flag is what the system raised, confirmed or dismissed or pending;
insufficient evidence is a result of its own and never counts as either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rounding import ratio, rounded
from ..vocabulary import PPE_RULES

GONE = "(zone no longer available)"
NO_ZONE = "No zone"


def window(rows: DataFrame, org: str, since: str, until: str) -> DataFrame:
    at = F.col("observed_at")
    return rows.where((F.col("org_id") == org) & (at >= F.lit(since).cast("timestamp")) & (at < F.lit(until).cast("timestamp")))


FLAG, UNSURE, FINE = (f"status = '{x}'" for x in ("POTENTIAL_VIOLATION", "UNVERIFIABLE", "COMPLIANT"))
YES, NO, OPEN = (f"review_state = '{x}'" for x in ("CONFIRMED", "DISMISSED", "PENDING"))
MEASURES = {
    "decisions": "true", "compliant": FINE, "flagged": FLAG, "confirmed": f"{FLAG} AND {YES}", "dismissed": f"{FLAG} AND {NO}", "pending": f"{FLAG} AND {OPEN}", "insufficient": UNSURE, "insufficient_confirmed": f"{UNSURE} AND {YES}",
}


def counts(**which: str | Column) -> list[Column]:
    return [F.count_if(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in which.items()]


def headline(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """One row; rates are null where nothing was decided."""
    n = decisions.agg(
        *counts(decisions="true", compliant=FINE, flagged_by_system=FLAG, insufficient_evidence=UNSURE, confirmed=f"{FLAG} AND {YES}", dismissed=f"{FLAG} AND {NO}", pending=f"{FLAG} AND {OPEN}", insufficient_confirmed=f"{UNSURE} AND {YES}", insufficient_dismissed=f"{UNSURE} AND {NO}")
    )
    return n.crossJoin(events.agg(F.count("*").alias("events_recorded"))).select(
        "*",
        ratio(F.col("compliant"), F.col("compliant") + F.col("flagged_by_system"), 4).alias("compliance_rate"),
        ratio(F.col("insufficient_evidence"), F.col("decisions"), 4).alias("unverifiable_rate"),
        ratio(F.col("confirmed"), F.col("confirmed") + F.col("dismissed"), 3).alias("confirmed_share_of_reviewed"),
    )


def review_reasons(decisions: DataFrame) -> DataFrame:
    return decisions.where(f"{YES} OR {NO}").groupBy(F.col("review_state").alias("state"), F.coalesce("review_reason", F.lit("NONE")).alias("reason")).agg(F.count("*").alias("n"))


def by_rule(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("rule_type").agg(*counts(**MEASURES))


def named_zones(decisions: DataFrame, zones: DataFrame) -> DataFrame:
    names = zones.select("zone_id", "zone_name")
    return decisions.join(names, "zone_id", "left").withColumn("zone_name", F.when(F.col("zone_id").isNull(), NO_ZONE).otherwise(F.coalesce("zone_name", F.lit(GONE))))


def by_zone(decisions: DataFrame, zones: DataFrame, top: int = 100) -> DataFrame:
    """The zones with most decisions; ties go to the smaller id."""
    found = named_zones(decisions, zones).groupBy("zone_id", "zone_name").agg(*counts(**MEASURES))
    return found.orderBy(F.desc("decisions"), F.asc_nulls_last("zone_id")).limit(top)


def by_camera(decisions: DataFrame, cameras: DataFrame, top: int = 100) -> DataFrame:
    named = decisions.join(cameras, "camera_id", "left").withColumn("camera_name", F.coalesce("camera_name", F.lit("(camera no longer available)")))
    return named.groupBy("camera_id", "camera_name").agg(*counts(**MEASURES)).orderBy(F.desc("decisions"), "camera_id").limit(top)


def breakdown(decisions: DataFrame, zones: DataFrame) -> DataFrame:
    """Rule, zone and camera breakdowns in one pass by grouping sets."""
    marked = named_zones(decisions, zones).select("rule_type", "zone_name", "camera_id", *[F.expr(c).cast("int").alias(k) for k, c in MEASURES.items()])
    # one shuffle over the distinct combinations instead of three over all rows
    fine = marked.groupBy("rule_type", "zone_name", "camera_id").agg(*[F.sum(k).alias(k) for k in MEASURES])
    sets = fine.groupingSets([[F.col("rule_type")], [F.col("zone_name")], [F.col("camera_id")]], "rule_type", "zone_name", "camera_id")
    return sets.agg(F.grouping_id().alias("g"), *[F.sum(k).alias(k) for k in MEASURES]).select(
        F.when(F.col("g") == 3, "rule").when(F.col("g") == 5, "zone").otherwise("camera").alias("dimension"), F.coalesce("rule_type", "zone_name", "camera_id").alias("value"), *MEASURES
    )


def by_hour(decisions: DataFrame, tz: str) -> DataFrame:
    """All 24 local hours, also those without decisions."""
    spark = decisions.sparkSession
    found = decisions.groupBy(F.hour(F.from_utc_timestamp("observed_at", tz)).alias("hour")).agg(*counts(decisions="true", flagged=FLAG))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(found, "hour", "left").select("hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("decisions", "flagged")])


def by_day(decisions: DataFrame, since: str, until: str, tz: str) -> DataFrame:
    """Every local day of the window, up to the microsecond before its end."""
    day = lambda t: F.to_date(F.from_utc_timestamp(t, tz))
    start, end = day(F.lit(since).cast("timestamp")), day(F.lit(until).cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND"))
    days = decisions.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    found = decisions.groupBy(day(F.col("observed_at")).alias("day")).agg(*counts(decisions="true", compliant=FINE, flagged=FLAG, insufficient=UNSURE))
    return days.join(found, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("decisions", "compliant", "flagged", "insufficient")])


def item_state(item: str) -> Column:
    return F.get_json_object("evidence", f"$.items.{item}.state")


def ppe(decisions: DataFrame) -> DataFrame:
    flag, helmet, vest = F.expr(FLAG), item_state("helmet") == "ABSENT", item_state("safety_vest") == "ABSENT"
    return decisions.where(F.col("rule_type").isin(*PPE_RULES)).agg(
        *counts(flagged=FLAG, missing_helmet=flag & helmet, missing_vest=flag & vest, missing_both=flag & helmet & vest, could_not_verify=UNSURE, compliant=FINE)
    )


def stays(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Exits from restricted zones with seconds and whether the whole visit was watched."""
    inside = zones.where("zone_type = 'RESTRICTED'").select("zone_id", "zone_name")
    json = lambda k: F.get_json_object("details", f"$.{k}")
    seconds = json("dwell_s").try_cast("decimal(38,10)")
    whole = (json("reason") == "LEFT") & (F.coalesce(json("first_sighting"), F.lit("false")) != "true") & (F.coalesce(json("visit_started_in_replay"), F.lit("false")) != "true")
    return events.where("event_type = 'EXITED_ZONE'").join(inside, "zone_id").select("zone_id", "zone_name", seconds.alias("s"), (whole & seconds.isNotNull()).alias("timed"))


def _stay_measures() -> list[Column]:
    timed = F.when(F.col("timed"), F.col("s"))
    return [
        F.count_if("timed").alias("visits_timed"), F.count_if(~F.col("timed") & F.col("s").isNotNull()).alias("visits_partial"), F.count_if(F.col("s").isNull()).alias("visits_not_timed"),
        rounded(F.avg(timed), 1).alias("average_seconds"), rounded(F.max(timed), 1).alias("max_seconds"), rounded(F.max(F.when(~F.col("timed"), F.col("s"))), 1).alias("partial_max_seconds"), rounded(F.max("s"), 1).alias("longest_seen_seconds"),
        F.max_by("timed", F.struct("s", "timed")).alias("longest_seen_is_complete"),
    ]


def zone_time(events: DataFrame, zones: DataFrame) -> DataFrame:
    return stays(events, zones).agg(*_stay_measures())


def zone_time_by_zone(events: DataFrame, zones: DataFrame, top: int = 50) -> DataFrame:
    return stays(events, zones).groupBy("zone_id", "zone_name").agg(*_stay_measures()).orderBy(F.desc_nulls_last("longest_seen_seconds"), "zone_id").limit(top)


def man_down(decisions: DataFrame) -> DataFrame:
    return decisions.where("rule_type = 'MAN_DOWN'").agg(*counts(flagged=FLAG, confirmed=f"{FLAG} AND {YES}", dismissed=f"{FLAG} AND {NO}", pending=f"{FLAG} AND {OPEN}", could_not_verify=UNSURE))


def occupancy(decisions: DataFrame) -> DataFrame:
    """Lone workers and crowds; flags on empty zones are in the rule breakdown only."""
    outcome = F.get_json_object("evidence", "$.outcome")
    both = {f"{n}_{k}": F.expr(FLAG) & (outcome == o) & F.expr(c) for n, o in (("lone_worker", "LONE_WORKER"), ("over_capacity", "OVER_CAPACITY")) for k, c in (("flagged", "true"), ("confirmed", YES), ("dismissed", NO), ("pending", OPEN))}
    return decisions.where("rule_type = 'OCCUPANCY'").agg(*counts(**both, could_not_verify=UNSURE))


def corrective_actions(actions: DataFrame, since: str, until: str, today: str) -> DataFrame:
    """Opened and closed in the window, open and overdue now, and mean days of those closed in it."""
    inside = lambda c: (F.col(c) >= F.lit(since).cast("date")) & (F.col(c) < F.lit(until).cast("date"))
    live = F.col("status").isin("OPEN", "IN_PROGRESS")
    shut = (F.col("status") == "CLOSED") & inside("closed_on")
    return actions.agg(
        *counts(opened=inside("created_on"), closed=shut, open=live, overdue=live & (F.col("due_on") < F.lit(today).cast("date"))),
        rounded(F.avg(F.when(shut, F.datediff("closed_on", "created_on"))), 1).alias("average_days_to_close"),
    )


def summary(decisions: DataFrame) -> DataFrame:
    """The summary's headline: reviews count for flags only, the share is null if none was judged."""
    return decisions.agg(
        *counts(total="true", compliant=FINE, potential_violations=FLAG, abstentions=UNSURE, open_alerts=f"{FLAG} AND {OPEN}", confirmed=f"{FLAG} AND {YES}", dismissed=f"{FLAG} AND {NO}")
    ).withColumn("confirmed_share_of_reviewed", ratio(F.col("confirmed"), F.col("confirmed") + F.col("dismissed"), 3))


#: Counters of every section of the document, by the fields they fill there.
_REVIEWED = {"flagged": FLAG, "confirmed": f"{FLAG} AND {YES}", "dismissed": f"{FLAG} AND {NO}", "pending": f"{FLAG} AND {OPEN}", "could_not_verify": UNSURE}
_HEADLINE = {
    "decisions": "true", "compliant": FINE, "flagged_by_system": FLAG, "insufficient_evidence": UNSURE, "confirmed": f"{FLAG} AND {YES}", "dismissed": f"{FLAG} AND {NO}", "pending": f"{FLAG} AND {OPEN}",
    "insufficient_confirmed": f"{UNSURE} AND {YES}", "insufficient_dismissed": f"{UNSURE} AND {NO}",
}
_PPE = {"flagged": FLAG, "missing_helmet": f"{FLAG} AND helmet", "missing_vest": f"{FLAG} AND vest", "missing_both": f"{FLAG} AND helmet AND vest", "could_not_verify": UNSURE, "compliant": FINE}
_OCCUPANCY = {f"{n}_{k}": f"{FLAG} AND outcome = '{n.upper()}' AND {c}" for n in ("lone_worker", "over_capacity") for k, c in (("flagged", "true"), ("confirmed", YES), ("dismissed", NO), ("pending", OPEN))} | {"could_not_verify": UNSURE}
_RULES = {"ppe": (PPE_RULES, _PPE), "man_down": (("MAN_DOWN",), _REVIEWED), "occupancy": (("OCCUPANCY",), _OCCUPANCY)}
_COUNTS = {"decisions": "decisions", "compliant": "compliant", "flagged": "flagged_by_system", "insufficient_evidence": "insufficient_evidence", "confirmed": "confirmed", "dismissed": "dismissed", "pending": "pending"}
_SETS = ("rule_type", "zone_id", "zone", "camera_id", "camera", "hour", "day", "state", "reason")


def document(decisions: DataFrame, events: DataFrame, actions: DataFrame, zones: DataFrame, cameras: DataFrame, since: str, until: str, tz: str, today: str, top: int = 100, top_stays: int = 50) -> DataFrame:
    """One row, doc: the whole report of a window as one JSON object with null fields kept.

    Decisions are read once: every section is a grouping set of one aggregation, and the
    groups (one a rule, zone, camera, hour, day and review reason; zones and cameras up to
    ``top``, most flags first) are put together by one more. Events and actions are read
    once each. Hours and days without decisions count 0; an empty window has zeros, empty
    arrays and null rates.
    """
    at = lambda c: F.from_utc_timestamp(c, tz)
    named = named_zones(decisions, zones).join(cameras, "camera_id", "left")
    rows = named.select(
        "status", "review_state", "rule_type", "zone_id", F.col("zone_name").alias("zone"), "camera_id", F.coalesce("camera_name", F.lit("(camera no longer available)")).alias("camera"),
        F.hour(at("observed_at")).alias("hour"), F.to_date(at("observed_at")).alias("day"), F.when(F.expr(f"{YES} OR {NO}"), F.col("review_state")).alias("state"), F.coalesce("review_reason", F.lit("NONE")).alias("reason"),
        (item_state("helmet") == "ABSENT").alias("helmet"), (item_state("safety_vest") == "ABSENT").alias("vest"), F.get_json_object("evidence", "$.outcome").alias("outcome"), F.col("rule_type").alias("rule"),
    )
    measures = counts(**_HEADLINE)
    for part, (rules, fields) in _RULES.items():
        kinds = ", ".join(f"'{r}'" for r in rules)
        measures += counts(**{f"{part}_{k}": f"rule IN ({kinds}) AND {c}" for k, c in fields.items()})
    sets = [[], ["rule_type"], ["zone_id", "zone"], ["camera_id", "camera"], ["hour"], ["day"], ["state", "reason"]]
    found = rows.groupingSets([[F.col(c) for c in s] for s in sets], *_SETS).agg(F.grouping_id().alias("g"), *measures)
    bit = {c: 1 << (len(_SETS) - 1 - i) for i, c in enumerate(_SETS)}
    which = {tuple(s): sum(b for c, b in bit.items() if c not in s) for s in sets}
    part = F.coalesce(*[F.when(F.col("g") == g, F.lit(s[0] if s else "all")) for s, g in which.items()])
    # the first zones and cameras; other sections are whole
    order = Window.partitionBy("part").orderBy(F.desc("flagged_by_system"), F.desc("decisions"), F.coalesce("zone", "camera"), F.coalesce("zone_id", "camera_id"))
    found = found.withColumn("part", part).withColumn("place", F.row_number().over(order)).where((F.col("place") <= top) | ~F.col("part").isin("zone_id", "camera_id"))

    one = lambda value: F.first(F.when(F.col("part") == "all", value), ignorenulls=True)
    zero = lambda names: F.struct(*[F.lit(0).cast("long").alias(k) for k in names])
    fields = lambda names: F.struct(*[F.col(v).alias(k) for k, v in names.items()])

    def array(name: str, keys: list[Column], value: Column, cond: Column | None = None) -> Column:
        here = F.col("part") == name if cond is None else (F.col("part") == name) & cond
        return F.transform(F.array_sort(F.collect_list(F.when(here, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("o"))))), lambda x: x["o"])

    listed = lambda *names: F.struct(*[F.col(c) for c in names], *[F.col(v).alias(k) for k, v in _COUNTS.items()])
    most = [-F.col("flagged_by_system"), -F.col("decisions")]
    start, end = F.to_date(at(F.lit(since).cast("timestamp"))), F.to_date(at(F.lit(until).cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND")))
    by = lambda name, value: F.map_from_entries(F.collect_list(F.when(F.col("part") == name, F.struct(F.col(name), value))))
    hour, day = {"decisions": "decisions", "flagged": "flagged_by_system"}, {"decisions": "decisions", "compliant": "compliant", "flagged": "flagged_by_system", "insufficient": "insufficient_evidence"}
    put = found.groupBy().agg(
        F.coalesce(one(fields(dict(zip(_HEADLINE, _HEADLINE)))), zero(_HEADLINE)).alias("head"),
        *[F.coalesce(one(fields({k: f"{p}_{k}" for k in f})), zero(f)).alias(p) for p, (_, f) in _RULES.items()],
        array("state", [F.col("state"), -F.col("decisions"), F.col("reason")], F.struct("state", "reason", F.col("decisions").alias("count")), F.col("state").isNotNull()).alias("review_reasons"),
        array("rule_type", [*most, F.col("rule_type")], listed("rule_type")).alias("by_rule"), array("zone_id", [F.col("place")], listed("zone")).alias("by_zone"), array("camera_id", [F.col("place")], listed("camera")).alias("by_camera"),
        by("hour", fields(hour)).alias("hours"), by("day", fields(day)).alias("days"),
    )
    filled = lambda steps, known, names, key: F.transform(steps, lambda k: F.struct(k.alias(key), *[F.coalesce(F.col(known)[k][n], F.lit(0)).alias(n) for n in names]))
    h = F.col("head")
    head = F.struct(
        F.lit(since).alias("since"), F.lit(until).alias("until"), F.lit(tz).alias("time_zone"), *[h[k].alias(k) for k in _HEADLINE],
        ratio(h["compliant"], h["compliant"] + h["flagged_by_system"], 4).alias("compliance_rate"), ratio(h["insufficient_evidence"], h["decisions"], 4).alias("unverifiable_rate"),
        ratio(h["confirmed"], h["confirmed"] + h["dismissed"], 3).alias("confirmed_share_of_reviewed"),
    )
    judged = put.select(head.alias("headline"), "review_reasons", "by_rule", "by_zone", "by_camera", filled(F.sequence(F.lit(0), F.lit(23)), "hours", hour, "hour").alias("by_hour"), filled(F.sequence(start, end), "days", day, "day").alias("by_day"), *_RULES)

    spent = stays(events, zones).groupingSets([[], [F.col("zone_id"), F.col("zone_name")]], "zone_id", "zone_name").agg(F.grouping_id().alias("g"), *_stay_measures())
    names = [c for c in spent.columns if c not in ("zone_id", "zone_name", "g")]
    spent = spent.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc_nulls_last("longest_seen_seconds"), "zone_id"))).withColumn("part", F.when(F.col("g") == 0, "zone").otherwise("all"))
    none = F.struct(*[(F.lit(0).cast("long") if c.startswith("visits") else F.lit(None).cast("boolean" if c.endswith("complete") else "double")).alias(c) for c in names])
    timed = spent.where(f"place <= {int(top_stays)}").groupBy().agg(F.coalesce(one(F.struct(*names)), none).alias("zone_time"), array("zone", [F.col("place")], F.struct("zone_name", *names)).alias("zone_time_by_zone"))
    recorded = events.agg(F.count("*").alias("events_recorded"))
    acted = corrective_actions(actions, since, until, today)
    acted = acted.select(F.struct(*acted.columns).alias("actions"))
    sections = [*judged.columns, "zone_time", "zone_time_by_zone", "events_recorded", "actions"]
    parts = judged.unionByName(timed, allowMissingColumns=True).unionByName(recorded, allowMissingColumns=True).unionByName(acted, allowMissingColumns=True)
    whole = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in sections])
    return whole.select(F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("doc"))


def report(decisions: DataFrame, events: DataFrame, actions: DataFrame, zones: DataFrame, cameras: DataFrame, org: str, since: str, until: str, tz: str, today: str) -> dict[str, DataFrame]:
    """All parts for one tenant and window, over one cached scan of its decisions and events."""
    d, e = window(decisions, org, since, until).persist(), window(events, org, since, until).persist()
    a = actions.where(F.col("org_id") == org)
    return {
        "headline": headline(d, e), "review_reasons": review_reasons(d), "by_rule": by_rule(d), "by_zone": by_zone(d, zones), "by_camera": by_camera(d, cameras), "by_hour": by_hour(d, tz), "by_day": by_day(d, since, until, tz),
        "ppe": ppe(d), "zone_time": zone_time(e, zones), "zone_time_by_zone": zone_time_by_zone(e, zones), "man_down": man_down(d), "occupancy": occupancy(d), "actions": corrective_actions(a, since, until, today),
    }
