"""Questions across organisations: overview, attention, signups, plan usage and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Plan limits (cameras, sites, seats, history days; none means unlimited).
LIMITS = {"FREE": (1, 1, 3, 7), "GROWTH": (10, 5, 25, 90), "ENTERPRISE": (None, None, None, 365)}
#: Weight and severity of each reason for attention.
REASONS = {"camera_error": (100, 3), "failed_session": (80, 2), "no_zones": (70, 2), "no_cameras": (40, 1), "no_members": (30, 1)}
#: Orders an overview can be shown in.
SORTS = {
    "name": ["name", "org_id"], "newest": ["-created_on", "org_id"], "oldest": ["created_on", "org_id"], "cameras": ["-cameras", "org_id"], "members": ["-members", "org_id"], "zones": ["-zones", "org_id"], "health": ["-score", "org_id"],
}


def sort(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in SORTS[key]])


def first_page(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` organisations in every order: (sort, place, org_id). Each order keeps its best in every task before they meet."""
    out = None
    for key, columns in SORTS.items():
        order = F.struct(*[(-F.col(c[1:]).cast("double") if c[1:] != "created_on" else -F.unix_date("created_on")).alias(c[1:]) if c.startswith("-") else F.col(c) for c in columns])
        best = sort(rows, key).limit(n).select("org_id", order.alias("key"))
        placed = best.agg(F.array_sort(F.collect_list(F.struct("key", "org_id"))).alias("rows")).select(F.posexplode("rows").alias("place", "r"))
        page = placed.select(F.lit(key).alias("sort"), (F.col("place") + 1).cast("long").alias("place"), "r.org_id")
        out = page if out is None else out.unionByName(page)
    return out


def effective_plan(today: str) -> Column:
    """The plan in force: FREE once the term has ended."""
    return F.when(F.col("term_ends_on") <= F.lit(today).cast("date"), "FREE").otherwise(F.col("plan"))


def limit_of(plan: Column, i: int) -> Column:
    out = F.lit(None).cast("int")
    for name, limits in LIMITS.items():
        out = F.when(plan == name, F.lit(limits[i]).cast("int")).otherwise(out)
    return out


def plan_usage(orgs: DataFrame, today: str) -> DataFrame:
    """Use against the limits of the plan in force; a null limit is none."""
    plan = effective_plan(today)
    over = [F.coalesce(F.col(c) > limit_of(plan, i), F.lit(False)) for i, c in enumerate(("cameras", "sites", "seats"))]
    return orgs.select("org_id", plan.alias("plan_in_force"), "cameras", "sites", "seats", *[limit_of(plan, i).alias(f"{c}_limit") for i, c in enumerate(("cameras", "sites", "seats", "history_days"))], (over[0] | over[1] | over[2]).alias("over_limit"))


def _troubles() -> dict[str, Column]:
    """Each reason for attention and when it holds; cameras without a zone see nothing."""
    cameras, none = F.col("cameras"), F.lit(0)
    return {"camera_error": F.col("cameras_in_error") > none, "failed_session": F.col("failed_sessions") > none, "no_zones": (cameras > none) & (F.col("zones") == none), "no_cameras": cameras == none, "no_members": F.col("members") == none}


def _counted(n: Column, one: str, rest: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n > 1, "s").otherwise(""), F.lit(rest))


def attention(orgs: DataFrame) -> DataFrame:
    """Live organisations with something wrong: reasons, their highest severity, summed weight."""
    when = _troubles()
    label = {"camera_error": _counted(F.col("cameras_in_error"), "camera", " in error"), "failed_session": _counted(F.col("failed_sessions"), "failed run", ""), "no_zones": F.lit("cameras configured but no zones drawn"), "no_cameras": F.lit("no cameras added yet"), "no_members": F.lit("no active members")}
    found = F.array_compact(F.array(*[F.when(when[k], F.struct(label[k].alias("label"), F.lit(w).alias("weight"), F.lit(s).alias("severity"))) for k, (w, s) in REASONS.items()]))
    rows = orgs.where(~F.col("deleted")).withColumn("r", found).where(F.size("r") > 0)
    return rows.select(
        "org_id", F.array_join(F.transform("r", lambda x: x["label"]), "; ").alias("reasons"), F.aggregate("r", F.lit(0), lambda s, x: F.greatest(s, x["severity"])).alias("severity"), F.aggregate("r", F.lit(0), lambda s, x: s + x["weight"]).alias("score")
    )


def health(orgs: DataFrame) -> DataFrame:
    """How bad it is (the higher the worse, errors and failed runs by their number) and the one thing to say about it."""
    when, n = _troubles(), lambda c: F.col(c)
    score = n("cameras_in_error") * 100 + n("failed_sessions") * 80 + sum(F.when(when[k], REASONS[k][0]).otherwise(0) for k in ("no_zones", "no_cameras", "no_members"))
    said = (("suspended", n("suspended"), F.lit("Suspended")), ("error", when["camera_error"], _counted(n("cameras_in_error"), "camera", " down")), ("error", when["failed_session"], _counted(n("failed_sessions"), "failed run", "")),
            ("warn", when["no_zones"], F.lit("No zones drawn")), ("warn", when["no_cameras"], F.lit("No cameras")), ("warn", when["no_members"], F.lit("No members")), ("live", n("running_sessions") > 0, F.lit("Processing")))
    level, label = F.lit("ok"), F.lit("Healthy")
    for word, cond, text in reversed(said):
        level, label = F.when(cond, word).otherwise(level), F.when(cond, text).otherwise(label)
    return orgs.where(~F.col("deleted")).select("org_id", score.cast("long").alias("score"), level.alias("level"), label.alias("label"))


def safe_cameras(cameras: DataFrame) -> DataFrame:
    """Cameras as members see them: whether there is a stream and a calibration, neither the address nor the matrix."""
    hidden = ("rtsp_url", "homography")
    return cameras.select(*[c for c in cameras.columns if c not in hidden], (F.col("rtsp_url").isNotNull() & (F.trim("rtsp_url") != "")).alias("has_rtsp_url"), F.col("homography").isNotNull().alias("is_calibrated"))


def audit(rows: DataFrame, action: str | None = None, actor: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The platform's audit rows of an action, an actor and whole days (both ends included)."""
    for column, value in (("action", action), ("actor", actor)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("at") >= F.lit(since).cast("timestamp"))
    return rows if until is None else rows.where(F.col("at") < F.lit(until).cast("timestamp") + F.expr("INTERVAL 1 DAY"))


def signups(orgs: DataFrame, since: str, until: str) -> DataFrame:
    """Organisations created on each day of [since, until] and in all so far, those before the window included."""
    days = orgs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("day"))
    per_day = orgs.groupBy(F.col("created_on").alias("day")).agg(F.count("*").alias("n"))
    before = per_day.where(F.col("day") < F.lit(since).cast("date")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("base"))
    rows = days.join(per_day, "day", "left").crossJoin(before)
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return rows.select("day", F.coalesce("n", F.lit(0)).alias("signups"), (F.col("base") + total).alias("total"))


def totals(orgs: DataFrame) -> DataFrame:
    live = orgs.where(~F.col("deleted"))
    return live.agg(F.count("*").alias("organisations"), F.count_if("suspended").alias("suspended"), *[F.sum(c).alias(c) for c in ("cameras", "sites", "seats")])


def overview(orgs: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Counts per organisation, each child table aggregated once before it is joined."""
    d = decisions.groupBy("org_id").agg(F.count("*").alias("decisions"), F.count_if(F.col("review_state") == "PENDING").alias("open_alerts"), F.max("observed_at").alias("last_decision"))
    e = events.groupBy("org_id").agg(F.count("*").alias("events"))
    return orgs.join(d, "org_id", "left").join(e, "org_id", "left").select("org_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("decisions", "open_alerts", "events")], "last_decision")


def search(orgs: DataFrame, text: str = "", show: str = "all") -> DataFrame:
    """Live organisations whose name holds ``text``; all, active, suspended, or in need of attention."""
    rows = orgs.where(~F.col("deleted") & F.lower("name").contains(text.lower().strip()))
    if show == "active":
        return rows.where(~F.col("suspended"))
    if show == "suspended":
        return rows.where("suspended")
    return rows.join(attention(orgs).select("org_id"), "org_id", "left_semi") if show == "attention" else rows


def histogram(rows: DataFrame, column: str, newest: int = 2000) -> DataFrame:
    """How often each value occurs among the newest rows."""
    return rows.orderBy(F.desc("observed_at"), F.desc("id")).limit(newest).groupBy(column).agg(F.count("*").alias("n"))


def term_end(start: Column, period: Column) -> Column:
    """End of a plan's term: a month or a year on."""
    return F.when(period == "YEARLY", F.add_months(start, 12)).otherwise(F.add_months(start, 1))


def schedule_runs(start: Column, now: Column, step_days: Column) -> Column:
    """How many steps bring a missed schedule past ``now``: one jump, not one run each."""
    return F.when(start > now, 0).otherwise(F.floor(F.datediff(now, start) / step_days) + 1)


def purgeable(orgs: DataFrame, today: str, grace_days: int = 30) -> DataFrame:
    """Deleted organisations whose grace is over (their last day is the term's end, else the creation)."""
    gone = F.coalesce("term_ends_on", "created_on")
    return orgs.where(F.col("deleted") & (F.date_add(gone, grace_days) < F.lit(today).cast("date"))).select("org_id", gone.alias("gone_on"))


def renewed(orgs: DataFrame, today: str, period: str = "MONTHLY") -> DataFrame:
    """Paid plans carried on: from the running term's end, or from today where it has ended."""
    start = F.greatest(F.coalesce("term_ends_on", F.lit(today).cast("date")), F.lit(today).cast("date"))
    return orgs.where(F.col("plan") != "FREE").select("org_id", "plan", term_end(start, F.lit(period)).alias("term_ends_on"))


def invitations(invites: DataFrame, orgs: DataFrame, email: str) -> DataFrame:
    """The caller's open invitations with the organisation's name, addresses compared trimmed and in lower case."""
    mine = invites.where(F.lower(F.trim("email")) == email.strip().lower())
    return mine.join(orgs.where(~F.col("deleted")).select("org_id", "name"), "org_id").select("invite_id", "org_id", "name", "role")
