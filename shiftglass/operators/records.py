"""Lists, audit trail, tenancy, replication and retention over events and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAGE_LIMIT = 200
UUID_SHAPE = "^.{8}-.{4}-.{4}-.{4}-.{12}$"


# --------------------------------------------------------------------------- tenancy and filters
def tenant(rows: DataFrame, caller_orgs: DataFrame, deleted_orgs: DataFrame | None = None, key: str = "org_id") -> DataFrame:
    """Rows of the caller's organisations, deleted ones left out; rows without one belong to nobody."""
    own = caller_orgs.select(key).distinct()
    if deleted_orgs is not None:
        own = own.join(deleted_orgs.select(key), key, "left_anti")
    # a caller has few organisations, an organisation many rows: these stay where they are
    return rows.join(F.broadcast(own), key, "left_semi")


def where_equal(rows: DataFrame, **values) -> DataFrame:
    """Rows that match all values given; a list means any of them, None means no condition."""
    for k, v in values.items():
        if v is not None:
            rows = rows.where(F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v)
    return rows


def between(rows: DataFrame, since: str | None, until: str | None, at: str = "observed_at") -> DataFrame:
    """The half-open time window; its ends must be in order."""
    if since is not None and until is not None and since >= until:
        raise ValueError("the window's start must be before its end")
    if since is not None:
        rows = rows.where(F.col(at) >= F.lit(since).cast("timestamp"))
    return rows if until is None else rows.where(F.col(at) < F.lit(until).cast("timestamp"))


# --------------------------------------------------------------------------- pages
def newest(rows: DataFrame, *columns: str) -> list[Column]:
    return [F.desc("observed_at"), F.desc("id")]


def page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """Newest first; ``limit`` is held between 1 and 200."""
    return rows.orderBy(*newest(rows)).offset(max(0, offset)).limit(min(PAGE_LIMIT, max(1, limit)))


def next_offset(total: int, limit: int, offset: int) -> int | None:
    """Where the next page starts, if there is one."""
    at = offset + min(PAGE_LIMIT, max(1, limit))
    return at if at < total else None


def after(rows: DataFrame, at: str, id_: int, limit: int) -> DataFrame:
    """Keyset page: the rows that follow (observed_at, id), oldest first."""
    t = F.lit(at).cast("timestamp")
    return rows.where((F.col("observed_at") > t) | ((F.col("observed_at") == t) & (F.col("id") > id_))).orderBy("observed_at", "id").limit(limit)


def newest_oldest_first(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest, oldest first."""
    return rows.orderBy(*newest(rows)).limit(n).orderBy("observed_at", "id")


def csv_cell(value: Column) -> Column:
    """Text a spreadsheet takes for a formula gets a quote in front."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(F.coalesce(text, F.lit("")))


def decision_view(decisions: DataFrame) -> DataFrame:
    """Decisions without the picture's place, only whether there is one."""
    return decisions.withColumn("has_picture", F.col("snapshot_ref").isNotNull()).drop("snapshot_ref")


def latest_by(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Newest row of every ``key``, the ``n`` newest of them."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("observed_at", "id")).alias("r")).select("r.*")
    return best.orderBy(*newest(rows)).limit(n)


# --------------------------------------------------------------------------- audit trail
def audit_trail(decisions: DataFrame, events: DataFrame, zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """Decisions and events in one form; in order of time, events first, by ``position`` columns (at, kind)."""
    worker = F.when(F.col("worker_key").startswith("zone-"), F.lit("Whole zone")).otherwise(F.concat(F.lit("Worker "), F.regexp_extract("worker_key", r"^trk-(\d+)$", 1)))
    names = lambda d: d.join(cameras, "camera_id", "left").join(zones.select("zone_id", "zone_name"), "zone_id", "left")
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in (("COMPLIANT", "Compliant"), ("POTENTIAL_VIOLATION", "Potential violation"), ("UNVERIFIABLE", "Could not verify")) for x in kv]), F.col("status"))
    common = [F.col("observed_at").alias("at"), F.coalesce("camera_name", F.lit("")).alias("camera"), F.coalesce("zone_name", F.lit("")).alias("zone"), worker.alias("worker")]
    a = names(events).select(*common, F.lit("Event").alias("record"), "id", F.initcap(F.translate("event_type", "_", " ")).alias("what"), F.lit("").alias("result"), F.lit("").alias("severity"), F.lit("").alias("review"))
    b = names(decisions).select(*common, F.lit("Decision").alias("record"), "id", F.initcap(F.translate("rule_type", "_", " ")).alias("what"), verdict.alias("result"), F.initcap("severity").alias("severity"), F.initcap(F.translate("review_state", "_", " ")).alias("review"))
    return a.unionByName(b)


def in_order(trail: DataFrame) -> DataFrame:
    return trail.orderBy("at", F.desc("record"), "id")


# --------------------------------------------------------------------------- replication
def decision_payload(decisions: DataFrame) -> DataFrame:
    """What is sent on: keys cut to their sizes, flags pending review and the rest not."""
    return decisions.select(
        "id", "org_id", F.left("worker_key", F.lit(80)).alias("worker_key"), "rule_type", "status", "observed_at",
        F.when(F.col("status") == "POTENTIAL_VIOLATION", "PENDING").otherwise("NOT_REQUIRED").alias("review_state"),
        F.when(F.col("status") == "UNVERIFIABLE", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))).alias("confidence"),
    )


def mapped(rows: DataFrame, cameras: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose camera and zone (if any) are known, and pairs of the others with counts."""
    known = rows.join(cameras.select("camera_id", F.lit(True).alias("c")), "camera_id", "left").join(zones.select("zone_id", F.lit(True).alias("z")), "zone_id", "left")
    ok = F.coalesce("c", F.lit(False)) & (F.col("zone_id").isNull() | F.coalesce("z", F.lit(False)))
    rest = known.where(~ok).groupBy("camera_id", "zone_id").agg(F.count("*").alias("n"))
    return known.where(ok).drop("c", "z"), rest


def with_known_rules(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule ids that no longer exist become null."""
    return decisions.join(rules.select("rule_id", F.lit(True).alias("r")), "rule_id", "left").withColumn("rule_id", F.when(F.col("r"), F.col("rule_id"))).drop("r")


def not_there(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """Idempotent append: rows whose key neither exists nor repeats."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


# --------------------------------------------------------------------------- rules and retention
#: Parameters of the built-in rules, keys in order as they are hashed.
ENTRY_DEFAULT = '{"mode": "AT_ENTRY", "required_ppe": ["helmet", "safety_vest"]}'
MAN_DOWN_DEFAULT = '{"lying_allowed_zone_ids": [], "min_seconds_down": 5.0}'


def rule_key(id_: Column, source: Column, kind: Column, zone: Column, params: Column) -> Column:
    """A rule's id, else its source, type, zone and the start of a hash of its parameters (JSON with sorted keys)."""
    made = F.concat_ws(":", source, kind, F.coalesce(zone, F.lit("None")), F.substring(F.sha1(params), 1, 8))
    return F.coalesce(F.nullif(id_, F.lit("")), made)


def slug_params(rules: DataFrame, zones: DataFrame, scalars: tuple[str, ...] = ("checkpoint_zone_id", "exit_zone_id"), lists: tuple[str, ...] = ("lying_allowed_zone_ids",)) -> DataFrame:
    """``rules`` (rule_id, scalars and lists of zone ids as maps) with the ids of ``zones`` (zone_id, slug) made slugs; unknown ids stay.

    ``params`` is a map of names to zone ids, ``lists`` one of names to arrays of them.
    """
    refs = rules.select("rule_id", F.explode(F.concat(F.map_values("params"), F.flatten(F.map_values("lists")))).alias("zone_id")).distinct()
    known = refs.join(zones.select("zone_id", "slug").where("slug IS NOT NULL"), "zone_id").groupBy("rule_id").agg(F.map_from_entries(F.collect_set(F.struct("zone_id", "slug"))).alias("__slugs"))
    name = lambda v: F.coalesce(F.col("__slugs")[v], v)
    both = rules.join(known, "rule_id", "left").withColumn("params", F.transform_values("params", lambda k, v: F.when(k.isin(*scalars), name(v)).otherwise(v)))
    return both.withColumn("lists", F.transform_values("lists", lambda k, v: F.when(k.isin(*lists), F.transform(v, name)).otherwise(v))).drop("__slugs")


def uncovered_defaults(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """The built-in entry rule for every restricted zone that has no entry rule, on or off."""
    own = rules.where("type = 'PPE_ENTRY'").select("zone_id")
    key = rule_key(F.lit(None).cast("string"), F.lit("default"), F.lit("PPE_ENTRY"), F.col("zone_id"), F.lit(ENTRY_DEFAULT))
    return zones.where("zone_type = 'RESTRICTED'").join(own, "zone_id", "left_anti").select(key.alias("rule_key"), "zone_id", F.lit("PPE_ENTRY").alias("type"), F.lit("default").alias("source"))


def session_rules(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Live rules, the defaults of zones without an entry rule, and the built-in man-down rule unless there is an own one, on or off."""
    live = rules.where("enabled").select(F.col("rule_id").alias("rule_key"), "zone_id", "type", F.lit("rule").alias("source"))
    key = rule_key(F.lit(None).cast("string"), F.lit("default"), F.lit("MAN_DOWN"), F.lit(None).cast("string"), F.lit(MAN_DOWN_DEFAULT))
    own = rules.agg(F.count_if(F.col("type") == "MAN_DOWN").alias("own")).where("own = 0")
    return live.unionByName(uncovered_defaults(zones, rules)).unionByName(own.select(key.alias("rule_key"), F.lit(None).cast("string").alias("zone_id"), F.lit("MAN_DOWN").alias("type"), F.lit("default").alias("source")))


def keep_decisions(decisions: DataFrame, actions: DataFrame, now: str, days: int) -> DataFrame:
    """Decisions that retention leaves: younger than twice ``days``, pending, or with an open action."""
    edge = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(2 * days))
    old = decisions.where((F.col("observed_at") < edge) & (F.col("review_state") != "PENDING"))
    gone = old.join(actions.where(F.col("status").isin("OPEN", "IN_PROGRESS")).select(F.col("decision_id").alias("id")), "id", "left_anti").select("id")
    return decisions.join(gone, "id", "left_anti")


def purge_counts(decisions: DataFrame, actions: DataFrame, now: str, days: int) -> DataFrame:
    """How many decisions retention takes from each organisation."""
    kept = keep_decisions(decisions, actions, now, days).select("id")
    return decisions.join(kept, "id", "left_anti").groupBy("org_id").agg(F.count("*").alias("purged"))
