"""Who may do what, which rules are valid, and which reviews and rows are allowed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..vocabulary import ITEMS, RULE_TYPES, RULE_ZONE_TYPES, STATUSES, ZONE_TYPES

#: The roles that hold each capability.
EVERYONE, STAFF, ADMINS = ("ADMIN", "MANAGER", "VIEWER"), ("ADMIN", "MANAGER"), ("ADMIN",)
CAPABILITIES = {
    EVERYONE: ("dashboard.view", "analytics.view", "reports.export", "zones.view", "members.view", "safety.view"),
    STAFF: ("zones.edit", "cameras.edit", "sites.edit", "analysis.run", "safety.review", "safety.rules.edit", "safety.evidence.view"),
    ADMINS: ("members.invite", "members.manage", "org.settings"),
}


def can(role: str | None, capability: str) -> bool:
    """False for an unknown role and for an unknown capability."""
    return any(capability in held and role in roles for roles, held in CAPABILITIES.items())


def capabilities(spark) -> DataFrame:
    rows = [(c, r) for roles, held in CAPABILITIES.items() for c in held for r in roles]
    return spark.createDataFrame(rows, "capability string, role string")


# --------------------------------------------------------------------------- rules
class RuleError(ValueError):
    """A rule that cannot be used, and why."""


@dataclass(frozen=True)
class Number:
    low: float
    high: float
    default: float | None = None
    required: bool = False
    whole: bool = False


#: Ranges and defaults of the rules' numbers.
NUMBERS = {
    "PPE_CONTINUOUS": {"grace_seconds": Number(1, 30, 3.0)},
    "MAX_DWELL": {"max_seconds": Number(10, 86400, required=True), "warn_fraction": Number(0.1, 1.0, 0.8)},
    "REQUIRED_EXIT": {"max_seconds_to_exit": Number(3, 600, 30.0)},
    "OCCUPANCY": {"min_people": Number(1, 1000, whole=True), "max_people": Number(0, 1000, whole=True), "grace_seconds": Number(3, 120, 10.0), "window_seconds": Number(0.1, 60, 2.0)},
    "MAN_DOWN": {"min_seconds_down": Number(3, 60, 5.0)},
    "WALK_ONLY": {"max_speed_heights_per_s": Number(0.1, 20, 1.8), "min_seconds": Number(0.5, 60, 2.0)},
}
RESTRICTED_ONLY = ("PPE_ENTRY", "PPE_CONTINUOUS", "REQUIRED_EXIT")


def _number(params: dict, name: str, spec: Number):
    v = params.get(name, spec.default)
    if v is None:
        if spec.required:
            raise RuleError(f"{name} is required")
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or (spec.whole and v != int(v)) or not spec.low <= v <= spec.high:
        raise RuleError(f"{name} must be {'a whole number ' if spec.whole else ''}from {spec.low} to {spec.high}")
    return int(v) if spec.whole else float(v)


def validate(kind: str, zone: str | None, params: dict | None, zones: dict[str, str]) -> dict:
    """The rule's parameters with defaults, or a RuleError. ``zones``: id -> type."""
    params = {} if params is None else params
    if kind not in RULE_TYPES or not isinstance(params, dict):
        raise RuleError("unknown rule type" if kind not in RULE_TYPES else "params must be an object")
    if zone is None and kind != "MAN_DOWN":
        raise RuleError(f"{kind} needs a zone")
    if zone is not None:
        allowed = ("RESTRICTED",) if kind in RESTRICTED_ONLY else RULE_ZONE_TYPES
        if zones.get(zone) not in allowed:
            raise RuleError(f"{kind} needs a zone of type {', '.join(allowed)}")
    out = {n: _number(params, n, spec) for n, spec in NUMBERS.get(kind, {}).items()}

    def place(name: str, of: str) -> str:
        if zones.get(params.get(name)) != of:
            raise RuleError(f"{name} must be a zone of type {of}")
        return params[name]

    if kind in ("PPE_ENTRY", "PPE_CONTINUOUS"):
        wanted = params.get("required_ppe", list(ITEMS))
        if not isinstance(wanted, (list, tuple)) or not wanted or set(wanted) - set(ITEMS):
            raise RuleError(f"required_ppe must list some of {', '.join(ITEMS)}")
        out["required_ppe"] = list(dict.fromkeys(wanted))
    if kind == "PPE_ENTRY":
        out["mode"] = params.get("mode", "AT_ENTRY")
        if out["mode"] not in ("AT_ENTRY", "VIA_CHECKPOINT"):
            raise RuleError("mode must be AT_ENTRY or VIA_CHECKPOINT")
        if out["mode"] == "VIA_CHECKPOINT":
            out["checkpoint_zone_id"] = place("checkpoint_zone_id", "PPE_CHECKPOINT")
            out["max_seconds_since_checkpoint"] = _number(params, "max_seconds_since_checkpoint", Number(5, 600, 60.0))
        elif params.get("checkpoint_zone_id"):
            raise RuleError("checkpoint_zone_id belongs to VIA_CHECKPOINT")
    if kind == "REQUIRED_EXIT":
        out["exit_zone_id"] = place("exit_zone_id", "EXIT")
    if kind == "OCCUPANCY":
        low, high = out["min_people"], out["max_people"]
        if low is None and high is None or None not in (low, high) and low > high:
            raise RuleError("give min_people, max_people or both, in order")
        empty = params.get("flag_empty", low is not None)
        if not isinstance(empty, bool) or empty and low is None:
            raise RuleError("flag_empty must be true or false, and needs min_people")
        out["flag_empty"] = empty
    if kind == "MAN_DOWN":
        out["lying_allowed_zone_ids"] = list(params.get("lying_allowed_zone_ids", []))
        if set(out["lying_allowed_zone_ids"]) - set(zones):
            raise RuleError("lying_allowed_zone_ids names an unknown zone")
    return out


def parse_rules(rows: list[dict], zones: dict[str, str]) -> tuple[list[dict], list[tuple]]:
    """Usable rules, and (id, reason) of those skipped."""
    good, bad = [], []
    for r in rows:
        try:
            good.append(r | {"params": validate(r["type"], r.get("zone_id"), r.get("params"), zones)})
        except RuleError as e:
            bad.append((r.get("id"), str(e)))
    return good, bad


# --------------------------------------------------------------------------- rows
def invalid_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions that break an invariant, with the first one broken."""
    c, s, r = F.col("confidence"), F.col("status"), F.col("review_state")
    broken = (
        F.when(~s.isin(*STATUSES), "status").when(~c.between(0, 1), "confidence").when((s == "UNVERIFIABLE") & (c != 0), "unverifiable confidence").when((s == "COMPLIANT") & (r != "NOT_REQUIRED"), "compliant review")
    )
    return decisions.withColumn("broken", broken).where("broken IS NOT NULL")


def invalid_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets that break an invariant."""
    ok = (
        (F.date_trunc("minute", "bucket_start") == F.col("bucket_start")) & (F.col("occupancy_min") <= F.col("occupancy_max")) & (F.col("occupancy_avg") <= F.col("occupancy_max"))
        & (F.col("sitting_frames") + F.col("standing_frames") + F.col("walking_frames") <= F.col("sample_frames")) & F.col("avg_activity_score").between(0, 100)
        & (F.col("total_dwell_seconds") <= 60 * F.greatest("occupancy_max", F.lit(1)))
    )
    return buckets.where(~ok)


def review(decisions: DataFrame, verdicts: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Decisions with allowed verdicts (id, state, reason) applied, and the refused ones with why.

    Only CONFIRMED and DISMISSED are verdicts; what complies takes none, nor does a decision
    of another or no organisation (it is simply not found).
    """
    target = decisions.select(F.col("id").alias("i"), F.col("status").alias("st"))
    checked = verdicts.join(target, F.col("id") == F.col("i"), "left").withColumn(
        "why", F.when(~F.col("state").isin("CONFIRMED", "DISMISSED"), "not a verdict").when(F.col("i").isNull(), "not found").when(F.col("st") == "COMPLIANT", "nothing to review")
    )
    good = checked.where("why IS NULL").select("id", F.col("state").alias("new_state"), F.col("reason").alias("new_reason"))
    done = decisions.join(good, "id", "left").withColumn("review_state", F.coalesce("new_state", "review_state")).withColumn("review_reason", F.when(F.col("new_state").isNotNull(), F.col("new_reason")).otherwise(F.col("review_reason")))
    stamped = done.withColumn("reviewed_at", F.when(F.col("new_state").isNotNull(), F.lit(now).cast("timestamp"))).drop("new_state", "new_reason")
    return stamped, checked.where("why IS NOT NULL").select("id", "state", "why")


def slug(name: Column) -> Column:
    """Lower-case words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unique_slugs(rows: DataFrame, name: str, key: str) -> DataFrame:
    """A slug per row; in order of ``key``, one that is taken gets -1, -2, ... until it is free. A name without any letter is ``org``.

    Numbers start from the row's place among equal names; only where one meets another
    name's slug (few rows) does the later of the two take its next number, round by round.
    """
    own = Window.partitionBy("s").orderBy(key)
    made = rows.withColumn("s", slug(F.col(name))).withColumn("n", F.row_number().over(own) - 1)
    while True:
        text = F.when(F.col("n") > 0, F.concat("s", F.lit("-"), F.col("n").cast("string"))).when(F.col("s") == "", "org").otherwise(F.col("s"))
        made = made.withColumn("slug", text)
        clash = made.withColumn("turn", F.row_number().over(Window.partitionBy("slug").orderBy(key))).where("turn > 1").groupBy("s").agg(F.min("n").alias("from"))
        if clash.isEmpty():
            return made.drop("s", "n")
        made = made.join(clash, "s", "left").withColumn("n", F.when(F.col("n") >= F.col("from"), F.col("n") + 1).otherwise(F.col("n"))).drop("from", "slug")


# --------------------------------------------------------------------------- rows that change
def soft_deleted(rows: DataFrame, ids: list, now: str, off: str = "enabled") -> DataFrame:
    """``rows`` with those of ``ids`` marked deleted and switched off; what is deleted keeps its first time."""
    hit = F.col("id").isin(ids)
    at = F.coalesce("deleted_at", F.when(hit, F.lit(now).cast("timestamp")))
    return rows.withColumn("deleted_at", at).withColumn(off, F.col(off) & at.isNull())


def stamped(old: DataFrame, new: DataFrame, actor: str, now: str, key: str = "id") -> DataFrame:
    """``new`` with who made and changed each row: the makers of ``old`` stay, only changed rows are touched."""
    fields = [c for c in new.columns if c != key]
    before = old.select(F.col(key).alias("__k"), F.struct(*fields).alias("__old"), *[F.col(c).alias(f"__{c}") for c in ("created_by", "updated_by", "updated_at")])
    both = new.join(before, F.col(key) == F.col("__k"), "left")
    same = F.col("__old").isNotNull() & F.struct(*fields).eqNullSafe(F.col("__old"))
    me, at = F.lit(actor), F.lit(now).cast("timestamp")
    return both.select(*new.columns, F.when(F.col("__k").isNull(), me).otherwise(F.col("__created_by")).alias("created_by"), F.when(same, F.col("__updated_by")).otherwise(me).alias("updated_by"), F.when(same, F.col("__updated_at")).otherwise(at).alias("updated_at"))


def without_evidence(decisions: DataFrame, now: str, days: int, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """References of pictures older than ``days``, and the decisions without them: the references go first, then the files."""
    old = F.col("snapshot_ref").isNotNull() & (F.col("observed_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    gone = decisions.where(old).select("id", "snapshot_ref")
    return gone, decisions.withColumn("snapshot_ref", F.when(~F.coalesce(old, F.lit(False)), F.col("snapshot_ref")))


def zone_changes(zones: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New or renamed zones (camera_id, zone_id, zone_name, zone_type, points) that are allowed, and the others with why.

    Names are trimmed and unique on a camera whatever their case; types are known ones,
    GENERAL if none is given; an outline has three points at least.
    """
    tidy = wanted.withColumn("zone_name", F.trim("zone_name")).withColumn("zone_type", F.upper(F.coalesce(F.nullif(F.trim("zone_type"), F.lit("")), F.lit("GENERAL"))))
    taken = zones.select("camera_id", F.lower("zone_name").alias("__name"), F.col("zone_id").alias("__other"))
    first = F.row_number().over(Window.partitionBy("camera_id", F.lower("zone_name")).orderBy("zone_id")) > 1
    clash = tidy.alias("w").join(taken, (F.col("w.camera_id") == taken["camera_id"]) & (F.lower("zone_name") == F.col("__name")) & (F.col("zone_id") != F.col("__other"))).select("w.camera_id", "zone_id").distinct().withColumn("__taken", F.lit(True))
    why = (
        F.when(F.coalesce(F.length("zone_name"), F.lit(0)) == 0, "name missing").when(F.length("zone_name") > 80, "name too long").when(~F.col("zone_type").isin(*ZONE_TYPES), "unknown type")
        .when(F.coalesce(F.size("points"), F.lit(0)) < 3, "too few points").when(F.col("__taken") | F.col("__twice"), "name taken")
    )
    checked = tidy.withColumn("__twice", first).join(clash, ["camera_id", "zone_id"], "left").withColumn("why", why)
    return checked.where("why IS NULL").drop("why", "__taken", "__twice"), checked.where("why IS NOT NULL").select("camera_id", "zone_id", "why")


def created(orgs: DataFrame, asked: DataFrame, now: str) -> dict[str, DataFrame]:
    """What founding organisations appends (org_id, name, owner): the organisation with its slug, a site, its administrator and an audit row."""
    at = F.lit(now).cast("timestamp")
    new = asked.join(orgs.select("org_id"), "org_id", "left_anti")
    every = orgs.select("org_id", "name", F.lit(0).alias("__new"), F.lit(None).cast("string").alias("owner")).unionByName(new.select("org_id", "name", F.lit(1).alias("__new"), "owner"))
    slugs = unique_slugs(every.withColumn("__order", F.struct("__new", "org_id")), "name", "__order").where("__new = 1")
    return {
        "organisations": slugs.select("org_id", "name", "slug", at.alias("created_at")),
        "sites": slugs.select("org_id", F.lit("Main site").alias("site_name")),
        "members": slugs.select("org_id", F.col("owner").alias("user_id"), F.lit("ORG_ADMIN").alias("role")),
        "audit": slugs.select("org_id", F.col("owner").alias("actor"), F.lit("organisation.created").alias("action"), at.alias("at")),
    }


#: What platform staff may see of an organisation's tables: counts and names, never footage or people.
PLATFORM_COLUMNS = {"organisations": ("org_id", "name", "plan", "created_on", "suspended", "deleted"), "cameras": ("camera_id", "org_id", "status"), "zones": ("zone_id", "camera_id", "zone_type")}


def platform_view(rows: DataFrame, table: str) -> DataFrame:
    return rows.select(*[c for c in PLATFORM_COLUMNS[table] if c in rows.columns])
