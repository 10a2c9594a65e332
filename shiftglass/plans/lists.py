"""Lists, audit trail, tenancy, replication and retention on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records, upkeep
from ..sources import domain
from ..sources.domain import sql
from ..streaming import sync

NOW = "1998-06-01 00:00:00"


def rules(s, p):
    """One rule per part: zone, type and whether it is on."""
    k = F.col("p_partkey")
    return domain.read(s, p, "part").where(k < 40).select(domain.numbered("rule-", k % 7).alias("rule_id"), domain.numbered("zone-", k % 12).alias("zone_id"), domain.one_of(domain.RULE, k % 6).alias("type"), (k % 3 != 0).alias("enabled"))


RULES = f"rules AS (SELECT 'rule-' || (p_partkey % 7) AS rule_id, 'zone-' || (p_partkey % 12) AS zone_id, {domain._pick(domain.RULE, 'p_partkey % 6')} AS type, p_partkey % 3 <> 0 AS enabled FROM part WHERE p_partkey < 40)"


def callers(s, p):
    return domain.organisations(s, p).where("org_id = 1").select(domain.numbered("org-", F.col("org_id")).alias("org_id"))


D, E, Z, C, A = domain.decisions, domain.safety_events, domain.zones, domain.cameras, domain.actions
SOME = ("id", "org_id", "status", "observed_at")


def _trail(s, p):
    window = lambda d, a, b: records.between(d, a, b)
    return records.audit_trail(window(D(s, p), "1998-01-01", "1998-04-01"), window(E(s, p), "2024-01-05", "2024-01-12"), Z(s, p), C(s, p))


def _purged(s, p):
    """Local decisions, two of three synced within forty days: how many stay and go, by organisation."""
    synced = F.when(F.col("id") % 3 > 0, F.col("observed_at") + F.make_interval(days=(F.col("id") % 40).cast("int")))
    stays, goes = sync.purged(D(s, p).select("id", "org_id", F.col("observed_at").alias("created_at"), synced.alias("synced_at")), NOW, 7, 900)
    both = stays.withColumn("goes", F.lit(False)).unionByName(goes.withColumn("goes", F.lit(True)))
    return both.groupBy("org_id", "goes").agg(F.count("*").alias("n"), F.min("created_at").alias("first"))


def _purge_counts(s, p):
    """Sessions (orders) of deleted customers and the findings (line items) of these, in the order in which they go."""
    orgs = domain.organisations(s, p)
    tables = {
        "organisations": orgs, "sessions": domain.read(s, p, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("org_id")),
        "findings": domain.read(s, p, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("n")),
    }
    links = {"findings": ("sessions", "session_id", "session_id"), "sessions": ("organisations", "org_id", "org_id")}
    counts, _ = upkeep.purge(tables, links, "organisations", orgs.where("deleted"), "org_id")
    return counts


def _due(s, p):
    """Customers' weekly and monthly reports that are due on a day, also of those that missed some."""
    k = F.col("org_id")
    rows = domain.organisations(s, p).select("org_id", F.when(k % 5 == 0, "OFF").when(k % 5 < 3, "WEEKLY").otherwise("MONTHLY").alias("schedule"), (F.col("created_on").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))).alias("next_at"), "plan", "deleted")
    return upkeep.due_reports(rows, "2024-03-15 12:00:00")


QUERIES = {
    "tenant_filter": lambda s, p: records.tenant(D(s, p), callers(s, p)).groupBy("org_id", "status").agg(F.count("*").alias("n")),
    "tenant_without_deleted": lambda s, p: records.tenant(D(s, p), D(s, p).select("org_id").distinct(), callers(s, p)).select(*SOME),
    "decisions_filtered": lambda s, p: records.where_equal(records.between(D(s, p), "1997-01-01", "1998-01-01"), status="POTENTIAL_VIOLATION", rule_type=["PPE_ENTRY", "MAN_DOWN"], review_state="CONFIRMED").select(*SOME),
    "decisions_page": lambda s, p: records.page(D(s, p), 50, 100).select(*SOME),
    "keyset_page": lambda s, p: records.after(D(s, p), "1996-05-05 05:05:00", 700, 75).select(*SOME),
    "export_newest_n": lambda s, p: records.newest_oldest_first(D(s, p), 500).select("id", "observed_at", records.csv_cell(F.concat(F.lit("="), "worker_key")).alias("worker"), records.csv_cell(F.col("zone_id")).alias("zone")),
    "decision_view": lambda s, p: records.decision_view(D(s, p)).select(*SOME, "has_picture"),
    "decision_payload": lambda s, p: records.decision_payload(D(s, p)),
    "latest_per_worker": lambda s, p: records.latest_by(D(s, p), "worker_key", 20).select(*SOME, "worker_key"),
    "audit_trail": lambda s, p: records.in_order(_trail(s, p)),
    "mapped_rows": lambda s, p: records.mapped(D(s, p), C(s, p), Z(s, p))[0].select(*SOME),
    "unmapped_pairs": lambda s, p: records.mapped(D(s, p), C(s, p), Z(s, p))[1],
    "top_unmapped_pairs": lambda s, p: records.mapped(D(s, p), C(s, p), Z(s, p))[1].orderBy(F.desc("n"), "camera_id", F.asc_nulls_last("zone_id")).limit(6),
    "known_rules": lambda s, p: records.with_known_rules(D(s, p), rules(s, p).dropDuplicates(["rule_id"])).groupBy("rule_id").agg(F.count("*").alias("n")),
    "idempotent_append": lambda s, p: records.not_there(D(s, p).unionByName(D(s, p)), D(s, p).where("id % 3 = 0")).select(*SOME),
    "uncovered_defaults": lambda s, p: records.uncovered_defaults(Z(s, p), rules(s, p)),
    "session_rules": lambda s, p: records.session_rules(Z(s, p), rules(s, p)),
    "retention_survivors": lambda s, p: records.keep_decisions(D(s, p), A(s, p), NOW, 90).select(*SOME),
    "retention_purge_counts": lambda s, p: records.purge_counts(D(s, p), A(s, p), NOW, 90),
    "purged_local": _purged,
    "org_purge_counts": _purge_counts,
    "org_purge_audit": lambda s, p: upkeep.purge_audit(domain.organisations(s, p).where("deleted"), "org_id", "name"),
    "due_reports": _due,
    "retention_preview": lambda s, p: D(s, p).where(F.col("observed_at") < F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(365))).agg(F.count("*").alias("older")),
    "status_tally": lambda s, p: D(s, p).groupBy("status").agg(F.count("*").alias("n")),
    "review_queue": lambda s, p: records.page(records.where_equal(D(s, p), review_state="PENDING"), 25, 0).select(*SOME),
    "unsynced_counts": lambda s, p: D(s, p).agg(F.count_if(F.col("snapshot_ref").isNull()).alias("decisions")).crossJoin(E(s, p).agg(F.count_if(F.expr("id % 4 = 0")).alias("events"))),
    "uuid_shaped": lambda s, p: D(s, p).select("id", F.md5(F.col("id").cast("string")).alias("h")).withColumn("u", F.when(F.col("id") % 2 == 0, F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])).otherwise(F.col("h"))).where(F.col("u").rlike(records.UUID_SHAPE)).select("id", "u"),
    "colleagues": lambda s, p: D(s, p).select("worker_key", "zone_id").distinct().join(D(s, p).where("id % 100 = 1").select("zone_id").distinct(), "zone_id", "left_semi").groupBy("worker_key").agg(F.count("*").alias("zones")),
}

KEEP = f"""keep AS (SELECT d.* FROM decisions d WHERE NOT (observed_at < TIMESTAMP '{NOW}' - INTERVAL 180 DAY AND review_state <> 'PENDING'
 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.decision_id = d.id AND a.status IN ('OPEN', 'IN_PROGRESS'))))"""
OK = """m AS (SELECT d.*, c.camera_id IS NOT NULL AND (d.zone_id IS NULL OR z.zone_id IS NOT NULL) AS ok FROM decisions d LEFT JOIN cameras c USING (camera_id) LEFT JOIN zones z ON d.zone_id = z.zone_id)"""
S = ", ".join(SOME)
TITLE = "array_to_string(list_transform(string_split(lower({c}), '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
UNCOVERED = "u AS (SELECT z.* FROM zones z WHERE zone_type = 'RESTRICTED' AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.type = 'PPE_ENTRY' AND r.zone_id = z.zone_id))"
DEFAULTS = f"SELECT 'default:PPE_ENTRY:' || zone_id || ':' || left(sha1('{records.ENTRY_DEFAULT}'), 8) AS rule_key, zone_id, 'PPE_ENTRY' AS type, 'default' AS source FROM u"
MAN_DOWN = f"SELECT 'default:MAN_DOWN:None:' || left(sha1('{records.MAN_DOWN_DEFAULT}'), 8), NULL, 'MAN_DOWN', 'default' WHERE NOT EXISTS (SELECT 1 FROM rules WHERE type = 'MAN_DOWN')"
NAMES = "coalesce(camera_name, '') AS camera, coalesce(zone_name, '') AS zone, 'Worker ' || replace(worker_key, 'trk-', '') AS worker"

ORACLE_SQL = {
    "tenant_filter": sql("SELECT org_id, status, count(*) AS n FROM decisions WHERE org_id = 'org-1' GROUP BY ALL", "decisions"),
    "tenant_without_deleted": sql(f"SELECT {S} FROM decisions WHERE org_id <> 'org-1'", "decisions"),
    "decisions_filtered": sql(f"SELECT {S} FROM decisions WHERE observed_at >= DATE '1997-01-01' AND observed_at < DATE '1998-01-01' AND status = 'POTENTIAL_VIOLATION' AND rule_type IN ('PPE_ENTRY', 'MAN_DOWN') AND review_state = 'CONFIRMED'", "decisions"),
    "decisions_page": sql(f"SELECT {S} FROM decisions ORDER BY observed_at DESC, id DESC LIMIT 50 OFFSET 100", "decisions"),
    "keyset_page": sql(f"SELECT {S} FROM decisions WHERE (observed_at, id) > (TIMESTAMP '1996-05-05 05:05:00', 700) ORDER BY observed_at, id LIMIT 75", "decisions"),
    "export_newest_n": sql("SELECT id, observed_at, '''=' || worker_key AS worker, coalesce(zone_id, '') AS zone FROM decisions ORDER BY observed_at DESC, id DESC LIMIT 500", "decisions"),
    "decision_view": sql(f"SELECT {S}, snapshot_ref IS NOT NULL AS has_picture FROM decisions", "decisions"),
    "decision_payload": sql("SELECT id, org_id, worker_key, rule_type, status, observed_at, CASE WHEN status = 'POTENTIAL_VIOLATION' THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS review_state, CASE WHEN status = 'UNVERIFIABLE' THEN 0.0 ELSE confidence END AS confidence FROM decisions", "decisions"),
    "latest_per_worker": sql(f"SELECT {S}, worker_key FROM decisions QUALIFY row_number() OVER (PARTITION BY worker_key ORDER BY observed_at DESC, id DESC) = 1 ORDER BY observed_at DESC, id DESC LIMIT 20", "decisions"),
    "audit_trail": sql(
        f"""SELECT observed_at AS at, {NAMES}, 'Event' AS record, id, {TITLE.format(c="event_type")} AS what, '' AS result, '' AS severity, '' AS review FROM safety_events LEFT JOIN cameras USING (camera_id) LEFT JOIN zones USING (zone_id) WHERE observed_at >= DATE '2024-01-05' AND observed_at < DATE '2024-01-12'
UNION ALL SELECT observed_at, {NAMES}, 'Decision', id, {TITLE.format(c="rule_type")}, CASE status WHEN 'COMPLIANT' THEN 'Compliant' WHEN 'POTENTIAL_VIOLATION' THEN 'Potential violation' ELSE 'Could not verify' END, {TITLE.format(c="severity")}, {TITLE.format(c="review_state")}
FROM decisions LEFT JOIN cameras USING (camera_id) LEFT JOIN zones USING (zone_id) WHERE observed_at >= DATE '1998-01-01' AND observed_at < DATE '1998-04-01'""".replace("LEFT JOIN zones USING (zone_id)", "LEFT JOIN (SELECT zone_id, zone_name FROM zones) USING (zone_id)"),
        "decisions", "safety_events", "zones", "cameras",
    ),
    "mapped_rows": sql(f"WITH {OK} SELECT {S} FROM m WHERE ok", "decisions", "zones", "cameras"),
    "unmapped_pairs": sql(f"WITH {OK} SELECT camera_id, zone_id, count(*) AS n FROM m WHERE NOT ok GROUP BY ALL", "decisions", "zones", "cameras"),
    "top_unmapped_pairs": sql(f"WITH {OK} SELECT camera_id, zone_id, count(*) AS n FROM m WHERE NOT ok GROUP BY ALL ORDER BY n DESC, camera_id, zone_id NULLS LAST LIMIT 6", "decisions", "zones", "cameras"),
    "known_rules": sql(f"WITH {RULES} SELECT CASE WHEN rule_id IN (SELECT rule_id FROM rules) THEN rule_id END AS rule_id, count(*) AS n FROM decisions GROUP BY 1", "decisions"),
    "idempotent_append": sql(f"SELECT {S} FROM decisions WHERE id % 3 <> 0", "decisions"),
    "uncovered_defaults": sql(f"WITH {RULES}, {UNCOVERED} {DEFAULTS}", "zones"),
    "session_rules": sql(f"WITH {RULES}, {UNCOVERED} SELECT rule_id AS rule_key, zone_id, type, 'rule' AS source FROM rules WHERE enabled UNION ALL {DEFAULTS} UNION ALL {MAN_DOWN}", "zones"),
    "retention_survivors": sql(f"WITH {KEEP} SELECT {S} FROM keep", "decisions", "actions"),
    "retention_purge_counts": sql(f"WITH {KEEP} SELECT org_id, count(*) AS purged FROM decisions WHERE id NOT IN (SELECT id FROM keep) GROUP BY 1", "decisions", "actions"),
    "org_purge_counts": sql("""WITH s AS (SELECT o_orderkey, deleted FROM orders LEFT JOIN organisations ON org_id = o_custkey), f AS (SELECT coalesce(deleted, false) AS deleted FROM lineitem LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT 1 AS step, 'findings' AS "table", count(*) FILTER (deleted) AS purged, count(*) FILTER (NOT deleted) AS kept FROM f UNION ALL SELECT 2, 'sessions', count(*) FILTER (coalesce(deleted, false)), count(*) FILTER (NOT coalesce(deleted, false)) FROM s
UNION ALL SELECT 3, 'organisations', count(*) FILTER (deleted), count(*) FILTER (NOT deleted) FROM organisations""", "organisations"),
    "org_purge_audit": sql("SELECT count(*) AS purged, list(org_id ORDER BY org_id, name) AS ids, list(name ORDER BY org_id, name) AS names FROM organisations WHERE deleted", "organisations"),
    "due_reports": f"""WITH RECURSIVE organisations AS ({domain.VIEWS["organisations"]}), d AS (SELECT org_id, plan, CASE WHEN org_id % 5 < 3 THEN 'WEEKLY' ELSE 'MONTHLY' END AS schedule, CAST(created_on AS TIMESTAMP) + to_hours(org_id % 24) AS due FROM organisations WHERE NOT deleted AND org_id % 5 > 0 AND CAST(created_on AS TIMESTAMP) + to_hours(org_id % 24) <= TIMESTAMP '2024-03-15 12:00:00'),
t AS (SELECT org_id, schedule, CASE WHEN schedule = 'WEEKLY' THEN due + INTERVAL 7 DAY ELSE due + INTERVAL 1 MONTH END AS due FROM d UNION ALL SELECT org_id, schedule, CASE WHEN schedule = 'WEEKLY' THEN due + INTERVAL 7 DAY ELSE due + INTERVAL 1 MONTH END FROM t WHERE due <= TIMESTAMP '2024-03-15 12:00:00'),
n AS (SELECT org_id, max(due) AS next_at FROM t GROUP BY org_id), b AS (SELECT *, CASE WHEN schedule = 'WEEKLY' THEN due - INTERVAL 7 DAY ELSE due - INTERVAL 1 MONTH END AS since FROM d)
SELECT b.org_id, since, due AS until, plan <> 'FREE' AS made, 'Scheduled ' || lower(schedule) || ' safety report, ' || strftime(since, '%-d %b') || ' to ' || strftime(due, '%-d %b %Y') AS title, next_at FROM b JOIN n USING (org_id)""",
    "purged_local": sql(f"""SELECT org_id, goes, count(*) AS n, min(created_at) AS first FROM (
SELECT org_id, observed_at AS created_at, coalesce(synced_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY OR (synced_at IS NULL AND observed_at < TIMESTAMP '{NOW}' - INTERVAL 900 DAY), false) AS goes
FROM (SELECT *, CASE WHEN id % 3 > 0 THEN observed_at + to_days(CAST(id % 40 AS INTEGER)) END AS synced_at FROM decisions)) GROUP BY ALL""", "decisions"),
    "retention_preview": sql(f"SELECT count(*) AS older FROM decisions WHERE observed_at < TIMESTAMP '{NOW}' - INTERVAL 365 DAY", "decisions"),
    "status_tally": sql("SELECT status, count(*) AS n FROM decisions GROUP BY 1", "decisions"),
    "review_queue": sql(f"SELECT {S} FROM decisions WHERE review_state = 'PENDING' ORDER BY observed_at DESC, id DESC LIMIT 25", "decisions"),
    "unsynced_counts": sql("SELECT (SELECT count(*) FROM decisions WHERE snapshot_ref IS NULL) AS decisions, (SELECT count(*) FROM safety_events WHERE id % 4 = 0) AS events", "decisions", "safety_events"),
    "uuid_shaped": sql("WITH h AS (SELECT id, md5(CAST(id AS VARCHAR)) AS h FROM decisions) SELECT id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS u FROM h WHERE id % 2 = 0", "decisions"),
    "colleagues": sql("SELECT worker_key, count(DISTINCT zone_id) AS zones FROM decisions WHERE zone_id IN (SELECT zone_id FROM decisions WHERE id % 100 = 1 AND zone_id IS NOT NULL) GROUP BY 1", "decisions"),
}
