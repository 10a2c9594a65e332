"""The domain's tables as views of the driver's tables, for Spark and as SQL for the oracle.

telemetry and safety events come from ``events``, decisions from ``orders``, corrective
actions from ``lineitem``, zones from ``nation``, cameras from ``region``, organisations from
``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ZONE_TYPE = ("RESTRICTED", "PPE_CHECKPOINT", "APPROACH", "EXIT", "GENERAL")
POSTURE = ("SITTING", "STANDING", "WALKING", "AWAY")
RULE = ("PPE_ENTRY", "PPE_CONTINUOUS", "MAX_DWELL", "REQUIRED_EXIT", "MAN_DOWN", "OCCUPANCY")
EVENT = ("ENTERED_ZONE", "EXITED_ZONE", "LOST_IN_ZONE", "REAPPEARED", "DWELL_EXCEEDED")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(prefix: str, value):
    return F.concat(F.lit(prefix), value.cast("string"))


def one_of(names: tuple[str, ...], index):
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample of a tracked person: time, place, posture, activity and floor position."""
    u, e = F.col("user_id"), F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), numbered("org-", u % 2).alias("org_id"), numbered("cam-", u % 3).alias("camera_id"), F.col("event_type").alias("zone_id"),
        u.alias("track_id"), one_of(POSTURE, e % 4).alias("posture_state"), F.least("value", F.lit(100.0)).alias("activity_score"),
        ((e * 37) % 1000 / 1000).alias("floor_x"), ((e * 61) % 1000 / 1000).alias("floor_y"), e.alias("sample_id"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").where(n < 22).select(numbered("zone-", n).alias("zone_id"), F.col("n_name").alias("zone_name"), numbered("cam-", F.col("n_regionkey")).alias("camera_id"), one_of(ZONE_TYPE, n % 5).alias("zone_type"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(numbered("cam-", F.col("r_regionkey")).alias("camera_id"), F.col("r_name").alias("camera_name"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged situations: rule, outcome, review and the evidence as JSON."""
    k, c, p, s = F.col("o_orderkey"), F.col("o_custkey"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    review = (
        F.when(s == "O", "NOT_REQUIRED")
        .when(s == "F", F.when(p.isin("1", "2"), "CONFIRMED").when(p == "3", "DISMISSED").otherwise("PENDING"))
        .otherwise(F.when(p == "1", "CONFIRMED").when(p == "2", "DISMISSED").otherwise("NOT_REQUIRED"))
    )
    helmet, vest = one_of(("ABSENT", "PRESENT", "UNVERIFIABLE"), k % 3), one_of(("PRESENT", "ABSENT"), c % 2)
    outcome = one_of(("LONE_WORKER", "OVER_CAPACITY", "EMPTY_ZONE", "CROWDED"), k % 4)
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), numbered("org-", c % 2).alias("org_id"), numbered("cam-", c % 6).alias("camera_id"), F.when(c % 10 != 0, numbered("zone-", c % 25)).alias("zone_id"),
        numbered("rule-", k % 9).alias("rule_id"), one_of(RULE, k % 6).alias("rule_type"), one_of(("INFO", "WARNING", "CRITICAL"), k % 3).alias("severity"),
        numbered("trk-", c % 50).alias("worker_key"),
        F.when(s == "O", "COMPLIANT").when(s == "F", "POTENTIAL_VIOLATION").otherwise("UNVERIFIABLE").alias("status"),
        F.when(s == "P", 0.0).otherwise((50 + k % 50) / 100).alias("confidence"),
        review.alias("review_state"),
        F.when(review == "CONFIRMED", "CORRECT").when((review == "DISMISSED") & (k % 3 < 2), one_of(("PPE_PRESENT", "OTHER"), k % 3)).alias("review_reason"),
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"), mins=(k % 60).cast("int"))).alias("observed_at"),
        F.format_string('{"outcome":"%s","items":{"helmet":{"state":"%s"},"safety_vest":{"state":"%s"}}}', outcome, helmet, vest).alias("evidence"),
        F.when(k % 4 == 0, F.concat(numbered("org-", c % 2), F.lit("/"), k.cast("string"), F.lit(".jpg"))).alias("snapshot_ref"),
        (F.col("o_totalprice") / 1000).alias("video_time_s"),
    )


def safety_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone events with their details as JSON."""
    u, e = F.col("user_id"), F.col("event_id")
    details = F.format_string(
        '{"reason":"%s","dwell_s":%s,"first_sighting":%s,"visit_started_in_replay":%s}',
        F.when(e % 3 != 0, "LEFT").otherwise("LOST"), F.col("value").cast("decimal(18,2)").cast("string"), (e % 7 == 0).cast("string"), (e % 11 == 0).cast("string"),
    )
    return read(spark, sf_dir, "events").select(
        e.alias("id"), numbered("org-", u % 2).alias("org_id"), numbered("cam-", u % 6).alias("camera_id"), numbered("zone-", u % 25).alias("zone_id"), numbered("trk-", u).alias("worker_key"),
        one_of(EVENT, e % 5).alias("event_type"), details.alias("details"), F.col("ts").cast("timestamp").alias("observed_at"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrective actions of decisions."""
    created, flag = F.to_date("l_shipdate"), F.col("l_returnflag")
    status = F.when(flag == "A", "OPEN").when(flag == "N", "IN_PROGRESS").when(F.col("l_linestatus") == "F", "CLOSED").otherwise("CANCELLED")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("decision_id"), F.col("l_linenumber").alias("action_no"), numbered("org-", F.col("l_suppkey") % 2).alias("org_id"), status.alias("status"),
        created.alias("created_on"), F.date_add(created, 30).alias("due_on"), F.when(status == "CLOSED", F.date_add(created, F.col("l_quantity").cast("int"))).alias("closed_on"),
    )


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenants with a plan."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("org_id"), F.col("c_name").alias("name"), one_of(("FREE", "GROWTH", "ENTERPRISE"), k % 3).alias("plan"), F.col("c_acctbal").alias("balance"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")).alias("created_on"), (k % 13 == 0).alias("suspended"), (k % 17 == 0).alias("deleted"),
        (k % 5).alias("cameras"), (k % 4).alias("sites"), (k % 7).alias("seats"), (k % 7).alias("members"), (k % 3).alias("zones"), F.when(k % 11 == 0, k % 3 + 1).otherwise(0).alias("cameras_in_error"), F.when(k % 6 == 5, k % 4).otherwise(0).alias("failed_sessions"), (k % 2).alias("running_sessions"), F.when(k % 3 != 0, F.date_add(F.lit("2024-02-01").cast("date"), (k % 60).cast("int"))).alias("term_ends_on"),
    )


def _pick(names: tuple[str, ...], index: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({index} + 1 AS BIGINT))"


#: The same views in the oracle's SQL, in an order in which each may use those before it.
VIEWS = {
    "telemetry": f"""SELECT ts, 'org-' || (user_id % 2) AS org_id, 'cam-' || (user_id % 3) AS camera_id, event_type AS zone_id, user_id AS track_id,
    {_pick(POSTURE, 'event_id % 4')} AS posture_state, least(value, 100.0) AS activity_score,
    ((event_id * 37) % 1000) / 1000 AS floor_x, ((event_id * 61) % 1000) / 1000 AS floor_y, event_id AS sample_id FROM events""",
    "zones": f"SELECT 'zone-' || n_nationkey AS zone_id, n_name AS zone_name, 'cam-' || n_regionkey AS camera_id, {_pick(ZONE_TYPE, 'n_nationkey % 5')} AS zone_type FROM nation WHERE n_nationkey < 22",
    "cameras": "SELECT 'cam-' || r_regionkey AS camera_id, r_name AS camera_name FROM region",
    "decisions0": f"""SELECT o_orderkey AS id, 'org-' || (o_custkey % 2) AS org_id, 'cam-' || (o_custkey % 6) AS camera_id,
    CASE WHEN o_custkey % 10 <> 0 THEN 'zone-' || (o_custkey % 25) END AS zone_id, 'rule-' || (o_orderkey % 9) AS rule_id, {_pick(RULE, 'o_orderkey % 6')} AS rule_type,
    {_pick(('INFO', 'WARNING', 'CRITICAL'), 'o_orderkey % 3')} AS severity, 'trk-' || (o_custkey % 50) AS worker_key,
    CASE o_orderstatus WHEN 'O' THEN 'COMPLIANT' WHEN 'F' THEN 'POTENTIAL_VIOLATION' ELSE 'UNVERIFIABLE' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE (50 + o_orderkey % 50) / 100 END AS confidence,
    CASE WHEN o_orderstatus = 'O' THEN 'NOT_REQUIRED'
      WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'CONFIRMED' WHEN o_orderpriority[1] = '3' THEN 'DISMISSED' ELSE 'PENDING' END
      ELSE CASE o_orderpriority[1] WHEN '1' THEN 'CONFIRMED' WHEN '2' THEN 'DISMISSED' ELSE 'NOT_REQUIRED' END END AS review_state,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS observed_at,
    {_pick(('LONE_WORKER', 'OVER_CAPACITY', 'EMPTY_ZONE', 'CROWDED'), 'o_orderkey % 4')} AS outcome,
    {_pick(('ABSENT', 'PRESENT', 'UNVERIFIABLE'), 'o_orderkey % 3')} AS helmet, {_pick(('PRESENT', 'ABSENT'), 'o_custkey % 2')} AS vest,
    CASE WHEN o_orderkey % 4 = 0 THEN 'org-' || (o_custkey % 2) || '/' || o_orderkey || '.jpg' END AS snapshot_ref, o_totalprice / 1000 AS video_time_s FROM orders""",
    "decisions": f"""SELECT *, CASE WHEN review_state = 'CONFIRMED' THEN 'CORRECT' WHEN review_state = 'DISMISSED' AND id % 3 < 2 THEN {_pick(('PPE_PRESENT', 'OTHER'), 'id % 3')} END AS review_reason FROM decisions0""",
    "safety_events": f"""SELECT event_id AS id, 'org-' || (user_id % 2) AS org_id, 'cam-' || (user_id % 6) AS camera_id, 'zone-' || (user_id % 25) AS zone_id, 'trk-' || user_id AS worker_key,
    {_pick(EVENT, 'event_id % 5')} AS event_type, CASE WHEN event_id % 3 <> 0 THEN 'LEFT' ELSE 'LOST' END AS reason, CAST(value AS DECIMAL(18,2)) AS dwell_s,
    event_id % 7 = 0 AS first_sighting, event_id % 11 = 0 AS in_replay, ts AS observed_at FROM events""",
    "actions": """SELECT l_orderkey AS decision_id, l_linenumber AS action_no, 'org-' || (l_suppkey % 2) AS org_id,
    CASE WHEN l_returnflag = 'A' THEN 'OPEN' WHEN l_returnflag = 'N' THEN 'IN_PROGRESS' WHEN l_linestatus = 'F' THEN 'CLOSED' ELSE 'CANCELLED' END AS status,
    CAST(l_shipdate AS DATE) AS created_on, CAST(l_shipdate AS DATE) + 30 AS due_on,
    CASE WHEN l_returnflag NOT IN ('A', 'N') AND l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS closed_on FROM lineitem""",
    "organisations": f"""SELECT c_custkey AS org_id, c_name AS name, {_pick(('FREE', 'GROWTH', 'ENTERPRISE'), 'c_custkey % 3')} AS plan, c_acctbal AS balance,
    DATE '2024-01-01' + CAST(c_custkey % 90 AS INTEGER) AS created_on, c_custkey % 13 = 0 AS suspended, c_custkey % 17 = 0 AS deleted, c_custkey % 5 AS cameras, c_custkey % 4 AS sites, c_custkey % 7 AS seats, c_custkey % 7 AS members, c_custkey % 3 AS zones, CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 3 + 1 ELSE 0 END AS cameras_in_error, CASE WHEN c_custkey % 6 = 5 THEN c_custkey % 4 ELSE 0 END AS failed_sessions, c_custkey % 2 AS running_sessions,
    CASE WHEN c_custkey % 3 <> 0 THEN DATE '2024-02-01' + CAST(c_custkey % 60 AS INTEGER) END AS term_ends_on FROM customer""",
}


def sql(body: str, *views: str) -> str:
    """``body`` behind the named views (decisions bring what they rest on)."""
    names = [n for n in VIEWS if n in views or (n == "decisions0" and "decisions" in views)]
    head = ",\n".join(f"{n} AS (\n{VIEWS[n]})" for n in names)
    return f"WITH {head}{',' if body.lstrip().upper().startswith('WITH ') else ''}\n{body.lstrip()[5:] if body.lstrip().upper().startswith('WITH ') else body}"
