"""Work that must be done once and in order: purging what belongs to deleted organisations, reports that are due.

Tables under ``Log`` are folders of Parquet named by a numbered log. A pass reads the log up to
its last number, prepares its rows in a folder of its own, and takes the next number by
creating that file, which only one of several runners can. A runner that comes second reads
what the first one did and prepares its pass anew, so that no job is taken twice and none is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --------------------------------------------------------------------------- purging in order
#: child -> (parent, the child's column, the parent's column)
Links = dict[str, tuple[str, str, str]]


def purge_order(links: Links, top: str) -> list[str]:
    """Tables so that each comes before what it refers to; the top one last."""
    return list(reversed(list(TopologicalSorter({c: {p} for c, (p, _, _) in links.items()} | {top: set()}).static_order())))


def purge(tables: dict[str, DataFrame], links: Links, top: str, gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What goes with the rows ``gone`` (a column ``key``) of table ``top``: (step, table, purged, kept) and what is left of every table.

    A row goes with the row it refers to, over any number of tables; one that refers to
    nothing, or to null, stays. Counts are taken before anything is removed, in the order in
    which the tables may be cut.
    """
    order, left, marked = purge_order(links, top), {}, {}
    for name in reversed(order):
        df = tables[name]
        if name == top:
            ids, column = gone.select(F.col(key).alias("__gone")).distinct(), key
        else:
            parent, column, of = links[name]
            ids = marked[parent].where("__goes").select(F.col(of).alias("__gone")).distinct()
        both = df.join(ids.withColumn("__goes", F.lit(True)), df[column] == F.col("__gone"), "left").drop("__gone")
        marked[name] = both.withColumn("__goes", F.coalesce("__goes", F.lit(False)))
        left[name] = marked[name].where("NOT __goes").drop("__goes")
    parts = [marked[n].agg(F.lit(i + 1).alias("step"), F.lit(n).alias("table"), F.count_if("__goes").alias("purged"), F.count_if(~F.col("__goes")).alias("kept")) for i, n in enumerate(order)]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return counts, left


def purge_audit(gone: DataFrame, key: str, name: str) -> DataFrame:
    """One row for the audit trail: how many organisations went, their ids and names in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.col(name).alias("name"))))
    return gone.agg(F.count("*").alias("purged"), F.transform(rows, lambda r: r["id"]).alias("ids"), F.transform(rows, lambda r: r["name"]).alias("names"))


# --------------------------------------------------------------------------- a log that runners share
class Log:
    """A table of numbered commits; a number is taken by one runner."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("_log").getFileSystem(self.conf)
        self.fs.mkdirs(self._path("_log"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The last number that was taken; 0 at the start."""
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(self._path("_log")) if f.getPath().getName().isdigit()), default=0)

    def read(self, version: int) -> DataFrame:
        """All rows committed up to a number."""
        names = []
        for n in range(1, version + 1):
            told = self.fs.open(self._path(f"_log/{n:012d}"))
            names.append(told.readUTF())
            told.close()
        paths = [f"{self.root}/{x}" for x in names]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, version: int) -> bool:
        """Writes ``rows`` and takes the number ``version``; False if another runner has it."""
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        # the name is written aside first, so that a number never points to nothing
        draft = self._path(f"_log/{name}.draft")
        out = self.fs.create(draft, True)
        out.writeUTF(name)
        out.close()
        try:
            lock = self.fs.create(self._path(f"_log/{version:012d}.lock"), False)  # one runner's; the others fail
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        lock.close()
        return bool(self.fs.rename(draft, self._path(f"_log/{version:012d}")))


# --------------------------------------------------------------------------- reports that are due
MADE = "org_id long, since timestamp, until timestamp, made boolean, title string, next_at timestamp"
STEPS = {"WEEKLY": "INTERVAL 7 DAYS", "MONTHLY": "INTERVAL 1 MONTH"}


def _stepped(at: Column, schedule: Column, back: bool = False) -> Column:
    return F.coalesce(*[F.when(schedule == s, at - F.expr(i) if back else at + F.expr(i)) for s, i in STEPS.items()])


def due_reports(schedules: DataFrame, now: str) -> DataFrame:
    """The reports that are due: ``MADE`` rows, one an organisation, whatever number of runs it missed.

    ``schedules``: org_id, schedule (WEEKLY, MONTHLY, else none), next_at, plan (the one in
    effect), deleted. The range is the step before the time it was due. A free plan gets no
    report (made is false), but its next time moves on too. That time is the first step after
    ``now``, counted month by month, as days are cut at a short month's end.
    """
    moment = F.lit(now).cast("timestamp")
    due = schedules.where(~F.col("deleted") & F.col("schedule").isin(*STEPS) & (F.col("next_at") <= moment))
    most = F.ceil(F.greatest(F.datediff(moment, "next_at"), F.lit(0)) / F.when(F.col("schedule") == "WEEKLY", 7).otherwise(28)) + 2
    later = F.aggregate(F.sequence(F.lit(1), most.cast("int")), _stepped(F.col("next_at"), F.col("schedule")), lambda t, _: F.when(t <= moment, _stepped(t, F.col("schedule"))).otherwise(t))
    since = _stepped(F.col("next_at"), F.col("schedule"), back=True)
    title = F.concat(F.lit("Scheduled "), F.lower("schedule"), F.lit(" safety report, "), F.date_format(since, "d MMM"), F.lit(" to "), F.date_format("next_at", "d MMM yyyy"))
    return due.select("org_id", since.alias("since"), F.col("next_at").alias("until"), (F.col("plan") != "FREE").alias("made"), title.alias("title"), later.alias("next_at"))


def current(schedules: DataFrame, done: DataFrame) -> DataFrame:
    """``schedules`` with the next time that the passes so far have set."""
    last = done.groupBy("org_id").agg(F.max("next_at").alias("__next"))
    return schedules.join(last, "org_id", "left").withColumn("next_at", F.greatest("next_at", "__next")).drop("__next")


def run_due(spark: SparkSession, schedules: DataFrame, root: str, now: str, before_commit: Callable[[], None] | None = None, tries: int = 20) -> DataFrame:
    """Takes what is due by ``now`` and is not taken yet; the rows this runner took. Any number of runners may do so at once."""
    log = Log(spark, root, MADE)
    for _ in range(tries):
        version = log.version()
        mine = due_reports(current(schedules, log.read(version)), now)
        if mine.isEmpty():
            return mine
        if before_commit:
            before_commit()
        if log.commit(mine, version + 1):
            told = log.read(version + 1)
            return told.join(log.read(version).select("org_id", "until"), ["org_id", "until"], "left_anti")
    raise TimeoutError("other runners were faster every time")
