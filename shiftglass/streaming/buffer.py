"""A buffer before a target that may be down: bounded per table, oldest rows go first, bad rows go aside alone.

What waits is a table in the shared folder, one folder a batch, so that a restart goes on where
it stopped: a batch that is taken again replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.sinks import kept_table
from .sync import halved

#: Rows that may wait, by table; a failed target is left alone for so long, doubled with each failure.
CAPS = {"events": 20_000, "decisions": 5_000}
BACK_OFF_S, BACK_OFF_MOST_S = 2.0, 60.0
STATE = "batch long, table string, dropped long, written long, refused long, failures int, wait_until timestamp"


class Buffer:
    """Rows of one table on their way to ``send``, which raises ``sync.Refused`` for bad rows and anything else if it is down."""

    def __init__(self, spark: SparkSession, table: str, root: str, send: Callable[[DataFrame], None], cap: int | None = None, order: str = "created_at"):
        self.spark, self.table, self.root, self.send = spark, table, f"{root.rstrip('/')}/{table}", send
        self.cap, self.order = CAPS.get(table, 5_000) if cap is None else cap, order

    def _read(self, name: str, schema) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def state(self) -> dict:
        """Counts so far and how long the target is left alone."""
        rows = self._read("state", STATE)
        total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dropped", "written", "refused")], F.max_by("failures", "batch").alias("failures"), F.max_by("wait_until", "batch").alias("wait_until"), F.max("batch").alias("batch")).first()
        return total.asDict()

    def take(self, rows: DataFrame, batch: int, now: str) -> dict:
        """One micro-batch: its rows wait behind those that do already, the oldest over the cap are dropped, the rest is sent."""
        known, moment = self.state(), F.lit(now).cast("timestamp")
        if known["batch"] is not None and batch <= known["batch"]:
            return known  # taken before a restart
        waiting = self._read(f"waiting/{known['batch']}", rows.schema) if known["batch"] is not None else rows.limit(0)
        newest = Window.orderBy(F.desc(self.order), F.desc("id"))
        ranked = kept_table(waiting.unionByName(rows).withColumn("__n", F.row_number().over(newest)))  # the cap and a batch at most
        n = ranked.count()
        kept = ranked.where(F.col("__n") <= self.cap)
        held = min(n, self.cap)
        told = {"dropped": n - held, "written": 0, "refused": 0, "failures": known["failures"] or 0, "wait_until": known["wait_until"]}
        left = kept.drop("__n")
        resting = known["wait_until"] is not None and self.spark.range(1).select(F.lit(known["wait_until"]) > moment).first()[0]
        if held and not resting:
            place = kept.withColumn("place", held + 1 - F.col("__n")).drop("__n")  # oldest first
            try:
                bad = halved(place, held, self.send)
                aside = place.join(self.spark.createDataFrame(bad, "place int, why string"), "place").drop("place") if bad else None
                if aside is not None:
                    aside.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/refused/batch={batch}")
                told |= {"written": held - len(bad), "refused": len(bad), "failures": 0, "wait_until": None}
                left = left.limit(0)
            except Exception:  # noqa: BLE001, the target is down: everything waits
                told["failures"] += 1
                pause = min(BACK_OFF_MOST_S, BACK_OFF_S * 2 ** (told["failures"] - 1))
                told["wait_until"] = self.spark.range(1).select(moment + F.make_interval(secs=F.lit(pause))).first()[0]
        left.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/waiting/{batch}")
        row = [(batch, self.table, told["dropped"], told["written"], told["refused"], told["failures"], told["wait_until"])]
        self.spark.createDataFrame(row, STATE).coalesce(1).write.mode("append").parquet(f"{self.root}/state")
        return told | {"waiting": 0 if told["written"] or told["refused"] else held}


def buffered(rows: DataFrame, buffer: Buffer, checkpoint: str, now: Callable[[], str]):
    """A query that puts every micro-batch of a stream through a buffer."""
    return rows.writeStream.foreachBatch(lambda df, batch: buffer.take(df, batch, now())).option("checkpointLocation", checkpoint)
