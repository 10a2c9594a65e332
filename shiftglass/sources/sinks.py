"""Tables written so that a repeated write changes nothing, and exports."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import records


def append_new(new: DataFrame, path: str, key: str = "id") -> None:
    """Append the rows whose key the table does not hold yet."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.dropDuplicates([key]).write.parquet(path)
        return
    records.not_there(new, old, key).write.mode("append").parquet(path)


def replace_days(buckets: DataFrame, path: str, at: str = "bucket_start") -> None:
    """Replace the days that ``buckets`` covers; other days stay as they are."""
    days = buckets.withColumn("day", F.to_date(at))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def export_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Rows as CSV with cells a spreadsheet cannot run, headed by names."""
    rows.select(*[records.csv_cell(F.col(c)).alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def audited(spark: SparkSession, path: str, actor: str, action: str, org: str, now: str) -> None:
    """Append the audit row; callers write it before they give the result out."""
    spark.createDataFrame([(actor, action, org, now)], "actor string, action string, org_id string, at string").write.mode("append").parquet(path)


def quarantine(rows: DataFrame, good, path: str) -> DataFrame:
    """The good rows; the others are written to ``path``."""
    bad = rows.where(~F.coalesce(good, F.lit(False)))
    bad.write.mode("append").parquet(path)
    return rows.where(good)


def yolo_labels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Label lines "class cx cy w h" in shares of the image as pixel boxes, with the file's name."""
    p = F.split(F.trim("value"), r"\s+")
    n = lambda i: p[i].try_cast("double")
    cx, cy, w, h = n(1) * width, n(2) * height, n(3) * width, n(4) * height
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("image"))
    return lines.where(F.size(p) >= 5).select("image", p[0].try_cast("int").alias("cls"), F.array(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2).alias("bbox"))


# --------------------------------------------------------------------------- shared folder, stored minute buckets
def shared_dir(spark) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); local masters without one get their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("shiftglass.shared", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("shiftglass.shared", found)
    return found.rstrip("/")


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version_of(spark, path: str) -> str:
    """A digest of the files under ``path``: their names, sizes and times of change. It is another one after any write."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    seen, files = hashlib.sha1(path.encode()), fs.listFiles(p, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    for line in sorted(found):
        seen.update(line.encode())
    return seen.hexdigest()[:16]


def stored_buckets(spark, source: str, buckets, folder: str | None = None) -> DataFrame:
    """The day-partitioned table of minute buckets of the rows at ``source``, made by ``buckets()`` where it is missing.

    The table lies in the shared folder, and a pointer file named after the version of its
    source tells where: every session that sees the same files reads the same table, and
    changed files make a new one, so that no dashboard shows what is no longer there. The
    pointer is put in place by one rename after the table is whole; a build that is cut off,
    or made twice at once, leaves a folder that nobody reads. A window on ``bucket_start``
    comes with one on ``day``, so that other days are not read.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = folder or shared_dir(spark)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/buckets-{version_of(spark, source)}.path")
    fs = pointer.getFileSystem(conf)
    if not fs.exists(pointer):
        made = f"buckets-{uuid.uuid4().hex}"
        buckets().withColumn("day", F.to_date("bucket_start")).repartition("day").write.partitionBy("day").parquet(f"{root}/{made}")
        draft = jvm.org.apache.hadoop.fs.Path(f"{root}/{made}.path")
        out = fs.create(draft, True)
        out.writeUTF(made)
        out.close()
        fs.rename(draft, pointer)
    told = fs.open(pointer)
    name = told.readUTF()
    told.close()
    return spark.read.parquet(f"{root}/{name}")


def merge_buckets(target: DataFrame, changes: DataFrame, key: tuple[str, ...] = ("org_id", "camera_id", "zone_id", "bucket_start")) -> DataFrame:
    """``target`` with the buckets of ``changes`` instead of its own of the same key, all measures replaced: a merge as one pass over both."""
    both = target.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    measures = [c for c in target.columns if c not in key]
    newest = both.groupBy(*key).agg(F.max_by(F.struct(*measures), F.col("__new")).alias("m"))
    return newest.select(*key, "m.*").select(*target.columns)


def csv_blocks(blocks: list[tuple[str, DataFrame]]) -> DataFrame:
    """A report of several tables as one ordered list of CSV lines (block, line, text): a title, the column names, the rows, a blank line.

    Cells are quoted as needed and cannot start a formula. Blocks are reports, of a few rows each.
    """
    out = None
    for i, (title, df) in enumerate(blocks):
        cell = lambda c: F.concat(F.when(c.rlike("^[=+\\-@\t\r]"), "'").otherwise(""), c)
        quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
        cells = F.concat_ws(",", *[F.coalesce(quoted(cell(F.col(f"`{c}`").cast("string"))), F.lit("")) for c in df.columns])
        w = Window.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in df.columns])
        rows = df.select(F.row_number().over(w).alias("n"), cells.alias("text"))
        head = df.sparkSession.createDataFrame([(-1, title), (0, ",".join(df.columns))], "n int, text string")
        block = head.unionByName(rows).unionByName(df.sparkSession.createDataFrame([(1 << 30, "")], "n int, text string")).select(F.lit(i).alias("block"), F.col("n").alias("line"), "text")
        out = block if out is None else out.unionByName(block)
    return out


def json_rows(df: DataFrame, order: list, name: str, nulls: bool = True) -> DataFrame:
    """One row: a small table as a JSON array of objects in ``order``, null fields kept as null."""
    options = {"ignoreNullFields": str(not nulls).lower()}
    ranked = df.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    items = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.struct(*df.columns).alias("o")))), lambda x: x["o"])
    return ranked.agg(F.to_json(items, options).alias(name))
