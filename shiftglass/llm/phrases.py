"""Phrase collocation mining: identical pieces become multiplicities, n-grams are counted per hash bucket out of core.

Texts are split at punctuation into pieces; equal pieces of a language are kept once with
their number. Tasks turn slices of pieces into distinct n-grams with weights, a sorted,
compressed run per hash bucket and language, so that a frequent n-gram travels once a
slice and not once an occurrence. A bucket's runs stream into a DuckDB aggregate with a
memory limit, which spills to the task's own folder and is removed with the task. Scores
need the counts of a candidate's parts: the candidate sends a request to each part's key,
and the answers come back by the candidate's key.
"""

from __future__ import annotations

import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BASE, Scratch, flat, hot_join, mix, slices, word_hashes

UNKNOWN = "und"
SPLIT = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of pieces that one task turns into n-grams at once, and bytes of pieces a bucket is meant for.
AT_ONCE = 8 << 20
BUCKET_BYTES = 48 << 20
MEMORY = "256MB"
#: Rows of a language that are ranked together before its best meet.
RANK_GROUP = 100_000


# --------------------------------------------------------------------------- pieces
def pieces(docs: DataFrame, text: str = "text", group: str = "lang") -> DataFrame:
    """(grp, piece, n): every distinct piece of a group, words one blank apart, and how often it occurs.

    Null text has no piece, null group counts as ``UNKNOWN``, pieces without a word are left out.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)).alias("grp"), F.explode(F.split(low, SPLIT)).alias("raw"))
    words = cut.select("grp", F.trim(F.regexp_replace("raw", r"[\x20\x09]+", " ")).alias("piece"))
    return words.where("piece <> ''").groupBy("grp", "piece").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- n-grams
def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key first stands, the sum of its weights, and every key's number."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, np.diff(keys[order]) != 0]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], np.add.reduceat(weights[order], np.flatnonzero(new)), number


def _cells(batch: pa.RecordBatch, most: int, buckets: int):
    """(bucket, group, number of n-grams, the n-grams a line each, their weights) of a slice of pieces."""
    raw, offs = flat(batch.column("piece"))
    gap = np.flatnonzero(raw == 32)
    starts = np.sort(np.concatenate([offs[:-1], gap + 1]))
    row = np.searchsorted(offs, starts, side="right") - 1
    ends = np.r_[starts[1:] - 1, len(raw)]
    last = np.r_[row[1:] != row[:-1], True]
    ends[last] = offs[row[last] + 1]
    offs, data = _gathered(raw, starts, ends)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs), pa.py_buffer(data))
    coded = words.dictionary_encode()
    place = np.argsort(np.asarray(pa.compute.sort_indices(coded.dictionary)))
    code = place[np.asarray(coded.indices)]
    digest = np.empty(len(place), np.uint64)
    digest[place] = word_hashes(*flat(coded.dictionary), lower=False)[0]
    group = batch.column("grp").dictionary_encode()
    weight = np.asarray(batch.column("n"))[row]
    # level by level: an n-gram is the number of its beginning and its last word
    number, at = np.asarray(group.indices).astype(np.int64)[row], np.arange(len(starts))
    level_hash = np.zeros(len(group.dictionary), np.uint64)
    found = []
    for k in range(most):
        good = at + k < len(starts)
        good[good] &= row[at[good] + k] == row[at[good]]
        at, number = at[good], number[good]
        if not len(at):
            break
        first, total, fresh = _distinct(number << 32 | code[at + k], weight[at])
        hashes = mix(level_hash[number[first]] * BASE + digest[code[at[first] + k]])
        found.append((at[first], at[first] + k, total, hashes))
        number, level_hash = fresh, hashes
    head, tail, total, hashes = (np.concatenate(x) for x in zip(*found))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    kind = np.asarray(group.indices)[row[head]]
    order = np.lexsort((np.arange(len(head)), kind, bucket))
    cut = np.flatnonzero(np.r_[True, (np.diff(bucket[order]) != 0) | (np.diff(kind[order]) != 0)])
    for a, b in zip(cut, [*cut[1:], len(order)]):
        some = order[a:b]
        data = _gathered(raw, starts[head[some]], ends[tail[some]], end=10)[1]
        yield int(bucket[some[0]]), group.dictionary[int(kind[some[0]])].as_py(), b - a, data, total[some]


def _gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the spans of ``raw``, each closed by the byte ``end`` if given."""
    size = ends - starts + (end is not None)
    offs = np.r_[0, np.cumsum(size)].astype(np.int64)
    index = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    data = np.r_[raw, np.uint8(0)][index]
    if end is not None:
        data[offs[1:] - 1] = end
    return offs, data


def counts(found: DataFrame, most: int, least: int, buckets: int) -> DataFrame:
    """(grp, phrase, f): how often each sequence of up to ``most`` words occurs, for those with ``least`` occurrences."""
    runs = "bucket int, grp string, size int, phrases binary, weights binary"

    def split(batches):
        codec = pa.Codec("zstd", 3)
        for b in slices(batches, "piece", AT_ONCE):
            cells = list(_cells(b, most, buckets))
            cols = [[c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells]]
            # length in front: the codec wants it back
            text = [len(c[3]).to_bytes(8, "little") + codec.compress(c[3], asbytes=True) for c in cells]
            sums = [codec.compress(c[4].astype("<i8").tobytes(), asbytes=True) for c in cells]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(text, pa.binary()), pa.array(sums, pa.binary())], names=["bucket", "grp", "size", "phrases", "weights"])

    def total(batches):
        import duckdb

        schema = pa.schema([("grp", pa.string()), ("phrase", pa.large_string()), ("n", pa.int64())])

        def opened():
            codec = pa.Codec("zstd")
            for b in batches:
                for grp, n, text, sums in zip(*(b.column(c).to_pylist() for c in ("grp", "size", "phrases", "weights"))):
                    raw = np.frombuffer(codec.decompress(text[8:], int.from_bytes(text[:8], "little")), np.uint8)
                    offs = np.r_[0, np.flatnonzero(raw == 10) + 1]
                    index = np.delete(np.arange(len(raw)), offs[1:] - 1)
                    data = pa.LargeStringArray.from_buffers(n, pa.py_buffer((offs - np.arange(n + 1)).astype(np.int64)), pa.py_buffer(raw[index]))
                    weights = pa.array(np.frombuffer(codec.decompress(sums, 8 * n), "<i8"))
                    for a in range(0, n, 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array([grp] * min(n - a, 1 << 16), pa.string()), data.slice(a, 1 << 16), weights.slice(a, 1 << 16)], schema=schema)

        spill = tempfile.mkdtemp(prefix="duckdb-")
        try:
            con = duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": spill, "threads": 1, "preserve_insertion_order": False})
            con.register("runs", pa.RecordBatchReader.from_batches(schema, opened()))
            got = con.sql(f"SELECT grp, phrase, CAST(sum(n) AS BIGINT) AS f FROM runs GROUP BY grp, phrase HAVING sum(n) >= {int(least)}")
            for b in got.to_arrow_reader(1 << 16):
                yield b.cast(pa.schema([("grp", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))
            con.close()
        finally:
            shutil.rmtree(spill, ignore_errors=True)

    return found.mapInArrow(split, runs).repartitionById(buckets, "bucket").mapInArrow(total, "grp string, phrase string, f long")


# --------------------------------------------------------------------------- scores
def mine(docs: DataFrame, text: str = "text", group: str = "lang", most: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): the ``top`` best-scoring phrases of every group.

    A phrase of 2 to ``most`` words is a candidate if it occurs ``least`` times. Its score is
    floor(10**6 * a * a / (l * r)) of its lowest-scoring cut. Candidates inside a longer
    one that has ``inside`` percent of their occurrences or more are dropped. Null text counts
    as empty, null group as ``UNKNOWN``; repeated rows count as often as they stand; an
    empty table, or one without candidates, gives an empty table.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    found = scratch.keep(pieces(docs, text, group))
    words = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "))) + 1
    sizes = scratch.keep(found.groupBy("grp").agg(F.sum(F.col("n") * words).alias("n"), F.sum(F.octet_length("piece").cast("long")).alias("bytes")))
    volume = sizes.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // BUCKET_BYTES))
    known = scratch.keep(counts(found, most, least, buckets))

    word = F.split("phrase", " ")
    candidates = known.withColumn("word", word).where(F.size("word") >= 2)
    part = lambda a, n: F.array_join(F.slice("word", a, n), " ")
    cuts = F.explode(F.sequence(F.lit(1), F.size("word") - 1)).alias("k")
    sides = candidates.select("grp", "phrase", F.col("f").alias("a"), "word", cuts)
    asked = sides.select("grp", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("k") + 1, F.size("word")).alias("part")))).alias("s"))
    asked = scratch.keep(asked.select("grp", "phrase", "a", "k", "s.left", "s.part"))
    facts = asked.groupBy("grp", "part").agg(F.count("*").alias("asked")).join(known.withColumnRenamed("phrase", "part"), ["grp", "part"])
    told = hot_join(asked, scratch.keep(facts.select("part", "grp", "f", "asked")), ["part", "grp"], "asked", asked.count(), ["grp", "phrase", "k"])
    both = told.groupBy("grp", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS LONG)")
    scored = both.withColumn("score", score).groupBy("grp", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    # every part of a candidate hears of it
    longer = candidates.where(F.size("word") > 2).select("grp", "word", "f", F.explode(F.sequence(F.lit(2), F.size("word") - 1)).alias("size"))
    longer = longer.select("grp", "word", "f", "size", F.explode(F.sequence(F.lit(1), F.size("word") - F.col("size") + 1)).alias("from"))
    over = longer.select("grp", part(F.col("from"), F.col("size")).alias("phrase"), "f").groupBy("grp", "phrase").agg(F.max("f").alias("over"))
    left = scored.join(over, ["grp", "phrase"], "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * inside))
    left = left.select("grp", "phrase", "a", "best.l", "best.r", "best.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = -(-max(known.count(), 1) // RANK_GROUP)
    near = left.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("__rank", F.row_number().over(Window.partitionBy("grp", "__salt").orderBy(*best))).where(F.col("__rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes.select("grp", "n"), "grp").select("grp", "rank", "phrase", "a", "l", "r", "n", "score")
