"""Line dedup: a suffix array over line IDs by prefix doubling, in DataFrame operations only.

A suffix is a document's lines from one line on. Lines that occur once in the corpus match
nothing, so only suffixes that start with a repeated line are ranked; all others, and the end
of a document, are the smallest symbol. Level j ranks suffixes by their first 2^j lines:
the pairs of ranks of level j - 1 at a place and 2^(j-1) lines on are counted, sorted over
all machines and numbered. Levels go on until no pair repeats. The last ranks give the
suffix array; the longest common prefix (LCP) of neighbours in it is added up from the levels'
ranks, largest first. A suffix's longest run that occurs elsewhere is the larger of its two
LCPs; the LCP interval of depth ``min_lines`` that it belongs to, a class of level
log2(``min_lines``), tells whether it starts a later copy. Later copies are deleted.

Ranks are exact: only lines are named by a hash (MD5, 128 bits), runs by numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, hot_join, numbered

MIN_LINES = 4
MIN_CHARS = 50

PLACE = ("d", "row", "at")
SPREAD = ["row", "at"]


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _row(text: str, doc_id: str):
    """Names a row by its id and text (16 bytes); what this names twice are equal rows."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("\x1e")), F.coalesce(F.col(text), F.lit("")))))


def _ranked(pairs: DataFrame, keys: list[str], total: int, scratch: Scratch) -> DataFrame:
    """d, row, at, rank, many (another suffix has the same run) and first (its first place) of every suffix.

    ``pairs`` has d, row, at, full (the run is whole) and ``keys``, by which it is ranked.
    """
    classes = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"), F.first("full").alias("full"))
    ranks = scratch.keep(classes.orderBy(*keys).select(*keys, "n", "first", (F.col("full") & (F.col("n") > 1)).alias("many"), F.monotonically_increasing_id().alias("rank")))
    return hot_join(pairs, ranks, keys, "n", total, SPREAD).select("d", "row", "at", "rank", "many", (F.col("first") != F.struct(*PLACE)).alias("later"))


def suffixes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[list[DataFrame], Scratch]:
    """The levels of the suffix array, level j by the first 2^j lines; level 0 also has chars, the length of the line.

    Document order is by id (null first), then by a hash; rows of equal id and text are one
    document, since nothing tells which comes first: they lose the same lines.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    whole = docs.select(F.col(doc_id).alias("d"), _row(text, doc_id).alias("row"), _lines(text).alias("lines"))  # the row is named before its lines are told apart
    lines = whole.select("d", "row", F.posexplode("lines").alias("at", "line")).select("d", "row", "at", F.unhex(F.md5("line")).alias("line"), F.length("line").alias("chars"))
    found = lines.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last")).where("first <> last").drop("last")
    shared = scratch.keep(found.orderBy("line").withColumn("rank", F.monotonically_increasing_id()))
    total = shared.agg(F.sum("n")).first()[0] or 0
    named = hot_join(lines, shared, ["line"], "n", total, SPREAD).where("rank IS NOT NULL").select("d", "row", "at", "rank", F.lit(True).alias("many"), (F.col("first") != F.struct(*PLACE)).alias("later"), "chars")
    levels, k = [scratch.keep(named.dropDuplicates(SPREAD))], 1
    while not levels[-1].where("many").isEmpty():
        level = levels[-1]
        ahead = level.select("row", (F.col("at") - k).alias("at"), F.col("rank").alias("next"), F.col("many").alias("goes_on"))
        both = level.select("d", "row", "at", "rank", "many").join(ahead, SPREAD, "left")
        # the end of a document or a line of its own sorts first; a pair is a whole run only if both halves repeat
        pairs = both.select("d", "row", "at", "rank", F.when(F.col("many"), F.coalesce("next", F.lit(-1))).otherwise(-1).alias("next"), (F.col("many") & F.coalesce("goes_on", F.lit(False))).alias("full"))
        levels.append(scratch.keep(_ranked(pairs.withColumnRenamed("rank", "half"), ["half", "next"], total, scratch)))
        k *= 2
    return levels, scratch


def longest_runs(levels: list[DataFrame], starts: DataFrame, scratch: Scratch) -> DataFrame:
    """row, at and lcp, the lines of the longest run from there that also starts elsewhere, of the suffixes ``starts``.

    ``starts`` must hold whole LCP intervals: with a suffix all that share its first lines.
    """
    array = numbered(levels[-1].select("d", "row", "at", "rank").join(starts.select("row", "at"), SPREAD, "left_semi"), ["rank", "d", "row", "at"], "sa", scratch)
    array = scratch.keep(array.select("row", "at", "sa"))
    left, right = array.select(F.col("row").alias("row1"), F.col("at").alias("at1"), "sa"), array.select(F.col("row").alias("row2"), F.col("at").alias("at2"), (F.col("sa") - 1).alias("sa"))
    pairs = left.join(right, "sa").withColumn("lcp", F.lit(0))
    for j in reversed(range(len(levels) - 1)):
        ranks = levels[j].where("many")
        for i in ("1", "2"):
            held = ranks.select(F.col("row").alias(f"row{i}"), F.col("at").alias(f"from{i}"), F.col("rank").alias(f"rank{i}"))
            pairs = pairs.withColumn(f"from{i}", F.col(f"at{i}") + F.col("lcp")).join(held, [f"row{i}", f"from{i}"], "left")
        pairs = pairs.select("row1", "at1", "row2", "at2", F.when(F.col("rank1") == F.col("rank2"), F.col("lcp") + (1 << j)).otherwise(F.col("lcp")).alias("lcp"))
        if j % 3 == 0:
            pairs = scratch.keep(pairs)
    sides = [pairs.select(F.col(f"row{i}").alias("row"), F.col(f"at{i}").alias("at"), "lcp") for i in "12"]
    return sides[0].unionByName(sides[1]).groupBy("row", "at").agg(F.max("lcp").alias("lcp"))


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """row, at, length and longest of every later copy: single lines of ``min_chars`` characters or more, runs of ``min_lines`` lines.

    ``longest`` is the number of lines of the longest run from there that also starts
    elsewhere. ``min_lines`` is a power of two.
    """
    depth = min_lines.bit_length() - 1
    if min_lines != 1 << depth:
        raise ValueError("min_lines must be a power of two")
    levels, scratch = suffixes(docs, text, doc_id)
    single = levels[0].where((F.col("chars") >= min_chars) & F.col("later")).select("row", "at", F.lit(1).alias("length"), F.lit(1).alias("longest"))
    if depth >= len(levels):
        return single
    repeated = levels[depth].where("many")
    runs = repeated.where("later").join(longest_runs(levels, repeated, scratch), SPREAD).select("row", "at", F.lit(min_lines).alias("length"), F.col("lcp").alias("longest"))
    return scratch.keep(single.unionByName(runs))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from ``text``.

    Adds n_lines, n_removed, n_runs (maximal deleted stretches) and longest_copy (lines of the
    longest repeated run that starts at a deleted line). Null text stays null and has no line; an
    empty text has one empty line. A column of these names in ``docs`` is replaced. Equal
    rows lose the same lines. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs", "longest_copy")
    found = copies(docs, text, doc_id, min_lines, min_chars)
    within = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = found.groupBy("row", "at").agg(F.max("length").alias("length"), F.max("longest").alias("longest")).withColumn("end", F.col("at") + F.col("length"))
    runs = (
        spans.withColumn("new", F.coalesce((F.col("at") > F.max("end").over(within)).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("row", "run")
        .agg(F.min("at").alias("a"), F.max("end").alias("b"), F.max("longest").alias("longest"))
        .groupBy(F.col("row").alias("__row"))
        .agg(F.collect_list(F.struct("a", "b")).alias("__runs"), F.max("longest").alias("__longest"))
    )
    joined = docs.withColumn("__row", _row(text, doc_id)).join(runs, "__row", "left")
    keep = F.filter(_lines(text), lambda x, i: ~F.exists("__runs", lambda r: (i >= r["a"]) & (i < r["b"])))
    cut = F.when(F.col("__runs").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))
    removed = F.coalesce(F.aggregate("__runs", F.lit(0), lambda s, r: s + (r["b"] - r["a"]).cast("int")), F.lit(0))
    return joined.select(
        *[cut.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.coalesce(F.size("__runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("__longest", F.lit(0)).cast("long").alias("longest_copy"),
    )
