"""Near-duplicate detection by ProbMinHash over weighted word shingles.

A document's shingles, weighted by their counts, are Poisson processes whose arrivals fall
into random registers; the first arrival of each register names a shingle, and two
documents agree on a register with their probability Jaccard similarity. Arrivals later
than the last register's first cannot matter, so they are not drawn.

Equal texts are one class from the start. Bands of registers deal class representatives
into buckets; candidates are verified by the exact similarity of their whole texts, and
linked classes are joined into components. Buckets are never expanded into all pairs at
once: first every member meets one leader, then, for members still apart, all their leaders,
the other pairs of small buckets and two further leaders of large ones. Large buckets that still
hold several components are searched whole, in blocks: members outside the bucket's largest
component meet all others, by a bound on the similarity first.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE, HOT_KEYS, U, Scratch, flat, hot_join, mix, pack, powers, ranges, run_hashes, slices, word_hashes

SHINGLE = 5
REGISTERS = 64
ROWS = 4
THRESHOLD = 0.8
SMALL_BUCKET = 24
LEADERS = 2
SHARE = 256
BLOCK = 256
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 512 << 10
VOCABULARY = 8192


# --------------------------------------------------------------------------- shingles
def shingles(raw: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the rows' distinct shingles; A-Z are lower-cased.

    A text of fewer words than ``width`` has one shingle of all its words, one without words none.
    """
    h, n = word_hashes(raw, offs, lower=True)
    inside = np.repeat(n, n) - ranges(n) >= width
    doc = np.repeat(np.arange(len(n)), n)
    whole = run_hashes(h, width)
    ok = inside[: len(whole)]
    s, d = whole[ok], doc[: len(whole)][ok]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        starts, (up, _) = np.cumsum(n) - n, powers(width + 1)
        own = [mix((h[starts[i] : starts[i] + n[i]] * up[: n[i]]).sum(dtype=np.uint64)[None] + U((int(n[i]) * int(BASE)) % 2**64))[0] for i in short]
        s, d = np.concatenate([s, np.array(own, np.uint64)]), np.concatenate([d, short])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    return d[at], s[at], np.diff(np.append(at, len(s)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """n_docs x m names of first arrivals, and which documents have shingles."""
    names = np.zeros((n_docs, m), np.uint64)
    weight = np.bincount(doc, count, n_docs)
    there = weight > 0
    limit = np.divide(m * (math.log(m) + 4), weight, out=np.zeros(n_docs), where=there)
    todo = there.copy()
    while todo.any():
        mine = todo[doc]
        d, s, w = doc[mine], shingle[mine], count[mine].astype(np.float64)
        x, j, found = np.zeros(len(s)), 0, []
        while len(s):
            j += 1
            r = mix(s + U((j * int(BASE)) % 2**64))
            x = x - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            ok = x < limit[d]
            d, s, w, x = d[ok], s[ok], w[ok], x[ok]
            found.append((d * m + (mix(r[ok]) % U(m)).astype(np.int64), x, s))
        cell, x, s = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((s, x, cell))
        cell, s = cell[order], s[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        names.reshape(-1)[cell[first]] = s[first]
        full = np.bincount(cell[first] // m, minlength=n_docs) == m
        todo &= ~full
        limit = np.where(todo, 2 * limit, limit)
    return names, there


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted shingles, counts); 0 if one is empty.

    The sum over shared shingles of 1 / sum of max(v / v_s, w / w_s) over all shingles.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    v, w = np.zeros(len(every)), np.zeros(len(every))
    v[np.searchsorted(every, a[0])], w[np.searchsorted(every, b[0])] = a[1], b[1]
    both = (v > 0) & (w > 0)
    ratio, n = np.unique(v[both] / w[both], return_inverse=True)
    total = sum(v[both][n == i].sum() / np.maximum(v, w * r).sum() for i, r in enumerate(ratio))
    return float(total)


# --------------------------------------------------------------------------- candidates
def _banded(docs: DataFrame, text: str, doc_id: str, m: int, rows: int) -> DataFrame:
    """id, key (of the text), has (shingles) and a hash per band of every row."""
    picked = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"), F.col(text).alias("t"))

    return picked.mapInArrow(lambda source: _signed(source, m, rows), "id long, key binary, has boolean, bands array<long>")


def _signed(source, m: int = REGISTERS, rows: int = ROWS):
    """Batches of id, key and t with has and bands instead of t; its arrays are many times as large as the text in hand."""
    for b in slices(source, "t", SLICE_BYTES):
        names, has = signatures(*shingles(*flat(b.column("t"))), b.num_rows, m)
        up, _ = powers(rows)
        bands = mix((names.reshape(b.num_rows, m // rows, rows) * up).sum(2, dtype=np.uint64)).view(np.int64)
        offs = pa.array(np.arange(b.num_rows + 1) * (m // rows), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(has), pa.ListArray.from_arrays(offs, pa.array(bands.reshape(-1)))], names=["id", "key", "has", "bands"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) as stars: every vertex that is not its component's smallest, and that smallest vertex."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(up := root[root], root):
            root = up
    out = np.flatnonzero(root != np.arange(len(names)))
    return names[out], names[root[out]]


def _stars(source):
    """The edges (a, b) of all batches of a task as stars, of keys of 16 bytes."""
    ends = [[flat(b.column(c))[0].view("S16") for c in "ab"] for b in source if b.num_rows]
    if ends:
        found = forest(*(np.concatenate(x) for x in zip(*ends)))
        yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(pack(x))]).cast(pa.binary()) for x in found], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b), as stars, of the pairs whose texts are as similar as asked."""
    # a hot leader's text is copied for every SHARE of its pairs, so that no task gets them all; fewer than HOT_KEYS leaders are hot
    most = max(SHARE, pairs.count() // HOT_KEYS)
    hot = F.broadcast(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > most).select("b", F.ceil(F.col("n") / SHARE).cast("int").alias("copies")))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"), F.lit(0)).alias("copy"))
    copied = texts.select(F.col("key").alias("b"), F.col("t").alias("tb")).join(hot, "b", "left").select("b", "tb", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    both = dealt.join(texts.select(F.col("key").alias("a"), F.col("t").alias("ta")), "a").join(copied, ["b", "copy"]).select("a", "b", "ta", "tb")

    def run(source):
        known: OrderedDict = OrderedDict()

        def parsed(key: bytes, text: str):
            if key not in known:
                raw = np.frombuffer((text or "").encode(), np.uint8)
                _, s, n = shingles(raw, np.array([0, len(raw)]))
                known[key] = (s, n)
                if len(known) > 256:
                    known.popitem(last=False)
            return known[key]

        for b in source:
            a_, b_ = b.column("a").to_pylist(), b.column("b").to_pylist()
            sims = [similarity(parsed(x, tx.as_py()), parsed(y, ty.as_py())) for x, y, tx, ty in zip(a_, b_, b.column("ta"), b.column("tb"))]
            yield b.select(["a", "b"]).filter(pa.array([x >= threshold for x in sims], pa.bool_()))

    return both.mapInArrow(lambda source: _stars(run(source)), "a binary, b binary")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, root): the vertices of ``edges`` (a, b), a > b, that are not their component's smallest key, with that key.

    Each round edges are dealt by their larger end and every task makes stars of its own;
    then a star's centre gives way to its own smallest neighbour, until none has one. Tasks
    that make edges make stars of them before (``_stars``), so that no larger end is hot.
    """
    while True:
        stars = scratch.keep(edges.repartition("a").mapInArrow(_stars, "a binary, b binary"))
        up = stars.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("up"), F.max("b").alias("last"))
        held = stars.groupBy("b").agg(F.count("*").alias("n"))
        middle = scratch.keep(up.join(held, "b", "left").where("n IS NOT NULL OR up <> last").select("b", "up", F.coalesce("n", F.lit(0)).alias("n")))
        if middle.isEmpty():
            return stars.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("root"))
        edges = hot_join(stars, middle, ["b"], "n", stars.count(), ["a"]).select("a", F.coalesce("up", "b").alias("b"))


def bounded(left: list, right: list, threshold: float) -> np.ndarray:
    """(i, j) of all left and right weighted sets that can be as similar as asked.

    With P and Q the shares of each set's weight that lie on shared shingles, the similarity
    is 1 / (1 / P + 1 / Q - 1) at most, and just that for sets without repeats.
    """

    def shared(sets: list, names: np.ndarray):
        row, s = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets]), np.concatenate([x for x, _ in sets])
        w = np.concatenate([n / max(n.sum(), 1) for _, n in sets])
        at = np.searchsorted(names, s)
        ok = names[np.minimum(at, len(names) - 1)] == s
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order], w[ok][order]

    names = np.intersect1d(np.concatenate([x for x, _ in left]), np.concatenate([x for x, _ in right]))
    if not len(names):
        return np.zeros((0, 2), np.int64)
    a, b = shared(left, names), shared(right, names)
    p, q = np.zeros((2, len(left), len(right)))
    for lo in range(0, len(names), VOCABULARY):
        dense = []
        for (row, at, w), n in ((a, len(left)), (b, len(right))):
            i, j = np.searchsorted(at, (lo, lo + VOCABULARY))
            m = np.zeros((2, n, min(VOCABULARY, len(names) - lo)))
            m[0, row[i:j], at[i:j] - lo], m[1, row[i:j], at[i:j] - lo] = w[i:j], 1
            dense.append(m)
        p += dense[0][0] @ dense[1][1].T
        q += dense[0][1] @ dense[1][0].T
    return np.argwhere((p > 0) & (p + q - p * q <= p * q / threshold + 1e-9))


def _rest(large: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join all components that any pair of one of the large buckets joins."""
    placed = large.select("bucket", "key").join(roots, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    sized = scratch.keep(placed.join(mixed, "bucket").join(texts.select("key", "size"), "key").withColumn("minor", F.expr("root <> most")).drop("most"))
    if sized.isEmpty():
        return sized.select(F.col("key").alias("a"), F.col("key").alias("b"))
    blocks = lambda rows: F.greatest(F.ceil(F.count_if(rows) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(rows, F.col("size"))), F.lit(0)) / BLOCK_BYTES)).cast("int")
    counts = sized.groupBy("bucket").agg(blocks(F.col("minor")).alias("minors"), blocks(~F.col("minor")).alias("majors"))
    own = F.pmod(F.xxhash64("key", "bucket"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    dealt = sized.join(counts, "bucket").withColumn("own", own)
    # a pair of blocks is a task's: (i, j) of minors for i <= j, and (i, -1 - j) of minors with majors
    cell = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    after = F.transform(F.sequence("own", F.col("minors") - 1), lambda j: cell(F.col("own"), j, True, False))
    before = F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: cell(i, F.col("own"), False, True))
    others = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda j: cell(F.col("own"), -1 - j, True, False))
    right = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: cell(i, -1 - F.col("own"), False, True))
    cells = F.when(F.col("minor"), F.concat(after, before, others)).otherwise(right)
    rows = dealt.select("bucket", "key", "root", F.explode(cells).alias("c")).select("bucket", "key", "root", "c.*").join(texts.select("key", "t"), "key")

    def run(t: pa.Table) -> pa.Table:
        key, root = t.column("key").to_pylist(), t.column("root").to_pylist()
        docs, s, n = shingles(*flat(t.column("t").combine_chunks()))
        cut = np.searchsorted(docs, np.arange(len(key) + 1))
        sets = [(s[x:y], n[x:y]) for x, y in zip(cut, cut[1:])]
        sides = [np.flatnonzero(np.asarray(t.column(side).combine_chunks())) for side in ("left", "right")]
        parent: dict = {}

        def top(r):
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        out = []
        for x, y in bounded(*([sets[i] for i in side] for side in sides), threshold) if all(map(len, sides)) else ():
            i, j = sides[0][x], sides[1][y]
            u, v = top(root[i]), top(root[j])
            if u != v and similarity(sets[i], sets[j]) >= threshold:
                parent[max(u, v)] = min(u, v)
                out.append((max(key[i], key[j]), min(key[i], key[j])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def _bucketed(members: DataFrame, buckets: DataFrame, n: str, total: int) -> DataFrame:
    """The ``members`` whose bucket is one of ``buckets`` (stored, with ``n`` members each, of ``total``), with its columns.

    Hot buckets, fewer than ``HOT_KEYS``, are broadcast to their own members; only these go through that join.
    """
    hot = [r["bucket"] for r in buckets.where(F.col(n) * HOT_KEYS > total).select("bucket").collect()]
    own = F.col("bucket").isin(hot) if hot else F.lit(False)
    cold = members.where(~own).join(buckets.where(~own), "bucket", "left").where(F.col(n).isNotNull())
    return cold.unionByName(members.where(own).join(F.broadcast(buckets.where(own)), "bucket")) if hot else cold


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """id, key, class_id and rep of every row: near-duplicate classes of whole documents.

    ``class_id`` is the smallest id of the class, ``key`` the hash of the text and ``rep``
    whether the row stands for its class (one row does, equal rows together). Classes are
    the components of links of probability Jaccard ``threshold`` or more between texts.
    Rows without words (null, empty, blank) are each their own class. A null id counts only
    where a class has no other. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows_ = scratch.keep(_banded(docs, text, doc_id, registers, rows))
    reps = scratch.keep(rows_.where("has").groupBy("key").agg(F.min("id").alias("rep_id"), F.min("bands").alias("bands")))
    members = reps.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("bucket"))
    pick = [F.min_by("key", F.xxhash64("key", "bucket", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("lead"), *pick).where("n > 1")
    dealt = scratch.keep(_bucketed(members, scratch.keep(buckets), "n", members.count()))
    ordered = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    star = scratch.keep(dealt.where("key <> lead").select(*ordered("key", "lead")).distinct())
    needed = dealt.select("key").distinct().join(reps.select("key", "rep_id"), "key")
    whole = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"), F.col(text).alias("t"))
    texts = scratch.keep(whole.alias("w").join(needed.alias("n"), (F.col("w.key") == F.col("n.key")) & F.col("id").eqNullSafe(F.col("rep_id"))).select("w.key", "t", F.octet_length("t").alias("size")).dropDuplicates(["key"]))
    # first one leader a text, then all other pairs of those still apart: a group's links are as many as its texts, not that times its bands
    nearest = scratch.keep(star.groupBy("a").agg(F.min("b").alias("b")))
    roots = components(_verified(nearest, texts, threshold), scratch)
    # a bucket of one component is done; what else a bucket's members meet is told apart by roots before it becomes pairs
    leads = ["lead", *(f"l{i}" for i in range(LEADERS))]
    placed = scratch.keep(dealt.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    own = [F.max(F.when(F.col("key") == F.col(x), F.col("root"))).alias(f"{x}_root") for x in leads]
    mixed = placed.groupBy("bucket").agg(F.first("n").alias("held"), F.min("root").alias("least"), F.max("root").alias("most"), *own).where("least <> most").drop("least", "most")
    undone = scratch.keep(_bucketed(placed, scratch.keep(mixed), "held", placed.count()))
    small = undone.where(F.col("n").between(3, SMALL_BUCKET)).groupBy("bucket").agg(F.collect_list(F.struct("key", "root")).alias("all"))
    inner = small.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where("x.key < y.key AND x.root <> y.root").select(F.col("y.key").alias("a"), F.col("x.key").alias("b"))
    large = undone.where(F.col("n") > SMALL_BUCKET)
    for x in leads:
        inner = inner.unionByName((undone if x == "lead" else large).where(f"key <> {x} AND root <> {x}_root").select(*ordered("key", x)))
    more = scratch.keep(inner.distinct().join(nearest, ["a", "b"], "left_anti"))
    edges = lambda: roots.select(F.col("key").alias("a"), F.col("root").alias("b"))
    roots = components(edges().unionByName(_verified(more, texts, threshold)), scratch)
    rest = scratch.keep(_rest(large, roots, texts, threshold, scratch))
    if not rest.isEmpty():
        roots = components(edges().unionByName(rest.mapInArrow(_stars, "a binary, b binary")), scratch)
    found = reps.join(roots, "key", "left").select("key", "rep_id", F.coalesce("root", "key").alias("root"))
    heads = found.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "key")).alias("head"))
    table = found.join(heads, "root").select("key", "class_id", "rep_id", (F.col("key") == F.col("head.key")).alias("heads"))
    mine = table.select(F.col("key").alias("__key"), F.col("class_id").alias("__class"), "rep_id", "heads")
    joined = rows_.join(mine, F.col("has") & (F.col("key") == F.col("__key")), "left")
    return joined.select(
        "id", "key", F.when(F.col("has"), F.col("__class")).otherwise(F.col("id")).alias("class_id"),
        (~F.col("has") | (F.col("heads") & F.col("id").eqNullSafe(F.col("rep_id")))).alias("rep"),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of every class; of equal rows that stand for it, one stays. Rows without words all stay."""
    found = classes(docs, text, doc_id, **options).where("rep").select(F.col("key").alias("__key"), F.col("id").alias("__id")).distinct()
    keyed = docs.withColumn("__k", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    same = F.coalesce(F.col(doc_id).cast("long") == F.col("__id"), F.col(doc_id).isNull() & F.col("__id").isNull())
    kept = keyed.join(found, F.col("__k") == F.col("__key")).where(same).drop("__key", "__id")
    wordless = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) == 0
    once = kept.where(~wordless).dropDuplicates(["__k"])
    return once.unionByName(kept.where(wordless)).drop("__k")
