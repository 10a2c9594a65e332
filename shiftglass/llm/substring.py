"""Substring dedup with a log-structured fingerprint index, batch by batch.

Every window of ``WIDTH`` words is represented in the index by the smallest of its
``GRAM``-word hashes, so equal windows meet and a run of windows shares one entry. A batch
of documents is merge-joined with the sorted immutable runs of the batches before, range
by range: keys that the history or the batch itself holds too are doubtful, and history's
own keys that were single till then are too, from now on. Then the batch's keys are added
as a run, and runs are compacted into one when there are ``FAN_OUT``. A second index of the
same kind holds a hash of all words of every doubtful window and tells which windows
really repeat. Both indexes and the batches' words lie in one folder and can be reopened.

Texts are held in parts of about ``PART_WORDS`` words, one packed row each, in tables
bucketed by part; a part asks for each of its keys once and is answered with those that
repeat. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import U, Scratch, flat, mix, pack, ranges, run_hashes, slices, word_hashes

WIDTH = 35
GRAM = 8
PART_WORDS = 2 << 20
RANGE_KEYS = 1_000_000
FAN_OUT = 2
BATCHES = 3

ASK = "range int, part long, keys binary, many binary"
RUN = "kind int, range int, keys binary, many binary"
REPEATED = "part long, range int, keys binary"
ADDED, CHANGED = 0, 1


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def windows(h: np.ndarray, sizes: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window within a document, its fingerprint, and the fingerprints' occurrences."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    inside = np.repeat(sizes, sizes) - ranges(sizes) >= width
    g = run_hashes(h, gram)
    span = width - gram + 1
    low = slide(g, span, np.minimum)
    low[~inside[:n]] = 0
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(len(g) - n, np.uint64)])
    chosen = (slide(padded, span, np.maximum) == g) & (g > 0)
    starts = np.flatnonzero(inside[:n])
    return starts, mix(low[starts]), mix(g[chosen])  # minima lie low; mixed, they spread over the ranges


def bounds(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def requests(part: int, keys: np.ndarray, parts: int) -> pa.Table:
    """A row per hash range that holds any: the distinct keys in order, and which occur more than once."""
    keys, n = np.unique(keys, return_counts=True)
    cut = np.searchsorted(keys, bounds(parts))
    rows = [(r, part, pack(keys[a:b]), pack(np.packbits(n[a:b] > 1))) for r, (a, b) in enumerate(zip([0, *cut], [*cut, len(keys)])) if b > a]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["range", "part", "keys", "many"])


def unpack(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("keys")]
    return keys, [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(k)].astype(bool) for x, k in zip(t.column("many"), keys)]


def merged(keys: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs as one: each key once, marked if any run marks it or two hold it. Runs are merged two by two."""
    runs = [(k, m) for k, m in zip(keys, many) if len(k)]
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    while len(runs) > 1:
        out = runs[len(runs) // 2 * 2 :]
        for (a, x), (b, y) in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(a, b)
            twice = a[np.minimum(at, len(a) - 1)] == b
            x = x.copy()
            x[at[twice]] = True
            place = at[~twice] + np.arange((~twice).sum())
            k, m = np.empty(len(a) + len(place), np.uint64), np.zeros(len(a) + len(place), bool)
            old = np.ones(len(k), bool)
            old[place] = False
            k[place], m[place], k[old], m[old] = b[~twice], y[~twice], a, x
            out.append((k, m))
        runs = out
    return runs[0]


def held_in(keys: np.ndarray, index: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a sorted run holds, and which it holds marked."""
    if not len(index):
        return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
    found = index[at] == keys
    return found, found & many[at]


def row_of(kind: int, range_: int, k: np.ndarray, m: np.ndarray) -> tuple:
    return kind, range_, pack(k), pack(np.packbits(m))


def run_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "range", "keys", "many"])


def absorb(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Merge-joins the requests of one range with its runs: the run to be added, and single keys of history that now repeat."""
    side = asked if len(asked) else held
    k, m = merged(*unpack(asked))
    index, many = merged(*unpack(held))
    found, marked = held_in(k, index, many)
    changed = k[found & ~marked]
    number = side.column("range")[0].as_py()
    return run_table([row_of(ADDED, number, k, m | found), row_of(CHANGED, number, changed, np.ones(len(changed), bool))])


def compact(held: pa.Table) -> pa.Table:
    return run_table([row_of(ADDED, held.column("range")[0].as_py(), *merged(*unpack(held)))])


def repeated(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Of each request of one range, the keys that the runs hold marked."""
    index, many = merged(*unpack(held))
    rows = []
    for part, number, key in zip(asked.column("part").to_pylist(), asked.column("range").to_pylist(), asked.column("keys")):
        k = np.frombuffer(key.as_py(), np.uint64)
        if (hit := held_in(k, index, many)[1]).any():
            rows.append((part, number, pack(k[hit])))
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["part", "range", "keys"])


class Index:
    """Sorted runs of keys in the shared folder, compacted when there are ``fan_out``."""

    def __init__(self, spark: SparkSession, root: str, parts: int, fan_out: int, state: dict | None = None):
        self.spark, self.root, self.parts, self.fan_out = spark, root, parts, fan_out
        self.state = state or {"runs": [], "changed": [], "asks": [], "made": 0}

    def _keep(self, df: DataFrame) -> str:
        self.state["made"] += 1
        path = f"{self.root}/{self.state['made']}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, asked: DataFrame) -> None:
        """Joins a batch's requests with history, then makes them a run."""
        path = self._keep(asked)
        found = self._keep(self._read([path], ASK).groupBy("range").cogroup(self.runs().groupBy("range")).applyInArrow(absorb, RUN))
        self.state["asks"].append(path)
        self.state["changed"].append(found)
        self.state["runs"].append(found)
        if len(self.state["runs"]) >= self.fan_out:
            self.state["runs"] = [self._keep(self.runs().groupBy("range").applyInArrow(compact, RUN))]

    def runs(self) -> DataFrame:
        return self._read(self.state["runs"], RUN).where(F.col("kind") == ADDED)

    def changed(self, batch: int) -> DataFrame:
        """Keys of the batches before that repeat since ``batch``."""
        return self._read(self.state["changed"][batch : batch + 1], RUN).where(F.col("kind") == CHANGED)

    def asks(self, batches: slice = slice(None)) -> DataFrame:
        return self._read(self.state["asks"][batches], ASK)

    @staticmethod
    def repeated(asked: DataFrame, held: DataFrame) -> DataFrame:
        return asked.groupBy("range").cogroup(held.groupBy("range")).applyInArrow(repeated, REPEATED)


# --------------------------------------------------------------------------- documents in parts
STORE = "part long, words long, ids binary, known binary, text binary, offsets binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string"


def parts_of(docs: DataFrame, text: str, doc_id: str, batch: int, part_words: int) -> DataFrame:
    picked = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))

    def run(source):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def part():
            ids, known, raw, sizes = (np.concatenate(x) for x in zip(*held))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            row = [(batch << 48) + (task << 24) + number, size, pack(ids), pack(known), pack(raw), pack(offsets)]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in STORE.split(", ")])

        for b in slices(source, "t", 2 << 20):
            raw, offs = flat(b.column("t"))
            _, n = word_hashes(raw, offs, lower=False)
            ids = b.column("i")
            held.append((np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_valid()), raw, np.diff(offs)))
            size += int(n.sum())
            if size >= part_words or sum(len(x[2]) for x in held) >= 16 * part_words:
                yield part()
                number, held, size = number + 1, [], 0
        if held:
            yield part()

    return picked.mapInArrow(run, STORE)


def words_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, word hashes and words per document of a part."""
    raw, offsets = np.frombuffer(t.column("text")[0].as_py(), np.uint8), np.frombuffer(t.column("offsets")[0].as_py(), np.int64)
    hashes, counts = [], []
    cuts = [0, *(np.flatnonzero(np.diff(offsets[:-1] >> 21)) + 1), len(offsets) - 1]  # hashed in parts to save memory
    for a, b in itertools.pairwise(cuts):
        h, n = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=False)
        hashes.append(h)
        counts.append(n)
    return raw, offsets, np.concatenate(hashes), np.concatenate(counts)


def keys_of(answers: pa.Table) -> np.ndarray:
    """All keys of a part's answers, sorted."""
    return np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in answers.column("keys")])) if len(answers) else np.zeros(0, np.uint64)


def among(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    return held_in(keys, sorted_keys, np.ones(len(sorted_keys), bool))[0]


class Corpus:
    """All batches of documents added so far: their words and the two indexes, in one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, ranges: int = 4, width: int = WIDTH, gram: int = GRAM, part_words: int = PART_WORDS, fan_out: int = FAN_OUT):
        """Opens the corpus in ``path``, or starts one there with ``ranges`` hash ranges (for each, about 8 million words at full size)."""
        self.spark, self.path = spark, path or Scratch(spark, "substring").root
        saved = self._saved()
        facts = saved or {"ranges": ranges, "width": width, "gram": gram, "part_words": part_words, "fan_out": fan_out, "stores": [], "prints": None, "windows": None}
        self.facts, self.width, self.gram = facts, facts["width"], facts["gram"]
        self.prints = Index(spark, f"{self.path}/prints", facts["ranges"], facts["fan_out"], facts["prints"])
        self.windows = Index(spark, f"{self.path}/windows", 4 * facts["ranges"], facts["fan_out"], facts["windows"])
        self.stores = [self._table(*s) for s in facts["stores"]]

    def _saved(self) -> dict | None:
        jvm = self.spark._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not log.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(log):
            return None
        return json.loads(self.spark.read.parquet(f"{self.path}/log").orderBy(F.desc("batches")).first()["facts"])

    def _table(self, path: str, buckets: int) -> DataFrame:
        name = f"substring_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({STORE}) USING parquet CLUSTERED BY (part) INTO {buckets} BUCKETS LOCATION '{path}'")
        out = self.spark.table(name)
        out.name = name
        return out

    def close(self) -> None:
        """Forgets the session's names of the tables; the folder stays."""
        for s in self.stores:
            self.spark.sql(f"DROP TABLE IF EXISTS {s.name}")

    def add(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        """One more batch: its windows are looked up in the history and become part of it."""
        batch, width, gram, prints, windows_ = len(self.stores), self.width, self.gram, self.prints.parts, self.windows.parts
        path, buckets, made = f"{self.path}/store/{batch}", max(8, min(8 * docs.rdd.getNumPartitions(), 1 << 14)), f"substring_{uuid.uuid4().hex}"
        parts_of(docs, text, doc_id, batch, self.facts["part_words"]).write.option("compression", "zstd").option("path", path).bucketBy(buckets, "part").saveAsTable(made)
        self.spark.sql(f"DROP TABLE {made}")
        self.facts["stores"].append((path, buckets))
        self.stores.append(self._table(path, buckets))

        def fingerprints(rows):
            for b in rows:
                for i in range(b.num_rows):
                    t = pa.Table.from_batches([b.slice(i, 1)])
                    _, _, h, n = words_of(t)
                    yield from requests(t.column("part")[0].as_py(), windows(h, n, width, gram)[2], prints).to_batches()

        def doubtful(t: pa.Table, answers: pa.Table) -> pa.Table:
            if not len(t) or not len(answers):
                return requests(0, np.zeros(0, np.uint64), windows_)
            _, _, h, n = words_of(t)
            starts, low, _ = windows(h, n, width, gram)
            ok = among(low, keys_of(answers))
            return requests(t.column("part")[0].as_py(), window_keys(h, starts[ok], low[ok], width), windows_)

        self.prints.add(self.stores[-1].mapInArrow(fingerprints, ASK))
        asked = None
        for b, store in enumerate(self.stores):
            held = self.prints.runs() if b == batch else self.prints.changed(batch)
            found = self.prints.repeated(self.prints.asks(slice(b, b + 1)), held)
            one = store.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(doubtful, ASK)
            asked = one if asked is None else asked.unionByName(one)
        self.windows.add(asked)
        facts = self.facts | {"prints": self.prints.state, "windows": self.windows.state}
        self.spark.createDataFrame([(batch, json.dumps(facts))], "batches int, facts string").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def results(self, digest: bool = False, since: int | None = None) -> DataFrame:
        """doc_id, n_words, n_removed and kept of all documents.

        With ``since``, only those of that batch and later ones, and earlier documents of
        which a window repeats since then.
        """
        width, gram = self.width, self.gram
        flagged = self.windows.repeated(self.windows.asks(), self.windows.runs()).withColumn("new", F.lit(False))
        if since is not None:
            for b in range(since, len(self.stores)):
                late = self.windows.repeated(self.windows.asks(slice(0, b)), self.windows.changed(b)).unionByName(self.windows.repeated(self.windows.asks(slice(b, b + 1)), self.windows.runs()))
                flagged = flagged.unionByName(late.withColumn("new", F.lit(True)))
        found = Scratch(self.spark, "substring-found").keep(flagged)

        def cut(always: bool):
            def run(t: pa.Table, answers: pa.Table) -> pa.Table:
                if not len(t):
                    return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
                raw, offsets, h, n = words_of(t)
                starts, low, _ = windows(h, n, width, gram)
                keys, total = window_keys(h, starts, low, width), int(n.sum())
                gone = covered(starts[among(keys, keys_of(answers.filter(pc.invert(answers.column("new")))))], width, total)
                fresh = None if always else covered(starts[among(keys, keys_of(answers.filter(answers.column("new"))))], width, total)
                ids, known = np.frombuffer(t.column("ids")[0].as_py(), np.int64), np.frombuffer(t.column("known")[0].as_py(), bool)
                text, out, at = raw.tobytes(), [], 0
                for i, ok, a, b, k in zip(ids.tolist(), known.tolist(), offsets[:-1], offsets[1:], n.tolist()):
                    if always or fresh[at : at + k].any():
                        words, mask = text[a:b].split(), gone[at : at + k]
                        lost = int(mask.sum())
                        kept = b" ".join(itertools.compress(words, (~mask).tolist()) if lost else words)
                        out.append((i if ok else None, k, lost, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
                    at += k
                return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

            return run

        out = None
        for b, store in enumerate(self.stores):
            mine = found.where(F.shiftright("part", 48) == b)
            one = store.groupBy("part").cogroup(mine.groupBy("part")).applyInArrow(cut(since is None or b >= since), RESULT)
            out = one if out is None else out.unionByName(one)
        return out


def window_keys(h: np.ndarray, starts: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """A hash of all words of the windows that start there."""
    return mix(run_hashes(h, width)[starts] ^ low) if len(starts) else np.zeros(0, np.uint64)


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` words the windows cover."""
    edge = np.bincount(starts, minlength=total + 1)[: total + 1] - np.bincount(starts + width, minlength=total + 1)[: total + 1]
    return np.cumsum(edge)[:-1] > 0


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, part_words: int = PART_WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one blank) of every row.

    With ``digest``, kept holds the SHA-256 of those words in lower-case hex instead.

    A word goes if a window of ``width`` words that covers it also starts elsewhere, in
    any document or its own. The rows come to the index in ``batches`` batches, dealt by a
    hash; the result is that of all at once. Null text has no words. Equal rows are
    separate documents. An empty table gives an empty table.
    """
    words = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 6
    corpus = Corpus(docs.sparkSession, None, max(4, words // (8 * RANGE_KEYS)), width, gram, part_words)
    dealt = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(batches))
    for b in range(batches):
        corpus.add(docs.where(dealt == b), text, doc_id)
    scratch = Scratch(docs.sparkSession, "substring-out")
    out = scratch.keep(corpus.results(digest))
    corpus.close()
    scratch.drop(corpus)
    return out
