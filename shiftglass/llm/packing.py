"""Best-fit packing of token sequences: length patterns by non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` cells) reaches the driver. There,
patterns of up to three length classes that fill a sequence get repeat counts by NNLS, the
counts are rounded down, and what is left is packed best-fit decreasing into the gaps and
new sequences, still as "so many pieces of this length at this offset". That plan is
broadcast; pieces are ranked within their length and look their place up by rank.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, slices, widened

CAPACITY = 4096
END_ID = 1
QUANTUM = 16
CACHE_WORDS = 1_000_000
ENCODE_AT_ONCE = 4096
#: Closing punctuation that the tokenizer parts from the letters before it.
CLOSING = b".,!?;:"
RANK_GROUP = 100_000


# --------------------------------------------------------------------------- pieces
def word_encoder(path: str, most_words: int = CACHE_WORDS):
    """A function from texts to the little-endian 32-bit ids of their tokens.

    The tokenizer lower-cases, never joins text across ASCII white space, and parts letters
    from what follows them. So each word (in lower case unless it may hold a special
    token) is encoded once and remembered, closing punctuation apart; words of letters are
    encoded many at a time. The memory is emptied at ``most_words`` words (some 200 bytes each).
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tok, cache = Tokenizer.from_file(path), {}
    bare = Tokenizer(tok.model)  # its model alone, for words that normalisation would not change
    bare.pre_tokenizer = WhitespaceSplit()

    def learn_letters(words: list[bytes]) -> None:
        """Words that are one run of letters each, so that token i of word j says so."""
        for i in range(0, len(words), ENCODE_AT_ONCE):
            some = words[i : i + ENCODE_AT_ONCE]
            e = bare.encode(b" ".join(some).decode("latin-1").translate(BYTE_NAMES), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4").tobytes(), np.cumsum(np.bincount(e.word_ids, minlength=len(some))) * 4
            at = 0
            for w, end in zip(some, ends.tolist()):
                cache[w] = ids[at:end]
                at = end

    def learn_others(words: list[bytes]) -> None:
        for i in range(0, len(words), ENCODE_AT_ONCE):
            some = words[i : i + ENCODE_AT_ONCE]
            for w, e in zip(some, tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                cache[w] = np.array(e.ids, "<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        raws = [t.encode("utf-8", "replace") for t in texts]
        lists = [(r if b"<|" in r else r.lower()).split() for r in raws]
        new = set().union(*lists).difference(cache)
        if len(cache) + len(new) > most_words:
            cache.clear()
            new = set().union(*lists)
        parted = {}
        for w in new:
            stem = w.rstrip(CLOSING)
            if len(stem) < len(w) and stem and 97 <= stem[-1] <= 122:
                parted[w] = stem
        need = (new.difference(parted) | set(parted.values()) | {w[len(x) :] for w, x in parted.items()}).difference(cache)
        letters = [w for w in need if plain(w)]
        learn_letters(letters)
        learn_others(list(need.difference(letters)))
        for w, stem in parted.items():
            cache[w] = cache[stem] + cache[w[len(stem) :]]
        return [b"".join(map(cache.__getitem__, words)) for words in lists]

    return encode


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies name each byte by a printable character: itself, else those from 256 on in turn."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in itself]
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 32}


BYTE_NAMES = _byte_names()


def plain(word: bytes) -> bool:
    """One run of letters below U+0250 in lower case, which no normalisation changes."""
    if word.isalpha():
        return word.islower()  # ASCII
    t = word.decode()
    return t.isalpha() and max(t) < "\u0250" and t == t.lower()


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, with_ids: bool = False, most_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32 and, if asked, ids.

    A document is its token ids and an end id; null text counts as empty. Documents over
    ``capacity`` ids are cut into pieces of that many, the last may be shorter.
    """
    picked = docs.select(*keep, F.col(text).alias("__text"))
    schema = widened(picked.drop("__text"), "piece int", "start long", "length long", "ids_crc32 long", *["ids binary"] * with_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        encode = word_encoder(tokenizer, most_words)
        for b in slices(batches, "__text", 1 << 20):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(encode([t or "" for t in b.column("__text").to_pylist()])):
                x += end
                for k, a in enumerate(range(0, len(x), 4 * capacity)):
                    part = x[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            kept = b.select(b.schema.names[:-1]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])],
                names=schema.names,
            )

    return picked.mapInArrow(cut, schema)


# --------------------------------------------------------------------------- the plan
def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with x >= 0 by the active-set method."""
    n, ab = a.shape[1], a.T @ b
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        grad = ab - a.T @ (a @ x)
        grad[active] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= 1e-9 * max(1.0, float(b.max())):
            break
        active[j] = True
        while True:
            z = np.zeros(n)
            part = a[:, active]
            z[active] = np.linalg.solve(part.T @ part + 1e-9 * np.eye(part.shape[1]), ab[active])
            bad = active & (z <= 1e-12)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
        x = z
    return x


def patterns(classes: np.ndarray, top: int) -> list[tuple[int, ...]]:
    """All multisets of up to three of the classes whose sum is ``top``."""
    there, out = set(classes.tolist()), []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if left in there and (not prefix or left >= prefix[-1]):
            out.append((*prefix, left))
        if len(prefix) < 2:
            for c in there:
                if c >= (prefix[-1] if prefix else 1) and 2 * c <= left:
                    grow((*prefix, c), left - c)

    grow((), top)
    return out


class Plan:
    """Groups of equal sequences: how many, what is free in each, and their slots.

    A slot is (length, rank of the first group member's piece, offset).
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left, self.rank, self.capacity = dict(histogram), defaultdict(int), capacity
        self.closed: list[tuple[int, list]] = []
        self.open: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.spaces: list[int] = []

    def put(self, count: int, space: int, slots: list) -> None:
        if space and self.left:
            if not self.open[space]:
                bisect.insort(self.spaces, space)
            self.open[space].append((count, slots))
        else:
            self.closed.append((count, slots))

    def take(self, length: int, count: int) -> int:
        first = self.rank[length]
        self.rank[length] += count
        self.left[length] -= count
        return first

    def repeat(self, lengths: list[int], count: int) -> None:
        slots, at = [], 0
        for x in lengths:
            slots.append((x, self.take(x, count), at))
            at += x
        self.put(count, self.capacity - at, slots)

    def best_fit(self, length: int) -> None:
        while self.left[length]:
            n, i = self.left[length], bisect.bisect_left(self.spaces, length)
            if i == len(self.spaces):
                per = min(self.capacity // length, n)
                self.repeat([length] * per, n // per)
                continue
            space = self.spaces[i]
            count, slots = self.open[space].pop()
            if not self.open[space]:
                self.spaces.pop(i)
            used = min(n, count)
            if used < count:
                self.put(count - used, space, [(x, r + used, at) for x, r, at in slots])
            self.put(used, space - length, [*slots, (length, self.take(length, used), self.capacity - space)])

    def segments(self) -> tuple[np.ndarray, int]:
        """Rows (length, first rank, first sequence, offset) in order; number of sequences."""
        rows, at = [], 0
        for count, slots in [*self.closed, *(g for groups in self.open.values() for g in groups)]:
            rows += [(x, r, at, o) for x, r, o in slots]
            at += count
        return np.array(sorted(rows), np.int64).reshape(-1, 4), at


def plan(histogram: dict[int, int], capacity: int = CAPACITY, quantum: int = QUANTUM) -> tuple[np.ndarray, int]:
    """Places for all pieces of a histogram length -> count."""
    p = Plan(histogram, capacity)
    if p.left.get(capacity):
        p.repeat([capacity], p.left[capacity])
    by_class: dict[int, list[int]] = defaultdict(list)
    for x in sorted((x for x, n in p.left.items() if n), reverse=True):
        by_class[-(-x // quantum)].append(x)
    classes = np.array(sorted(by_class))
    found = patterns(classes, capacity // quantum) if len(classes) else []
    if found:
        a = np.zeros((len(classes), len(found)))
        for j, pattern in enumerate(found):
            for c in pattern:
                a[np.searchsorted(classes, c), j] += 1
        times = nnls(a, np.array([sum(p.left[x] for x in by_class[c]) for c in classes], float))
        for j in np.argsort(-times, kind="stable"):
            n = int(times[j] + 1e-6)
            while n:
                lengths, need = [], defaultdict(int)
                for c in found[j]:
                    x = next((x for x in by_class[c] if p.left[x] > need.get(x, 0)), None)
                    if x is None:
                        break
                    need[x] += 1
                    lengths.append(x)
                if len(lengths) < len(found[j]):
                    break
                k = min([n, *(p.left[x] // m for x, m in need.items())])
                p.repeat(sorted(lengths, reverse=True), k)
                n -= k
    for x in sorted((x for x, n in p.left.items() if n), reverse=True):
        p.best_fit(x)
    return p.segments()


# --------------------------------------------------------------------------- placing
def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (with a column length, 1 to ``capacity``) plus sequence_id and offset.

    Sequences hold ``capacity`` ids at most, without gaps. Rows of equal length are
    interchangeable; they are ranked within (length, salt), the salts' offsets come from
    counts. An empty table gives an empty table.
    """
    spark, scratch = found.sparkSession, Scratch(found.sparkSession, "pack")
    kept = scratch.keep(found.withColumn("__mark", F.xxhash64(*[F.col(c) for c in found.columns])))
    total = kept.count()
    salts = -(-max(total, 1) // RANK_GROUP)
    salted = kept.withColumn("__salt", F.pmod("__mark", F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(rows)
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__salt").orderBy("__mark")
    ranked = (
        salted.withColumn("__rank", F.row_number().over(within) - 1)
        .join(starts, ["length", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__first"))
        .select(*found.columns, "__rank")
    )
    schema = widened(found, "sequence_id long", "offset long")

    def place(batches):
        m = shared.value
        keys = m[:, 0] << 40 | m[:, 1]
        for b in batches:
            rank = b.column("__rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, b.column("length").to_numpy() << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m[at, 2] + rank - m[at, 1]), pa.array(m[at, 3])], names=schema.names)

    return ranked.mapInArrow(place, schema)
