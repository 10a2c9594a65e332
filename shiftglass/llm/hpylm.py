"""Language-model scoring: a hierarchical Pitman-Yor bigram model sampled by Gibbs.

Restaurants: one per context (the word before), all sharing one parent, the word
restaurant, whose own parent is uniform over the vocabulary. A table in a context
restaurant is a customer of the parent. A sweep re-seats every (context, word) group from
its conditional, given the other tables of its context and the parent without the group's
own customers, then re-seats the parent. All groups move at once, as in distributed Gibbs
sampling; after a burn-in, every sweep's state of both levels is a draw, and the predictive
probabilities of the draws are averaged.

Nothing is keyed by word in the shuffles, so that no word can be hot: documents are held
in batches of tokens, whose words are numbered in the order of their hashes first; then a
batch sends each of its distinct bigrams once, with its own count, to hash ranges of bigrams. A range holds each bigram of the corpus once. Those of one customer
have one table for good; a sweep reads and rewrites the others only, and exchanges tables
with hash ranges of words, which know each range's words from its first report. Of a draw
the words' totals are stored once, not for every range. In the end
every range adds up the draws and answers the batches in the order asked. All draws derive
from the bigrams' places, so that reruns repeat them.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import END_TOKEN, U, Scratch, flat, freed, mix, pack, slices, word_hashes

BATCH_TOKENS = 3 << 19
RANGE_KEYS = 2_000_000
THETA = 1.0
BURN_IN = 3
DRAWS = 4
EXACT = 256
GRID = 64


# --------------------------------------------------------------------------- seatings
@functools.lru_cache(8)
def stirling(d: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat c customers at t tables."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(1, n + 1)
    for c in range(n):
        stay = c - d * t
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.where((t <= c) & (stay > 0), s[c, 1:] + np.log(np.maximum(stay, 1e-300)), -np.inf))
    return s


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, np.float64)
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """``stirling`` for many customers: a saddle-point value of the generating function ((1 - (1 - x)^d) / d)^t c! / t!."""
    goal = np.log(c / t)
    y = np.maximum((goal - math.log(d)) / (1 - d), 2 * goal / (1 - d + 1e-9) * 0.5 + 1e-9)
    for _ in range(40):
        a, b = np.expm1(y), np.expm1(d * y)
        h = -np.log1p(1 / a) + (1 - d) * y + math.log(d) + np.log1p(1 / b)
        step = (h - goal) / (1 / a + (1 - d) - d / b)
        y = np.clip(y - step, y / 4, y * 4)
        if np.all(np.abs(step) <= 1e-10 * (1 + y)):
            break
    a, b = np.expm1(y), np.expm1(d * y)
    spread = c * (1 / a + (1 - d) - d / b) * a
    return lgamma(c + 1.0) - lgamma(t + 1.0) + t * (-np.log1p(1 / b) - math.log(d)) + c * np.log1p(1 / a) - 0.5 * np.log(2 * math.pi * spread)


@functools.lru_cache(8)
def shortfall(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(t / c^d), and what ``saddle`` lacks there: it depends on that ratio alone, and falls in a line below it."""
    t = np.arange(1.0, EXACT // 2)
    lacks = stirling(d)[EXACT, 1 : len(t) + 1] - saddle(np.full(len(t), float(EXACT)), t, d)
    at = np.log(t) - d * math.log(EXACT)
    slope = (lacks[1] - lacks[0]) / (at[1] - at[0])
    return np.concatenate([[at[0] - 60], at]), np.concatenate([[lacks[0] - 60 * slope], lacks])


def log_weight(t: np.ndarray, c, rest, p, e, d: float, theta: float) -> np.ndarray:
    """Unnormalised log probability of ``t`` tables of ``c`` customers, for many customers."""
    w = saddle(c, t, d) + np.interp(np.log(t) - d * np.log(c), *shortfall(d))
    r = theta / d + rest
    w = w + t * math.log(d) + lgamma(r + t) - lgamma(r)
    return w + (t * np.log(p) if e is None else lgamma(p * e + t) - lgamma(p * e) - lgamma(e + t) + lgamma(e))


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    return (mix(keys + U((salt * 0x9E3779B97F4A7C15) % 2**64)) >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def seat(c: np.ndarray, rest: np.ndarray, p: np.ndarray, keys: np.ndarray, d: float, theta: float, salt: int, e: np.ndarray | None = None) -> np.ndarray:
    """Tables of groups of ``c`` equal customers, the other tables of their restaurant and parent given.

    ``p`` is the parent's probability of the group's word; with ``e``, the parent's customers
    and strength, it grows with every table: (p e + k) / (e + k). Up to ``EXACT`` customers
    t is drawn from the weights themselves, above from their saddle-point values around the
    mode (log-concave in t), all of them or, if they spread over more than ``GRID``, in steps.
    """
    t = np.minimum(c, 1)
    lows = [2 << i for i in range((EXACT).bit_length() - 1)]
    table = stirling(d)
    for lo in lows:
        band = np.flatnonzero((c >= lo) & (c < 2 * lo) & (c <= EXACT))
        for part in np.array_split(band, max(1, len(band) * lo >> 19)):
            if not len(part):
                continue
            k = np.arange(1, int(c[part].max()) + 1)
            logs = table[c[part][:, None], k] + np.cumsum(np.log(theta + d * (rest[part, None] + k - 1)), axis=1)
            if e is None:
                logs += k * np.log(p[part, None])
            else:
                logs += np.cumsum(np.log(((p * e)[part, None] + k - 1) / (e[part, None] + k - 1)), axis=1)
            weights = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
            t[part] = 1 + (weights < uniform(keys[part], salt)[:, None] * weights[:, -1:]).sum(1)
    every = np.flatnonzero(c > EXACT)
    for big in np.array_split(every, max(1, len(every) >> 12)):
        if not len(big):
            continue
        n = c[big].astype(np.float64)
        given = (rest[big], p[big], None if e is None else e[big])
        value = lambda x, rows=slice(None): log_weight(x, n[rows], given[0][rows], given[1][rows], None if e is None else given[2][rows], d, theta)  # noqa: E731, B023

        def first(low, high, holds):
            """The smallest t from ``low`` to ``high`` that ``holds``, which it does from there on."""
            low, high = low.copy(), high.copy()
            while (open_ := low < high).any():
                rows = np.flatnonzero(open_)
                mid = np.floor((low[rows] + high[rows]) / 2)
                ok = holds(mid, rows)
                high[rows], low[rows] = np.where(ok, mid, high[rows]), np.where(ok, low[rows], mid + 1)
            return low

        mode = first(np.ones(len(big)), n - 1, lambda x, rows: value(x + 1, rows) <= value(x, rows))
        least = value(mode) - 40
        start = first(np.ones(len(big)), mode, lambda x, rows: value(x, rows) >= least[rows])
        last = first(mode, n - 1, lambda x, rows: value(x + 1, rows) < least[rows])
        step = np.ceil((last - start + 1) / GRID)
        at = start[:, None] + step[:, None] * np.arange(GRID)
        spread = lambda x: np.repeat(x, GRID)
        centre = np.minimum(at + (step[:, None] - 1) / 2, (n - 1)[:, None])
        logs = log_weight(centre.ravel(), spread(n), spread(given[0]), spread(given[1]), None if e is None else spread(given[2]), d, theta).reshape(at.shape)
        logs = np.where(at <= last[:, None], logs, -np.inf)
        weights = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
        chosen = (weights < uniform(keys[big], salt)[:, None] * weights[:, -1:]).sum(1)
        x = at[np.arange(len(big)), chosen] + np.floor(step * uniform(keys[big], salt + (1 << 32)))
        t[big] = np.clip(x, 1, n).astype(t.dtype)
    return t


# --------------------------------------------------------------------------- batches
BATCH = "batch long, tokens long, ids binary, known binary, sizes binary, learn binary, words binary, text binary"


def batches(docs: DataFrame, text: str, doc_id: str, learn: str, batch_tokens: int) -> DataFrame:
    """Rows of about ``batch_tokens`` tokens: distinct words, the most frequent first, and each token's place among them, in planes."""
    picked = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(learn).alias("l"), F.col(text).alias("t"))

    def run(source):
        base, number, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def batch():
            ids, known, sizes, learn, h = (np.concatenate(x) for x in zip(*held))
            words, text, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            row = [base + number, len(h), pack(ids), pack(known), pack(sizes), pack(learn), pack(words[order]), planes(turned(order)[text].astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=[x.split()[0] for x in BATCH.split(", ")])

        for b in slices(source, "t", 2 << 20):
            h, n = word_hashes(*flat(b.column("t")), lower=True)
            ends = np.cumsum(n)
            h = np.insert(h, ends, END_TOKEN)
            ids = b.column("i")
            held.append((np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_valid()), n + 1, np.asarray(b.column("l").fill_null(False)), h))
            size += len(h)
            if size >= batch_tokens:
                yield batch()
                number, held, size = number + 1, [], 0
        if held:
            yield batch()

    return picked.mapInArrow(run, BATCH)


class Batch:
    """A batch's arrays and its distinct bigrams by range of their keys and, within, by words."""

    def __init__(self, t: pa.Table, ranges: int):
        get = lambda name, kind: np.frombuffer(t.column(name)[0].as_py(), kind)
        words, self.sizes = get("words", np.uint64), get("sizes", np.int64)
        order = np.argsort(words)
        self.words, self.text = words[order], turned(order)[level(t.column("text")[0].as_py(), np.int32)].astype(np.int32)
        self.learn, self.ids, self.known = get("learn", bool), get("ids", np.int64), get("known", bool)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        before = np.empty_like(self.text)
        before[1:] = self.text[:-1]
        before[self.starts] = self.text[ends - 1]  # a text starts in the end token's context
        code = before.astype(np.int64) * len(self.words) + self.text
        learnt = np.repeat(self.learn, self.sizes)
        code, self.pair, n = np.unique(code, return_inverse=True, return_counts=True)
        count = np.bincount(self.pair[learnt], minlength=len(code))
        left, right = code // len(self.words), code % len(self.words)
        place = np.searchsorted(bounds(ranges), bigram_keys(self.words[left], self.words[right]), side="right")
        self.order = np.argsort(place, kind="stable")
        self.count, self.left, self.right = count[self.order], left[self.order], right[self.order]
        at = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=ranges))]).tolist()
        self.parts = [(p, a, b) for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        self.learnt = np.bincount(self.text[learnt], minlength=len(self.words))


def bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U(0xFF51AFD7ED558CCD) + right)


def bounds(ranges: int) -> np.ndarray:
    """First keys of equal ranges of 64-bit keys, but the first."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def cuts(keys: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys, none empty; ``firsts``: the ranges' first keys, but the first."""
    at = np.searchsorted(keys, firsts)
    return [(p, int(a), int(b)) for p, (a, b) in enumerate(zip([0, *at], [*at, len(keys)])) if b > a]


def rising(x: np.ndarray) -> bytes:
    """Numbers in order, by their differences."""
    return count32(np.diff(x, prepend=0))[0]


def risen(raw: bytes) -> np.ndarray:
    return np.cumsum(counts(raw), dtype=np.int64)


def narrow(x: np.ndarray) -> bytes:
    """Numbers of a list in 2 or 4 bytes each."""
    return pack(x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32))


def wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(list(x), kinds[k]) for (_, k), x in zip(fields, zip(*rows))] if rows else [pa.array([], kinds[k]) for _, k in fields], names=[n for n, _ in fields])


def joined(t: pa.Table, name: str, kind) -> np.ndarray:
    """The arrays of a column's rows as one."""
    return np.concatenate([unsqueezed(r.as_py(), kind) for r in t.column(name)]) if len(t) else np.zeros(0, kind)


def turned(order: np.ndarray) -> np.ndarray:
    """Where a permutation puts 0, 1, ..."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers plane by plane, all first bytes, then all second ones, ...: small ones leave planes of zeros, which compress to nothing."""
    return pack(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)


def level(raw: bytes, kind) -> np.ndarray:
    """``planes`` turned back."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers of 4 bytes packed: how many, then their planes, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(planes(x), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, kind) -> np.ndarray:
    return level(pa.decompress(raw[8:], 4 * int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


def count32(*arrays: np.ndarray) -> tuple[bytes, ...]:
    """Counts, most of them small, packed."""
    return tuple(squeezed(a.astype(np.uint32)) for a in arrays)


def counts(raw: bytes) -> np.ndarray:
    return unsqueezed(raw, np.uint32)


# --------------------------------------------------------------------------- ranges of bigrams and of words
ASK = "part int, batch long, words binary, left binary, right binary, n binary"
HELD = "kind int, part int, batch long, left binary, right binary, c binary, t binary, at binary, down binary, sent binary, place binary, word_part int, keys binary"
FULL, PLACE, MANY, REPORT = range(4)
SEEN = "batch long, part int, seen binary, place binary, a long, b long, words long"
WORDS = "part int, word_part int, place binary, customers binary"
STATE = "part int, word_part int, tables binary, sent binary, own binary, s long, o long, ones long, twos long"
DRAW = "part int, word_part int, draw int, tables binary, sent binary, own binary"


def held_table(rows: list[dict]) -> pa.Table:
    names = [x.split()[0] for x in HELD.split(", ")]
    return table_of(HELD, [tuple(r.get(n) for n in names) for r in rows])


def gather(t: pa.Table) -> pa.Table:
    """One range's bigrams and words out of all batches' requests, and each batch's places among the bigrams."""
    words = [risen(x.as_py()) for x in t.column("words")]
    n = [counts(x.as_py()) for x in t.column("n")]
    every = np.unique(np.concatenate(words))
    code = []
    for w, k, left, right in zip(words, n, t.column("left"), t.column("right")):
        own = np.searchsorted(every, w)
        code.append(own[risen(left.as_py())] * len(every) + own[wide(right.as_py(), len(k))])
    code, at = np.unique(np.concatenate(code), return_inverse=True)
    c, part = np.bincount(at, np.concatenate(n), len(code)).astype(np.int64), t.column("part")[0].as_py()
    rows = [{"kind": FULL, "part": part, "keys": rising(every), **dict(zip(("left", "right", "c"), count32(code // len(every), code % len(every), c)))}]
    rows += [{"kind": PLACE, "part": part, "batch": b, "place": rising(at[e - len(k) : e])} for b, k, e in zip(t.column("batch").to_pylist(), n, np.cumsum([len(k) for k in n]))]
    return held_table(rows)


def opening(starts: np.ndarray):
    """A range's bigrams of many customers, a table each, and its first report, which tells its words."""

    def run(t: pa.Table) -> pa.Table:
        left, right, c = (joined(t, x, np.uint32).astype(np.int64) for x in ("left", "right", "c"))
        every, part = risen(t.column("keys")[0].as_py()), t.column("part")[0].as_py()
        one, many = c == 1, np.flatnonzero(c > 1)
        cut, count = cuts(every, starts[1:-1]), lambda side: np.bincount(side[one], minlength=len(every))
        groups = Many(part, many, left[many], right[many], c[many], np.ones(len(many), np.int64), count(left), count(right), cut)
        customers = np.bincount(left, c, len(every))
        return held_table(groups.rows([{"keys": rising(every[a:b] - starts[p]), "c": count32(customers[a:b])[0]} for p, a, b in cut]))

    return run


class Many:
    """A range's bigrams of two customers or more: places among all, words, customers and tables; per word the tables of all others."""

    def __init__(self, part: int, at, left, right, c, t, down, sent, cut):
        self.part, self.at, self.left, self.right, self.c, self.t, self.down, self.sent, self.cut = part, at, left, right, c, t, down, sent, cut

    @staticmethod
    def read(t: pa.Table) -> "Many":
        get = lambda name: counts(t.column(name)[0].as_py()).astype(np.int64)
        cut = [tuple(x) for x in get("keys").reshape(-1, 3).tolist()]
        return Many(t.column("part")[0].as_py(), *(get(x) for x in ("at", "left", "right", "c", "t", "down", "sent")), cut)

    def rows(self, first: list[dict] | None = None) -> list[dict]:
        """The groups as a row, and for each range of words a report of the tables in their restaurants and of them; the ``first`` one tells the words."""
        n = len(self.down)
        down, sent = self.down + np.bincount(self.left, self.t, n), self.sent + np.bincount(self.right, self.t, n)
        names = ("at", "left", "right", "c", "t", "down", "sent", "keys")
        mine = {"kind": MANY, "part": self.part, **dict(zip(names, count32(self.at, self.left, self.right, self.c, self.t, self.down, self.sent, np.array(self.cut).reshape(-1))))}
        return [mine, *({"kind": REPORT, "part": self.part, "word_part": p, **(first[i] if first else {}), **dict(zip(("down", "sent"), count32(down[a:b], sent[a:b])))} for i, (p, a, b) in enumerate(self.cut))]

    def reseat(self, x: "Totals", d: float, salt: int) -> None:
        """New tables of every group."""
        sent = x.sent[self.right] - self.t  # the parent without the group
        weight = sent - x.sums["d"] * np.minimum(x.own[self.right], sent) + x.base
        e = THETA + x.sums["s"] - self.t
        keys = mix((self.at + (self.part << 36)).astype(np.uint64))
        self.t = seat(self.c, x.tables[self.left] - self.t, weight / e, keys, d, THETA, salt, e)


class Totals:
    """A range's words in one state: tables as contexts, the parent's customers and tables of them."""

    def __init__(self, answers: pa.Table, sums: dict, v: int):
        answers = answers.sort_by("word_part")
        self.tables, self.sent, self.own = (joined(answers, x, np.uint32).astype(np.float64) for x in ("tables", "sent", "own"))
        self.sums, self.base = sums, (THETA + sums["d"] * sums["o"]) / (v + 1)

    def predict(self, left, right, c, t, customers, d: float) -> np.ndarray:
        """Predictive probability of every bigram."""
        parent = (self.sent - self.sums["d"] * self.own + self.base) / (THETA + self.sums["s"])
        return (c - d * t + (THETA + d * self.tables[left]) * parent[right]) / (THETA + customers[left])


def contexts(starts: np.ndarray):
    """Each range's places among the words of one word range, and these words' customers as contexts, out of all first reports."""

    def run(t: pa.Table) -> pa.Table:
        number = t.column("word_part")[0].as_py()
        places = [risen(x.as_py()) for x in t.column("keys")]
        customers = np.bincount(np.concatenate(places), joined(t, "c", np.uint32), starts[number + 1] - starts[number])
        return table_of(WORDS, [(part, number, k.as_py(), *count32(customers[i])) for part, k, i in zip(t.column("part").to_pylist(), t.column("keys"), places)])

    return run


def add_words(salt: int, v: int, d: float, tables: float, starts: np.ndarray):
    """Adds up what all ranges report of the words of one word range, and seats the parent restaurant.

    The row without a part has the totals of all words of the word range, the others those of a range's words.
    """

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        number = (t if len(t) else known).column("word_part")[0].as_py()
        n, own = int(starts[number + 1] - starts[number]), t.filter(pc.is_null(t.column("part")))
        t = t.filter(pc.is_valid(t.column("part")))
        by_part = {p: risen(x.as_py()) for p, x in zip(known.column("part").to_pylist(), known.column("place"))}
        places = [by_part[p] for p in t.column("part").to_pylist()]
        before = joined(own, "sent", np.uint32).astype(np.float64) if len(own) else np.zeros(n)
        at = np.concatenate(places)
        down, sent = (np.bincount(at, joined(t, x, np.uint32), n).astype(np.int64) for x in ("down", "sent"))
        own = seat(sent, np.maximum(tables - before, 0), np.full(n, 1 / (v + 1)), np.arange(n, dtype=np.uint64) + U(number << 36), d, THETA, salt)
        out = [(None, number, *count32(down, sent, own), int(sent.sum()), int(own.sum()), int((sent == 1).sum()), int((sent == 2).sum()))]
        out += [(part, number, *count32(down[i], sent[i], own[i]), *[None] * 4) for part, i in zip(t.column("part").to_pylist(), places)]
        return table_of(STATE, out)

    return run


def told(own: pa.Table, known: pa.Table) -> pa.Table:
    """The totals of one word range's words in some draws, for every range that has of them."""
    out = []
    for i, number, draw in zip(range(len(own)), own.column("word_part").to_pylist(), own.column("draw").to_pylist()):
        totals = [counts(own.column(x)[i].as_py()) for x in ("tables", "sent", "own")]
        for part, place in zip(known.column("part").to_pylist(), known.column("place")):
            at = risen(place.as_py())
            out.append((part, number, draw, *count32(*(x[at] for x in totals))))
    return table_of(DRAW, out)


# --------------------------------------------------------------------------- the model
class Model:
    """Counts and seatings of the batches of one table, scored in ``score``."""

    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", learn: str = "learn", batch_tokens: int = BATCH_TOKENS):
        self.spark, self.scratch, self.tables, self.draws = docs.sparkSession, Scratch(docs.sparkSession, "hpylm"), [], []
        # bucketed by batch: the answers are shuffled to the batches, never the batches themselves
        found = batches(docs, text, doc_id, learn, batch_tokens)
        self.store = self.saved(found, max(8 * docs.rdd.getNumPartitions(), 8), "batch")
        facts = self.store.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
        self.ranges = max(4, -(-(facts["tokens"] or 0) // RANGE_KEYS))
        self.word_ranges = max(4, self.ranges // 8)

    def saved(self, df: DataFrame, buckets: int, by: str) -> DataFrame:
        """A table of its own in the shared folder, bucketed."""
        name = f"hpylm_{uuid.uuid4().hex}"
        path = f"{self.scratch.root}/{name}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(min(buckets, 1 << 14), by).saveAsTable(name)
        out = self.spark.table(name)
        out.name, out.path = name, path
        self.tables.append(out)
        return out

    def forget(self, table: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        self.scratch.drop(table)
        self.tables.remove(table)

    def count_words(self) -> None:
        """N and V of the training tokens, and every batch's answer how often its words occur in them and which numbers they have."""
        k = self.word_ranges

        def ask(rows):
            for b in rows:
                for i in range(b.num_rows):
                    x, batch = Batch(pa.Table.from_batches([b.slice(i, 1)]), 1), b.column("batch")[i].as_py()
                    yield from table_of(ASK, [(p, batch, pack(x.words[lo:hi]), None, None, count32(x.learnt[lo:hi])[0]) for p, lo, hi in cuts(x.words, bounds(k))]).to_batches()

        def add(t: pa.Table) -> pa.Table:
            keys = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("words")]
            words, at = np.unique(np.concatenate(keys), return_inverse=True)
            seen, out = np.bincount(at, joined(t, "n", np.uint32), len(words)).astype(np.int64), []
            for batch, part, x, e in zip(t.column("batch").to_pylist(), t.column("part").to_pylist(), keys, np.cumsum([len(x) for x in keys])):
                mine = at[e - len(x) : e]
                out.append((batch, part, *count32(seen[mine]), rising(mine), *((int(seen.sum()), int((seen > 0).sum()), len(words)) if not out else [None] * 3)))
            return table_of(SEEN, out)

        self.seen = self.scratch.keep(self.store.mapInArrow(ask, ASK).groupBy("part").applyInArrow(add, SEEN))
        n = self.seen.agg(F.sum("a"), F.sum("b")).first()
        self.n, self.v = n[0] or 0, n[1] or 0
        sizes = np.zeros(k, np.int64)
        for r in self.seen.where("words IS NOT NULL").select("part", "words").collect():  # a row for each range of words
            sizes[r["part"]] = r["words"]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def count_bigrams(self) -> None:
        ranges, starts = self.ranges, self.starts

        def ask(t: pa.Table, seen: pa.Table) -> pa.Table:
            x, batch, seen, out = Batch(t, ranges), t.column("batch")[0].as_py(), seen.sort_by("part"), []
            numbers = np.concatenate([starts[p] + risen(x.as_py()) for p, x in zip(seen.column("part").to_pylist(), seen.column("place"))])
            for p, lo, hi in x.parts:
                mine, at = np.unique(np.concatenate([x.left[lo:hi], x.right[lo:hi]]), return_inverse=True)
                out.append((p, batch, rising(numbers[mine]), rising(at[: hi - lo]), narrow(at[hi - lo :]), count32(x.count[lo:hi])[0]))
            return table_of(ASK, out)

        asked = self.store.groupBy("batch").cogroup(self.seen.select("batch", "part", "place").groupBy("batch")).applyInArrow(ask, ASK)
        self.full = self.saved(asked.groupBy("part").applyInArrow(gather, HELD), 2 * ranges, "part").select("kind", "part", "batch", "left", "right", "c", "place", "keys")
        full = self.full.where(F.col("kind") == FULL)
        ones = full.select("c").mapInArrow(tally, "ones long, twos long").agg(F.sum("ones"), F.sum("twos")).first()
        self.d = discount(ones[0], ones[1])
        freed(self.spark)
        self.held = self.saved(full.groupBy("part").applyInArrow(opening(starts), HELD), 2 * ranges, "part")
        reports = self.held.where(F.col("kind") == REPORT).select("word_part", "part", "keys", "c")
        self.words = self.saved(reports.groupBy("word_part").applyInArrow(contexts(starts), WORDS), 2 * self.word_ranges, "word_part")
        self.first = self.words.select("part", "word_part", "customers")
        self.words_told = self.words.select("part", "word_part", "place").mapInArrow(lambda rows: numbers_of(rows, starts), "part int, word_part int, keys binary")

    def state(self, step: int) -> tuple[DataFrame, dict]:
        """The words' totals for every range, the parent re-seated."""
        last = self.sums[-1] if self.sums else {"d": 0.5, "o": float(self.v)}
        add = add_words(step << 33, self.v, last["d"], last["o"], self.starts)
        asked = self.held.where(F.col("kind") == REPORT).select("word_part", "part", "down", "sent")
        if self.sums:
            asked = asked.unionByName(self.own.select("word_part", "part", F.col("own").alias("sent")), allowMissingColumns=True)
        state = self.scratch.keep(asked.groupBy("word_part").cogroup(self.words.groupBy("word_part")).applyInArrow(lambda t, known: add(t, known), STATE))
        s, o, n1, n2 = (x or 0 for x in state.agg(*(F.sum(c) for c in ("s", "o", "ones", "twos"))).first())
        self.sums.append({"s": s, "o": o, "d": self.sums[0]["d"] if self.sums else discount(n1, n2)})
        # the parent's tables were seated with the discount of the first state from the second on
        return state, self.sums[-1]

    def groups(self) -> DataFrame:
        return self.held.where(F.col("kind") == MANY).select("part", "at", "left", "right", "c", "t", "down", "sent", "keys")

    def sample(self, burn_in: int = BURN_IN, draws: int = DRAWS) -> None:
        """``burn_in`` sweeps from one table a group on, then ``draws`` states, one sweep apart, which are kept.

        A group's discount is n1 / (n1 + 2 n2) of the bigrams seen once and twice, the
        parent's the same of its customers in the first state; strengths are ``THETA``.
        """
        self.count_words()
        freed(self.spark)
        self.count_bigrams()
        freed(self.spark)
        self.sums, self.kept, passed = [], [], None
        for step in range(1, burn_in + draws + 1):
            state, sums = self.state(step)
            if passed is not None:
                self.scratch.drop(passed)
            draw = F.lit(step - burn_in - 1).alias("draw")
            self.own = passed = self.scratch.keep(state.where("part IS NULL").select("part", "word_part", draw, "tables", "sent", "own"))
            if step > burn_in:
                mine = self.scratch.keep(self.groups().select("part", draw, *(["at"] if not self.kept else []), "t"))
                if not self.kept:
                    self.many = mine.select("part", "at")
                self.kept.append((sums, self.totals(self.own), mine.select("part", "draw", "t")))
                self.draws += [self.own, mine]
                passed = None  # the words' totals of a draw are kept
            old = self.held
            if step < burn_in + draws:
                answers, run = state.where("part IS NOT NULL").select("part", "word_part", "tables", "sent", "own"), sweep(self.d, sums, self.v, step << 33)
                self.held = self.saved(self.groups().groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, HELD), 2 * self.ranges, "part")
            self.forget(old)  # what the draws hold of it is kept apart
            self.scratch.drop(state)
            freed(self.spark)

    def totals(self, own: DataFrame) -> DataFrame:
        """The words' totals in some draws for every range."""
        return own.groupBy("word_part").cogroup(self.words.groupBy("word_part")).applyInArrow(told, DRAW)

    def score(self) -> DataFrame:
        """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

        Scores are log10 probabilities; perplexity is 10 to the power of -score / n_tokens. Null and
        empty texts hold the end token only. With nothing to learn from, both models are
        uniform over the one unknown word.
        """
        n, v, d, ranges, sums = self.n, self.v, self.d, self.ranges, [x for x, _, _ in self.kept]
        schema = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

        def answer(held: pa.Table, states: pa.Table) -> pa.Table:
            full, places = held.filter(pc.equal(held.column("kind"), FULL)), held.filter(pc.equal(held.column("kind"), PLACE))
            left, right, c = (joined(full, x, np.uint32).astype(np.int64) for x in ("left", "right", "c"))
            first = states.filter(pc.is_valid(states.column("customers"))).sort_by("word_part")
            customers, p = joined(first, "customers", np.uint32).astype(np.float64), 0.0
            many = joined(states.filter(pc.is_valid(states.column("at"))), "at", np.uint32)
            for i, s in enumerate(sums):
                mine, t = states.filter(pc.fill_null(pc.equal(states.column("draw"), i), False)), np.minimum(c, 1)
                t[many] = joined(mine.filter(pc.is_valid(mine.column("t"))), "t", np.uint32)
                p = p + Totals(mine.filter(pc.is_valid(mine.column("tables"))), s, v).predict(left, right, c, t, customers, d) / len(sums)
            logs, part = np.log10(p).astype(np.float32), full.column("part")[0].as_py()
            return table_of("batch long, part int, logs binary", [(b, part, squeezed(logs[risen(x.as_py())])) for b, x in zip(places.column("batch").to_pylist(), places.column("place"))])

        def run(t: pa.Table, c: pa.Table) -> pa.Table:
            x = Batch(t, ranges)
            c = c.sort_by("part")
            logs = np.empty(len(x.order))
            logs[x.order] = joined(c.filter(pc.is_valid(c.column("logs"))), "logs", np.float32)
            seen = joined(c.filter(pc.is_valid(c.column("seen"))), "seen", np.uint32).astype(np.int64)
            base = np.log10((seen + 0.5) / (n + 0.5 * (v + 1)))[x.text]
            add = lambda y: np.add.reduceat(y, x.starts)
            score = add(logs[x.pair])
            return pa.table({
                "doc_id": pa.array(x.ids, mask=~x.known), "learn": pa.array(x.learn), "n_tokens": pa.array(x.sizes), "n_known": pa.array(add((seen > 0)[x.text].astype(np.int64))),
                "train_tokens": pa.array(np.full(len(x.ids), n, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(score), "perplexity": pa.array(10.0 ** (-score / x.sizes)),
            })

        states = self.first.unionByName(self.many, allowMissingColumns=True)
        if self.kept:
            owns, groups = self.draws[::2], [x for _, _, x in self.kept]
            for more in (self.totals(functools.reduce(DataFrame.unionByName, owns)), *groups):
                states = states.unionByName(more, allowMissingColumns=True)
        answers = self.full.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(answer, "batch long, part int, logs binary")
        both = answers.unionByName(self.seen.select("batch", "part", "seen"), allowMissingColumns=True)
        return self.store.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(run, schema)

    def close(self) -> None:
        """Drops the model's tables; nothing can be scored afterwards."""
        for table in list(self.tables):
            self.forget(table)
        self.scratch.drop(self.seen, *self.draws)


def discount(n1, n2) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def sweep(d: float, sums: dict, v: int, salt: int):
    """Re-seats a range's groups, given a state."""

    def run(groups: pa.Table, answers: pa.Table) -> pa.Table:
        x = Many.read(groups)
        x.reseat(Totals(answers, sums, v), d, salt)
        return held_table(x.rows())

    return run


def numbers_of(rows, starts: np.ndarray):
    """Each range's words by their numbers in the corpus, 8 bytes each."""
    for b in rows:
        for i, p in enumerate(b.column("word_part").to_pylist()):
            yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([pack(starts[p] + risen(b.column("place")[i].as_py()))], pa.binary())], names=["part", "word_part", "keys"])


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the texts learnt from and of the others, over all their tokens."""
    return scored.groupBy("learn").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.sum("n_tokens").alias("n_tokens"))


def tally(rows):
    """How many bigrams were learnt once and twice."""
    for b in rows:
        c = [counts(r.as_py()) for r in b.column("c")]
        yield pa.RecordBatch.from_pydict({"ones": [int(sum((x == 1).sum() for x in c))], "twos": [int(sum((x == 2).sum() for x in c))]})
