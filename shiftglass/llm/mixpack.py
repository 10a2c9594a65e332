"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target proportions.

Documents of a source form a queue of token ids. A *stripe* is a stretch of the output in
which every queue is due a whole number of ids: up to stripe k queue s has had
floor((k * stripe * weight_s + phase_s) / weights) ids, so the remainder, its deficit, is
carried exactly from stripe to stripe and any stripe can be filled by any task. Within a
stripe the queues are served in turn, a round a window: each round adds the queue's share
of a window to its deficit, and the queue sends whole quanta (or the rest of a document)
while the deficit lasts; what is left is carried to the next window. The stripes' ids
follow each other without gaps and are cut into sequences; of the last, incomplete one
every binary digit of its length becomes a sequence of its own, so that nothing is padded.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, slices, widened
from .packing import BYTE_NAMES

CAPACITY = 2048
END_ID = 1
#: Ids of a stripe; a group of this many ids, two or four bytes each, is what one task holds at once.
STRIPE = 1 << 18
#: Ids a queue sends at least, if its document has so many left: smaller ones mix finer and cut more.
QUANTUM = 64
#: Characters whose classes no edition of Unicode has changed, so that all tokenizers part them alike.
SETTLED = re.compile("[^\x00-ɏ‐-‧]")


# --------------------------------------------------------------------------- ids
def byte_encoder(path: str):
    """A function from texts to arrays of ids, and the ids' type.

    ``path`` is a byte-level BPE file of the tokenizers library whose ids are its ranks. The
    same merges run by tiktoken give the same ids four times as fast; texts with characters
    outside ``SETTLED`` go through the tokenizers library itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    byte_of = {chr(b): b for b in range(256)} | {v: k for k, v in BYTE_NAMES.items()} | {"\u0120": 32}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in tok.get_vocab(with_added_tokens=False).items() if t not in special}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    kind = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if SETTLED.search(t):
                ids = tok.encode(t, add_special_tokens=False).ids
            else:
                ids = fast.encode(t, allowed_special="all", disallowed_special=())
            out.append(np.array([*ids, END_ID], kind))
        return out

    return encode, kind


def tokens(docs: DataFrame, tokenizer: str, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the queue, the ids (end id included) and where in its task's part of the queue they begin.

    Null text counts as empty; null is a source of its own.
    """
    picked = docs.select(*keep, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("__queue"), F.col(text).alias("__text"))
    schema = widened(picked.drop("__text"), "__part int", "__before long", "doc_tokens long", "__ids binary")

    def run(batches):
        encode, kind = byte_encoder(tokenizer)
        part, told = TaskContext.get().partitionId(), {}
        for b in slices(batches, "__text", 1 << 20):
            found = encode([t or "" for t in b.column("__text").to_pylist()])
            before = []
            for q, ids in zip(b.column("__queue").to_pylist(), found):
                at = told.get(q, 0)
                before.append(at)
                told[q] = at + len(ids)
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([part] * n, pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                names=schema.names,
            )

    return picked.mapInArrow(run, schema)


# --------------------------------------------------------------------------- stripes
def stripe_cut(schema, stripe: int, weights: int, width: int):
    """A function that cuts documents, placed in their queues, where stripes begin."""

    def run(batches):
        for b in batches:
            names = b.schema.names
            col = {c: b.column(c) for c in names}
            ids = col.get("__ids")
            row, at, start, length, part = [], [], [], [], []
            rest = zip(*(col[c].to_pylist() for c in ("__queue", "__first", "__before", "doc_tokens", "__weight")))
            for i, (q, first, before, n, weight) in enumerate(rest):
                phase, rate, x = zlib.crc32(q.encode()) * weights >> 32, stripe * weight, first + before
                end, a = x + n, x
                while a < end:
                    k = ((a + 1) * weights - phase - 1) // rate
                    stop = min(end, ((k + 1) * rate + phase) // weights)
                    row.append(i)
                    at.append(k)
                    start.append(a - x)
                    length.append(stop - a)
                    if ids is not None:
                        part.append(ids[i].as_buffer().slice((a - x) * width, (stop - a) * width).to_pybytes())
                    a = stop
            kept = b.select([c for c in names if c in schema.names and c not in ("__ids",)]).take(pa.array(row, pa.int64()))
            more = [pa.array(at, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more, *([pa.array(part, pa.binary())] if ids is not None else [])], names=schema.names)

    return run


def rounds(lengths: list[list[int]], window: int = CAPACITY, quantum: int = QUANTUM) -> list[tuple[int, int, int, int]]:
    """Deficit round-robin: pieces (queue, item, from, length) in the order they are sent.

    Every queue holds items of the given lengths; its share of a window is its share of all.
    """
    sizes = [sum(q) for q in lengths]
    total, out = sum(sizes), []
    deficit, item, sent = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    live = [s for s, n in enumerate(sizes) if n]
    while live:
        for s in live:
            deficit[s] += sizes[s] * window
            items = lengths[s]
            while item[s] < len(items):
                left = items[item[s]] - sent[s]
                if deficit[s] < min(quantum, left) * total:
                    break
                n = min(deficit[s] // total, left)
                if n:
                    if out and out[-1][:2] == (s, item[s]):
                        out[-1] = (s, item[s], out[-1][2], out[-1][3] + n)
                    else:
                        out.append((s, item[s], sent[s], n))
                deficit[s] -= n * total
                sent[s] += n
                if sent[s] == items[item[s]]:
                    item[s], sent[s] = item[s] + 1, 0
        live = [s for s in live if item[s] < len(lengths[s])]
    return out


def borders(total: int, capacity: int) -> np.ndarray:
    """Where the sequences of the incomplete window begin: one for every binary digit of its length."""
    at, left, out = total - total % capacity, total % capacity, []
    for bit in reversed(range(capacity.bit_length())):
        if left >> bit & 1:
            out.append(at)
            at += 1 << bit
    return np.array([*out, total], np.int64)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), targets: DataFrame | None = None,
         capacity: int = CAPACITY, stripe: int = STRIPE, quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: ``keep``, start, length, ids_crc32, doc_tokens, sequence_id and offset there.

    ``targets`` (source, weight: a positive integer) gives the mix, 1 where it is silent; by
    default each source weighs what it holds, so that all queues end together. A queue that
    ends earlier leaves its share to the others. ``capacity`` is a power of two. Null text
    counts as empty, null is a source of its own, repeated rows are documents of their own,
    an empty table gives an empty one.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    scratch = Scratch(docs.sparkSession, "mixpack")
    kept = scratch.keep(tokens(docs, tokenizer, text, source, keep))
    parts = kept.groupBy("__queue", "__part").agg(F.sum("doc_tokens").alias("__n"))
    earlier = Window.partitionBy("__queue").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__queue").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = parts.select("__queue", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"), F.sum("__n").over(whole).alias("__weight"))
    if targets is not None:
        asked = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("__queue"), F.col("weight").cast("long").alias("__asked"))
        asked = asked.groupBy("__queue").agg(F.greatest(F.max("__asked"), F.lit(1)).alias("__asked"))
        starts = starts.join(asked, "__queue", "left").withColumn("__weight", F.coalesce("__asked", F.lit(1).cast("long"))).drop("__asked")
    starts = scratch.keep(starts)
    weights, total = starts.select("__queue", "__weight").distinct().agg(F.sum("__weight")).first()[0] or 1, kept.agg(F.sum("doc_tokens")).first()[0] or 0
    placed = kept.join(starts, ["__queue", "__part"])
    width = byte_encoder(tokenizer)[1].itemsize

    light = placed.select("__queue", "__first", "__before", "doc_tokens", "__weight")
    cut = widened(light.select("__queue"), "__stripe long", "__start long", "__length long")
    sizes = light.mapInArrow(stripe_cut(cut, stripe, weights, width), cut).groupBy("__stripe").agg(F.sum("__length").alias("__n"))
    sizes = scratch.keep(sizes.withColumn("__block", F.shiftright("__stripe", 12)))
    up = Window.partitionBy("__block").orderBy("__stripe").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("__block").agg(F.sum("__n").alias("__all"))  # a row for 4096 stripes
    blocks = blocks.select("__block", F.coalesce(F.sum("__all").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    begins = sizes.withColumn("__to", F.coalesce(F.sum("__n").over(up), F.lit(0))).join(blocks, "__block").select("__stripe", (F.col("__to") + F.col("__base")).alias("__at"))

    cut = widened(placed.select(*keep, "__queue", "__first", "__before", "doc_tokens"), "__stripe long", "__start long", "__length long", "__part_ids binary")
    striped = placed.select(*keep, "__queue", "__first", "__before", "doc_tokens", "__weight", "__ids").mapInArrow(stripe_cut(cut, stripe, weights, width), cut)
    schema = widened(docs.select(*keep), "start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long")
    tail = borders(total, capacity)

    def serve(table: pa.Table) -> pa.Table:
        place = pa.table({"q": table.column("__queue"), "x": pa.array(np.asarray(table.column("__first")) + np.asarray(table.column("__before")))})
        table = table.take(pa.compute.sort_indices(place, [("q", "ascending"), ("x", "ascending")])).combine_chunks()
        length, start = np.asarray(table.column("__length")), np.asarray(table.column("__start"))
        queue = np.asarray(table.column("__queue").combine_chunks().dictionary_encode().indices)
        turn = np.flatnonzero(np.r_[True, np.diff(queue) != 0])
        sent = np.array(rounds([x.tolist() for x in np.split(length, turn[1:])], capacity, quantum), np.int64).reshape(-1, 4)
        row, offset, n = turn[sent[:, 0]] + sent[:, 1], sent[:, 2], sent[:, 3]
        # cut where sequences begin
        at = int(table.column("__at")[0].as_py())
        ends = at + np.cumsum(n)
        first, last = at, int(ends[-1])
        marks = np.arange(-(-first // capacity) * capacity, min(last, int(tail[0])) + 1, capacity)
        marks = np.unique(np.concatenate([ends - n, marks, tail]))
        marks = marks[(marks >= first) & (marks < last)]
        sizes = np.diff(np.append(marks, last))
        piece = np.searchsorted(ends, marks, side="right")
        row, offset = row[piece], offset[piece] + marks - (ends - n)[piece]
        # ids of the stripe, in the order of its rows
        raw = np.frombuffer(b"".join(table.column("__part_ids").to_pylist()), f"<u{width}").astype("<u4")
        home = np.cumsum(length) - length
        crc = [zlib.crc32(raw[a : a + k]) for a, k in zip((home[row] + offset).tolist(), sizes.tolist())]
        late = np.searchsorted(tail, marks, side="right") - 1
        sequence = np.where(late < 0, marks // capacity, tail[0] // capacity + late)
        inside = np.where(late < 0, marks % capacity, marks - tail[late])
        out = table.select(list(keep)).take(pa.array(row))
        more = [start[row] + offset, sizes, np.array(crc, np.int64), np.asarray(table.column("doc_tokens"))[row], sequence, inside]
        return pa.Table.from_arrays([*out.columns, *(pa.array(x, pa.int64()) for x in more)], names=schema.names)

    return striped.join(begins, "__stripe").groupBy("__stripe").applyInArrow(serve, schema)
