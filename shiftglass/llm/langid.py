"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums, per language, how often each hashed n-gram occurs in all labelled texts
(one partial count vector per task, added per block of buckets); the resulting
log-probability matrix has ``buckets`` x languages cells and is the only thing that is
broadcast. Scoring turns each batch of texts into sparse n-gram hits and adds the matrix
rows of the hits text by text in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import U, mix, slices, widened

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
BLOCK = 1 << 12
STEP = 1 << 18
SMOOTHING = 0.1
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the text of each.

    Letters are lower-cased, any run of other ASCII characters counts as one blank, and a text
    starts and ends with a blank.
    """
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    p = np.concatenate(points) if points else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(points), dtype=np.int32), [len(x) for x in points])
    plain = (p < 128) & ~((p >= 97) & (p <= 122))
    again = np.zeros(len(p), bool)
    again[1:] = plain[1:] & plain[:-1] & (row[1:] == row[:-1])
    return np.where(plain, np.uint32(32), p)[~again], row[~again]


def grams(texts: list[str], step: int = STEP):
    """(buckets, texts) of all character n-grams, for at most ``step`` places at a time; a text's n-grams of an order come in order."""
    p, row = letters(texts)
    for i in range(0, len(p), step):
        h = np.zeros(min(step, len(p) - i), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(p) - i - n + 1]
            h = h * U(0x100000001B3) + p[i + n - 1 : i + n - 1 + len(h)].astype(np.uint64) + U(1)
            if n in ORDERS and len(h):
                r = row[i : i + len(h)]
                ok = r == row[i + n - 1 : i + n - 1 + len(h)]
                yield (mix(h[ok]) % U(BUCKETS)).astype(np.int64), r[ok]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = 4096) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probability matrix of buckets x languages) of all rows with a label.

    The matrix's last row holds the log priors. No rows with a label: no languages. A
    language takes ``BUCKETS`` cells of 4 bytes; of more labels than ``most_languages`` no
    matrix is made.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = "l string, block int, counts binary"

    def count(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in slices(batches, "t", 1 << 19):
            labels, texts = b.column("l").to_pylist(), b.column("t").to_pylist()
            names = sorted(set(labels))
            at = np.array([names.index(x) for x in labels])
            for g, r in grams(texts):
                m = np.bincount(at[r] * BUCKETS + g, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for i, x in enumerate(names):
                    total[x] = total.get(x, 0) + m[i]
            for i, x in enumerate(names):
                docs[x] = docs.get(x, 0) + int((at == i).sum())
        for x, m in total.items():
            k = BUCKETS // BLOCK
            yield pa.RecordBatch.from_pydict({"l": [x] * (k + 1), "block": pa.array(range(k + 1), pa.int32()), "counts": [*(m[i * BLOCK : (i + 1) * BLOCK].astype("<i8").tobytes() for i in range(k)), np.array([docs[x]], "<i8").tobytes()]})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in t.column("counts").to_pylist())
        return pa.table({"l": t.column("l")[:1], "block": t.column("block")[:1], "counts": pa.array([total.tobytes()])})

    found = rows.mapInArrow(count, schema).groupBy("l", "block").applyInArrow(add, schema)
    if (n := rows.agg(F.count_distinct("l")).first()[0]) > most_languages:
        raise ValueError(f"{n} languages are more than most_languages, {most_languages}")
    got = found.collect()
    langs = sorted({r["l"] for r in got})
    m, prior = np.zeros((BUCKETS, len(langs))), np.ones(len(langs))
    for r in got:
        x, j = np.frombuffer(r["counts"], "<i8"), langs.index(r["l"])
        if r["block"] == BUCKETS // BLOCK:
            prior[j] = x[0]
        else:
            m[r["block"] * BLOCK : (r["block"] + 1) * BLOCK, j] = x
    logs = np.log(m + SMOOTHING) - np.log(m.sum(0) + SMOOTHING * BUCKETS)
    return langs, np.vstack([logs, np.log(prior / prior.sum())[None]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` with lang_pred and score, the posterior of the predicted language.

    Null texts, texts without a letter and an empty model give ``und`` with score 0; equal
    posteriors go to the language first in code point order. Kept columns of the two names
    are replaced.
    """
    langs, matrix = model
    keep = tuple(k for k in keep if k not in ("lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    picked = docs.select(*keep, F.col(text).alias("__text"))
    schema = widened(picked.drop("__text"), "lang_pred string", "score double")

    def score(batches):
        m = shared.value
        for b in slices(batches, "__text", 1 << 19):
            texts = [x if x is not None and LETTER.search(x) else None for x in b.column("__text").to_pylist()]
            known = np.array([x is not None for x in texts]) & bool(langs)
            names, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if known.any():
                total = np.tile(m[-1].astype(np.float64), (int(known.sum()), 1))
                for g, r in grams([x for x, k in zip(texts, known) if k]):
                    if len(g):
                        first = np.flatnonzero(np.diff(r, prepend=-1))
                        total[r[first]] += np.add.reduceat(m[g], first, axis=0, dtype=np.float64)
                best = total.argmax(1)
                names[known] = np.array(langs, object)[best]
                score[known] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names[:-1]), pa.array(names, pa.string()), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return picked.mapInArrow(score, schema)


def remainder(doc_id: str, k: int):
    """crc32 of the id as text, modulo ``k``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % k, F.lit(0))
