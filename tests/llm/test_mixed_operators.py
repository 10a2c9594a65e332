"""Mixed packing, collocations and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shiftglass.llm import convtrie, mixpack, phrases
from shiftglass.llm.common import tokenizer_path

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "It's 2024, Été…", "x" * 9000, "many words " * 3000, "<|endoftext|> text <|endoftext|>", "tab\tnew\n\n  line\x0bvt\x1c\x85", "\U0001f600 你好   ﬁ", "don't  I'LL"]


# --------------------------------------------------------------------------- mixed packing
def reference_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_ids_are_the_tokenizers():
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(0x250)] + [*"‐–—…‘’“”"] + [*" \n\t'stremvdabc012"] * 12 + ["\U0001f600", "ﷺ", " ", "ก"]
    texts = ODD[1:] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    encode, kind = mixpack.byte_encoder(BYTE_BPE)
    assert [x.tolist() for x in encode(texts)] == reference_ids(texts) and kind.itemsize == 2


def check_packed(rows, texts, capacity):
    """Every id once, sequences gapless and full but for powers of two; the ids of each sequence's pieces."""
    want = {i: x for i, x in enumerate(reference_ids(texts))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["length"] > 0
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
    for i, x in want.items():
        at = 0
        for a, n in sorted(by_doc[i]):
            assert a == at
            at += n
        assert at == len(x)
    for x in by_seq.values():
        at = 0
        for o, n, _ in sorted(x, key=lambda p: p[0]):
            assert o == at
            at += n
        assert at == capacity or at & (at - 1) == 0
    return by_seq


@pytest.mark.parametrize("capacity, stripe, quantum", [(64, 1000, 8), (2048, 1 << 18, 64), (256, 700, 1)])
def test_mixed_sequences_hold_every_id_in_the_mix(spark, capacity, stripe, quantum):
    rng = random.Random(capacity)
    texts = [*ODD, *(" ".join(rng.choice("ab cd efg hijk".split()) for _ in range(rng.choice([3, 40, 400]))) for _ in range(150))]
    sources = [rng.choice(["big"] * 4 + ["mid", "mid", "low", None, ""]) for _ in texts]
    docs = spark.createDataFrame([(i, t, s, 7, "x") for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string, length int, __text string").repartition(5)
    rows = mixpack.pack(docs, BYTE_BPE, keep=("doc_id", "source"), capacity=capacity, stripe=stripe, quantum=quantum).collect()
    by_seq = check_packed(rows, texts, capacity)
    total, held = sum(len(x) for x in reference_ids(texts)), Counter()
    for x, s in zip(reference_ids(texts), sources):
        held[s] += len(x)
    assert len(by_seq) == total // capacity + bin(total % capacity).count("1")
    # at every window's end each source has had its share, but for a quantum, a round's order and a stripe's rounding
    had = Counter()
    for k in sorted(by_seq):
        for _, n, s in by_seq[k]:
            had[s] += n
        done = sum(had.values())
        assert all(abs(had[s] - done * held[s] / total) <= capacity + quantum + 6 for s in held)
    if capacity == 2048:
        mixes = [Counter({s: sum(n for _, n, x in by_seq[k] if x == s) for s in held}) for k in range(total // capacity)]
        assert all(abs(m[s] - capacity * held[s] / total) <= 2 * quantum + 2 for m in mixes[1:] for s in held)


def test_mixed_packing_of_targets_and_nothing(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("one two three".split()) for _ in range(100)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 3), ("b", 1)], "source string, weight int")
    by_seq = check_packed(mixpack.pack(docs, BYTE_BPE, keep=("doc_id", "source"), targets=targets, capacity=256, stripe=1024, quantum=16).collect(), texts, 256)
    share = [sum(n for _, n, s in by_seq[k] if s == "a") / 256 for k in range(10)]
    assert all(abs(x - 0.75) <= 0.15 for x in share)
    empty = mixpack.pack(docs.where("false"), BYTE_BPE)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    same = spark.createDataFrame([(1, "copy", "s")] * 40 + [(None, None, None)], "doc_id long, text string, source string")
    assert sum(r["length"] for r in mixpack.pack(same, BYTE_BPE).collect()) == 40 * 2 + 1
    with pytest.raises(ValueError):
        mixpack.pack(docs, BYTE_BPE, capacity=100)


def test_deficits_are_carried():
    sent = mixpack.rounds([[1000], [10] * 50, [300, 200]], window=100, quantum=7)
    assert Counter((q, i) for q, i, *_ in sent) and {(q, i): sum(n for a, b, _, n in sent if (a, b) == (q, i)) for q, i, *_ in sent} == {(0, 0): 1000, (2, 0): 300, (2, 1): 200, **{(1, i): 10 for i in range(50)}}
    had, done = [0, 0, 0], 0
    for q, _, _, n in sent:
        had[q] += n
        done += n
        assert all(abs(h - done * s / 2000) <= 107 for h, s in zip(had, (1000, 500, 500)))


# --------------------------------------------------------------------------- collocations
def brute_phrases(rows, most, least, inside, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n, cand = sum(x for p, x in c.items() if len(p) == 1), {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (q := p[i : i + k]) and 100 * a >= inside * c[q]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                s, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def test_collocations_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "AT_ONCE", 600)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(phrases, "RANK_GROUP", 20)
    rng = random.Random(4)
    word = lambda: rng.choice("the The of a é \x1cx   \U0001f600 'q' \"r".split(" ")) if rng.random() < 0.6 else f"w{rng.randrange(30)}"
    text = lambda: "".join(word() + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\r\n", "?! ", "\x0b"]) for _ in range(rng.randrange(40)))
    rows = [(rng.choice(["en", "en", "de", None, "und", "", "a\tb\nc"]), text()) for _ in range(300)]
    rows += [("en", "united states of mind")] * 40 + [("en", None), (None, None), ("en", ""), ("en", " . "), ("de", "of the of the of the " * 200)]
    docs = spark.createDataFrame([(i, t, lang, 3, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, piece string").repartition(3)
    for most, least, top in ((3, 10, 2000), (4, 5, 25), (2, 3, 7)):
        got = phrases.mine(docs, most=most, least=least, top=top)
        assert got.columns == ["grp", "rank", "phrase", "a", "l", "r", "n", "score"] and [t for c, t in got.dtypes if c not in ("grp", "phrase")] == ["bigint"] * 6
        assert Counter(tuple(r) for r in got.collect()) == brute_phrases(rows, most, least, 50, top)
    assert phrases.mine(docs.where("false")).count() == 0 and phrases.mine(docs.where("doc_id < 3")).count() == 0


def test_scores_of_large_counts_are_exact(spark, monkeypatch):
    """Products pass 64 bits: equal pieces stand for 10**12 occurrences each."""
    a, l, r = 3_000_000_000_001, 3_000_000_000_007, 4_000_000_000_019

    def many(docs, text, group):
        return spark.createDataFrame([("en", "x y", a), ("en", "x", l - a), ("en", "y", r - a)], "grp string, piece string, n long")

    monkeypatch.setattr(phrases, "pieces", many)
    got = phrases.mine(spark.range(1)).collect()
    assert [tuple(x) for x in got] == [("en", 1, "x y", a, l, r, l + r, 10**6 * a * a // (l * r))]


# --------------------------------------------------------------------------- the trie
def brute_trie(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = (*own.get(c - c % 20, [])[:h], *own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


CONVS = "conv_id long, turn long, role string, text string, depth int, id string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(convtrie, "IDS_AT_ONCE", 5)
    rng = random.Random(seed)
    said = ["hi", "hi there", "", None, "a b c", "tell\tme\x0bmore"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]) if seed else "user", rng.choice(said[: 2 + seed * 2])) for c in range(300) if c % 7 for t in range(rng.randrange(5))]
    rows += [(c, t, "user", "the same") for c in range(400, 600) for t in range(3)]  # a large group of copies
    rows += [(700, t, "user", "long") for t in range(60)] + [(None, 0, "user", "lost"), (901, 0, "u", "x"), (901, 0, "u", "x")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVS).repartition(4)
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = convtrie.trie(convtrie.rebuilt(convtrie.turns(df)))
            assert Counter(tuple(r) for r in got.collect()) == brute_trie(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing_and_of_turnless(spark):
    df = spark.createDataFrame([(c, 0, "user", "x", 1, "x") for c in (21, 22, 23)], CONVS)
    trie = lambda d: convtrie.trie(convtrie.rebuilt(convtrie.turns(d)))
    assert trie(df.where("false")).count() == 0
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    got = trie(spark.createDataFrame([(*r, 1, "x") for r in rows], CONVS))
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(rows)
    assert {t for _, t in got.dtypes} == {"bigint", "string"}


def test_stitching_keeps_sums():
    """All ways to cut sorted keys into tasks give the same nodes."""
    rng = random.Random(5)
    keys = sorted({b"".join(hashlib.md5(bytes([rng.randrange(3)])).digest() for _ in range(rng.randrange(6))) for _ in range(60)})
    rows = [(k, 100 - i, 1 + i % 3, list(range(len(k) // 16))) for i, k in enumerate(keys)]
    schema = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.int64()))])

    def nodes(cuts):
        done, left = [], []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            if a < b:
                for out in convtrie.sweep([pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[a:b]], schema=schema)]):
                    for r in out.to_pylist():
                        (left if r.pop("open") else done).append(r)
        return sorted((r["id"], *(r[c] for c in convtrie.SCHEMA.names)) for r in done + convtrie.stitch(pa.Table.from_pylist(left, schema=convtrie.SCHEMA)).to_pylist())

    whole = nodes([])
    for _ in range(40):
        assert nodes(sorted(rng.sample(range(1, len(rows)), rng.randrange(8)))) == whole
