"""Scoring, deduplication and language operators against brute force, with odd rows of every kind."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftglass.llm import hpylm, langid, linedup, probminhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, row long, key string, words string"


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choices(words, k=n))


def odd_rows():
    """Null, empty, blank and very long texts, equal rows, equal texts, null ids, clashing columns."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [None, "", "  \t\n ", "x" * 30000, base, base, base.replace("w7 ", "q7 ", 1), passage, prose(rng, 30) + " " + passage + "\n" + prose(rng, 20), ("la la la " * 400).strip(), prose(rng, 5), "one two", "one two", "été 你好 " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, base), (None, prose(rng, 50)), (None, None)]
    rows += [(100 + i, prose(rng, 40 + i)) for i in range(20)]
    return [(i, t, ("en", None, "de")[k % 3], ("s1", None)[k % 2], 3, 7, 0.5, 9, "k", "w") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().split()


# --------------------------------------------------------------------------- HPYLM
def test_hpylm_counts_and_base_scores(spark, docs, none):
    learn = (F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1).alias("learn")
    rows = docs.select("doc_id", "text", learn).collect()
    m = hpylm.Model(docs.withColumn("learn", learn), batch_tokens=500)
    m.sample()
    got = m.score().collect()
    m.close()
    tokens = [[w.lower() for w in split(r["text"])] + [b""] for r in rows]
    c = Counter(w for r, t in zip(rows, tokens) if r["learn"] for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r, t in zip(rows, tokens))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    m = hpylm.Model(none.withColumn("learn", F.lit(True)))
    m.sample()
    assert m.score().count() == 0


def test_hpylm_beats_the_base_on_held_out_text(spark):
    rng = random.Random(1)
    follow = {f"w{i}": [f"w{(7 * i + k) % 50}" for k in range(3)] for i in range(50)}

    def text():
        out = ["w0"]
        for _ in range(80):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, text(), i % 4 != 0) for i in range(80)], "doc_id long, text string, learn boolean")
    m = hpylm.Model(df, batch_tokens=700)
    m.sample()
    r = m.score().where("NOT learn").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] / r[2] > -0.75 and r[0] > r[1] + 0.5 * r[2]  # three equal followers: log10(1/3) = -0.48


def gibbs(texts, d0, d, theta, v, sweeps, burn, rng):
    """Predictive probabilities p(word | context) of a sampler that moves one customer at a time, averaged over sweeps."""
    cust = [(u, w) for t in texts for u, w in zip([t[-1], *t[:-1]], t)]
    tables, at = {}, [None] * len(cust)  # (u, w) -> sizes of the context's tables
    top, seats = {}, {}  # w -> sizes of the parent's tables; customers of the parent are tables
    totals = {"c": Counter(), "t": Counter(), "s": 0, "o": 0}

    def parent(w):
        return (sum(top.get(w, [])) - d0 * len(top.get(w, [])) + (theta + d0 * totals["o"]) / (v + 1)) / (theta + totals["s"])

    def sit(sizes, disc, new):
        r = rng.random() * (sum(x - disc for x in sizes) + new)
        for i, x in enumerate(sizes):
            r -= x - disc
            if r < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def leave(sizes):
        r = rng.random() * sum(sizes)
        for i, x in enumerate(sizes):
            r -= x
            if r < 0:
                break
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def add(u, w):
        if sit(tables.setdefault((u, w), []), d, (theta + d * totals["t"][u]) * parent(w)):
            totals["t"][u] += 1
            totals["o"] += sit(top.setdefault(w, []), d0, (theta + d0 * totals["o"]) / (v + 1))
            totals["s"] += 1
        totals["c"][u] += 1

    def remove(u, w):
        totals["c"][u] -= 1
        if leave(tables[u, w]):
            totals["t"][u] -= 1
            totals["s"] -= 1
            totals["o"] -= leave(top[w])

    for u, w in cust:
        add(u, w)
    words, p = sorted({w for t in texts for w in t}) + [None], Counter()
    for sweep in range(sweeps):
        for u, w in cust:
            remove(u, w)
            add(u, w)
        for u, w in itertools.product(words, words) if sweep >= burn else ():
            own = tables.get((u, w), [])
            p[u, w] += (sum(own) - d * len(own) + (theta + d * totals["t"][u]) * parent(w)) / (theta + totals["c"][u]) / (sweeps - burn)
    return p


def test_scores_match_a_sampler_that_moves_one_customer_at_a_time(spark):
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{(5 * i + k) % 12}" for k in (0, 1, 1, 3)] for i in range(12)}

    def text(n):
        out = [f"w{rng.randrange(12)}"]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.9 else f"w{rng.randrange(12)}")
        return out

    rows = [(i, text(25), i % 5 != 0) for i in range(60)] + [(100, ["w1", "new", "w2"], False), (101, [], False)]
    m = hpylm.Model(spark.createDataFrame([(i, " ".join(t), x) for i, t, x in rows], "doc_id long, text string, learn boolean"), batch_tokens=400)
    m.sample(burn_in=6, draws=30)
    got = {r["doc_id"]: r for r in m.score().collect()}
    held = hpylm.perplexity(m.score()).where("NOT learn").first()
    d, d0, v = m.d, m.sums[0]["d"], m.v
    m.close()
    p = gibbs([[*t, ""] for _, t, x in rows if x], d0, d, hpylm.THETA, v, 90, 30, random.Random(7))
    known, off = {w for w, _ in p}, []
    for i, t, _ in rows:
        t = [w if w in known else None for w in [*t, ""]]
        want = sum(math.log10(p[u, w]) for u, w in zip([t[-1], *t[:-1]], t))
        off.append((got[i]["score"] - want) / len(t))
        assert abs(off[-1]) < (0.03 if len(t) > 20 else 0.15), (i, got[i]["score"], want)
        assert math.isclose(got[i]["perplexity"], 10 ** (-got[i]["score"] / len(t)))
    assert abs(np.mean(off[:60])) < 0.01
    mine = [got[i] for i, _, x in rows if not x]
    assert math.isclose(held["perplexity"], 10 ** (-sum(r["score"] for r in mine) / sum(r["n_tokens"] for r in mine)))


def test_every_context_predicts_with_mass_one(spark):
    """Over all known words and the unknown one, in contexts of few and of many tables."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    learnt = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=100)), True) for i in range(60)]
    asked = [(100 + i, f"{u} {w}", False) for i, (u, w) in enumerate(itertools.product([*words, "unknown"], repeat=2))]
    m = hpylm.Model(spark.createDataFrame([*learnt, *asked, (99, "", False)], "doc_id long, text string, learn boolean"), batch_tokens=900)
    m.sample(burn_in=2, draws=3)
    mass, bigrams, get = Counter(), 0, lambda x: hpylm.counts(x).astype(int)
    for r in m.full.where(F.col("kind") == hpylm.FULL).collect():
        left, right, c, mine = get(r["left"]), get(r["right"]), get(r["c"]), F.col("part") == r["part"]
        customers = np.concatenate([get(x["customers"]) for x in m.first.where(mine).orderBy("word_part").collect()])
        bigrams += len(c)
        for sums, totals, groups in m.kept:
            t, g = np.minimum(c, 1), groups.where(mine).first()
            t[get(m.many.where(mine).first()["at"])] = get(g["t"])
            p = hpylm.Totals(totals.where(mine).toArrow(), sums, m.v).predict(left, right, c, t, customers, m.d)
            words_ = np.concatenate([np.frombuffer(x["keys"], np.uint64) for x in m.words_told.where(mine).orderBy("word_part").collect()])
            for u, x in zip(words_[left].tolist(), p.tolist()):
                mass[u] += x / len(m.kept)
    m.close()
    assert bigrams == 32 * 32 and len(mass) == 32 and np.allclose(list(mass.values()), 1, atol=1e-9)


def test_nothing_to_learn_from(spark):
    m = hpylm.Model(spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, learn boolean"))
    m.sample()
    got = {r["doc_id"]: r for r in m.score().collect()}
    m.close()
    assert got[1]["n_known"] == got[1]["train_tokens"] == 0 and abs(got[1]["score"]) < 1e-6 and abs(got[1]["base_score"]) < 1e-9 and got[2]["n_tokens"] == 1


@pytest.mark.parametrize("c, rest, p, e", [(3, 4, 0.05, None), (90, 40, 0.05, 500.0), (1500, 10, 0.001, None), (1500, 1000, 0.01, None), (2000, 5000, 0.2, None), (2000, 20000, 0.02, 1e5)])
@pytest.mark.parametrize("d", [0.3, 0.5, 0.8])
def test_seatings_follow_their_conditional(c, rest, p, e, d):
    """Mean and spread of the tables drawn against the weights of all numbers of tables."""
    n, k = 8000, np.arange(1, c + 1)
    t = hpylm.seat(np.full(n, c), np.full(n, float(rest)), np.full(n, p), np.arange(n, dtype=np.uint64), d, 1.0, 1, None if e is None else np.full(n, e))
    logs = hpylm.stirling(d, c)[c, 1:] + np.cumsum(np.log(1 + d * (rest + k - 1))) + (k * math.log(p) if e is None else np.cumsum(np.log((p * e + k - 1) / (e + k - 1))))
    w = np.exp(logs - logs.max())
    w /= w.sum()
    mean, sd = (w * k).sum(), math.sqrt((w * k * k).sum() - (w * k).sum() ** 2)
    assert t.min() >= 1 and t.max() <= c
    assert abs(t.mean() - mean) < 0.01 * mean + 4 * sd / math.sqrt(n) and abs(t.std() - sd) < 0.05 * sd + 0.02


# --------------------------------------------------------------------------- substring dedup
def brute_windows(rows, width):
    c = Counter(tuple(w[k : k + width]) for w in rows for k in range(len(w) - width + 1))
    for w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if c[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        yield gone


def wanted(rows, width):
    return sorted((str(i), len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode()) for (i, w), g in zip(rows, brute_windows([w for _, w in rows], width)))


def told(got):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got)


@pytest.mark.parametrize("width, batches", [(35, 1), (12, 3)])
def test_substring_dedup_matches_brute_force(docs, none, width, batches):
    rows = [(r["doc_id"], split(r["text"])) for r in docs.collect()]
    assert told(substring.dedup(docs, width=width, batches=batches, part_words=300).collect()) == wanted(rows, width)
    assert substring.dedup(none).count() == 0


def test_batch_by_batch_equals_all_at_once(spark, tmp_path):
    """A reopened index tells after each batch what changes, on both sides, and ends where a single pass does."""
    rng = random.Random(21)
    passages = [prose(rng, 30) for _ in range(8)]
    rows = [(i, " ".join(x for _ in range(3) for x in (prose(rng, rng.randrange(5, 25)), rng.choice(passages)))) for i in range(24)]
    known, moved = {}, 0
    for b in range(4):
        mine = rows[6 * b : 6 * b + 6]
        corpus = substring.Corpus(spark, f"file://{tmp_path}/index", width=20, part_words=120)
        corpus.add(spark.createDataFrame(mine, "doc_id long, text string").repartition(2))
        changes = corpus.results(since=b).collect()
        assert len(corpus.prints.state["runs"]) == 1 and len(corpus.stores) == b + 1
        before, known = dict(known), known | {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in changes}
        assert {i for i, _ in mine} <= {r["doc_id"] for r in changes} and len(changes) == len({r["doc_id"] for r in changes})
        assert sorted((str(i), *x) for i, x in known.items()) == wanted([(i, split(t)) for i, t in rows[: 6 * b + 6]], 20)
        assert told(corpus.results().collect()) == wanted([(i, split(t)) for i, t in rows[: 6 * b + 6]], 20)
        corpus.close()
        moved += sum(known[i] != x for i, x in before.items())
    assert moved > 0


def test_runs_merge_and_compact():
    k, m = substring.merged([np.array([1, 5, 9], np.uint64), np.array([5, 7], np.uint64)], [np.array([False, False, True]), np.array([False, False])])
    assert k.tolist() == [1, 5, 7, 9] and m.tolist() == [False, True, False, True]
    rng = np.random.default_rng(5)
    for n in range(5):
        keys = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(n)]
        many = [rng.random(len(x)) < 0.2 for x in keys]
        k, m = substring.merged(keys, many)
        c, marked = Counter(x for r in keys for x in r.tolist()), {x for r, y in zip(keys, many) for x in r[y].tolist()}
        assert k.tolist() == sorted(c) and m.tolist() == [c[x] > 1 or x in marked for x in sorted(c)]


# --------------------------------------------------------------------------- near duplicates
def shingle_set(t):
    w = [x.lower() for x in split(t)]
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_similarity(a, b):
    if not a or not b:
        return 0.0
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a | b) for x in a if x in b)


def test_near_duplicates_match_brute_force(spark, docs, none):
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for g in range(6):
        words = prose(rng, 150).split()
        for k in range(5):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"edit{g}{k}"
            rows.append((1000 + 10 * g + k, " ".join(w)))
    got = probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and brute_similarity(sets[a], sets[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    want = Counter((str(i), str(min((x for x in ids if x is not None), default=None))) for ids in groups.values() for i in ids)
    assert Counter((str(r["id"]), str(r["class_id"])) for r in got) == want
    reps = Counter(r["class_id"] for r in got if r["rep"] and r["class_id"] is not None)
    assert all(n == 1 for i, n in reps.items() if i != 4) and reps[4] == 2  # equal rows stand together
    kept = probminhash.dedup(docs).collect()
    assert Counter(r["doc_id"] for r in kept)[4] == 1 and {1, 2} <= {r["doc_id"] for r in kept} and {5, 6} & {r["doc_id"] for r in kept} == set()
    assert probminhash.classes(none).count() == 0 and probminhash.dedup(none).count() == 0


@pytest.mark.parametrize("block", [8, 256])
def test_close_pairs_within_a_template_family_are_found(spark, monkeypatch, block):
    """Texts of mutual similarity about 0.75, too many for a small bucket, that hold pairs of about 0.82."""
    monkeypatch.setattr(probminhash, "BLOCK", block)
    rng = random.Random(31)
    base, rows = [f"t{i}" for i in range(304)], []

    def edited(words, at, tag):
        out = list(words)
        for i in at:
            out[i] = f"{tag}x{i}"
        return out

    for g in range(40):
        mine = [(g + x) % 43 for x in (0, 1, 4, 11)]  # two groups share one place at most
        one = edited(base, [7 * i + 3 for i in mine], f"g{g}")
        rows.append((2 * g, " ".join(one)))
        rows.append((2 * g + 1, " ".join(edited(one, [7 * i + 3 for i in rng.sample(sorted({*range(43)} - {*mine}), 6)], f"h{g}"))))
    sets = [set(shingle_set(t)) for _, t in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b)  # noqa: E731  (no shingle occurs twice in a text)
    near = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(sets[a], sets[b]) >= 0.8}
    across = [jaccard(sets[2 * a], sets[2 * b]) for a, b in itertools.combinations(range(40), 2)]
    assert len(near) == 40 and sum(across) / len(across) > 0.74 and max(across) < 0.8
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in sorted(near):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["class_id"] for r in probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_pairs_behind_one_heavy_shingle_are_found(spark):
    """300 pairs of similarity 0.809 that all share one shingle of most of their weight: a bucket of 600 texts."""
    rng, rows = random.Random(17), []
    for g in range(300):
        tail = [f"g{g}t{i}" for i in range(150)]
        other = list(tail)
        for i in range(0, 150, 10):
            other[i] = f"x{g}t{i}"
        rows += [(2 * g, " ".join(["same"] * 850 + tail)), (2 * g + 1, " ".join(["same"] * 850 + other))]
    sim = brute_similarity(shingle_set(rows[0][1]), shingle_set(rows[1][1]))
    apart = brute_similarity(shingle_set(rows[0][1]), shingle_set(rows[2][1]))
    got = {r["id"]: r["class_id"] for r in probminhash.classes(spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string")).collect()}
    if apart >= 0.8:
        assert set(got.values()) == {0}
    else:
        assert sim >= 0.8 and sum(got[2 * g + 1] == 2 * g for g in range(300)) >= 297 and all(got[2 * g] == 2 * g for g in range(300))


def test_bound_never_falls_below_the_similarity():
    rng = np.random.default_rng(4)
    sets = [(np.sort(rng.choice(40, k, False)).astype(np.uint64), rng.integers(1, 5, k)) for k in (*rng.integers(1, 40, 60), 0)]
    for threshold in (0.2, 0.5, 0.8):
        found = {tuple(x) for x in probminhash.bounded(sets, sets, threshold)}
        assert {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if probminhash.similarity(a, b) >= threshold} <= found


def test_registers_estimate_probability_jaccard():
    rng = random.Random(2)
    texts = [prose(rng, 300, [f"v{i}" for i in range(60)]), None]
    w = texts[0].split()
    w[:40] = prose(rng, 40, ["z1", "z2", "z3"]).split()
    texts[1] = " ".join(w)
    raw = "".join(texts).encode()
    offs = np.array([0, len(texts[0].encode()), len(raw)])
    names, has = probminhash.signatures(*probminhash.shingles(np.frombuffer(raw, np.uint8), offs), 2, 4096)
    exact = brute_similarity(*map(shingle_set, texts))
    assert has.all() and abs((names[0] == names[1]).mean() - exact) < 0.03


# --------------------------------------------------------------------------- line dedup
def test_line_dedup_matches_brute_force(spark, none):
    rng = random.Random(3)
    pool = [prose(rng, k % 9 + 1) for k in range(25)] + [prose(rng, 30) for _ in range(4)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(60, rows[3][1]), (61, "\n".join([pool[0]] * 40)), (62, None), (63, ""), (None, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row long, at int")
    got = {(r["doc_id"]): r for r in linedup.dedup(df).collect()}
    order, seen1, seen4, want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), set(), set(), {}
    for i, t in order:
        lines = (t or "").split("\n")
        dead = [False] * len(lines)
        for k, x in enumerate(lines):
            if x in seen1 and len(x) >= 50:
                dead[k] = True
            seen1.add(x)
        for k in range(len(lines) - 3):
            run = tuple(lines[k : k + 4])
            if run in seen4:
                dead[k : k + 4] = [True] * 4
            seen4.add(run)
        want[i] = (sum(dead), None if t is None else "\n".join(x for x, g in zip(lines, dead) if not g))
    assert {i: (r["n_removed"], r["text"]) for i, r in got.items()} == want
    assert linedup.dedup(none).count() == 0
    # the longest run that starts at a copy of four lines and also starts elsewhere
    text = {(i, k): (t or "").split("\n")[k:] for i, t in order for k in range((t or "").count("\n") + 1)}
    shared = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    seen, longest = set(), Counter()
    for (i, k), x in text.items():
        if len(x) >= 4 and tuple(x[:4]) in seen:
            longest[i] = max(longest[i], max(shared(x, y) for p, y in text.items() if p != (i, k)))
        seen.add(tuple(x[:4]))
    assert {i: r["longest_copy"] for i, r in got.items() if i in longest} == dict(longest) and max(longest.values()) == 39
    assert all(r["longest_copy"] == (r["n_removed"] > 0) for i, r in got.items() if i not in longest)


def test_line_dedup_splits_hot_lines(spark, monkeypatch):
    from shiftglass.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 5)
    rows = [(i, "\n".join(["same"] * (i % 5 + 1) + [f"own {i % 7}"] + ["same"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["longest_copy"]) for r in linedup.dedup(df).collect()}
    monkeypatch.setattr(common, "HOT_KEYS", 4096)
    assert got == {r["doc_id"]: (r["n_removed"], r["longest_copy"]) for r in linedup.dedup(df).collect()} and got[59][0] > 0


def test_line_dedup_uses_no_python(docs):
    plan = linedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_line_dedup_of_odd_rows(docs):
    got = linedup.dedup(docs)
    assert got.count() == docs.count() and {"row", "key", "size"} <= set(got.columns)


# --------------------------------------------------------------------------- language ID
def test_language_id_on_held_out_texts(spark, docs, none):
    rng = random.Random(4)
    words = {"aa": ["shanti", "mela", "toru", "kesh"], "bb": ["grunz", "flek", "schop", "rax"], "cc": ["ouille", "tante", "peu", "vieux"]}
    rows = [(i, prose(rng, 15, words[x]), x) for i, x in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.remainder("doc_id", 4) == 2
    model = langid.train(df.where(~held))
    got = langid.predict(df.where(held), model, keep=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    odd = langid.predict(docs, model, keep=("doc_id", "score")).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd if r["doc_id"] in (0, 1, 2)) and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.predict(none, model).count() == 0 and langid.train(none)[0] == []
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}


def test_language_id_matches_a_plain_implementation(spark):
    """Matrix and posteriors from dictionaries of character n-grams, one n-gram at a time."""
    rng = random.Random(8)
    texts = [(" ".join(rng.choice(["Ab", "cda", "é", "x9y", "DA"]) for _ in range(rng.randrange(1, 30))), rng.choice(["p", "q", "r"])) for _ in range(60)] + [("", "p"), (None, "q"), ("  12 ..", "r")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    langs, matrix = langid.train(df.where("doc_id % 3 > 0"))

    def plain(t):
        s = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in f" {(t or '').lower()} ")
        while "  " in s:
            s = s.replace("  ", " ")
        return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)]

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
        return int(langid.mix(np.array([h], np.uint64))[0]) % langid.BUCKETS

    counts, docs_of = {x: Counter() for x in "pqr"}, Counter()
    for i, (t, x) in enumerate(texts):
        if i % 3:
            counts[x].update(map(bucket, plain(t)))
            docs_of[x] += 1
    assert langs == ["p", "q", "r"]
    logs = {x: lambda b, x=x: math.log((counts[x][b] + langid.SMOOTHING) / (sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS)) for x in langs}
    for j, x in enumerate(langs):
        assert all(abs(matrix[b, j] - logs[x](b)) < 1e-4 for b in [*counts[x], 0, 77])
        assert abs(matrix[-1, j] - math.log(docs_of[x] / sum(docs_of.values()))) < 1e-5
    for r in langid.predict(df, (langs, matrix), keep=("doc_id",)).collect():
        t = texts[r["doc_id"]][0]
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = {x: math.log(docs_of[x] / sum(docs_of.values())) + sum(map(logs[x], map(bucket, plain(t)))) for x in langs}
        best = max(langs, key=lambda x: total[x])
        want = 1 / sum(math.exp(total[x] - total[best]) for x in langs)
        assert abs(r["score"] - want) < 1e-3 and (r["lang_pred"] == best or want < 0.51)
