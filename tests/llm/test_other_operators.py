"""Search, media, mixing, packing, archives and the pipeline against brute force and round trips."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftglass.llm import mixing, packing, progjpeg, topk, warc
from shiftglass.llm.common import tokenizer_path

TEXTS = [None, "", " ", "a", "Hello, World! It's 2024 Été", "x" * 9000, "many words " * 4000, "<|endoftext|> text", "tab\tnew\nline\x0bvt\x0cff", "\U0001f600 你好"]


# --------------------------------------------------------------------------- top-k
def brute_topk(rows, step, k):
    """Rows (id, vector), null ids last among equal scores; every row but the query's own is a candidate."""
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % step == 0:
            found = [(max(-topk.BOUND, min(topk.BOUND, sum(a * b for a, b in zip(v, w)))), j) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v)]
            found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(found[:k])]
    return Counter(out)


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (120, 6)) / 8 + 0.01
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, [])]
    rows += [(5, [float(x) for x in v[5]]), (10, [float(x) for x in v[10]]), (10, [0.5] * 6), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (1, [5.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, row int").repartition(3)
    got = topk.search(topk.quantise(df), F.col("id") % 10 == 0, 5)
    assert Counter(tuple(r) for r in got.collect()) == brute_topk(rows, 10, 5)
    q = topk.quantise(df)
    assert topk.search(q.where("false"), F.col("id") % 10 == 0, 5).count() == 0 and topk.search(q, F.col("id") < 0, 5).count() == 0
    assert topk.search(q.where("id < 3"), F.col("id") == 0, 9).count() == 3


def test_topk_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 1e9]), (3, [0.1, 0.1]), (4, [1e12, 1e12]), (5, [1.3e7, -1.3e7])]
    got = topk.search(topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.lit(True), 3).collect()
    held = [(i, [max(-topk.LARGEST / 256, min(topk.LARGEST / 256, x)) for x in v]) for i, v in rows]
    assert Counter(tuple(r) for r in got) == brute_topk(held, 1, 3)


def test_topk_ties_and_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_GROUP", 14)
    monkeypatch.setattr(topk, "CANDIDATE_GROUP", 22)
    q = topk.quantise(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "vec_id long, embedding array<double>"))
    got = topk.search(q, F.col("id") % 2 == 0, 3).collect()
    assert all(sorted(r["vec_id"] for r in got if r["query_id"] == i) == [j for j in range(4) if j != i][:3] for i in range(0, 40, 2))


# --------------------------------------------------------------------------- progressive JPEG
def test_payloads_survive_the_image(spark):
    df = spark.createDataFrame([(i, t, b"m", "f") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary, feature string")
    got = progjpeg.read_media(progjpeg.write_media(df)).collect()
    for r in got:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert bytes(r["payload"]) == raw + bytes(-len(raw) % 64 or 64 * (not raw)) and r["n_bytes"] == len(raw)
        assert len(r["rgb"]) == 3 * r["height"] * r["width"] and bytes(r["media"][:2]) == b"\xff\xd8"
    assert progjpeg.read_media(progjpeg.write_media(df.where("false"))).count() == 0


def test_any_bytes_survive_all_scans():
    rng = np.random.default_rng(2)
    p = [rng.integers(0, 256, 6400).astype(np.uint8).tobytes(), bytes([1, 255] * 320), rng.choice([0] * 19 + [1, 255, 2], 6400).astype(np.uint8).tobytes(), bytes(range(256)), bytes(64)]
    assert progjpeg.payloads(*progjpeg.coefficients(progjpeg.store(p))) == p


def test_decoded_pixels_are_the_inverse_transform():
    rng = np.random.default_rng(3)
    c = [rng.integers(-20, 20, (4, 64)), rng.integers(-9, 9, (1, 64)), rng.integers(-9, 9, (1, 64))]
    (got,) = progjpeg.decode(progjpeg.encode([(1, 1, c)], [b""]))

    def plane(blocks, wide):
        k = np.arange(8)
        basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
        out = []
        for b in blocks:
            x = np.zeros(64)
            x[progjpeg.ZIGZAG] = b
            out.append(np.clip(np.rint(basis @ x.reshape(8, 8) @ basis.T + 128), 0, 255))
        return np.block([[out[i * wide + j] for j in range(wide)] for i in range(len(out) // wide)])

    y, cb, cr = plane(c[0], 2), plane(c[1], 1).repeat(2, 0).repeat(2, 1) - 128, plane(c[2], 1).repeat(2, 0).repeat(2, 1) - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2).clip(0, 255)
    assert np.abs(got.astype(float) - want).max() <= 1.5


# --------------------------------------------------------------------------- mixing
def test_targets_are_shared_by_weight_and_stop_at_twice_the_source():
    t = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 10})
    assert t["a"] == 20 and t[None] == 20 and t["b"] + t["c"] == Fraction(3, 2) * 2020 - 40
    assert t["c"] / t["b"] == 2 and sum(t.values()) == Fraction(3, 2) * 2020
    assert mixing.targets({}) == {} and mixing.targets({"z": 0}) == {"z": 0}


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(1)
    rows = [(i, ("a", "b", "c", None)[min(3, int(rng.random() ** 2 * 4))], rng.randrange(0, 90), 1, "x") for i in range(1500)] + [(7, "a", 5, 1, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target long, copies string")
    got, again = mixing.mix(df).collect(), mixing.mix(df.repartition(7)).collect()
    key = lambda rs: Counter((r["doc_id"], r["taken"]) for r in rs)
    assert key(got) == key(again) and len(got) == len(rows)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_mix_of_long_and_short_documents_meets_its_targets(spark):
    """Sources of twenty to some hundred documents of 1 to 20,000 words: within a thousandth of the target."""
    rng = np.random.default_rng(6)
    rows = [(1000 * k + i, f"s{k}", int(min(20000, rng.lognormal(5, 1.5) + 1))) for k in range(8) for i in range(20 + 60 * k)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 8 and all(abs(r["taken"] - r["target"]) <= max(2, 0.001 * r["target"]) for r in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 99, 400), np.full(400, 0.3)
    q = mixing.flight(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - 120) < 1e-6 and abs((q * size).sum() - 0.3 * size.sum()) < 1e-5


# --------------------------------------------------------------------------- packing
def test_pieces_hold_the_tokenizers_ids_and_pack_without_gaps(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok, rows = Tokenizer.from_file(path), [(i, t, 1, "z") for i, t in enumerate(TEXTS)] + [(3, "a", 1, "z")] * 2 + [(None, "b c", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, offset string")
    got = packing.pack(packing.pieces(df, path)).collect()
    for i, t in enumerate(TEXTS):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i})
        assert mine == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(packing.pieces(df.where("false"), path)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = [np.clip(rng.lognormal(6.5, 1, 20000).astype(int), 1, 4096), rng.integers(1, 4097, 9000), rng.integers(1, 40, 5000), np.full(3000, 1366)][seed]
    h = Counter(lengths.tolist())
    rows, n = packing.plan(h)
    used, keys = Counter(), rows[:, 0] << 40 | rows[:, 1]
    for x, c in h.items():
        for k in range(c):
            i = np.searchsorted(keys, x << 40 | k, side="right") - 1
            assert rows[i, 0] == x
            used[int(rows[i, 2] + k - rows[i, 1])] += x
    assert len(used) == n and max(used.values()) <= 4096
    assert n <= 1.02 * lengths.sum() / 4096 + 1 or seed == 3 and n == 1500


# --------------------------------------------------------------------------- WARC
def test_archives_give_back_all_pages(spark):
    big, rng = "b" * 1500, random.Random(1)
    pages = [(i, f"http://Host{rng.randrange(4)}.example.com/p{rng.randrange(9)}?q=é x", big if i % 3 == 0 else f"{i}" * (i * 7 % 400), "x") for i in range(200)]
    pages += [(500, None, None, "x"), (501, "no-scheme", "", "x"), (502, "http://h/\n", big + "c", "x"), (502, "http://h/\n", big + "c", "x"), (None, "http://n/", big, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    got = warc.capture_index(df, archive_bytes=20_000).collect()
    top = {}
    for i, _, h, _ in pages:
        if len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), i if i is not None else -1)

    def want(i, u, h):
        raw = (h or "").encode()
        again = len(raw) >= 1000 and Counter(x[2] for x in pages)[h] > 1 and i != top[h]
        return str((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h] if again else None))

    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == sorted(want(i, u, h) for i, u, h, _ in pages)
    ordered = sorted(got, key=lambda r: r["position"])
    assert [(r["url_key"], r["captured_at"]) for r in ordered] == sorted((r["url_key"], r["captured_at"]) for r in got)
    assert [r["position"] for r in ordered] == list(range(len(pages)))
    assert warc.capture_index(df.where("false")).count() == 0


def test_archives_take_any_id_and_any_url(spark, monkeypatch):
    """Ids beyond every calendar, escapes, and an order that holds across archives and key ranges."""
    from shiftglass.llm import common

    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    paths = ["%7e", "~b", "b", "m", "%7A%7a", "zq", "Ax", "%2525", "é", "%C3%A9", "a b", "a%20b", "", "%"]
    pages = [(10**12 * (i % 3) + i * 7919 % 101, f"http://h.org/{paths[i % len(paths)]}" if i % 11 else None, "same " * 300 if i % 2 else str(i)) for i in range(90)]
    pages += [(-5, "http://h.org/", "x"), (2**63 - 1, "http://h.org/", "x"), (-(2**63), "http://h.org/", "x"), (None, "http://h.org/", "x")]
    got = warc.capture_index(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), archive_bytes=2000).collect()
    place = lambda i, u, h: warc.place(warc.url_key(u), warc.captured_at(i), i, hashlib.sha1((h or "").encode()).hexdigest())
    ordered = sorted(got, key=lambda r: r["position"])
    assert [warc.place(r["url_key"], r["captured_at"], r["page_id"], r["payload_digest"]) for r in ordered] == sorted(place(*p) for p in pages)
    keeper = max(i for i, _, h in pages if i is not None and h.startswith("same"))
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {keeper}


def test_loser_tree_merges_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://user@Blog.Example.com:8080/a?b=1#c") == "com,example,blog)/a?b=1" and warc.url_key(None) == ""


# --------------------------------------------------------------------------- pipeline
def test_pipeline_stages_keep_the_contract(spark):
    import corpus_pipeline as cp

    rng = random.Random(8)
    words = {"en": ["the", "ship", "sails", "north", "today"], "de": ["das", "schiff", "fährt", "heute", "weg"]}
    text = lambda lang, n, w=14: "\n".join(" ".join(rng.choice(words[lang]) + str(rng.randrange(60)) for _ in range(w)) for _ in range(n))
    rows = [(i, text(lang, 6, 14 if i else 120), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de"] * 40)]
    near = "\n".join(line.replace("ship", "boat", 1) for line in rows[0][1].split("\n"))  # a word in every line, so that no line is a copy
    rows += [(200, rows[3][1], "de", "s1"), (201, near, "en", None), (202, None, "en", "s0"), (203, "12 34 ..", None, "s0"), (204, rows[4][1].split("\n")[0] + "\n" + text("en", 5), "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    outs = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "").persist()
        outs[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
    ids = {k: {r["doc_id"] for r in v} for k, v in outs.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {202, 203}
    lines = {r["doc_id"]: r for r in outs["line_dedup"]}
    assert 200 not in lines and lines[204]["text"] == rows[-1][1].split("\n", 1)[1] and lines[204]["n_chars"] == len(lines[204]["text"])
    assert all(lines[r[0]]["text"] == r[1] for r in rows[:80])
    shingles = lambda t: set(zip(*[t.lower().split()[k:] for k in range(5)]))
    x, y = shingles(rows[0][1]), shingles(near)
    assert lines[201]["text"] == near and 0.8 <= len(x & y) / len(x | y) < 1 and ids["near_dedup"] == ids["line_dedup"] - {201}
    words_of = lambda rs: sum(len((r["text"] or "").split()) for r in rs)
    assert abs(words_of(outs["mixing"]) / (1.5 * words_of(outs["near_dedup"])) - 1) < 0.1
    assert {r["doc_id"] for r in outs["packing"]} == ids["mixing"] and Counter(r["doc_id"] for r in outs["packing"]) == Counter(r["doc_id"] for r in outs["mixing"])


ODD = "doc_id long, text string, lang string, source string, n_chars long, length int, size long, target double, id long, key string"


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_dedup", "mixing", "packing"])
def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, name):
    """Null ids, texts and sources, equal rows, empty and blank texts, and columns named like the operators' own."""
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)[name]
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "plain words of a text " * 12, "plain words of a text " * 12, "x" * 5000, " ".join(rng.choices(["river", "stone", "cloud"], k=60))]
    rows = [(i if i % 3 else None, t, ("en", None)[i % 2], (None, "s")[i % 2], len(t or ""), 1, 2, 3.0, 4, "k") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]
    docs = spark.createDataFrame(rows, ODD)
    got = stage(spark, docs, "")
    found = got.collect()
    if name != "packing":
        assert got.columns == list(cp.COLUMNS)
    if name == "near_dedup":
        assert Counter(r["text"] for r in found)["plain words of a text " * 12] == 1 and sum(not (r["text"] or "").strip() for r in found) == 4
    if name == "packing":
        assert sum(r["piece"] == 0 for r in found) == len(rows)
    if name == "language_id":
        assert all(any(c.isalpha() for c in r["text"]) for r in found)
    nothing = stage(spark, spark.createDataFrame([], ODD), "")
    assert nothing.columns == got.columns and nothing.count() == 0


def test_pipeline_equals_its_stages_run_one_by_one(spark, tmp_path):
    """``run`` writes and rereads each stage: the same pieces as the stages in memory, on a table with a group of each kind."""
    import corpus_pipeline as cp

    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "sun", "tor", "vel", "wix")]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=15)) for _ in range(n))
    rows = [(i, text(5), "aa", f"s{i % 2}") for i in range(40)]
    rows += [(100, rows[0][1], "aa", "s0"), (101, None, None, "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
    key = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    got = key(cp.run(spark, str(tmp_path)))
    assert got == key(docs) and got
