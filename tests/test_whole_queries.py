"""Queries over whole tables, without an oracle, against brute force."""

from collections import Counter

import pytest

from shiftglass.operators import evaluation
from shiftglass.plans import scenes

SF_DIR = "/root/testdata/sf0.001"


def test_every_frame_has_head_counts(spark):
    people = scenes.people(spark, SF_DIR).collect()
    want = Counter({(r["frame"], z[0]): 0 for r in people for z in scenes.ZONES})
    for r in people:
        x, y = (r["bbox"][0] + r["bbox"][2]) / 2, r["bbox"][3]
        inside = [z for z, _, a, b, c, d in scenes.ZONES if a < x < c and b < y < d]
        if inside:
            want[r["frame"], inside[0]] += 1
    got = scenes.QUERIES["zone_head_counts"](spark, SF_DIR).collect()
    assert {(r["frame"], r["zone_id"]): r["n"] for r in got} == dict(want) and len(got) == len(want)


def test_every_organisation_has_an_overview(spark):
    orgs, found = scenes.O(spark, SF_DIR).collect(), scenes.D(spark, SF_DIR).collect()
    n, pending = Counter(r["worker_key"] for r in found), Counter(r["worker_key"] for r in found if r["review_state"] == "PENDING")
    events = Counter(r["worker_key"] for r in scenes.E(spark, SF_DIR).collect())
    last = {}
    for r in found:
        last[r["worker_key"]] = max(last.get(r["worker_key"], r["observed_at"]), r["observed_at"])
    names = [f"trk-{r['org_id']}" for r in orgs]
    got = scenes.QUERIES["platform_overview"](spark, SF_DIR).collect()
    assert sorted((r["org_id"], r["decisions"], r["open_alerts"], r["events"], str(r["last_decision"])) for r in got) == sorted((k, n[k], pending[k], events[k], str(last.get(k))) for k in names)
    assert any(int(k[4:]) >= 60 for k in names)


def closest(rows, queries):
    distance = lambda q, r: min((q["hash"] ^ r["hash"]).bit_count(), (q["mirror"] ^ r["hash"]).bit_count())
    return sorted((q["id"], *min((distance(q, r), r["id"]) for r in rows if r["id"] != q["id"])) for q in queries)


def test_nearest_hash_searches_every_other_row(spark):
    rows = scenes.hashes(spark, SF_DIR).collect()
    want = closest(rows, [r for r in rows if r["id"] % 100 == 0])
    assert any(i % 25 == 0 for _, _, i in want)
    assert sorted(map(tuple, scenes.QUERIES["nearest_hash"](spark, SF_DIR).collect())) == want
    found = scenes.QUERIES["near_duplicate_summary"](spark, SF_DIR).first()
    assert (found["n"], found["identical"], found["near"]) == (len(want), sum(d <= 0 for _, d, _ in want), sum(d <= 6 for _, d, _ in want))


@pytest.mark.parametrize("block, store_block", [(1, 7), (5, 1000)])
def test_nearest_by_blocks(spark, block, store_block):
    rows = [{"id": i, "hash": (i // 2 * 2654435761) % 2**40, "mirror": (i * 40503) % 2**40} for i in range(60)]
    h = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, hash long, mirror long")
    got = evaluation.nearest(h.where("id % 4 = 0").toDF("q_id", "q_hash", "q_mirror"), h, block, store_block)
    assert sorted(map(tuple, got.collect())) == closest(rows, [r for r in rows if r["id"] % 4 == 0])


def test_latency_collects_no_group(spark):
    rows = [(None if i % 9 == 0 else f"z{i % 3}", None if i % 7 == 0 else float(i * 37 % 50)) for i in range(400)] + [("none", None)]
    found = evaluation.latency(spark.createDataFrame(rows, "zone string, v double"), "zone", "v")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    want = {}
    for z in {z for z, _ in rows}:
        v = sorted(x for y, x in rows if y == z and x is not None)
        want[z] = v[int(0.95 * (len(v) - 1))] if v else None
    assert {r["zone"]: r["p95"] for r in found.collect()} == want
