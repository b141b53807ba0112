"""Draws without a list of pairs, the pivot index and one-to-one matches, against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tideline.operators import joins as J


def test_valleys_in_proportion_to_the_gap(spark):
    """Many peaks of one score: each valley's share of the draws against its gap; and valleys that are all alike."""
    n = 6000
    valleys = [(0, 0.25), (1, 0.25), (2, 0.2), (3, 0.1), (4, 0.0)]
    peaks = spark.createDataFrame([(1, k, 0.5) for k in range(n)] + [(2, k, 0.9) for k in range(n)], "video_id long, peak long, score double")
    v = spark.createDataFrame([(1, k, x) for k, x in valleys] + [(2, k, 0.3) for k in range(3)], "video_id long, valley long, score double")
    got = collections.Counter((r.video_id, r.valley) for r in J.draw_valleys(peaks, v, 3).collect())
    gaps = [0.5 - x for _, x in valleys]
    for k, gap in enumerate(gaps):
        p = gap / sum(gaps)
        assert abs(got[1, k] - n * p) < 4 * (n * p * (1 - p)) ** 0.5
    assert all(abs(got[2, k] - n / 3) < 4 * (n * 2 / 9) ** 0.5 for k in range(3)) and sum(got.values()) == 2 * n


@pytest.mark.parametrize("margin", [0.3, 0.85])
def test_margin_pairs(spark, margin):
    """All pairs where a video has few; else so many distinct ones of them, spread over all."""
    rng = random.Random(6)
    rows = [(v, k, rng.randint(0, 20) / 20, rng.random()) for v, size in ((1, 12), (2, 90), (3, 1)) for k in range(size)]
    got = collections.defaultdict(list)
    for r in J.draw_margin_pairs(spark.createDataFrame(rows, "video_id long, idx int, gt double, score double"), margin, 150, 7).collect():
        got[r.video_id].append((r.i, r.j))
    for v in (1, 2, 3):
        mine = [r for r in rows if r[0] == v]
        pairs = {(a[1], b[1]) for a in mine for b in mine if b[2] <= a[2] - margin or (a[2] > 0.7 and b[3] > 0.6 and b[2] < 0.2)}
        assert len(got[v]) == len(set(got[v])) == min(len(pairs), 150) and set(got[v]) <= pairs
        if v == 2:
            assert len({i for i, _ in got[v]}) > 0.5 * len({i for i, _ in pairs})


@pytest.mark.parametrize("bits", [3, 10])
def test_margin_pairs_by_number(spark, monkeypatch, bits):
    """The very pairs of the drawn numbers, with a video's places in one block and in many; no window or sort for the draws."""
    monkeypatch.setattr(J, "PLACE_BITS", bits, raising=False)
    rng = random.Random(9)
    rows = [(v, k, None if rng.random() < 0.05 else rng.randint(0, 20) / 20, rng.random()) for v, size in ((1, 9), (2, 70), (3, 1)) for k in range(size)]
    want = set()
    for v in (1, 2, 3):
        mine = [r for r in rows if r[0] == v and r[2] is not None]
        near = lambda a, b: b[2] <= a[2] - 0.3
        pairs = [(a[2], a[1], not near(a, b), b[2], b[1]) for a in mine for b in mine if near(a, b) or (a[2] > 0.7 and b[3] > 0.6 and b[2] < 0.2)]
        n, m = len(pairs), min(len(pairs), 120)
        for t in range(m):
            low, high = t * n // m, (t + 1) * n // m
            u = int(hashlib.md5(f"{v}|{t}|7".encode()).hexdigest()[:8], 16) / 4294967296
            p = sorted(pairs)[low + int(u * (high - low))]
            want.add((v, p[1], p[4]))
    d = J.draw_margin_pairs(spark.createDataFrame(rows, "video_id long, idx int, gt double, score double"), 0.3, 120, 7)
    got = [tuple(r) for r in d.collect()]
    assert len(got) == len(set(got)) > 120 and set(got) == want
    assert "Window" not in d._jdf.queryExecution().executedPlan().toString()


def test_pivots_lose_nothing_and_spare_products(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = np.vstack([c + rng.normal(size=(25, 24)) * 0.25 for c in centres] + [np.zeros((2, 24))])
    d = spark.createDataFrame([(k % 2, k, v.tolist()) for k, v in enumerate(x)], "video_id long, idx int, feature array<double>").repartition(4)
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if i % 2 == j % 2 and u[i] @ u[j] > 0.85}
    got = {(r.i, r.j): r.w for r in J.similar_pairs(d, 0.85).collect()}
    assert got.keys() == want and len(want) > 500 and all(w == pytest.approx(u[i] @ u[j]) for (i, j), w in got.items())
    assert J.pivot_pairs(d, 0.85).count() < 0.5 * 2 * (150 * 149 / 2)


@pytest.mark.parametrize("spread", [6, 60, 4000])
def test_matches_in_order_of_probes(spark, spread):
    rng = random.Random(spread)
    p = [(k, rng.randrange(spread)) for k in rng.sample(range(1000), 120)]
    b = [(k, rng.randrange(spread)) for k in rng.sample(range(500), 25)]
    free, want = sorted(b), {}
    for i, n in sorted(p):
        hit = next((c for c in free if abs(c[1] - n) <= 2), None)
        if hit:
            free.remove(hit)
            want[i] = hit[0]
    got = J.tolerance_match(spark.createDataFrame(p, "probe_id long, length long"), spark.createDataFrame(b, "build_id long, length long"), 2)
    assert {r.probe_id: r.build_id for r in got.collect()} == want


def test_similar_pairs_meet_by_blocks(spark, monkeypatch):
    """Several blocks a video, dimensions that differ, null and zero vectors; a pair of blocks is one group, and no pair of vectors is joined."""
    monkeypatch.setattr(J, "SIMILAR_BLOCK", 16)
    monkeypatch.setattr(J, "SIMILAR_STRIP", 5)
    rng = np.random.default_rng(8)
    x = {(v, k): rng.normal(size=6 if k % 9 else 4).tolist() for v in (1, 2) for k in range(50)}
    x[1, 3], x[1, 4], x[2, 7] = [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], None
    rows = [(v, k, f) for (v, k), f in x.items()]
    d = J.similar_pairs(spark.createDataFrame(rows, "video_id long, idx int, feature array<double>"), 0.3)
    got = {(r.video_id, r.i, r.j): r.w for r in d.collect()}
    good = {k: np.array(f) for k, f in x.items() if f and None not in f and any(f)}
    want = {(v, i, j): float(a @ b / np.sqrt((a @ a) * (b @ b))) for (v, i), a in good.items() for (u, j), b in good.items() if u == v and i < j and len(a) == len(b)}
    want = {k: w for k, w in want.items() if w > 0.3}
    assert got.keys() == want.keys() and len(want) > 100 and all(got[k] == pytest.approx(w) for k, w in want.items())
    assert "MapInArrow" in d._jdf.queryExecution().toString()
