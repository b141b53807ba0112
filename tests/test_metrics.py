"""Metrics against plain formulas."""

import random

import pandas as pd
import pytest

from tideline.functions import scalars as C
from tideline.operators import graph as G
from tideline.operators import joins as J
from tideline.operators import metrics as M


def test_kendall_equals_all_pairs(spark):
    random.seed(2)
    rows = [(g, i, float(random.randint(0, 9)), float(random.randint(0, 9))) for g in range(3) for i in range(60)]
    d = spark.createDataFrame(rows + [(3, 0, 1.0, 1.0), (4, 0, 1.0, 2.0), (4, 1, 1.0, 3.0)], "g long, idx int, x double, y double")
    got = {r.g: r.tau for r in M.kendall_tau_b(d, ["g"], "x", "y").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for g in range(3):
        v = [(x, y) for k, _, x, y in rows if k == g]
        pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(v) for b in v[:i]]
        want = sum(p * q for p, q in pairs) / (sum(p * p for p, _ in pairs) * sum(q * q for _, q in pairs)) ** 0.5
        assert got[g] == pytest.approx(want)
    assert got.keys() == {0, 1, 2, 4} and got[4] is None


def test_spearman_has_average_ranks(spark):
    p = pd.DataFrame({"g": [1] * 6, "x": [1.0, 2, 2, 3, 5, 4], "y": [2.0, 1, 3, 3, 6, 6]})
    want = p.x.rank().corr(p.y.rank())
    assert M.spearman(spark.createDataFrame(p), ["g"], "x", "y").first().rho == pytest.approx(want)


def test_event_f1_empty_sides(spark):
    s = "video_id long, rank int, s double, e double"
    pred = spark.createDataFrame([(1, 1, 0.0, 10.0), (2, 1, 0.0, 5.0)], s)
    true = spark.createDataFrame([(1, 0.0, 9.0), (3, 1.0, 2.0)], "video_id long, s double, e double")
    got = {r.video_id: (r.tp, r.f1) for r in M.event_f1(pred, true).collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (0, 0.0)}


def test_captions_and_times(spark):
    d = spark.createDataFrame([('"Wow, look at this!" #fyp \U0001f525\nsecond line',)], "t string")
    assert d.select(C.clean_caption(d.t)).first()[0] == "Wow, look at this!"
    d = spark.createDataFrame([("[01:05]",), ("soon",), (None,)], "t string")
    assert [r[0] for r in d.select(C.parse_mmss(d.t)).collect()] == [65, 0, 0]
    d = spark.createDataFrame([(65.0,), (6000.0,)], "s double")
    assert [r[0] for r in d.select(C.mmss(d.s)).collect()] == ["01:05", "100:00"]


def test_tolerance_match_is_greedy_in_order(spark):
    random.seed(5)
    p = [(i, random.randint(0, 60)) for i in range(80)]
    b = [(i, random.randint(0, 60)) for i in range(12)]
    free, want = list(b), set()
    for i, n in p:
        hit = next((c for c in free if abs(c[1] - n) <= 2), None)
        if hit:
            free.remove(hit)
            want.add((i, hit[0]))
    got = J.tolerance_match(spark.createDataFrame(p, "probe_id long, length long"), spark.createDataFrame(b, "build_id long, length long"), 2)
    assert {tuple(r) for r in got.collect()} == want


def test_bfs_stops_at_the_limit(spark):
    e = spark.createDataFrame([(1, i, i + 1, 1.0) for i in range(20)], "video_id long, i int, j int, w double")
    s = spark.createDataFrame([(1, 5)], "video_id long, idx int")
    got = sorted(r.idx for r in G.bfs_sample(G.both_ways(e), s, 4).collect())
    assert got == [3, 4, 5, 6]
