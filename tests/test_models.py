"""Fits from sums against direct solutions, and ranks by pushing against a linear solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import graph as G
from tideline.operators import metrics as M
from tideline.operators import models as D


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) * [1, 2, 0.1, 5, 1, 0] + 3  # one column is constant
    y = np.clip(0.5 + x[:, :3] @ [0.1, -0.05, 0.4] - 1.2 + rng.normal(size=400) * 0.05, 0, 1)
    return x, y, rng.integers(0, 5, 400)


def ridge_fit(x, y, ridge=0.1):
    """By stacked rows: the penalty as rows of their own."""
    c, spread = x - x.mean(0), x.std(0)
    a = np.vstack([c, np.diag(np.sqrt(ridge * len(x)) * spread)])
    w = np.linalg.lstsq(a, np.r_[y - y.mean(), np.zeros(x.shape[1])], rcond=None)[0]
    return w, y.mean() - w @ x.mean(0)


def table(spark, rows):
    x, y, split = rows
    data = [(i, int(split[i]), x[i].tolist(), float(y[i])) for i in range(len(x))]
    return spark.createDataFrame([*data, (900, 1, None, 0.5), (901, 2, x[0].tolist(), None), (902, 3, [None, *x[0, 1:].tolist()], 0.5)], "i long, split int, feature array<double>, gt double").repartition(5)


def test_all_folds_from_one_aggregation(spark, rows):
    x, y, split = rows
    got = {r.i: r.prediction for r in D.cross_validate(table(spark, rows), "split").collect()}
    assert set(got) >= set(range(400))
    for k in range(5):
        w, b = ridge_fit(x[split != k], y[split != k])
        for i in np.flatnonzero(split == k):
            assert got[i] == pytest.approx(np.clip(x[i] @ w + b, 0, 1), abs=1e-8)
    d = table(spark, rows)
    one = {r.i: r.prediction for r in D.score_regression(d.where("split <> 3"), d.where("split = 3")).collect()}
    assert all(one[i] == pytest.approx(got[i], abs=1e-9) for i in np.flatnonzero(split == 3))


def test_components_have_a_fixed_sign(spark, rows):
    x = rows[0]
    got = {r.i: (r.pc1, r.pc2, r.explained1) for r in D.pca(table(spark, rows).where("i < 400"), "feature", 2).collect()}
    c = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(c)
    for k, place in ((-1, 0), (-2, 1)):
        w = axes[:, k] * np.sign(axes[np.argmax(np.abs(axes[:, k])), k])
        assert all(got[i][place] == pytest.approx((x[i] - x.mean(0)) @ w, abs=1e-8) for i in range(400))
    assert got[0][2] == pytest.approx(values[-1] / values.sum())


def test_push_reads_where_rank_flows(spark, monkeypatch):
    """A long chain with side links: ranks by a linear solve, and edges of few blocks only."""
    monkeypatch.setattr(G, "PUSH_BLOCK", 20)
    n = 600
    links = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 7, 0.5) for i in range(0, n - 7, 3)]
    e = spark.createDataFrame([(1, i, j, w) for i, j, w in links], "video_id long, i int, j int, w double")
    nodes = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 0)], "video_id long, idx int")
    seeds = spark.createDataFrame([(1, 300), (1, 303)], "video_id long, idx int")
    seen = []
    ranks = G.personalized_pagerank(G.row_normalise(G.both_ways(e), nodes, "none"), seeds, nodes, tolerance=1e-10, spy=lambda d: seen.append(d.count()))
    got = {r.idx: r.p for r in ranks.collect()}
    a = np.zeros((n, n))
    for i, j, w in links:
        a[i, j] = a[j, i] = w
    start = np.zeros(n)
    start[[300, 303]] = 0.5
    want = np.linalg.solve(np.eye(n) - 0.85 * (a / a.sum(1, keepdims=True)).T, 0.15 * start)
    assert len(got) == n and all(got[i] == pytest.approx(want[i], abs=1e-7) for i in range(n))
    assert max(seen) < 0.6 * 2 * len(links)  # no round reads the whole graph


@pytest.mark.parametrize("kinds", [2, 30, 10_000])
def test_tau_by_all_pairs(spark, kinds):
    rng = np.random.default_rng(kinds)
    data = [(g, float(rng.integers(kinds)), float(rng.integers(kinds))) for g, size in ((0, 2), (1, 130), (2, 1), (3, 301)) for _ in range(size)] + [(4, 1.0, float(k)) for k in range(5)]
    got = {r.g: r.tau for r in M.kendall_tau_b(spark.createDataFrame(data, "g int, x double, y double"), ["g"], "x", "y").collect()}
    for g in (0, 1, 3, 4):
        x, y = (np.array([r[k] for r in data if r[0] == g]) for k in (1, 2))
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        below = np.sqrt((sx != 0).sum() * (sy != 0).sum())
        assert got[g] == (pytest.approx((sx * sy).sum() / below) if below else None)
    assert 2 not in got
    assert M.kendall_tau_b(spark.createDataFrame(data, "g int, x double, y double").where(F.lit(False)), ["g"], "x", "y").count() == 0
