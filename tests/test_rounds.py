"""Suppression, matching and selection by rounds against going through the ranks; what a video's knapsack holds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.operators import groups as G
from tideline.operators import intervals as I
from tideline.operators import metrics as M
from tideline.operators import models as D
from tideline.operators import select as S
from tideline.operators import timeline as T


def hull_iou(a, b):
    both = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    return both / (max(a[1], b[1]) - min(a[0], b[0]))


@pytest.mark.parametrize("most,width,island", [(12, 16.0, 2000), (100, 3.0, 1), (12, 16.0, 6)])
def test_suppression_by_rounds(spark, most, width, island):
    rng = random.Random(most)
    rows = []
    for v, size, length in ((1, 60, 300), (2, 80, 40), (3, 1, 10)):
        for p in range(size):
            s = rng.uniform(0, length)
            rows.append((v, p, s, s + rng.uniform(1, 12), rng.randint(0, 9) / 10))
    d = spark.createDataFrame(rows, "video_id long, p int, start double, end double, score double")
    got = {}
    for r in I.temporal_nms(d, F.col("score"), most=most, width=width, island=island).collect():
        got.setdefault(r.video_id, set()).add(r.p)
    for v in (1, 2, 3):
        kept = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[4], r[1])):
            if len(kept) < most and all(hull_iou(k[2:4], r[2:4]) <= 0.2 for k in kept):
                kept.append(r)
        assert got[v] == {k[1] for k in kept}
    assert I.temporal_nms(d.where("false"), F.col("score")).count() == 0


def test_matching_by_rounds(spark):
    rng = random.Random(9)
    pred = [(v, k, s := rng.uniform(0, 60), s + rng.uniform(2, 9)) for v in range(6) for k in range(rng.randint(0, 14))]
    true = [(v, s := rng.uniform(0, 60), s + rng.uniform(2, 9)) for v in range(7) for _ in range(rng.randint(0, 14))]
    got = {r.video_id: r.tp for r in M.event_f1(spark.createDataFrame(pred, "video_id long, rank int, s double, e double"), spark.createDataFrame(true, "video_id long, s double, e double"), 0.2).collect()}
    for v in got:
        free, tp = [t for t in true if t[0] == v], 0
        for _, _, s, e in sorted((p for p in pred if p[0] == v), key=lambda p: p[1]):
            iou = lambda t: (o := max(0.0, min(e, t[2]) - max(s, t[1]))) / (e - s + t[2] - t[1] - o)  # noqa: E731, B023
            hit = min((t for t in free if iou(t) >= 0.2), key=lambda t: (-round(iou(t), 9), t[1]), default=None)
            if hit:
                free.remove(hit)
                tp += 1
        assert got[v] == tp
    assert set(got) == {p[0] for p in pred} | {t[0] for t in true}


def test_knapsack_holds_a_bit_a_choice():
    rng = np.random.default_rng(2)
    weights, values, capacity = rng.integers(5, 60, 600), rng.random(600), 3000
    tracemalloc.start()
    chosen = S.knapsack(weights, values, capacity)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * 3001 / 8 + 500_000  # 14 MB as numbers
    best = np.zeros((601, capacity + 1))
    for i in range(600):
        best[i + 1] = best[i]
        best[i + 1, weights[i] :] = np.maximum(best[i, weights[i] :], best[i, : capacity + 1 - weights[i]] + values[i])
    assert values[chosen].sum() == pytest.approx(best[-1, -1]) and weights[chosen].sum() <= capacity
    assert S.knapsack(np.array([3, 4]), np.array([0.5, 0.1]), 100) == [0, 1] and S.knapsack(np.array([], int), np.array([]), 5) == []


def test_grown_clips_by_a_loop(spark):
    """Uneven times, long plateaus and several peaks, against the rule row by row."""
    rng = np.random.default_rng(12)
    rows = []
    for v in range(4):
        t = np.cumsum(rng.choice([0.5, 1.0, 1.0, 2.0], 90)) - 0.5
        x = np.convolve(rng.random(94), np.ones(5) / 5, "valid")
        rows += [(v, k, float(t[k]), float(x[k])) for k in range(90)]
    d = spark.createDataFrame(rows, "video_id long, idx int, t double, score double")
    got = {(r.video_id, r.p): (r.start, r.end, r.frame_score) for r in T.peak_grow(d).collect()}
    want = {}
    for v in range(4):
        mine = [r for r in rows if r[0] == v]
        t, x = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        n, step = (x - x.min()) / (x.max() - x.min() + 1e-8), float(np.percentile(np.diff(t), 50))
        for p in range(90):
            if (p and n[p] <= n[p - 1]) or (p < 89 and n[p] < n[p + 1]):
                continue
            below = t[n < 0.6 * n[p]]
            a = max(below[below < t[p]], default=None)
            b = min(below[below > t[p]], default=None)
            a, b = t[0] if a is None else a + step, t[-1] + step if b is None else b
            half = min(max(b - a, 4.0), 12.0)
            start = t[p] - half / 2 if b - a < 4 or b - a > 12 else a
            start = max(0.0, min(start, t[-1] + step - half))
            end = min(start + half, t[-1] + step)
            want[v, p] = (start, end, x[(t >= start) & (t < end)].mean())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_only_spaced_frames_are_scored(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(rows):
        seen.add(len(rows))
        return float(rows["idx"].sum())

    clips = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.9), (1, 1, 20.0, 22.0, 0.8), (1, 2, 30.0, 60.0, 0.1)], "video_id long, p int, start double, end double, frame_score double")
    f = spark.range(100).select(F.lit(1).cast("long").alias("video_id"), F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("t"))
    got = {r.p: r.clip_score for r in D.clip_verifier(clips, f, score, k=4, top=2).collect()}
    assert got == {0: 0 + 3 + 6 + 9, 1: 20 + 21, 2: None} and seen.value == 6


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_across_batches(size):
    """Groups that end within, at and beyond batches, groups of null keys and empty batches."""
    rows = [(None, None)] * 3 + [(None, "a")] + [(1, None)] * 2 + [(1, "a")] * 5 + [(1, "b")] + [(2, "b")] * 9
    t = pa.table({"v": pa.array([r[0] for r in rows], pa.int64()), "k": pa.array([r[1] for r in rows], pa.string()), "n": list(range(len(rows)))})
    batches = t.to_batches(max_chunksize=size)
    got = []
    for whole, first in G.whole_groups(iter([batches[0].slice(0, 0), *batches, batches[0].slice(0, 0)]), ["v", "k"]):
        n = whole["n"].to_pylist()
        got += [n[a:b] for a, b in zip(first, [*first[1:], len(n)])]
    want = {}
    for n, r in enumerate(rows):
        want.setdefault(r, []).append(n)
    assert got == list(want.values())
    assert list(G.whole_groups(iter([]), ["v"])) == [] and [x[1].tolist() for x in G.whole_groups(iter([batches[0].slice(0, 1)]), ["v"])] == [[0]]


def test_small_batches_change_nothing(spark):
    """Kendall, knapsack, placed and verified clips with batches of three rows and of the usual size."""
    rng = random.Random(3)
    f = spark.createDataFrame([(v, i, float(i), rng.random(), rng.randint(0, 5) / 5) for v in range(6) for i in range(40 if v else 1)], "video_id long, idx int, t double, a double, b double")
    clips = T.peak_grow(f, "a", shortest=2.0, longest=6.0).cache()
    shots = f.select("video_id", F.col("idx").alias("shot_id"), F.col("idx").alias("end_f"), (F.col("idx") % 3 + 1).alias("length"), F.col("a").alias("mean"))

    def everything():
        found = [M.kendall_tau_b(f, ["video_id"], "a", "b"), S.budget_knapsack(shots), S.greedy_clip_selection(clips.withColumnRenamed("frame_score", "score")), D.clip_verifier(clips, f, lambda rows: rows["b"].mean() + rows["idx"].iloc[0])]
        return [sorted(map(tuple, d.collect()), key=str) for d in found]

    usual = everything()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert everything() == usual and all(usual)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0] for r in usual[0]} == set(range(1, 6))  # one row has no tau
