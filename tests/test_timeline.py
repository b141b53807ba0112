"""Hand-made curves with known results, and plain loops against the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import intervals as I
from tideline.operators import select as S
from tideline.operators import timeline as T


def curve(spark, values, column="score"):
    rows = [(1, i, float(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"video_id long, idx int, t double, {column} double")


def bumps():
    return [0.05 + 0.9 * math.exp(-((t - 20) ** 2) / 8) + 0.6 * math.exp(-((t - 45) ** 2) / 4) for t in range(60)]


def decay_loop(x, d):
    out = []
    for seq in (x, x[::-1]):
        m, o = 0.0, []
        for v in seq:
            m = max(v, m * d)
            o.append(m)
        out.append(o)
    return [max(a, b) for a, b in zip(out[0], out[1][::-1])]


def gauss(x, s):
    r = int(4 * s + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
    p = np.pad(np.array(x, float), r, mode="symmetric")
    return np.convolve(p, w / w.sum(), "valid")


def test_decayed_max_and_gaussian_match_loops(spark):
    random.seed(1)
    x = [random.uniform(0.6, 1) if random.random() < 0.1 else random.uniform(0, 0.05) for _ in range(120)]
    d = T.decayed_max(curve(spark, x), "score", 0.9, "d").orderBy("idx").collect()
    assert [r.d for r in d] == pytest.approx(decay_loop(x, 0.9), abs=1e-12)
    for sigma, values in ((2.0, x), (20.0, x[:15]), (0.0, x)):
        g = T.gaussian_filter(curve(spark, values), "score", sigma, "g").orderBy("idx").collect()
        assert [r.g for r in g] == pytest.approx(list(gauss(values, sigma)) if sigma else values, abs=1e-12)


def test_edge_curves(spark):
    assert T.bitemporal(curve(spark, [0.0] * 10)).where("calibrated <> 0").count() == 0
    assert T.bitemporal(curve(spark, [0.7])).first().calibrated == pytest.approx(0.7)
    assert T.bitemporal(curve(spark, [1.0])).count() == 1
    assert T.bitemporal(curve(spark, [1.0]).limit(0)).count() == 0
    assert T.decayed_max(curve(spark, [0.2, -1.0, 0.3]), "score", 0.0, "d").orderBy("idx").collect()[1].d == 0


def test_ema_starts_from_first_value(spark):
    d = spark.createDataFrame([("r", 2, 3.0), ("r", 0, 1.0), ("r", 1, 2.0)], "run string, step int, v double")
    assert [r.ema for r in T.ema(d, "v", 0.9, ("run",), "step").orderBy("step").collect()] == pytest.approx([1.0, 1.1, 1.29])


def test_peaks_grow_inside_the_video(spark):
    p = T.peak_grow(curve(spark, bumps())).orderBy("p").collect()
    assert [r.p for r in p if r.frame_score > 0.2] == [20, 45]
    assert all(0 <= r.start < r.end <= 60 and 4 <= r.end - r.start <= 12.0001 for r in p)
    flat = T.local_maxima(curve(spark, [0.3] * 10), "score").collect()
    assert [r.idx for r in flat] == [0]


def test_nms_keeps_no_overlap(spark):
    clips = spark.createDataFrame([(1, 10.0, 16.0, 0.9), (1, 30.0, 36.0, 0.8), (1, 0.0, 6.0, 0.7), (1, 12.0, 18.0, 0.95)], "video_id long, start double, end double, s double")
    kept = T and I.temporal_nms(clips, F.col("s"), 12, 0.2).orderBy("start").collect()
    assert [(r.start, r.end) for r in kept] == [(0, 6), (12, 18), (30, 36)]


def clip(start, end, peak, score):
    return {"start": float(start), "end": float(end), "peak": float(peak), "score": score}


def test_greedy_selection_known_cases(spark):
    def select(*clips, **options):
        d = spark.createDataFrame([{"video_id": 1} | {k: float(v) for k, v in c.items()} for c in clips])
        return S.greedy_clip_selection(d, **options).orderBy("start").collect()

    got = select(clip(10, 16, 13, 0.9), clip(30, 36, 33, 0.8), clip(0, 6, 3, 0.7), clip(12, 18, 15, 0.95), target=14)
    assert [(c["start"], c["end"]) for c in got] == [(10, 18), (30, 36)] and got[0]["merged"] == 2
    assert [(c["start"], c["end"]) for c in select(clip(0, 4, 2, 0.8), clip(10, 14, 12, 0.1))] == [(0, 4)]
    got = select(clip(10, 16, 13, 0.9), clip(14, 20, 17, 0.8), clip(15, 16.5, 16, 0.7))
    assert [(c["start"], c["end"]) for c in got] == [(10, 20)]


def test_times_and_not_rows_bound_events_at_two_rows_a_second(spark):
    """The curve of two bumps, sampled at 2 Hz: events have the same times as at 1 Hz, within a step."""
    score = lambda t: 0.05 + 0.9 * math.exp(-((t - 20) ** 2) / 8) + 0.6 * math.exp(-((t - 45) ** 2) / 4)
    both = {}
    for hertz in (1, 2):
        d = spark.createDataFrame([(1, i, i / hertz, score(i / hertz)) for i in range(60 * hertz)], "video_id int, idx int, t double, score double")
        both[hertz] = [
            [(r["start"], r["end"]) for r in x.orderBy("start").collect()]
            for x in (T.peak_grow(d), T.threshold_segments(d, threshold=0.3), T.adaptive_events(d, sigma=hertz, min_duration=3.0), T.top_peak_events(d, min_duration=3.0))
        ]
    for one, two in zip(both[1], both[2]):
        assert len(one) == len(two) > 0
        assert all(abs(a - b) <= 1.5 for p, q in zip(one, two) for a, b in zip(p, q))


def test_lead_in(spark):
    d = spark.createDataFrame([(1, 10.0, 16.0), (1, 2.0, 8.0), (1, 0.0, 6.0)], "video_id long, start double, end double")
    got = [(r.start, r.lead_in) for r in I.lead_in(d, 5.0).collect()]
    assert got == [(5.0, 5.0), (0.0, 2.0), (0.0, 0.0)]


def test_knapsack_is_optimal():
    random.seed(3)
    for _ in range(60):
        n = random.randint(1, 9)
        w, v = np.array([random.randint(1, 9) for _ in range(n)]), np.array([random.random() for _ in range(n)])
        cap = random.randint(0, 25)
        best = max(sum(v[i] for i in range(n) if m >> i & 1) for m in range(1 << n) if sum(w[i] for i in range(n) if m >> i & 1) <= cap)
        got = S.knapsack(w, v, cap)
        assert sum(w[got]) <= cap and sum(v[got]) == pytest.approx(best)


def test_partitioning_does_not_matter(spark):
    rows = [(v, i, float(i), ((i * 37 + v * 11) % 101) / 100) for v in range(5) for i in range(50)]
    d = spark.createDataFrame(rows, "video_id long, idx int, t double, score double")
    results = [{tuple(r) for r in T.threshold_segments(d.repartition(n), threshold=0.6).collect()} for n in (1, 8)]
    assert results[0] == results[1] and results[0]


def test_the_peak_moves_into_what_is_left(spark):
    """Of a clip that loses the part with its peak, the peak moves to the nearest end of the rest."""
    d = spark.createDataFrame([(1, 10.0, 20.0, 12.0, 0.9), (1, 8.0, 30.0, 13.0, 0.8)], "video_id long, start double, end double, peak double, score double")
    got = [tuple(r) for r in S.greedy_clip_selection(d, gap=-1.0).orderBy("start").select("start", "end", "peak").collect()]
    assert got == [(10.0, 20.0, 12.0), (20.0, 30.0, 20.0)]
