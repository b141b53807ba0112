"""Streams keep the state of many videos together: a group is one call, whatever its number of videos, and each video's rows come out as by themselves."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import timeline as T
from tideline.streaming import streams as S


class Held:
    """A state value, and the handle that gives it."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):  # noqa: N802
        return Held()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def plain_curve(x):
    """Smoothed curve before its scale, one step after the other."""
    ahead, back = list(x), list(x)
    for k in range(1, len(x)):
        ahead[k] = max(ahead[k], ahead[k - 1] * 0.9)
        back[-1 - k] = max(back[-1 - k], back[-k] * 0.9)
    weights = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    return np.convolve(np.pad(np.maximum(ahead, back), 8, mode="symmetric"), weights / weights.sum(), "valid")


def test_many_videos_in_one_state():
    """Forty curves, a few of them long, in batches that most don't have rows in."""
    rng = np.random.default_rng(5)
    curves = {v: rng.random(size) ** 3 for v, size in enumerate(rng.integers(1, 40, 36).tolist() + [900, 701, 350, 2])}
    at, seen, newest, processor = dict.fromkeys(curves, 0), {}, {}, S.IncrementalBitemporal(0.9, 2.0, 1.0)
    processor.init(Held())
    while any(at[v] < len(x) for v, x in curves.items()):
        rows = []
        for v in rng.permutation([v for v, x in curves.items() if at[v] < len(x)])[:9].tolist():
            to = min(at[v] + int(rng.integers(1, 120)), len(curves[v]))
            rows += [(v, k, curves[v][k]) for k in range(at[v], to)]
            at[v] = to
        d = pd.DataFrame(rows, columns=["video_id", "idx", "score"]).sample(frac=1, random_state=3)
        (out,) = processor.handleInputRows((0,), iter([d.iloc[:5], d.iloc[5:]]), None)
        seen |= {(r.video_id, r.idx): r.smooth for r in out.itertuples()}
        newest |= {r.video_id: (r.goal, r.top) for r in out.itertuples()}
    for v, x in curves.items():
        want = plain_curve(x)
        assert [seen[v, k] for k in range(len(x))] == pytest.approx(want.tolist(), abs=1e-9) and newest[v] == pytest.approx((x.max(), want.max()))
    assert len(processor.tail.get()[0]) / S.IncrementalBitemporal.FORM.itemsize < sum(min(len(x), 300) for x in curves.values())


def test_curves_end_to_end_are_scored_as_one_by_one():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 5, 9, 40, 3])
    x = rng.random(sizes.sum())
    parts = np.split(x, np.cumsum(sizes)[:-1])
    assert S.bitemporal_array(x, sizes) == pytest.approx(np.concatenate([np.clip(plain_curve(p) * p.max() / plain_curve(p).max(), 0, 1) for p in parts]), abs=1e-12)


def test_a_group_is_scored_at_once(spark, tmp_path):
    """120 videos of three chunks each, in three groups: calls go by groups and batches. Rows without a video are one more group."""
    folder = str(tmp_path)

    def rescore(x, sizes):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return S.bitemporal_array(x, sizes)

    rows = [(v or None, k, (v * 7 + k * 5) % 11 / 11, k, 21) for v in range(121) for k in range(21)]
    d = spark.createDataFrame(rows, "video_id long, idx int, score double, at long, n_frames long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    got = {(r.video_id, r.idx): (r["mean"], r.n) for r in S.trailing_curve(spark, S.replay(spark, d, files=3), rescore, groups=3).collect()}
    assert len(list(tmp_path.iterdir())) <= 4 * 3 and len(got) == 121 * 21
    for v in range(121):
        x, total, n = np.array([r[2] for r in rows if r[0] == (v or None)]), np.zeros(21), np.zeros(21)
        for upto in (8, 16, 21):
            total[:upto] += S.bitemporal_array(x[:upto])
            n[:upto] += 1
        assert all(got[v or None, k] == (pytest.approx(total[k] / n[k], abs=1e-9), n[k]) for k in range(21))


def test_clips_of_many_videos(spark):
    rng = np.random.default_rng(9)
    hits = {v or None: (rng.random(40) < 0.6).tolist() for v in range(60)}
    rows = [(v, k, h, 1000 + k) for v, x in hits.items() for k, h in enumerate(x)]
    d = spark.createDataFrame(rows, "video_id long, segment long, hit boolean, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    out = S.run_to_table(spark, S.extend_clips(S.replay(spark, d, files=5), groups=2)).groupBy("video_id", "clip").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    want = {}
    for v, x in hits.items():
        clip = -1
        for k, h in enumerate(x):
            if h:
                clip += not (k and x[k - 1])
                want[v, clip] = (want.get((v, clip), (k,))[0], k)
    assert {(r.video_id, r.clip): (r.s, r.e) for r in out.collect()} == want


def test_missing_scores_count_as_in_the_whole_curve(spark):
    rows = [(1, k, None if k in (3, 4, 30) else (k * 7 % 13) / 13) for k in range(50)]
    d = spark.createDataFrame(rows, "video_id long, idx int, score double").withColumn("ts", F.timestamp_seconds("idx"))
    got = {r.idx: r.calibrated for r in S.incremental_bitemporal(spark, S.replay(spark, d, files=3)).collect()}
    assert got == pytest.approx({r.idx: r.calibrated for r in T.bitemporal(d).collect()}, abs=1e-9)
