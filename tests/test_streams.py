"""Streams with state: long curves in many batches against the whole curve, and against a loop over chunks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import timeline as T
from tideline.streaming import streams as S


def curves(spark):
    """Three videos: noise with rests of zeros, a short one, zeros only. `ts` orders all frames."""
    rng = np.random.default_rng(2)
    long = rng.random(1500) ** 3 * (rng.random(1500) < 0.4)
    long[400:900] = 0.0
    rows = [(1, k, float(x)) for k, x in enumerate(long)] + [(2, k, float(x)) for k, x in enumerate(rng.random(11))] + [(3, k, 0.0) for k in range(700)]
    return spark.createDataFrame([(v, k, x, 1000 + k) for v, k, x in rows], "video_id long, idx int, score double, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_incremental_curve_is_the_whole_curve(spark, monkeypatch):
    d = curves(spark)
    sizes = []
    run = S.run_to_table

    def spied(spark_, stream):
        out = run(spark_, stream)
        sizes.extend(r["n"] for r in out.groupBy("video_id", "upto").agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(S, "run_to_table", spied)
    got = {(r.video_id, r.idx): r.calibrated for r in S.incremental_bitemporal(spark, S.replay(spark, d, files=12)).collect()}
    want = {(r.video_id, r.idx): r.calibrated for r in T.bitemporal(d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(sizes) > 20 and max(sizes) <= 1500 // 12 + 300  # a batch's frames and the open tail, however much came before


def trailing_loop(x, chunk, most):
    total, n = np.zeros(len(x)), np.zeros(len(x), int)
    for at in range(0, len(x), chunk):
        upto = min(at + chunk, len(x))
        low = max(0, upto - most)
        total[low:upto] += S.bitemporal_array(x[low:upto])
        n[low:upto] += 1
    return total / n, n


@pytest.mark.parametrize("chunk,most,files", [(8, 300, 5), (7, 20, 9)])
def test_trailing_buffer_by_chunks(spark, chunk, most, files):
    d = curves(spark)
    got = {}
    for r in S.trailing_curve(spark, S.replay(spark, d.withColumn("n_frames", F.count("*").over(Window.partitionBy("video_id"))), files=files), chunk=chunk, most=most).collect():
        got[r.video_id, r.idx] = (r["mean"], r["n"])
    by = {}
    for r in d.orderBy("video_id", "idx").collect():
        by.setdefault(r.video_id, []).append(r.score)
    assert len(got) == sum(map(len, by.values()))
    for v, x in by.items():
        mean, n = trailing_loop(np.array(x), chunk, most)
        assert all(got[v, k] == (pytest.approx(mean[k], abs=1e-9), n[k]) for k in range(len(x)))


def test_frames_have_to_follow_each_other(spark):
    d = curves(spark).where("video_id = 2 and idx <> 4").withColumn("n_frames", F.lit(11))
    with pytest.raises(Exception, match="follow each other"):
        S.trailing_curve(spark, S.replay(spark, d, files=2)).collect()


