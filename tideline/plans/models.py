"""Plug-ins and fitted models."""

import pandas as pd
from pyspark.sql import functions as F

from tideline.functions.scalars import r6
from tideline.operators import metrics as E
from tideline.operators import models as M
from tideline.operators import timeline as T
from tideline.plans.registry import query
from tideline.plans.timeline import GROWN
from tideline.sources.views import frame_features, frames


def fake_scorer():
    """A scorer with two bumps, made once a task."""
    import numpy as np

    return lambda rows: pd.Series(0.1 + 0.8 * np.exp(-((rows["t"] - 3) ** 2) / 2) + 0.6 * np.exp(-((rows["t"] - 9) ** 2) / 2), index=rows.index)


@query("scorer_plugin", "frames", "SELECT video_id, idx, round(0.1 + 0.8 * exp(-pow(t - 3, 2) / 2) + 0.6 * exp(-pow(t - 9, 2) / 2), 6) AS p FROM frames")
def scorer_plugin(spark, sf):
    d = M.scorer_plugin(frames(spark, sf).select("video_id", "idx", "t"), fake_scorer, "p", batch=128)
    return d.select("video_id", "idx", r6("p").alias("p"))


@query(
    "clip_verifier_plugin", "frames",
    GROWN + """, rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(frame_score, 9) DESC, p) AS rn FROM clips), fr AS (SELECT r.video_id, r.p, list(f.gt ORDER BY f.idx) AS l, count(*) AS n FROM rk r JOIN frames f ON f.video_id = r.video_id AND f.t >= r.start AND f.t < r."end" WHERE rn <= 8 GROUP BY 1, 2),
cs AS (SELECT video_id, p, list_avg(list_transform(range(0, least(4, n)), lambda i: l[1 + CAST(round(i * (n - 1) / CAST(greatest(least(4, n) - 1, 1) AS DOUBLE)) AS INT)])) AS s FROM fr)
SELECT c.video_id, c.p, round(frame_score, 6) AS frame_score, round(s, 6) AS clip_score, round(coalesce(0.5 * frame_score + 0.5 * s, frame_score), 6) AS rank_score FROM clips c LEFT JOIN cs ON cs.video_id = c.video_id AND cs.p = c.p""",
)
def clip_verifier_plugin(spark, sf):
    """The eight best clips of each video, verified from four frames."""
    f = frames(spark, sf).select("video_id", "idx", "t", "gt")
    d = M.clip_verifier(T.peak_grow(frames(spark, sf)), f, lambda rows: rows["gt"].mean())
    return d.select("video_id", "p", *[r6(c).alias(c) for c in ("frame_score", "clip_score", "rank_score")])


def vectors(spark, sf):
    """Features with a target that a linear model can learn from."""
    f = frame_features(spark, sf)
    return f.withColumn("gt", F.least(F.greatest(0.5 + 2 * F.col("feature")[0].cast("double") + F.col("feature")[1].cast("double"), F.lit(0.0)), F.lit(1.0)))


#: Sums of products by split; for each split the rest's covariances and their solution by elimination (the matrix is positive definite); its model on its own rows.
FITS = """, v AS (SELECT video_id, idx, feature AS x, video_id % 5 AS split, least(greatest(0.5 + 2 * CAST(feature[1] AS DOUBLE) + CAST(feature[2] AS DOUBLE), 0), 1) AS gt FROM frame_features),
z AS (SELECT split, list_concat([1.0], CAST(x AS DOUBLE[]), [gt]) AS z FROM v), ij AS (SELECT i, j FROM range(1, 67) a(i), range(1, 67) b(j)),
own AS (SELECT split, i, j, sum(z[i] * z[j]) AS s FROM z, ij GROUP BY 1, 2, 3), al AS (SELECT i, j, sum(s) AS s FROM own GROUP BY 1, 2), rs AS (SELECT split, i, j, al.s - own.s AS s FROM own JOIN al USING (i, j)),
fr AS (SELECT split, i AS k, s FROM rs WHERE j = 1), cv AS (SELECT r.split, r.i, r.j, r.s / n.s - a.s / n.s * b.s / n.s AS c FROM rs r JOIN fr n ON n.split = r.split AND n.k = 1 JOIN fr a ON a.split = r.split AND a.k = r.i JOIN fr b ON b.split = r.split AND b.k = r.j WHERE r.i > 1 AND r.j > 1),
ro AS (SELECT split, i, list(CASE WHEN i = j THEN 1.1 * c ELSE c END ORDER BY j) AS r FROM cv WHERE i < 66 GROUP BY 1, 2), mt AS (SELECT split, list(r ORDER BY i) AS m FROM ro GROUP BY 1),
el AS (WITH RECURSIVE e AS (SELECT split, 1 AS k, m FROM mt UNION ALL SELECT split, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(list_zip(r, m[k]), lambda y: y[1] - r[k] / m[k][k] * y[2]) END) FROM e WHERE k <= 64) SELECT split, list_transform(m, lambda r: r[65]) AS w FROM e WHERE k = 65),
md AS (SELECT el.split, w, mean[65] - list_dot_product(w, mean[1:64]) AS b FROM el JOIN (SELECT f.split, list(f.s / n.s ORDER BY f.k) AS mean FROM fr f JOIN fr n ON n.split = f.split AND n.k = 1 WHERE f.k > 1 GROUP BY 1) USING (split)),
pd AS (SELECT video_id, idx, v.split, gt, least(greatest(list_dot_product(CAST(x AS DOUBLE[]), w) + b, 0), 1) AS p FROM v JOIN md USING (split))
"""


@query("score_regression", "frame_features", FITS + "SELECT video_id, idx, round(gt, 6) AS gt, round(p, 6) AS prediction FROM pd WHERE split = 0")
def score_regression(spark, sf):
    v = vectors(spark, sf)
    return M.score_regression(v.where("video_id % 5 <> 0"), v.where("video_id % 5 = 0")).select("video_id", "idx", r6("gt").alias("gt"), r6("prediction").alias("prediction"))


def preference_pairs(v):
    a = v.select("video_id", F.col("idx").alias("i"), F.col("feature").alias("chosen"), F.col("gt").alias("a"), F.explode(F.sequence(F.col("idx") - 5, F.col("idx") + 5)).alias("j"))
    return a.join(v.select("video_id", F.col("idx").alias("j"), F.col("feature").alias("rejected"), F.col("gt").alias("b")), ["video_id", "j"]).where("a > b + 0.1")


@query("pairwise_preference_fit")
def pairwise_preference_fit(spark, sf):
    v = vectors(spark, sf)
    w = M.preference_fit(preference_pairs(v.where("video_id % 5 <> 0")))
    return v.where("video_id % 5 = 0").select("video_id", "idx", "gt", M.linear_score(F.col("feature"), w).alias("score"))


@query(
    "cross_validation_run", "frame_features",
    FITS + """, rk AS (SELECT split, video_id, rank() OVER (PARTITION BY video_id ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY video_id, round(p, 9)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY video_id ORDER BY round(gt, 9)) + (count(*) OVER (PARTITION BY video_id, round(gt, 9)) - 1) / 2.0 AS b FROM pd),
rh AS (SELECT split, video_id, corr(a, b) AS rho FROM rk GROUP BY 1, 2), one AS (SELECT split, avg(rho) AS rho, count(*) AS n FROM rh GROUP BY 1) SELECT CAST(split AS INT) AS split, round(rho, 6) AS rho, n FROM one UNION ALL SELECT NULL, round(avg(rho), 6), CAST(sum(n) AS BIGINT) FROM one""",
)
def cross_validation_run(spark, sf):
    """Five splits in one aggregation and five small solves; the mean rank correlation of each split's videos, and the mean of splits."""
    v = vectors(spark, sf).withColumn("split", (F.col("video_id") % 5).cast("int"))
    tests = M.cross_validate(v, "split").select("split", "video_id", F.round("prediction", 9).alias("p"), F.round("gt", 9).alias("gt"))
    one = E.spearman(tests, ["split", "video_id"], "p", "gt").groupBy("split").agg(F.avg("rho").alias("rho"), F.count("*").alias("n"))
    both = one.unionByName(one.agg(F.lit(None).cast("int").alias("split"), F.avg("rho").alias("rho"), F.sum("n").alias("n")))
    return both.select("split", r6("rho").alias("rho"), "n")
