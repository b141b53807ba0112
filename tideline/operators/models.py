"""Fitted models over vectors: components, regression, preference fits; and plug-in scorers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import clip01, sigmoid
from tideline.operators.groups import spread


def as_vector(c: str | Column) -> Column:
    return array_to_vector(F.transform(c, lambda x: x.cast("double")))


def moments(df: DataFrame, columns: list[Column], by: Column | None = None) -> dict:
    """By value of `by`: the sums of z z' over rows, z being 1 and the numbers of `columns` (vectors or numbers). Rows with a null are left out.

    A task keeps one matrix a value and sends it once; what reaches the driver has the size of the matrices, however many rows there are.
    """
    parts = [F.transform(c, lambda x: x.cast("double")) if dict(df.select(c.alias("c")).dtypes)["c"].startswith("array") else F.array(c.cast("double")) for c in columns]
    d = df.select((by if by is not None else F.lit(0)).cast("string").alias("by"), F.concat(F.array(F.lit(1.0)), *parts).alias("z")).where(F.col("z").isNotNull() & F.forall("z", lambda x: x.isNotNull()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            if b.num_rows:
                z = b.column("z").flatten().to_numpy().reshape(b.num_rows, -1)
                coded = b.column("by").dictionary_encode()
                for k, key in enumerate(coded.dictionary.to_pylist()):
                    mine = z[coded.indices.to_numpy() == k]
                    total[key] = total.get(key, 0) + mine.T @ mine
        for key, m in total.items():
            yield pa.record_batch({"by": pa.array([key] * m.size, pa.string()), "pos": pa.array(np.arange(m.size)), "v": pa.array(m.ravel())})

    rows = d.where("by is not null").mapInArrow(sums, "by string, pos long, v double").groupBy("by", "pos").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for key, g in rows.groupby("by"):
        n = math.isqrt(len(g))
        out[key] = g.sort_values("pos")["v"].to_numpy().reshape(n, n)
    return out


def covariance(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and covariances (by n) of a matrix of `moments`."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """df with pc1 ... pck, and explained1 ...: shares of variance. A component's sign makes its largest loading (the first of equals) positive."""
    found = moments(df, [F.col(vector)])
    if not found:
        return df.withColumns({f"{name}{i + 1}": F.lit(None).cast("double") for i in range(k) for name in ("pc", "explained")})
    _, mean, c = covariance(found["0"])
    values, axes = np.linalg.eigh(c)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i in range(k):
        w = axes[:, i] * np.sign(axes[np.argmax(np.round(np.abs(axes[:, i]), 9)), i])
        out[f"pc{i + 1}"] = dot(F.col(vector), w) - float(w @ mean)
        out[f"explained{i + 1}"] = F.lit(float(values[i] / values.sum()))
    return df.withColumns(out)


def dot(vector: Column, weights: np.ndarray) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def least_squares(m: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and intercept for the last column of `moments` from the others; the penalty is `ridge` times each weight squared times its column's variance."""
    _, mean, c = covariance(m)
    a = c[:-1, :-1] + ridge * np.diag(np.diag(c)[:-1])
    a[np.diag_indices_from(a)] += np.diag(a) == 0  # a constant column gets weight 0
    w = np.linalg.lstsq(a, c[:-1, -1], rcond=None)[0]
    return w, float(mean[-1] - w @ mean[:-1])


def score_regression(train: DataFrame, test: DataFrame, vector: str = "feature", target: str = "gt", ridge: float = 0.1) -> DataFrame:
    """test with `prediction`: squared loss on train's vectors, by normal equations, clipped to [0, 1]."""
    w, b = least_squares(moments(train, [F.col(vector), F.col(target)])["0"], ridge)
    return test.withColumn("prediction", clip01(dot(F.col(vector), w) + F.lit(b)))


def cross_validate(df: DataFrame, split: str, vector: str = "feature", target: str = "gt", ridge: float = 0.1) -> DataFrame:
    """df with `prediction` from the rows of all other splits: one aggregation gives every split's sums, and a training set's are the total less the split's own.

    Splits are few; their models are small rows that are joined by split.
    """
    sums = moments(df, [F.col(vector), F.col(target)], F.col(split))
    total = sum(sums.values())
    models = [(key, *least_squares(total - own, ridge)) for key, own in sums.items() if len(sums) > 1]
    rows = df.sparkSession.createDataFrame([(key, w.tolist(), b) for key, w, b in models], "split__ string, w__ array<double>, b__ double")
    j = df.join(F.broadcast(rows), F.col(split).cast("string") == F.col("split__"))  # a row a split
    value = F.aggregate(F.zip_with(vector, "w__", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) + F.col("b__")
    return j.withColumn("prediction", clip01(value)).drop("split__", "w__", "b__")


def preference_fit(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", ridge: float = 0.01) -> list[float]:
    """Weights of a linear scorer from pairs of vectors: logistic regression on the differences, each pair given both ways round."""
    d = F.zip_with(chosen, rejected, lambda a, b: a.cast("double") - b.cast("double"))
    up = pairs.select(as_vector(d).alias("x__"), F.lit(1.0).alias("y__"))
    down = pairs.select(as_vector(F.transform(d, lambda x: -x)).alias("x__"), F.lit(0.0).alias("y__"))
    return LogisticRegression(featuresCol="x__", labelCol="y__", fitIntercept=False, regParam=ridge).fit(up.union(down)).coefficients.toArray().tolist()


def linear_score(vector: Column, weights: list[float]) -> Column:
    w = F.array(*map(F.lit, weights))
    return sigmoid(F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x))


def scorer_plugin(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.Series]], out: str = "score", batch: int = 256) -> DataFrame:
    """df with a user's score: make() runs once a task, then its result on batches of bounded size."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name != out)}, `{out}` double"
    kept = [c for c in df.columns if c != out]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for p in parts:
            for at in range(0, len(p), batch):
                b = p.iloc[at : at + batch]
                yield b[kept].assign(**{out: scorer(b)})

    return df.mapInPandas(run, schema)


def clip_verifier(clips: DataFrame, frames: DataFrame, score: Callable[[pd.DataFrame], float], k: int = 4, top: int = 8, width: float = 12.0) -> DataFrame:
    """clips (video_id, p, start, end, frame_score) with clip_score of the best `top` of each video, from k evenly spaced frames, and rank_score.

    Frames meet clips by cells of `width`, and only the k frames of a clip reach the scoring function.
    """
    from tideline.operators.joins import range_join_points
    from tideline.operators.tables import top_k

    best = top_k(clips, ["video_id"], [F.round("frame_score", 9).desc(), F.asc("p")], top)
    j = range_join_points(frames, best.select("video_id", "p", "start", "end"), "t", "start", "end", width).where("t < end")
    of_clip = Window.partitionBy("video_id", "p")
    j = spread(j, "video_id", "p").withColumns({"at__": F.row_number().over(of_clip.orderBy("idx")) - 1, "n__": F.count("*").over(of_clip)})
    spaced = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n__")) - 1), lambda i: F.rint(i * (F.col("n__") - 1) / F.greatest(F.least(F.lit(k), F.col("n__")) - 1, F.lit(1))).cast("int"))
    picked = j.where(F.array_contains(spaced, F.col("at__"))).drop("n__").sortWithinPartitions("video_id", "p", "at__")

    def scores(d: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        own = d.drop(columns="at__")
        found = [float(score(own.iloc[a:b].reset_index(drop=True))) for a, b in zip(first, np.r_[first[1:], len(d)])]
        return d[["video_id", "p"]].iloc[first].assign(clip_score=found)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the clip that a batch leaves open: k rows at most
        for part in parts:
            d = part if held is None else pd.concat([held, part])
            first = np.flatnonzero(d["at__"].to_numpy() == 0)
            if len(first):
                if len(first) > 1:
                    yield scores(d.iloc[: first[-1]], first[:-1])
                held = d.iloc[first[-1] :]
        if held is not None:
            yield scores(held, np.array([0]))

    kind = dict(clips.dtypes)
    scored = picked.mapInPandas(run, f"video_id {kind['video_id']}, p {kind['p']}, clip_score double")
    out = clips.join(scored, ["video_id", "p"], "left")
    return out.withColumn("rank_score", F.coalesce(0.5 * F.col("frame_score") + 0.5 * F.col("clip_score"), F.col("frame_score")))
