"""Preference pairs: pools of clips, losses and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.tables import seeded, top_k
from tideline.sources.views import video


def clip_pools(df: DataFrame, length: int, quantile: float, value: str = "gt") -> DataFrame:
    """video_id, clip, m, k, hi, lo: non-overlapping clips with their mean, and ranks from both ends; a last clip that ends with the video is left out."""
    d = df.withColumn("n", F.count("*").over(video())).where(F.floor(F.col("idx") / length) * length < F.col("n") - length)
    c = d.groupBy("video_id", F.floor(F.col("idx") / length).cast("int").alias("clip")).agg(F.avg(value).alias("m"))
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(video()) * quantile))
    rank = lambda o: F.row_number().over(Window.partitionBy("video_id").orderBy(o, "clip"))
    return c.select("*", k.alias("k"), rank(F.round("m", 9).desc()).alias("hi"), rank(F.round("m", 9)).alias("lo"))


def pair_pools(pools: DataFrame, margin: float, seed: int) -> DataFrame:
    """Each clip of the upper pool that beats the best of the lower one by `margin`, with a seeded pick of the lower pool."""
    low = pools.where("lo <= k").select("video_id", F.col("clip").alias("rejected"), F.col("m").alias("rm"))
    best = low.groupBy("video_id").agg(F.max("rm").alias("top"))
    up = pools.where("hi <= k").join(best, "video_id").where(F.col("m") >= F.col("top") + margin).select("video_id", F.col("clip").alias("chosen"))
    return top_k(up.join(low.drop("rm"), "video_id"), ["video_id", "chosen"], [seeded("video_id", "chosen", "rejected", seed=seed)], 1).select("video_id", "chosen", "rejected")


def preference_losses(z: Column) -> dict[str, Column]:
    """DPO, IPO, focal, and the importance weight of a logit."""
    s = 1 / (1 + F.exp(-z))
    return {"dpo": -F.log(s), "ipo": z * z, "focal": (1 - s) * (1 - s) * -F.log(s), "weight": F.least(F.greatest(F.exp(-z), F.lit(0.1)), F.lit(5.0))}
