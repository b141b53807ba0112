"""Operators on intervals of a video: clips, shots, segments, events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.groups import whole_groups
from tideline.operators.timeline import merge_gaps


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column, hull: bool = False) -> Column:
    """Intersection over the true union, or over the hull of both."""
    both = overlap(s1, e1, s2, e2)
    union = F.greatest(e1, e2) - F.least(s1, s2) if hull else (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlapping(a: DataFrame, b: DataFrame, width: float = 16.0) -> DataFrame:
    """Pairs of intervals of a video, a (s, e) and b (s2, e2), that share more than an end: an equi-join on cells of `width`, each pair in its first shared cell."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))).alias("cell")
    j = a.select("*", cells("s", "e")).join(b.withColumnsRenamed({"s": "s2", "e": "e2"}).select("*", cells("s2", "e2")), ["video_id", "cell"])
    return j.where((F.col("cell") == F.floor(F.greatest("s", "s2") / width)) & (F.least("e", "e2") > F.greatest("s", "s2"))).drop("cell")


#: Clips of an island (a chain of clips that overlap) that are suppressed in one task; larger islands go by rounds.
ISLAND = 2000


def _best_first(overlap: float, start: str, end: str):
    """Rows sorted by video, island and rank: of each island the clips that going through the ranks keeps."""

    def kept(t: pa.Table, first: np.ndarray) -> pa.Table:
        s, e = (t[c].to_numpy().astype(float) for c in (start, end))
        stay = np.ones(len(s), bool)
        for a, b in zip(first, np.r_[first[1:], len(s)]):
            for k in range(a, b - 1):
                if stay[k]:
                    both = np.minimum(e[k + 1 : b], e[k]) - np.maximum(s[k + 1 : b], s[k])
                    stay[k + 1 : b] &= ~(both > np.maximum(overlap * (np.maximum(e[k + 1 : b], e[k]) - np.minimum(s[k + 1 : b], s[k])), 0.0))
        return t.filter(pa.array(stay))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, ["video_id", "island__"]):
            yield from kept(t, first).to_batches()

    return run


def _by_rounds(ranked: DataFrame, overlap: float, start: str, end: str, width: float) -> DataFrame:
    """The same over pairs that overlap more: a clip that none of its open neighbours outranks is kept, and its neighbours go. A round is a few joins on what is left of the pairs."""
    from tideline.operators.graph import cut_lineage

    own = ranked.select("video_id", F.col("rank__").alias("r"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"))
    both, hull = F.least("e", "e2") - F.greatest("s", "s2"), F.greatest("e", "e2") - F.least("s", "s2")
    pairs = overlapping(own, own.withColumnRenamed("r", "r2"), width).where((F.col("r") < F.col("r2")) & (both > overlap * hull))
    pairs = cut_lineage(pairs.select("video_id", "r", "r2"))  # the first one outranks the second
    lost = None
    while not pairs.isEmpty():
        beaten = pairs.select("video_id", F.col("r2").alias("r")).distinct()
        tops = pairs.join(beaten, ["video_id", "r"], "left_anti")
        gone = cut_lineage(tops.select("video_id", F.col("r2").alias("r")).distinct())
        lost = gone if lost is None else lost.union(gone)
        left = pairs.join(beaten, ["video_id", "r"], "left_semi").join(gone, ["video_id", "r"], "left_anti")
        pairs = cut_lineage(left.join(gone.withColumnRenamed("r", "r2"), ["video_id", "r2"], "left_anti").select("video_id", "r", "r2"))
    return ranked if lost is None else ranked.join(lost.withColumnRenamed("r", "rank__"), ["video_id", "rank__"], "left_anti").select(ranked.columns)


def temporal_nms(clips: DataFrame, score: Column, most: int = 12, overlap: float = 0.2, start: str = "start", end: str = "end", width: float = 16.0, island: int = ISLAND) -> DataFrame:
    """Best first, keep a clip whose hull IoU with all kept ones is at most `overlap`, until `most` are kept. Ties go by the other columns, in their order.

    Clips only bear on clips of their island, a chain of clips that overlap. An island is held at once; one of more than `island` clips is never gathered, it goes by
    rounds over its overlapping pairs. The first `most` of a video that stay are taken at the end, which is where going through the ranks stops.
    """
    from tideline.operators.graph import cut_lineage

    rest = [c for c in clips.columns if c != "video_id"]
    along = Window.partitionBy("video_id").orderBy(start, end)
    before = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    d = clips.withColumn("rank__", F.row_number().over(Window.partitionBy("video_id").orderBy(score.desc(), *rest)))
    d = d.withColumn("new__", F.coalesce((F.col(start) >= before).cast("int"), F.lit(1))).withColumn("island__", F.sum("new__").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("new__")
    d = cut_lineage(d.withColumn("size__", F.count("*").over(Window.partitionBy("video_id", "island__"))))
    small = d.where(F.col("size__") <= island).repartition("video_id").sortWithinPartitions("video_id", "island__", "rank__")
    kept = small.mapInArrow(_best_first(overlap, start, end), d.schema)
    large = d.where(F.col("size__") > island)
    if not large.isEmpty():
        kept = kept.unionByName(_by_rounds(large, overlap, start, end, width))
    kept = kept.withColumn("n__", F.row_number().over(Window.partitionBy("video_id").orderBy("rank__"))).where(F.col("n__") <= most)
    return kept.select("video_id", *rest)


def lead_in(clips: DataFrame, seconds: float) -> DataFrame:
    """Clips that start up to `seconds` earlier, not before 0; `lead_in` is how much."""
    new = F.greatest(F.lit(0.0), F.col("start") - seconds)
    return clips.withColumn("lead_in", F.col("start") - new).withColumn("start", new)


def merge_touching(clips: DataFrame, gap: float = 0.5) -> DataFrame:
    """Fuse clips with a gap of at most `gap`: duration-weighted score, the start of the best clip, and how many."""
    length = F.col("end") - F.col("start")
    more = {"score": F.sum(F.col("score") * length) / F.sum(length), "best": F.max_by("start", F.struct(F.round("score", 9), -F.col("start"))), "merged": F.count("*")}
    return merge_gaps(clips, gap, aggregates=more)


def mean_inside(runs: DataFrame, curve: DataFrame, value: str) -> DataFrame:
    """runs (video_id, start_i, end_i) with the mean of a curve's rows inside, ends included: positions are exploded, so the join is on equality."""
    p = runs.select("video_id", "start_i", "end_i", F.explode(F.sequence("start_i", "end_i")).alias("idx"))
    return p.join(curve, ["video_id", "idx"]).groupBy("video_id", "start_i", "end_i").agg(F.avg(value).alias(value))


def boundaries_to_intervals(bounds: DataFrame, lengths: DataFrame) -> DataFrame:
    """Inclusive intervals between boundaries (video_id, b); 0 and n (lengths: video_id, n) are added."""
    b = bounds.union(lengths.select("video_id", F.lit(0))).union(lengths.select("video_id", "n")).distinct()
    end = F.lead("b").over(Window.partitionBy("video_id").orderBy("b")) - 1
    return b.select("video_id", F.col("b").alias("start_f"), end.alias("end_f")).where("end_f is not null")
