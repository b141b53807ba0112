"""Operators on frame graphs: edges (video_id, src, dst, w), as joins and grouped sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.joins import similarity_edges
from tideline.sources.files import scratch_root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the folder that spark.checkpoint.dir names and go on from there (a temporary one only where none is named)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def temporal_graph(features: DataFrame, window: int, threshold: float) -> DataFrame:
    """video_id, i, j, w, edge_type, i < j: the backbone (i, i + 1) and similarity edges further apart."""
    by = Window.partitionBy("video_id").orderBy("idx")
    back = features.select("video_id", F.col("idx").alias("i"), F.lead("idx").over(by).alias("j")).where("j is not null").select("video_id", "i", "j", F.lit(1.0).alias("w"), F.lit("backbone").alias("edge_type"))
    near = similarity_edges(features, window, threshold=threshold).where("j - i > 1").withColumn("edge_type", F.lit("similarity"))
    return back.unionByName(near)


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, w of undirected edges i, j."""
    a = edges.select("video_id", F.col("i").alias("src"), F.col("j").alias("dst"), "w")
    return a.union(a.select("video_id", "dst", "src", "w"))


def row_normalise(edges: DataFrame, nodes: DataFrame, self_loops: str = "before") -> DataFrame:
    """Transition weights. self_loops: "before" adds weight 1 to itself first; "none" leaves rows without edges out; "after" adds the identity to normalised rows."""
    loops = nodes.select("video_id", F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(1.0).alias("w"))
    e = edges.unionByName(loops) if self_loops == "before" else edges
    total = F.sum("w").over(Window.partitionBy("video_id", "src"))
    e = e.withColumn("w", F.col("w") / (total + 1e-8) if self_loops == "before" else F.when(total > 0, F.col("w") / total).otherwise(F.col("w")))
    return e.unionByName(loops) if self_loops == "after" else e


def label_diffusion(transition: DataFrame, labels: DataFrame, value: str, alpha: float, steps: int) -> DataFrame:
    """labels (video_id, idx, value) with y: y <- (1 - alpha) y0 + alpha A y, `steps` times; lineage is cut every few steps."""
    y0 = labels.select("video_id", "idx", F.col(value).alias("y0"))
    y = y0.withColumnRenamed("y0", "y")
    for k in range(steps):
        moved = transition.join(y.withColumnRenamed("idx", "dst"), ["video_id", "dst"]).groupBy("video_id", "src").agg(F.sum(F.col("w") * F.col("y")).alias("m"))
        y = y0.join(moved.withColumnRenamed("src", "idx"), ["video_id", "idx"], "left").select("video_id", "idx", ((1 - alpha) * F.col("y0") + alpha * F.coalesce("m", F.lit(0.0))).alias("y"))
        if k % 3 == 2 and k + 1 < steps:
            y = cut_lineage(y)
    return y


def bfs_sample(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """video_id, idx, level: from the seeds, each round adds neighbours of those added last, until a video has `most` or no more can be reached.

    The best edge to a seed goes first (a node without one counts 0); ties go by node. A video that goes on adds a node a round, so `most` rounds are enough.
    """
    edges = cut_lineage(edges)  # every round reads it
    held = seeds.select("video_id", "idx", F.lit(0).alias("level"))
    near = cut_lineage(edges.join(seeds.select("video_id", F.col("idx").alias("src")), ["video_id", "src"]).groupBy("video_id", F.col("dst").alias("idx")).agg(F.max("w").alias("w")))
    front = held
    for level in range(1, most + 1):
        n = held.groupBy("video_id").agg(F.count("*").alias("n"))
        new = edges.join(front.select("video_id", F.col("idx").alias("src")), ["video_id", "src"]).select("video_id", F.col("dst").alias("idx")).distinct().join(held, ["video_id", "idx"], "left_anti")
        new = new.join(near, ["video_id", "idx"], "left")
        r = F.row_number().over(Window.partitionBy("video_id").orderBy(F.round(F.coalesce("w", F.lit(0.0)), 9).desc(), "idx"))
        front = new.withColumn("r", r).join(n, "video_id").where(F.col("r") <= F.lit(most) - F.col("n")).select("video_id", "idx", F.lit(level).alias("level"))
        front = cut_lineage(front)
        if front.isEmpty():
            break
        held = cut_lineage(held.union(front))
    return held


#: Nodes of a block of `personalized_pagerank`, in order of idx.
PUSH_BLOCK = 512


def _push(alpha: float, tolerance: float):
    """Push residuals within one block of nodes until all are small; what leaves the block is residual of nodes elsewhere."""

    def run(key: tuple, nodes: pa.Table, edges: pa.Table) -> pa.Table:
        idx, p, r = (nodes[c].to_numpy().copy() for c in ("idx", "p", "r"))
        order = np.argsort(idx)
        idx, p, r = idx[order], p[order], r[order]
        src, dst, w = (edges[c].to_numpy() for c in ("src", "dst", "w"))
        here = np.isin(src, idx)
        src, dst, w = np.searchsorted(idx, src[here]), dst[here], w[here]
        far, back = np.unique(dst, return_inverse=True)
        at = np.minimum(np.searchsorted(idx, far), len(idx) - 1)
        inside = idx[at] == far
        left = np.zeros(len(far))
        while np.any(r > tolerance):
            now = np.where(r > tolerance, r, 0.0)
            p += (1 - alpha) * now
            r -= now
            flow = np.bincount(back, alpha * now[src] * w, minlength=len(far))
            r[at[inside]] += flow[inside]
            left[~inside] += flow[~inside]
        out = np.flatnonzero(left > 0)
        n, m = len(idx), len(out)
        return pa.table({
            "video_id": pa.array([key[0].as_py()] * (n + m), key[0].type), "idx": pa.array(np.r_[idx, far[out]]).cast(nodes["idx"].type),
            "p": np.r_[p, np.zeros(m)], "r": np.r_[r, left[out]], "own": np.r_[np.ones(n, np.int32), np.zeros(m, np.int32)],
        })

    return run


def personalized_pagerank(transition: DataFrame, seeds: DataFrame, nodes: DataFrame, alpha: float = 0.85, tolerance: float = 1e-10, most_rounds: int = 1000, spy: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """video_id, idx, p: rank flows along src -> dst, and restarts at the seeds. Forward push: seeds hold a residual of 1 in all, a push keeps (1 - alpha) of a node's
    residual as rank and hands the rest on, until no residual is above `tolerance`.

    Nodes are in blocks of PUSH_BLOCK by idx. A round takes the blocks with a residual above the tolerance, and their edges only; each pushes until its own residuals are small, and
    residual that crosses blocks is added up between rounds. So a round's work follows where rank still flows, not the graph. `spy` sees each round's edges.
    """
    block = F.floor(F.col("idx") / PUSH_BLOCK)
    edges = cut_lineage(transition.select("video_id", "src", "dst", "w", F.floor(F.col("src") / PUSH_BLOCK).alias("block")))
    k = seeds.groupBy("video_id").agg(F.count("*").alias("k"))
    start = nodes.select("video_id", "idx").join(k, "video_id").join(seeds.select("video_id", "idx", F.lit(1.0).alias("s")), ["video_id", "idx"], "left")
    state = cut_lineage(start.select("video_id", "idx", F.lit(0.0).alias("p"), (F.coalesce("s", F.lit(0.0)) / F.col("k")).alias("r"), F.lit(1).alias("own")))
    kinds = dict(state.dtypes)
    for _ in range(most_rounds):
        placed = state.withColumn("block", block)
        hot = cut_lineage(placed.where(F.col("r") > tolerance).select("video_id", "block").distinct())
        if hot.isEmpty():
            return state.select("video_id", "idx", "p")
        active, theirs = placed.join(hot, ["video_id", "block"], "left_semi"), edges.join(hot, ["video_id", "block"], "left_semi")
        if spy:
            spy(theirs)
        pushed = active.groupBy("video_id", "block").cogroup(theirs.groupBy("video_id", "block")).applyInArrow(_push(alpha, tolerance), f"video_id {kinds['video_id']}, idx {kinds['idx']}, p double, r double, own int")
        rest = placed.join(hot, ["video_id", "block"], "left_anti").select("video_id", "idx", "p", "r", "own")
        sums = rest.unionByName(pushed).groupBy("video_id", "idx").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.max("own").alias("own"))
        state = cut_lineage(sums.where("own = 1"))  # no node without a row of its own
    raise RuntimeError("ranks did not settle")


def seeds_and_top(ranks: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The seeds and the k best other nodes of each video."""
    rest = ranks.join(seeds, ["video_id", "idx"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.round("p", 9).desc(), "idx"))).where(F.col("r") <= k)
    return seeds.select("video_id", "idx").union(rest.select("video_id", "idx"))


def consensus_ratio(edges: DataFrame, scores: DataFrame, chosen: Column, rejected: Column) -> DataFrame:
    """video_id, ratio: mean consensus of chosen over rejected nodes after one diffusion step from the seeds (a missing score is the video's mean), in [0.1, 5]."""
    s = scores.withColumn("s", F.coalesce("score", F.avg("score").over(Window.partitionBy("video_id"))))
    t = row_normalise(edges, s)
    m = t.join(s.select("video_id", F.col("idx").alias("dst"), "s"), ["video_id", "dst"]).groupBy("video_id", F.col("src").alias("idx")).agg(F.sum(F.col("w") * F.col("s")).alias("c"))
    g = s.join(m, ["video_id", "idx"]).groupBy("video_id").agg(F.avg(F.when(chosen, F.col("c"))).alias("a"), F.avg(F.when(rejected, F.col("c"))).alias("b"))
    return g.select("video_id", F.least(F.greatest(F.col("a") / F.col("b"), F.lit(0.1)), F.lit(5.0)).alias("ratio"))


def laplacian_smoothness(features: DataFrame, scores: str, clip: Column) -> DataFrame:
    """video_id, clip, smoothness: mean over all ordered pairs of a clip of a_ij (p_i - p_j)^2, a the positive cosine divided by its column's sum."""
    from tideline.operators.joins import cosine

    f = features.withColumn("clip", clip)
    j = f.select("video_id", "clip", F.col("idx").alias("i"), F.col("feature").alias("x"), F.col(scores).alias("p")).join(f.select("video_id", "clip", F.col("idx").alias("j"), F.col("feature").alias("y"), F.col(scores).alias("q")), ["video_id", "clip"])
    a = j.select("video_id", "clip", "j", "p", "q", F.greatest(cosine(F.col("x"), F.col("y")), F.lit(0.0)).alias("a"))
    a = a.withColumn("a", F.col("a") / F.sum("a").over(Window.partitionBy("video_id", "clip", "j")))
    return a.groupBy("video_id", "clip").agg(F.avg(F.col("a") * (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))).alias("smoothness"))


def subgraph(edges: DataFrame, first: int, last: int) -> DataFrame:
    """Edges with both ends in [first, last], weights scaled to [0, 1] in each video."""
    from tideline.functions.scalars import minmax

    inside = edges.where(F.col("i").between(first, last) & F.col("j").between(first, last))
    return inside.withColumn("w", minmax(F.col("w"), Window.partitionBy("video_id")))
