"""Joins: as-of, range, tolerance, pairs within a video."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.groups import map_groups, spread
from tideline.operators.tables import seeded


def product(a: Column, b: Column) -> Column:
    """Inner product of two vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; it stays in the JVM."""
    return product(a, b) / F.sqrt(product(a, a) * product(b, b))


def range_join_points(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, width: float, key: str = "video_id") -> DataFrame:
    """Points with the spans (of the same key) that hold them, start <= t <= end: spans are listed by the cells of `width` they touch, so the join is on equality."""
    s = spans.withColumn("cell__", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("cell__", F.floor(F.col(t) / width))
    return p.join(s, [key, "cell__"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("cell__")


def first_containing(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, text: str, width: float, default: str) -> DataFrame:
    """Every point with the text of the first span that holds it, or a default."""
    hit = range_join_points(points, spans.select("video_id", start, end, text), t, start, end, width)
    best = hit.groupBy("video_id", t).agg(F.min_by(text, start).alias(text))
    return points.join(best, ["video_id", t], "left").withColumn(text, F.coalesce(text, F.lit(default)))


def asof(targets: DataFrame, knots: DataFrame, t: str = "t", value: str = "v") -> DataFrame:
    """targets with the knot at or before (p_t, p_v) and the one at or after (n_t, n_v): one union and one sort a video, no range join."""
    kind = dict(knots.dtypes)[value]
    k = knots.select("video_id", t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("k"), F.lit(0).alias("side"))
    x = targets.select("video_id", t, F.lit(None).cast(f"struct<t:double,v:{kind}>").alias("k"), F.lit(1).alias("side"))
    by = Window.partitionBy("video_id").orderBy(t, "side")
    back = Window.partitionBy("video_id").orderBy(t, F.desc("side"))
    u = k.union(x).withColumn("p", F.last("k", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    u = u.withColumn("n", F.first("k", ignorenulls=True).over(back.rowsBetween(0, Window.unboundedFollowing)))
    return u.where("side = 1").select("video_id", t, F.col("p.t").alias("p_t"), F.col("p.v").alias("p_v"), F.col("n.t").alias("n_t"), F.col("n.v").alias("n_v"))


def asof_linear(targets: DataFrame, knots: DataFrame, ends: str = "extrapolate", out: str = "v") -> DataFrame:
    """Linear interpolation of knots (video_id, t, v) at targets (video_id, t). ends: extrapolate by the first or last two knots, or constant."""
    d = asof(targets, knots)
    first = Window.partitionBy("video_id").orderBy("t")
    last = Window.partitionBy("video_id").orderBy(F.desc("t"))
    edge = lambda w, name: knots.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("video_id").agg(*[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{name}_{c}{r}") for r in (1, 2) for c in ("t", "v")])
    d = d.join(edge(first, "a"), "video_id", "left").join(edge(last, "z"), "video_id", "left")

    def line(t1, v1, t2, v2):
        return F.when(F.col(t1) == F.col(t2), F.col(v1)).otherwise(F.col(v1) + (F.col(v2) - F.col(v1)) * (F.col("t") - F.col(t1)) / (F.col(t2) - F.col(t1)))

    outside = lambda e: F.coalesce(line(f"{e}_t1", f"{e}_v1", f"{e}_t2", f"{e}_v2"), F.col(f"{e}_v1")) if ends == "extrapolate" else F.col(f"{e}_v1")
    v = F.when(F.col("p_t").isNull(), outside("a")).when(F.col("n_t").isNull(), outside("z")).otherwise(line("p_t", "p_v", "n_t", "n_v"))
    return d.select("video_id", "t", v.alias(out))


def asof_nearest(targets: DataFrame, knots: DataFrame, out: str = "v") -> DataFrame:
    """The value of the nearest knot; the lower one in a tie."""
    d = asof(targets, knots)
    low = F.col("n_t").isNull() | (F.col("p_t").isNotNull() & (F.col("t") - F.col("p_t") <= F.col("n_t") - F.col("t")))
    return d.select("video_id", "t", F.when(low, F.col("p_v")).otherwise(F.col("n_v")).alias(out))


def band_pairs(df: DataFrame, window: int, columns: list[str]) -> DataFrame:
    """Pairs i < j <= i + window of a video with both sides' columns (suffixes _i, _j): offsets and an equi-join."""
    i = df.select("video_id", F.col("idx").alias("i"), *[F.col(c).alias(f"{c}_i") for c in columns])
    i = i.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + window)))
    j = df.select("video_id", F.col("idx").alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return i.join(j, ["video_id", "j"])


def similarity_edges(features: DataFrame, window: int, quantile: float | None = None, threshold: float | None = None) -> DataFrame:
    """video_id, i, j, w: cosine edges within a window, at or above a quantile of them or a threshold, negatives as 0."""
    e = band_pairs(features.withColumn("sq", product(F.col("feature"), F.col("feature"))), window, ["feature", "sq"])  # squares once a vector, not once a pair
    e = e.select("video_id", "i", "j", F.greatest(product(F.col("feature_i"), F.col("feature_j")) / F.sqrt(F.col("sq_i") * F.col("sq_j")), F.lit(0.0)).alias("w"))
    if quantile is not None:
        cut = e.groupBy("video_id").agg(F.percentile("w", quantile).alias("cut"))
        e = e.join(cut, "video_id").where("w >= cut").drop("cut")
    return e.where(F.col("w") >= threshold) if threshold is not None else e


def tolerance_match(probe: DataFrame, build: DataFrame, tolerance: int) -> DataFrame:
    """probe_id, build_id: one-to-one matches of probe (probe_id, length) and build (build_id, length) with |difference| <= tolerance.

    The same as when probes in order of id take the lowest free candidate each. In a round every length's first free probe proposes to the lowest free candidate that it
    reaches; a candidate accepts the lowest of all free probes that reach it, if that one proposes to it. Nobody before that probe can want the candidate, so the match is final. A
    round takes grouped minima by length; the first pair of all always matches, so rounds end, and lengths that don't reach each other go on side by side. Only as many probes of a length as there are
    candidates within its reach can match, its lowest ones; the rest never takes part.
    """
    from tideline.operators.graph import cut_lineage

    reach = lambda c: F.explode(F.sequence(F.col(c) - tolerance, F.col(c) + tolerance))
    builds = cut_lineage(build.select("build_id", F.col("length").cast("long").alias("length")).where("build_id is not null and length is not null"))
    near = builds.groupBy("length").agg(F.count("*").alias("n")).select(reach("length").alias("length"), "n").groupBy("length").agg(F.sum("n").alias("size"))
    known = probe.select("probe_id", F.col("length").cast("long").alias("length")).where("probe_id is not null")
    ranked = known.join(near, "length").withColumn("r", F.row_number().over(Window.partitionBy("length").orderBy("probe_id")))
    probes = cut_lineage(ranked.where("r <= size").select("probe_id", "length"))
    done = None
    while True:
        low = probes.groupBy("length").agg(F.min("probe_id").alias("probe_id"))
        offers = builds.groupBy("length").agg(F.min("build_id").alias("build_id")).select(reach("length").alias("length"), "build_id").groupBy("length").agg(F.min("build_id").alias("build_id"))
        proposed = low.join(offers, "length").select("probe_id", "build_id")
        asked = proposed.select("build_id").distinct().join(builds, "build_id").select("build_id", reach("length").alias("length"))
        first = asked.join(low, "length").groupBy("build_id").agg(F.min("probe_id").alias("probe_id"))
        new = cut_lineage(proposed.join(first, ["build_id", "probe_id"]).select("probe_id", "build_id"))
        if new.isEmpty():
            return (new if done is None else done).select(F.col("probe_id").cast("long"), F.col("build_id").cast("long"))
        done = new if done is None else cut_lineage(done.union(new))
        probes = cut_lineage(probes.join(new, "probe_id", "left_anti"))
        builds = cut_lineage(builds.join(new, "build_id", "left_anti"))


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0)))


#: Vectors of a block of `similar_pairs`, and rows of a strip of a block pair's products.
SIMILAR_BLOCK, SIMILAR_STRIP = 2048, 256


def _block_products(least: float):
    """The pairs above `least` of one pair of blocks: sides 0 and 1, or side 0 with itself."""

    def solve(t: pa.Table) -> pa.Table:
        width, side = t["dim"][0].as_py(), t["side"].to_numpy()
        idx = t["idx"].to_numpy()
        x = t["feature"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), width)
        with np.errstate(all="ignore"):
            sq = (x * x).sum(axis=1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if side[-1] else 0))
        i, j, w = [], [], []
        for at in range(0, len(a), SIMILAR_STRIP):
            rows = a[at : at + SIMILAR_STRIP]
            with np.errstate(all="ignore"):
                c = (x[rows] @ x[b].T) / np.sqrt(np.outer(sq[rows], sq[b]))
            p, q = np.nonzero(~(c <= least) & (idx[rows][:, None] < idx[b][None, :]))
            i, j, w = [*i, idx[rows[p]]], [*j, idx[b[q]]], [*w, c[p, q]]
        i, j, w = (np.concatenate(v) for v in (i, j, w))
        return pa.table({"video_id": t["video_id"].slice(0, 1).take(pa.array(np.zeros(len(i), int))), "i": pa.array(i).cast(t["idx"].type), "j": pa.array(j).cast(t["idx"].type), "w": w})

    return solve


def similar_pairs(features: DataFrame, least: float) -> DataFrame:
    """video_id, i, j, w, i < j: all pairs of a video with a cosine w > least (or none that is a number), in double precision.

    A video's vectors are in blocks by idx, and each pair of blocks is one matrix product of bounded size in some task; only pairs above `least` leave it. A vector travels
    once for each block of its video. Vectors of length 0 or with null components have no cosine and are left out; those of different dimensions don't meet.
    """
    kinds = dict(features.dtypes)
    f = features.where(F.exists("feature", lambda x: x != 0) & ~F.exists("feature", lambda x: x.isNull()))
    f = f.select("video_id", "idx", "feature", F.size("feature").alias("dim"), F.floor(F.col("idx") / SIMILAR_BLOCK).alias("b"))
    blocks = f.select("video_id", "dim", "b").distinct()
    pairs = blocks.withColumnRenamed("b", "b1").join(blocks.withColumnRenamed("b", "b2"), ["video_id", "dim"]).where("b1 <= b2")
    first = f.withColumnRenamed("b", "b1").join(pairs, ["video_id", "dim", "b1"]).withColumn("side", F.lit(0))
    second = f.withColumnRenamed("b", "b2").join(pairs.where("b1 < b2"), ["video_id", "dim", "b2"]).withColumn("side", F.lit(1))
    keys = ["video_id", "dim", "b1", "b2"]
    both = spread(first.unionByName(second).select(*keys, "side", "idx", "feature"), *keys)
    return map_groups(both, keys, ["side", "idx"], _block_products(least), f"video_id {kinds['video_id']}, i {kinds['idx']}, j {kinds['idx']}, w double")


def pivot_pairs(features: DataFrame, least: float) -> DataFrame:
    """video_id, i, j, x, y, xx, yy, i < j: pairs of a video's vectors that may have a cosine > least; none that has is missing. xx and yy are the vectors' squares.

    Three vectors of a video are pivots: the one of least idx, the farthest from it, and the farthest from both. Angles obey the triangle inequality, so a pair within the angle of
    `least` differs by no more than that in its angle to any pivot. Cells of that width by the first two pivots meet their neighbours only, and what the third pivot
    rules out never has its product taken. Vectors of length 0 have no cosine and are left out.
    """
    reach = math.acos(max(min(least, 1.0), -1.0)) + 1e-9
    f = features.where(F.exists("feature", lambda x: x != 0)).select("video_id", "idx", "feature")
    first = f.groupBy("video_id").agg(F.min_by("feature", "idx").alias("p1"))
    d = f.join(first, "video_id").withColumn("a1", angle(F.col("feature"), F.col("p1")))
    d = d.join(d.groupBy("video_id").agg(F.max_by("feature", F.struct(F.round("a1", 9), "idx")).alias("p2")), "video_id").withColumn("a2", angle(F.col("feature"), F.col("p2")))
    third = d.groupBy("video_id").agg(F.max_by("feature", F.struct(F.round(F.least("a1", "a2"), 9), "idx")).alias("p3"))
    d = d.join(third, "video_id").withColumn("a3", angle(F.col("feature"), F.col("p3"))).select("video_id", "idx", "feature", product(F.col("feature"), F.col("feature")).alias("sq"), "a1", "a2", "a3")
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    x = d.select("video_id", F.col("idx").alias("i"), F.col("feature").alias("x"), F.col("sq").alias("xx"), *[F.col(f"a{k}").alias(f"x{k}") for k in (1, 2, 3)], around("a1").alias("c1")).withColumn("c2", F.explode(F.sequence(F.floor(F.col("x2") / reach) - 1, F.floor(F.col("x2") / reach) + 1)))
    y = d.select("video_id", F.col("idx").alias("j"), F.col("feature").alias("y"), F.col("sq").alias("yy"), *[F.col(f"a{k}").alias(f"y{k}") for k in (1, 2, 3)], cell("a1").alias("c1"), cell("a2").alias("c2"))
    near = [F.abs(F.col(f"x{k}") - F.col(f"y{k}")) <= reach for k in (1, 2, 3)]
    return x.join(y, ["video_id", "c1", "c2"]).where("i < j").where(near[0] & near[1] & near[2]).select("video_id", "i", "j", "x", "y", "xx", "yy")


def unit_number(*keys: str | Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.conv(F.substring(seeded(*keys, seed=seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def _last_at(rows: DataFrame, at: str, keep: list[str], asks: DataFrame, x: str) -> DataFrame:
    """asks with the columns `keep` of its video's last row whose `at` is at most x: both sorted together once."""
    a = rows.select("video_id", F.col(at).cast("double").alias("at__"), F.lit(0).alias("kind__"), F.struct(*keep).alias("row__"))
    b = asks.select("video_id", F.col(x).cast("double").alias("at__"), F.lit(1).alias("kind__"), F.struct(*asks.columns).alias("ask__"))
    both = a.withColumn("ask__", F.lit(None).cast(b.schema["ask__"].dataType)).unionByName(b.withColumn("row__", F.lit(None).cast(a.schema["row__"].dataType)))
    # of rows at one place the last in order of `keep`, then those who ask
    back = Window.partitionBy("video_id").orderBy("at__", "kind__", "row__").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("row__", F.last("row__", ignorenulls=True).over(back)).where("kind__ = 1")
    return found.select("ask__.*", *[F.col(f"row__.{c}").alias(c) for c in keep])


def draw_valleys(peaks: DataFrame, valleys: DataFrame, seed: int) -> DataFrame:
    """video_id, peak, valley: for each peak (video_id, peak, score) one valley (video_id, valley, score), with probability in proportion to how far it lies below.

    Every valley has to lie below every peak of its video. The weight is linear in the score: what a peak has above the highest valley counts for all valleys alike, the rest
    doesn't depend on the peak. So a first number decides which part draws, and a second one is looked up, among valleys in order of score, by number or in their running
    sums. No peak meets more than one valley.
    """
    by = Window.partitionBy("video_id").orderBy(F.desc("score"), "valley")
    v = valleys.withColumn("top", F.max("score").over(Window.partitionBy("video_id"))).withColumn("below", F.col("top") - F.col("score"))
    v = v.select("video_id", "valley", "top", "below", (F.row_number().over(by) - 1).alias("k"), (F.sum("below").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("below")).alias("start"))
    n = v.groupBy("video_id").agg(F.count("*").alias("n"), F.max("top").alias("top"), F.sum("below").alias("sum"))
    p = peaks.join(n, "video_id").withColumn("alike", F.col("n") * (F.col("score") - F.col("top")))
    p = p.withColumn("whole", unit_number("video_id", "peak", seed=seed) * (F.col("alike") + F.col("sum")) < F.col("alike")).withColumn("u", unit_number("video_id", "peak", F.lit("v"), seed=seed))
    some = p.where("whole").withColumn("k", F.floor(F.col("u") * F.col("n")).cast("int")).join(v.select("video_id", "k", "valley"), ["video_id", "k"]).select("video_id", "peak", "valley")
    far = p.where("not whole").select("video_id", "peak", (F.col("u") * F.col("sum")).alias("x"))
    return some.unionByName(_last_at(v.where("below > 0"), "start", ["valley"], far, "x").select("video_id", "peak", "valley"))


#: Places of a video's rows that one array holds, as bits.
PLACE_BITS = 10


def draw_margin_pairs(rows: DataFrame, margin: float, most: int, seed: int, hard_chosen: float = 0.7, hard_score: float = 0.6, hard_rejected: float = 0.2) -> DataFrame:
    """video_id, i, j: up to `most` pairs of a video's rows (video_id, idx, gt, score) with gt_j <= gt_i - margin, or hard negatives (gt_i > hard_chosen, score_j > hard_score, gt_j < hard_rejected).

    Pairs are numbered, not listed: with rows in order of gt, row i's partners by margin are the first c_i of all rows, and its further hard ones are neighbours among
    the hard rows. So c_i and the count of these number all N pairs, and row i has the numbers from its running sum on. A video with more than `most` draws one number in each
    of `most` stretches of equal length of [0, N): a row lists the stretches that its numbers touch, and keeps the drawn numbers that are its own, as one array. j is read at
    its place in the video's rows, which are kept in blocks of 2^PLACE_BITS: a row meets the blocks that its numbers touch, and draws become rows of their own only after that.
    """
    from tideline.operators.graph import cut_lineage

    place = Window.partitionBy("video_id").orderBy("gt", "idx")
    hard = F.expr(f"gt < {hard_rejected} and score > {hard_score}")
    d = rows.select("video_id", "idx", F.col("gt").cast("double").alias("gt"), "score").where("gt is not null").withColumn("hard", F.coalesce(hard, F.lit(False)).cast("int"))
    upto = lambda what: F.expr(f"{what} over (partition by video_id order by gt range between unbounded preceding and cast({margin} as double) preceding)")
    d = d.withColumns({"c": upto("count(*)"), "h": F.coalesce(upto("sum(hard)"), F.lit(0)), "hards": F.sum("hard").over(Window.partitionBy("video_id"))})
    d = d.withColumn("more", F.when(F.col("gt") > hard_chosen, F.col("hards") - F.col("h")).otherwise(0)).withColumn("n", F.col("c") + F.col("more"))
    run = F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, 0))
    of_video = Window.partitionBy("video_id")
    d = d.withColumns({"start": run - F.col("n"), "whole": F.sum("n").over(of_video), "size": F.count("*").over(of_video), "k": F.row_number().over(place) - 1, "hk": F.sum("hard").over(place.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    d = cut_lineage(d.select("video_id", "idx", "c", "h", "n", "start", "whole", "size", "k", "hk", "hard"))  # read twice, its windows run once
    m, whole = F.least("whole", F.lit(most)), F.col("whole")

    def drawn(t: Column) -> Column:
        low, high = F.call_function("div", t * whole, m), F.call_function("div", (t + 1) * whole, m)
        return low + F.floor(unit_number("video_id", t, seed=seed) * (high - low)) - F.col("start")

    # number p is in stretch t where t * whole div m <= p < (t + 1) * whole div m: the last t with t * whole < m * (p + 1)
    touched = F.sequence(F.call_function("div", m * (F.col("start") + 1) - 1, whole), F.call_function("div", m * (F.col("start") + F.col("n")) - 1, whole))
    own = F.filter(F.transform(touched, drawn), lambda o: (o >= 0) & (o < F.col("n")))
    # partners stand at a place among all rows or, after these, among the hard ones
    own = F.transform(own, lambda o: F.when(o < F.col("c"), o).otherwise(F.col("size") + F.col("h") + o - F.col("c")))
    block = lambda p: F.shiftright(p, PLACE_BITS)
    asked = spread(d.where("n > 0"), "video_id", "idx").select("video_id", F.col("idx").alias("i"), "size", own.alias("own"))
    one = F.col("size") <= 1 << PLACE_BITS - 1  # all places of a short video, hard ones too, are in one block
    asked = asked.select("video_id", "i", "own", F.explode(F.when(one, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform("own", block)))).alias("block"))
    places = d.select("video_id", "idx", F.explode(F.when(F.col("hard") == 1, F.array(F.col("k").cast("long"), F.col("size") + F.col("hk"))).otherwise(F.array(F.col("k").cast("long")))).alias("place"))
    blocks = places.groupBy("video_id", block(F.col("place")).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "idx"))), lambda s: s["idx"]).alias("js"))
    # merged, as sizes are estimated without the draws; outer, as an inner explode would be checked for emptiness before, by all hashes once more
    met = asked.join(blocks.hint("merge"), ["video_id", "block"]).select("video_id", "i", "block", "js", F.explode_outer("own").alias("p"))
    return met.where(block(F.col("p")) == F.col("block")).select("video_id", "i", F.get("js", F.col("p").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")).alias("j"))
