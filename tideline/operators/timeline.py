"""Time-series operators on curves: rows (video_id, idx, ...), one row a step, one group a video."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.tables import seeded
from tideline.sources.views import curve, video


def until():
    return curve().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def since():
    return curve().rowsBetween(Window.currentRow, Window.unboundedFollowing)


def norm_of_difference(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def motion_delta(features: DataFrame) -> DataFrame:
    """video_id, idx, motion: distance to both neighbours plus the norm of the second difference; 0 where a neighbour is missing."""
    d = features.withColumn("p", F.lag("feature").over(curve())).withColumn("n", F.lead("feature").over(curve()))
    second = F.zip_with(F.zip_with("p", "n", lambda a, b: a.cast("double") + b.cast("double")), F.col("feature"), lambda s, x: s - 2 * x.cast("double"))
    bend = F.sqrt(F.aggregate(second, F.lit(0.0), lambda s, x: s + x * x))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.select("video_id", "idx", (zero(norm_of_difference(F.col("feature"), F.col("p"))) + zero(norm_of_difference(F.col("feature"), F.col("n"))) + zero(bend)).alias("motion"))


def decayed_max(df: DataFrame, value: str, decay: float, out: str) -> DataFrame:
    """max over both directions of value * decay ** distance, as a running maximum in log space."""
    if decay <= 0:
        return df.withColumn(out, F.greatest(F.col(value), F.lit(0.0)))
    step = math.log(decay)
    log = F.when(F.col(value) > 0, F.log(value))
    ahead = F.exp(F.max(log - F.col("idx") * step).over(until()) + F.col("idx") * step)
    back = F.exp(F.max(log + F.col("idx") * step).over(since()) - F.col("idx") * step)
    return df.withColumn(out, F.greatest(F.coalesce(ahead, F.lit(0.0)), F.coalesce(back, F.lit(0.0))))


def gaussian_filter(df: DataFrame, value: str, sigma: float, out: str, keys: tuple[str, ...] = ("video_id",), edge: str = "mirror") -> DataFrame:
    """Gaussian smoothing. edge "mirror": radius int(4 sigma + 0.5), the ends reflected with the end sample repeated; "repeat": radius ceil(3 sigma).

    A window of the radius holds every sample that a row needs, reflected ones too, so nothing moves beyond the sort of a curve.
    """
    if sigma <= 0:
        return df.withColumn(out, F.col(value))
    r = int(4 * sigma + 0.5) if edge == "mirror" else math.ceil(3 * sigma)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(weights)
    by = Window.partitionBy(*keys)
    d = df.withColumns({"n__": F.count("*").over(by), "near__": F.collect_list(value).over(by.orderBy("idx").rowsBetween(-r, r)), "w__": F.array(*[F.lit(w / total) for w in weights])})
    n, lowest = F.col("n__"), F.greatest(F.col("idx") - r, F.lit(0))

    def reflected(o: Column) -> Column:
        at = F.col("idx") + o - r
        if edge == "repeat":
            return F.least(F.greatest(at, F.lit(0)), n - 1)
        m = F.pmod(at, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    inner = F.zip_with("near__", "w__", lambda v, w: v * w)
    ends = F.transform("w__", lambda w, o: w * F.element_at(F.col("near__"), (reflected(o) - lowest + 1).cast("int")))
    terms = F.when(F.size("near__") == 2 * r + 1, inner).otherwise(ends)
    return d.withColumn(out, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).drop("n__", "near__", "w__")


def rescaled(df: DataFrame, value: str, raw: str, out: str, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """value brought to raw's peak in each group, then clipped to [0, 1]."""
    by = Window.partitionBy(*keys)
    top, goal = F.max(value).over(by), F.max(raw).over(by)
    return df.withColumn(out, F.least(F.greatest(F.when(top > 0, F.col(value) * goal / top).otherwise(F.col(value)), F.lit(0.0)), F.lit(1.0)))


def bitemporal(df: DataFrame, value: str = "score", decay: float = 0.9, sigma: float = 2.0, out: str = "calibrated") -> DataFrame:
    d = decayed_max(df.withColumn("raw__", F.col(value)), "raw__", decay, "d__")
    return rescaled(gaussian_filter(d, "d__", sigma, "g__"), "g__", "raw__", out).drop("raw__", "d__", "g__")


def highpass(df: DataFrame, value: str = "score", decay: float = 0.9, sigma: float = 2.0, wide: float = 20.0, out: str = "calibrated") -> DataFrame:
    d = gaussian_filter(df.withColumn("raw__", F.col(value)), "raw__", wide, "slow__")
    d = d.withColumn("fast__", F.greatest(F.col("raw__") - F.col("slow__"), F.lit(0.0)))
    d = gaussian_filter(decayed_max(d, "fast__", decay, "d__"), "d__", sigma, "g__")
    return rescaled(d, "g__", "raw__", out).drop("raw__", "slow__", "fast__", "d__", "g__")


def median_filter(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    """Running median of odd width, zeros beyond the ends."""
    h = width // 2
    held = F.collect_list(value).over(curve().rowsBetween(-h, h))
    padded = F.concat(held, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(held)))
    return df.withColumn(out, F.element_at(F.sort_array(padded), h + 1))


def median_calibration(df: DataFrame, value: str = "score", decay: float = 0.9, sigma: float = 2.0, width: int = 3, out: str = "calibrated") -> DataFrame:
    d = median_filter(df.withColumn("raw__", F.col(value)), "raw__", width, "m__")
    d = gaussian_filter(decayed_max(d, "m__", decay, "d__"), "d__", sigma, "g__")
    return rescaled(d, "g__", "raw__", out).drop("raw__", "m__", "d__", "g__")


def ema(df: DataFrame, value: str, keep: float, keys: tuple[str, ...], order: str, out: str = "ema") -> DataFrame:
    """Exponential moving average from the first value on, by running sums of values scaled by keep ** -place.

    Sums start anew in blocks short enough for a double's range; a block adds what the one before ends with, decayed. What an earlier one would add is beyond a double.
    """
    block = max(1, min(int(460 / -math.log(keep)), 1 << 20)) if 0 < keep < 1 else 1 << 20
    by = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, order, (F.row_number().over(by) - 1).alias("i__"), F.col(value).cast("double").alias("x__"))
    p = (F.col("i__") % block).cast("double")
    d = d.withColumns({"b__": F.floor(F.col("i__") / block), "p__": p, "c__": F.when(F.col("i__") == 0, F.col("x__")).otherwise((1 - keep) * F.col("x__"))})
    inside = Window.partitionBy(*keys, "b__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    scale = lambda e: F.pow(F.lit(float(keep)), e)
    if keep == 0:
        return d.select(*keys, order, F.col("x__").alias(out))
    d = d.withColumn("own__", F.sum(F.col("c__") * scale(-F.col("p__"))).over(inside) * scale(F.col("p__")))
    d = d.withColumn("carry__", F.lag("own__").over(by))  # in a block's first row: where the block before ended
    first = F.first("carry__").over(inside)
    return d.select(*keys, order, (F.col("own__") + F.coalesce(first, F.lit(0.0)) * scale(F.col("p__") + 1)).alias(out))


def runs(df: DataFrame, above: Column, end_rule: str = "last_above") -> DataFrame:
    """video_id, start_i, end_i, start_t, end_t of maximal stretches where `above` holds: rows and, from column t (without it the row number), times.

    end_rule: the last row above, or the first row below (the last row if none).
    """
    t = F.col("t") if "t" in df.columns else F.col("idx")
    d = df.select("video_id", "idx", t.cast("double").alias("t"), above.cast("int").alias("a"))
    d = d.withColumn("new", ((F.col("a") == 1) & (F.coalesce(F.lag("a").over(curve()), F.lit(0)) == 0)).cast("int")).withColumn("next_t", F.coalesce(F.lead("t").over(curve()), "t"))
    d = d.withColumn("run", F.sum("new").over(until())).withColumn("last", F.max("idx").over(video()))
    g = d.where("a = 1").groupBy("video_id", "run").agg(F.min("idx").alias("start_i"), F.max("idx").alias("end_i"), F.first("last").alias("last"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.max("next_t").alias("next_t"))
    below = end_rule == "first_below"
    return g.select("video_id", "start_i", (F.least(F.col("end_i") + 1, F.col("last")) if below else F.col("end_i")).alias("end_i"), "start_t", F.col("next_t" if below else "end_t").alias("end_t"))


def spans(runs_: DataFrame, least: float) -> DataFrame:
    """video_id, start, end: the times of runs that last `least` at least."""
    return runs_.where(F.col("end_t") - F.col("start_t") >= least).select("video_id", F.col("start_t").alias("start"), F.col("end_t").alias("end"))


def rows_inside(intervals: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """The rows whose `at` lies in an interval (video_id, start, end: ends included, none of a video overlaps another), with its start and end.

    Rows and interval starts are sorted together once; each row looks back to the last start.
    """
    a = intervals.select("video_id", F.col("start").cast("double").alias("at__"), F.lit(0).alias("kind__"), F.struct("start", "end").alias("span__"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("row__"))
    b = rows.select("video_id", F.col(at).cast("double").alias("at__"), F.lit(1).alias("kind__"), F.lit(None).cast(a.schema["span__"].dataType).alias("span__"), F.struct(*rows.columns).alias("row__"))
    back = Window.partitionBy("video_id").orderBy("at__", "kind__").rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionByName(b).withColumn("span__", F.last("span__", ignorenulls=True).over(back))
    return d.where((F.col("kind__") == 1) & (F.col("at__") <= F.col("span__.end"))).select("row__.*", "span__.start", "span__.end")


def merge_gaps(intervals: DataFrame, gap: float, start: str = "start", end: str = "end", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Fuse intervals of a video whose gap to those before is at most `gap`."""
    by = Window.partitionBy("video_id").orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    d = intervals.withColumn("new__", F.coalesce((F.col(start) - before > gap).cast("int"), F.lit(1)))
    d = d.withColumn("island__", F.sum("new__").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    more = [c.alias(k) for k, c in (aggregates or {}).items()]
    return d.groupBy("video_id", "island__").agg(F.min(start).alias(start), F.max(end).alias(end), *more).drop("island__")


def threshold_segments(df: DataFrame, value: str = "score", threshold: float = 0.5, min_duration: float = 1.0, merge_gap: float = 2.0) -> DataFrame:
    """Runs above a threshold; videos without any are done again with their median as threshold."""

    def once(d: DataFrame) -> DataFrame:
        return merge_gaps(spans(runs(d, F.col(value) > F.col("th__")), min_duration), merge_gap)

    one = once(df.withColumn("th__", F.lit(threshold)))
    rest = df.join(one.select("video_id").distinct(), "video_id", "left_anti")
    medians = rest.groupBy("video_id").agg(F.median(value).alias("th__"))
    return one.withColumn("fallback", F.lit(False)).unionByName(once(rest.join(medians, "video_id")).withColumn("fallback", F.lit(True)))


def trapezoid(df: DataFrame, value: str) -> DataFrame:
    """df with area__: the piece of area between a row and the one before it."""
    return df.withColumn("area__", (F.col(value) + F.lag(value).over(curve())) / 2 * (F.col("t") - F.lag("t").over(curve())))


def area_and_peak(intervals: DataFrame, curve: DataFrame, value: str) -> DataFrame:
    """intervals (video_id, start, end) with auc (trapezoid) and peak over the rows inside, ends included."""
    c = trapezoid(curve.select("video_id", "idx", "t", value), value)
    return rows_inside(intervals, c, "t").groupBy("video_id", "start", "end").agg(F.sum(F.when(F.col("t") > F.col("start"), F.col("area__")).otherwise(0.0)).alias("auc"), F.max(value).alias("peak"))


def adaptive_events(df: DataFrame, value: str = "score", sigma: float = 2.0, k: float = 0.75, floor: float = 0.1, min_duration: float = 5.0, gap: float = 3.0) -> DataFrame:
    """video_id, start, end, auc, peak, rank: runs of the smoothed curve above max(floor, mean + k std), merged, ranked by area."""
    d = gaussian_filter(df.select("video_id", "idx", "t", value), value, sigma, "g")
    d = d.withColumn("th", F.greatest(F.lit(floor), F.avg("g").over(video()) + k * F.stddev_pop("g").over(video())))
    m = merge_gaps(spans(runs(d, F.col("g") > F.col("th"), "first_below"), min_duration), gap)
    e = area_and_peak(m, d, "g")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.round("auc", 9).desc(), "start")))


def top_peak_events(df: DataFrame, value: str = "score", k: float = 0.75, min_duration: float = 5.0, gap: float = 5.0, top: int = 3) -> DataFrame:
    """Runs above mean + k std; areas of merged runs add up, the peak is the largest; the top by peak."""
    d = df.select("video_id", "idx", "t", value).withColumn("th", F.avg(value).over(video()) + k * F.stddev_pop(value).over(video()))
    e = area_and_peak(spans(runs(d, F.col(value) > F.col("th"), "first_below"), min_duration), d, value)
    m = merge_gaps(e, gap, aggregates={"auc": F.sum("auc"), "peak": F.max("peak")})
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("peak"), "start"))).where(F.col("rank") <= top)


def peak_regions(df: DataFrame, value: str = "gt", min_frames: int = 2, peaks: int = 10) -> DataFrame:
    """video_id, idx, mask: the largest runs above mean + std, end row included."""
    d = df.select("video_id", "idx", value).withColumn("th", F.avg(value).over(video()) + F.stddev_pop(value).over(video()))
    r = runs(d, F.col(value) > F.col("th"), "first_below").where(F.col("end_i") - F.col("start_i") >= min_frames)
    c = d.withColumn("area", (F.col(value) + F.lead(value).over(curve())) / 2)
    a = rows_inside(r.select("video_id", F.col("start_i").alias("start"), F.col("end_i").alias("end")), c, "idx").where(F.col("idx") < F.col("end") - 1)
    a = a.groupBy("video_id", F.col("start").alias("start_i"), F.col("end").alias("end_i")).agg(F.sum("area").alias("auc"))
    best = a.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.round("auc", 9).desc(), "start_i"))).where(F.col("r") <= peaks)
    hit = best.select("video_id", F.explode(F.sequence("start_i", "end_i")).alias("idx")).distinct().withColumn("mask", F.lit(1))
    return df.select("video_id", "idx").join(hit, ["video_id", "idx"], "left").select("video_id", "idx", F.coalesce("mask", F.lit(0)).alias("mask"))


def mark_maxima(df: DataFrame, value: str) -> DataFrame:
    """df with is_peak: rows above the one before and not below the next; in a curve without any, its maximum."""
    x = F.col(value)
    d = df.withColumn("is_peak", (x > F.coalesce(F.lag(value).over(curve()), F.lit(float("-inf")))) & (x >= F.coalesce(F.lead(value).over(curve()), F.lit(float("-inf")))))
    d = d.withColumn("best__", F.min(F.struct((-x).alias("x"), "idx")).over(video())).withColumn("any__", F.max("is_peak").over(video()))
    return d.withColumn("is_peak", F.col("is_peak") | (~F.col("any__") & (F.col("idx") == F.col("best__.idx")))).drop("best__", "any__")


def local_maxima(df: DataFrame, value: str) -> DataFrame:
    """Rows above the one before and not below the next; a curve without any gives its maximum."""
    return mark_maxima(df, value).where("is_peak").drop("is_peak")


def peak_grow(df: DataFrame, value: str = "score", drop: float = 0.4, shortest: float = 4.0, longest: float = 12.0) -> DataFrame:
    """Clips around peaks: as far as the normalised score stays at (1 - drop) of the peak, clamped in length, inside the video; mean score inside.

    A row lasts the video's median step. A clip longer than `longest` is cut around its peak whatever its ends, so only rows within twice that of a peak
    matter: a window of that range holds them, in the shuffle that a curve has anyway. It is the last of the windows, so that no other carries its lists, and only peaks keep theirs.
    """
    low, high = F.min(value).over(video()), F.max(value).over(video())
    d = df.select("video_id", "idx", F.col("t").cast("double").alias("t"), ((F.col(value) - low) / (high - low + 1e-8)).alias("x"), F.col(value).alias("v"), (F.col("t") - F.lag("t").over(curve())).alias("gap"))
    d = d.withColumns({"step": F.coalesce(F.percentile("gap", F.lit(0.5)).over(video()), F.lit(1.0)), "t0": F.min("t").over(video()), "last": F.max("t").over(video())})
    reach = float(2 * longest)
    around = f"over (partition by video_id order by t range between cast({reach} as double) preceding and cast({reach} as double) following)"
    p = mark_maxima(d, "x").withColumn("near", F.expr(f"collect_list(struct(t, x, v)) {around}")).where("is_peak").withColumnsRenamed({"idx": "p", "t": "peak", "x": "px"})
    low_t = F.transform(F.filter("near", lambda r: r["x"] < (1 - drop) * F.col("px")), lambda r: r["t"])
    p = p.withColumn("low", low_t).withColumns({"l": F.array_max(F.filter("low", lambda t: t < F.col("peak"))), "r": F.array_min(F.filter("low", lambda t: t > F.col("peak")))})
    duration, far = F.col("last") + F.col("step"), F.col("peak") - reach
    a = F.when(F.col("l").isNotNull(), F.col("l") + F.col("step")).otherwise(F.greatest("t0", far))
    b = F.when(F.col("r").isNotNull(), F.col("r")).otherwise(F.when(F.col("last") <= F.col("peak") + reach, duration).otherwise(F.col("peak") + reach))
    half = F.least(F.greatest(b - a, F.lit(shortest)), F.lit(longest))
    start = F.when((b - a < shortest) | (b - a > longest), F.col("peak") - half / 2).otherwise(a)
    start = F.greatest(F.lit(0.0), F.least(start, duration - half))
    c = p.select("video_id", "p", "peak", start.alias("start"), F.least(start + half, duration).alias("end"), "near")
    inside = F.filter("near", lambda x: (x["t"] >= F.col("start")) & (x["t"] < F.col("end")))
    # no filter on what follows from `near`: pushed down, it would compute a clip's ends anew for each of its rows; a clip always holds its peak
    total = F.aggregate(inside, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda s, x: F.struct((s["s"] + x["v"]).alias("s"), (s["n"] + 1).alias("n")), lambda s: s["s"] / s["n"])
    return c.select("video_id", "p", "peak", "start", "end", total.alias("frame_score"))


def overlap_chunks(df: DataFrame, size: int, stride: int, last: bool = True) -> DataFrame:
    """video_id, chunk, idx, valid: rows of overlapping chunks; the last one ends with the video; short videos are one padded chunk."""
    v = df.groupBy("video_id").agg((F.max("idx") + 1).alias("n"))
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - size, F.lit(stride)))
    tail = F.when((F.col("n") > size) & ((F.col("n") - size) % stride != 0), F.array(F.col("n") - size)).otherwise(F.array().cast("array<int>"))
    c = v.select("video_id", "n", F.posexplode(F.concat(starts, tail) if last else starts).alias("chunk", "start"))
    e = c.select("video_id", "chunk", "n", F.explode(F.sequence("start", F.col("start") + size - 1)).alias("idx"))
    return e.select("video_id", "chunk", "idx", (F.col("idx") < F.col("n")).alias("valid"))


def chunks_of(df: DataFrame, size: int, stride: int) -> DataFrame:
    """df with `chunks`: the numbers of the `overlap_chunks` that hold a row (idx from 0 without gaps), by arithmetic on its place."""
    n, idx = F.count("*").over(video()), F.col("idx")
    regular = F.when(n <= size, 1).otherwise(F.floor((n - size) / stride) + 1)
    low, high = F.greatest(F.ceil((idx - size + 1) / stride), F.lit(0)), F.least(F.floor(idx / stride), regular - 1)
    d = df.withColumns({"low__": low, "high__": high, "more__": F.when((n > size) & ((n - size) % stride != 0) & (idx >= n - size), F.array(regular))})
    none = F.array().cast("array<bigint>")
    own = F.when(F.col("low__") <= F.col("high__"), F.sequence("low__", "high__")).otherwise(none)
    return d.withColumn("chunks", F.concat(own, F.coalesce("more__", none))).drop("low__", "high__", "more__")


def position_fill(picks: DataFrame, n_frames: str = "n_frames") -> DataFrame:
    """video_id, frame, score: each pick's score up to the next pick; the last one up to the video's end."""
    by = Window.partitionBy("video_id").orderBy("pick")
    nxt = F.coalesce(F.lead("pick").over(by), F.col(n_frames))
    return picks.withColumn("nxt", nxt).where("nxt > pick").select("video_id", F.explode(F.sequence("pick", F.col("nxt") - 1)).alias("frame"), "score")


def segment_phase_samples(videos: DataFrame, fps: float, step: int, segment: int) -> DataFrame:
    """video_id, segment, frame: every step-th frame, counted anew in each segment of some seconds."""
    seconds = F.greatest(F.floor(F.col("n_frames") / fps), F.lit(1))
    s = videos.select("video_id", "n_frames", F.explode(F.sequence(F.lit(0), seconds - 1, F.lit(segment).cast("long"))).alias("segment"))
    a, b = F.floor(F.col("segment") * fps), F.least(F.floor((F.col("segment") + segment) * fps), F.col("n_frames"))
    return s.where(b > a).select("video_id", F.col("segment").cast("long").alias("segment"), F.explode(F.sequence(a, b - 1, F.lit(step).cast("long"))).alias("frame"))


def augment(df: DataFrame, chunk: int, seed: int) -> DataFrame:
    """Labels shifted by -2 to 2 rows in a chunk (ends repeated), a tenth of the rows of every second chunk zeroed, and noise by key."""
    d = df.withColumn("chunk", F.floor(F.col("idx") / chunk).cast("int"))
    by = Window.partitionBy("video_id", "chunk").orderBy("idx")
    u = lambda *k: F.conv(F.substring(seeded(*k, seed=seed), 1, 8), 16, 10).cast("double") / 4294967295.0
    shift = F.floor(u("video_id", "chunk") * 4.999).cast("int") - 2
    d = d.withColumn("shift", shift)
    options = [F.when(F.col("shift") == s, F.lag("gt", s).over(by) if s >= 0 else F.lead("gt", -s).over(by)) for s in range(-2, 3)]
    edge = F.when(F.col("shift") > 0, F.first("gt").over(by)).otherwise(F.last("gt").over(by.rowsBetween(0, Window.unboundedFollowing)))
    zero = (F.col("chunk") % 2 == 0) & (u("video_id", "idx", F.lit("z")) < 0.1)
    noise = 0.1 * F.sqrt(-2 * F.log(F.greatest(u("video_id", "idx", F.lit("a")), F.lit(1e-12)))) * F.cos(2 * math.pi * u("video_id", "idx", F.lit("b")))
    return d.select("video_id", "idx", "chunk", F.coalesce(*options, edge).alias("gt"), F.when(zero, F.lit(0.0)).otherwise(F.col("score") + noise).alias("score"))
