"""Streaming forms: tables replayed as files, results written by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tideline.sources.files import shared_folder


def replay(spark: SparkSession, df: DataFrame, files: int = 4) -> DataFrame:
    """A stream of df's rows in order of `ts`: written as `files` slices of time, one after the other, and read one slice a trigger.

    Every slice is dealt to the same number of files, about a million rows each, in turn, so that none is empty and a trigger takes a whole slice.
    """
    folder = shared_folder(spark)
    df.write.parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all")
    at = F.unix_micros("ts")
    n, cuts = rows.agg(F.count("*"), F.percentile_approx(at, [k / files for k in range(1, files)], 1000)).first()
    cuts, parts = cuts or [], max(1, n // files // 1_000_000)
    for k in range(files):  # the file source takes files in order of their times
        low = at > cuts[k - 1] if k else F.lit(True)
        high = at <= cuts[k] if k < len(cuts) else F.lit(True)
        rows.where(low & high).repartition(parts).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(f"{folder}/in")


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet; then that table."""
    path = shared_folder(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_batches(spark: SparkSession, stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{shared_folder(spark)}/state").trigger(availableNow=True).start()
    q.awaitTermination()


#: What keeps the state of `trailing_curve` and `incremental_bitemporal`: arbitrary state needs this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Groups of videos for each task, at least; and the rows of a whole table for each group, about, where the table is known.
GROUPS_A_TASK, GROUP_ROWS = 8, 200_000


def groups_of(spark: SparkSession, rows: int = 0) -> int:
    """How many groups of videos a stream keeps state of. A group's state is read, worked on and written at once, so a video costs its rows and not a call of a worker."""
    return max(GROUPS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // GROUP_ROWS)


def _by_group(stream: DataFrame, groups: int | None, *columns: str) -> DataFrame:
    """group, video_id, columns: videos by hash; rows without a video are a group of their own, -1, and have a number in its place, which `_named` takes back."""
    group = F.when(F.col("video_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("video_id"), F.lit(groups or groups_of(stream.sparkSession)))).cast("long")
    return stream.select(group.alias("group"), F.coalesce("video_id", F.lit(0)).cast("long").alias("video_id"), *columns)


def _named(key: tuple, video: np.ndarray) -> np.ndarray | None:
    return None if key[0] < 0 else video


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Rows of `processor`, by group. Sets the session's state store, which has to stay until the stream has started."""
    rows.sparkSession.conf.set(*STATE_STORE)
    return rows.groupBy("group").transformWithStateInPandas(processor, schema, "append", "none")


def _held(state, form: np.dtype) -> np.ndarray:
    return np.frombuffer(state.get()[0], form) if state.exists() else np.zeros(0, form)


def _records(form: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(columns["video"]), form)
    for name, values in columns.items():
        out[name] = values
    return out


def _in_order(held: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sizes, rest): the frames of each video of `new`, its held ones first; each video's number of frames; held frames of other videos.

    A batch's frames have to follow a video's held ones without a gap, as `replay` of an ordered table gives them.
    """
    mine = np.isin(held["video"], new["video"])
    rows, fresh = np.concatenate([held[mine], new]), np.r_[np.zeros(mine.sum(), bool), np.ones(len(new), bool)]
    order = np.lexsort((rows["idx"], rows["video"]))
    rows, fresh = rows[order], fresh[order]
    begins = np.r_[True, rows["video"][1:] != rows["video"][:-1]]
    follows = np.r_[True, (np.diff(rows["idx"]) == 1) & (fresh[1:] >= fresh[:-1])]
    good = np.where(begins, ~fresh | (rows["idx"] == 0), follows)
    if not good.all():
        raise ValueError(f"frames of video {rows['video'][good.argmin()]} don't follow each other")
    return rows, np.diff(np.r_[np.flatnonzero(begins), len(rows)]), held[~mine]


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of curves that lie end to end: where its curve begins, and its place in it."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return first, np.arange(len(first)) - first


def decayed(x: np.ndarray, sizes: np.ndarray, decay: float) -> np.ndarray:
    """Running maximum of each curve, in which a value counts for less by `decay` a step. Each round doubles the steps that were looked back."""
    out, (_, place), step = x.astype(float), _places(sizes), 1
    while step < sizes.max(initial=0):
        at = np.flatnonzero(place >= step)
        out[at] = np.fmax(out[at], out[at - step] * decay**step)
        step *= 2
    return out


def smoothed(d: np.ndarray, sizes: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of each curve, the ends reflected (their sample repeated)."""
    r = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    (first, place), size, out = _places(sizes), np.repeat(sizes, sizes), np.zeros(len(d))
    for step, w in zip(range(-r, r + 1), weights / weights.sum()):
        at = (place + step) % (2 * size)
        out += w * d[first + np.where(at < size, at, 2 * size - 1 - at)]
    return out


def bitemporal_array(x: np.ndarray, sizes: np.ndarray | None = None, decay: float = 0.9, sigma: float = 2.0) -> np.ndarray:
    """`timeline.bitemporal` of curves that lie end to end, `sizes` their lengths (none: x is one curve)."""
    sizes = np.array([len(x)]) if sizes is None else sizes
    begin = np.cumsum(sizes) - sizes
    both = np.fmax(decayed(x, sizes, decay), decayed(x[::-1], sizes[::-1], decay)[::-1])
    g = smoothed(np.fmax(both, 0.0), sizes, sigma)
    goal, top = (np.repeat(np.fmax.reduceat(v, begin), sizes) for v in (x, g))
    return np.clip(np.where(top > 0, g * goal / np.where(top > 0, top, 1.0), g), 0.0, 1.0)


class TrailingBuffer(StatefulProcessor):
    """For each chunk of frames: the last `most` frames scored anew, scores added up by frame.

    State, of all videos of a group: the frames of the buffer with their score, sum and count (`most` of a video at most), and, with a count of 0, the frames of a chunk
    that isn't full yet. A frame that leaves the buffer never changes again and leaves the state. A video's last chunk may be short: it is full at the frame n_frames - 1,
    if n_frames is known. Windows of all videos are scored together, about BLOCK frames at a time.
    """

    FORM = np.dtype([("video", "i8"), ("idx", "i4"), ("score", "f8"), ("sum", "f8"), ("n", "i4"), ("final", "?")])
    BLOCK = 1 << 20

    def __init__(self, rescore: Callable[[np.ndarray, np.ndarray], np.ndarray], chunk: int, most: int):
        self.rescore, self.chunk, self.most = rescore, chunk, most

    def init(self, handle) -> None:
        self.buffer = handle.getValueState("buffer", "frames binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = _records(self.FORM, video=new["video_id"], idx=new["idx"], score=new["score"], final=new["idx"] == new["n_frames"] - 1)
        f, sizes, rest = _in_order(_held(self.buffer, self.FORM), new)
        (first, _), at, begin = _places(sizes), np.arange(len(f)), np.cumsum(sizes) - sizes
        scored = begin + np.add.reduceat((f["n"] > 0).astype(int), begin)  # where frames of each video begin that have no score
        since = np.maximum.accumulate(np.fmax(np.repeat(scored, sizes), np.r_[0, np.where(f["final"], at + 1, 0)[:-1]]))  # the first frame of a frame's chunk, or of those before
        ends = (at >= since) & (((at - since + 1) % self.chunk == 0) | f["final"])
        upto = np.flatnonzero(ends) + 1
        low = np.fmax(first[upto - 1], upto - self.most)
        block = np.cumsum(upto - low) // self.BLOCK
        for b in np.unique(block):
            length, begins = (upto - low)[block == b], low[block == b]
            own, place = _places(length)
            frame = np.repeat(begins, length) + place
            f["sum"] += np.bincount(frame, self.rescore(f["score"][frame], length), len(f))
            f["n"] += np.bincount(frame, minlength=len(f)).astype("i4")
        last = np.maximum.reduceat(np.where(ends, at + 1, 0), begin)
        some = last > 0
        scored = np.repeat(np.where(some, last, scored), sizes)
        self.buffer.update((np.concatenate([rest, f[at >= scored - self.most]]).tobytes(),))
        out = np.repeat(some, sizes) & (at < scored)
        if out.any():
            g = f[out]
            yield pd.DataFrame({"video_id": _named(key, g["video"]), "upto": f["idx"][scored[out] - 1], "idx": g["idx"], "n": g["n"], "mean": g["sum"] / g["n"]})

    def close(self) -> None:
        pass


def trailing_curve(spark: SparkSession, stream: DataFrame, rescore: Callable[[np.ndarray, np.ndarray], np.ndarray] = bitemporal_array, chunk: int = 8, most: int = 300, groups: int | None = None) -> DataFrame:
    """video_id, idx, n, mean: every frame's n scores, averaged, after all batches of `stream` (video_id, idx, score, n_frames).

    With each chunk, the last `most` frames of its video are scored anew by `rescore`, which takes the scores of curves that lie end to end, and their lengths. Results depend
    on chunks and not on batches. What a batch writes is the buffer's frames, where a chunk was full, and those that left it; the newest row of a frame holds. State is kept
    by `groups` of videos (none: `groups_of` the session).
    """
    if chunk > most:
        raise ValueError("a chunk has to fit into the buffer, or frames would never be scored")
    rows = _stateful(_by_group(stream, groups, "idx", "score", "n_frames"), TrailingBuffer(rescore, chunk, most), "video_id long, upto int, idx int, n int, mean double")
    return run_to_table(spark, rows).groupBy("video_id", "idx").agg(F.max_by(F.struct("n", "mean"), "upto").alias("x")).select("video_id", "idx", "x.n", "x.mean")


class IncrementalBitemporal(StatefulProcessor):
    """The smoothed curve of `timeline.bitemporal`, before its scale, kept up as frames arrive.

    A new frame changes earlier ones only as far as its decayed score can exceed theirs, and the smoothing reaches a radius beyond. A frame is settled once a score of `most`,
    right after the newest frame, could not change it or any within the radius; it is written for the last time and leaves the state but for the
    radius that its successors need. Contributions below TINY count as none, which bounds the open frames even where scores are zero. The state is that of all videos of a
    group: their open frames, and two numbers for each.
    """

    TINY = 1e-12
    FORM = np.dtype([("video", "i8"), ("idx", "i4"), ("score", "f8"), ("ahead", "f8"), ("done", "?")])
    WHOLE = np.dtype([("video", "i8"), ("goal", "f8"), ("fixed", "f8")])

    def __init__(self, decay: float, sigma: float, most: float):
        self.decay, self.sigma, self.most, self.radius = decay, sigma, most, int(4 * sigma + 0.5)

    def init(self, handle) -> None:
        self.tail = handle.getValueState("tail", "frames binary")
        self.whole = handle.getValueState("whole", "videos binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = _records(self.FORM, video=new["video_id"], idx=new["idx"], score=new["score"], ahead=new["score"])
        if (new["score"] > self.most).any():
            raise ValueError(f"a score of video {new['video'][(new['score'] > self.most).argmax()]} is above {self.most}")
        f, sizes, rest = _in_order(_held(self.tail, self.FORM), new)
        (_, place), begin = _places(sizes), np.cumsum(sizes) - sizes
        best = lambda x, where: np.fmax.reduceat(np.where(where, x, -np.inf), begin)

        ahead, back = decayed(f["ahead"], sizes, self.decay), decayed(f["score"][::-1], sizes[::-1], self.decay)[::-1]
        d, left = np.fmax(np.fmax(ahead, back), 0.0), np.add.reduceat(f["done"].astype(int), begin)
        g = smoothed(d, sizes, self.sigma)  # a curve whose start is gone has a radius of done frames first, which are neighbours only
        last = f["idx"][begin + sizes - 1]
        reach = self.most * self.decay ** (np.repeat(last, sizes) + 1.0 - f["idx"])
        still = (d < reach) & (reach > self.TINY)  # may rise yet
        first = np.minimum.reduceat(np.where(still, place, np.repeat(sizes, sizes)), begin)
        settled = np.fmax(first - self.radius, left)  # these are final; the last of the curve see its reflected end
        open_, done = place >= np.repeat(left, sizes), place < np.repeat(settled, sizes)

        before, video = _held(self.whole, self.WHOLE), f["video"][begin]
        known, mine = np.isin(video, before["video"]), np.isin(before["video"], video)  # both in order of videos
        goal, fixed = best(f["score"], True), best(g, open_ & done)
        goal[known], fixed[known] = np.fmax(goal[known], before["goal"][mine]), np.fmax(fixed[known], before["fixed"][mine])
        top = np.fmax(fixed, best(g, ~done))
        whole = np.concatenate([before[~mine], _records(self.WHOLE, video=video, goal=goal, fixed=fixed)])
        self.whole.update((whole[np.argsort(whole["video"])].tobytes(),))
        f["ahead"], f["done"] = ahead, done
        self.tail.update((np.concatenate([rest, f[place >= np.repeat(settled, sizes) - self.radius]]).tobytes(),))
        each = lambda x: np.repeat(x, sizes)[open_]
        yield pd.DataFrame({"video_id": _named(key, f["video"][open_]), "upto": each(last), "idx": f["idx"][open_], "score": f["score"][open_], "smooth": g[open_], "goal": each(goal), "top": each(top)})

    def close(self) -> None:
        pass


def incremental_bitemporal(spark: SparkSession, stream: DataFrame, decay: float = 0.9, sigma: float = 2.0, most: float = 1.0, groups: int | None = None) -> DataFrame:
    """video_id, idx, score, calibrated after all batches of `stream` (video_id, idx, score: at most `most`), the same as `timeline.bitemporal` of the whole.

    A batch reads its own frames and each video's open tail. The scale to a video's peak is two numbers that a batch writes anew, applied to the newest row of each frame.
    State is kept by `groups` of videos (none: `groups_of` the session).
    """
    rows = _stateful(_by_group(stream, groups, "idx", "score"), IncrementalBitemporal(decay, sigma, most), "video_id long, upto int, idx int, score double, smooth double, goal double, top double")
    out = run_to_table(spark, rows)
    newest = out.groupBy("video_id", "idx").agg(F.max_by(F.struct("score", "smooth"), "upto").alias("x"))
    scale = out.groupBy("video_id").agg(F.max_by(F.struct("goal", "top"), "upto").alias("s"))
    scaled = F.when(F.col("s.top") > 0, F.col("x.smooth") * F.col("s.goal") / F.col("s.top")).otherwise(F.col("x.smooth"))
    return newest.join(scale, "video_id").select("video_id", "idx", "x.score", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("calibrated"))


def tumbling_hits(stream: DataFrame, width: str, delay: str, gate: float) -> DataFrame:
    """video_id, start, t, conf: tumbling segments with a hit (column hit) whose mean confidence is above the gate."""
    w = stream.withWatermark("ts", delay).groupBy("video_id", F.window("ts", width))
    g = w.agg(F.min(F.when(F.col("hit"), F.col("ts"))).alias("t"), F.avg(F.when(F.col("hit"), F.col("score"))).alias("conf"))
    return g.where(F.col("conf") > gate).select("video_id", F.col("window.start").alias("start"), "t", "conf")


def sliding_means(stream: DataFrame, width: str, step: str, delay: str) -> DataFrame:
    g = stream.withWatermark("ts", delay).groupBy("video_id", F.window("ts", width, step)).agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    return g.select("video_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def session_hits(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    g = stream.withWatermark("ts", delay).groupBy("video_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select("video_id", F.col("session_window.start").alias("start"), "last", "n")


def extend_clips(stream: DataFrame, groups: int | None = None) -> DataFrame:
    """video_id, clip, start, end after every batch: a hit segment (segment number s, column hit) that follows the clip's end extends it, else it opens a new one.

    State: clip number, start and end of each video's open clip, by `groups` of videos (none: `groups_of` the session); each batch's rows are taken in order of segment.
    """
    form = np.dtype([("video", "i8"), ("clip", "i8"), ("start", "i8"), ("end", "i8")])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], form) if state.exists else np.zeros(0, form)
        rows = pd.concat(list(parts))
        rows = rows[rows["hit"].eq(True)].sort_values(["video_id", "segment"])
        s, video = rows["segment"].to_numpy(), rows["video_id"].to_numpy()
        if not len(s):
            state.update((held.tobytes(),))
            return
        begins = np.r_[True, video[1:] != video[:-1]]
        begin, of = np.flatnonzero(begins), np.cumsum(begins) - 1
        known, mine = np.isin(video[begin], held["video"]), np.isin(held["video"], video)  # both in order of videos
        last = _records(form, video=video[begin], clip=-1, start=-1, end=-2)
        last[known] = held[mine]
        end = np.where(begins, last["end"][of], np.fmax(last["end"][of], np.r_[0, s[:-1]]))  # of the clip before each hit
        opens = (s > end + 1) | (begins & (last["clip"][of] < 0))
        number = np.cumsum(opens)
        clip = last["clip"][of] + number - (number - opens)[begin][of]
        at = np.flatnonzero(opens | begins)  # the first hit of each clip in this batch
        to = np.r_[at[1:], len(s)] - 1
        whole = _records(form, video=video[at], clip=clip[at], start=np.where(opens[at], s[at], last["start"][of[at]]), end=np.where(opens[at], s[to], np.fmax(last["end"][of[at]], s[to])))
        newest = whole[np.r_[whole["video"][1:] != whole["video"][:-1], True]]
        held = np.concatenate([held[~mine], newest])
        state.update((held[np.argsort(held["video"])].tobytes(),))
        yield pd.DataFrame({"video_id": _named(key, whole["video"]), "clip": whole["clip"], "start": whole["start"], "end": whole["end"]})

    rows = _by_group(stream, groups, "segment", "hit")
    return rows.groupBy("group").applyInPandasWithState(step, "video_id long, clip long, start long, end long", "clips binary", "append", GroupStateTimeout.NoTimeout)
