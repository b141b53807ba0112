"""Streaming queries: the events table replayed."""

from pyspark.sql import functions as F

from tideline.functions.scalars import r6
from tideline.operators import timeline as T
from tideline.plans.registry import query
from tideline.plans.timeline import decay_sql, gauss_sql, merge_sql, runs_sql, scaled_sql
from tideline.sources.files import shared_folder
from tideline.sources.views import frames, table, video
from tideline.streaming import streams as S


def timed(spark, sf):
    return frames(spark, sf).select("video_id", "idx", F.col("ts").cast("timestamp").alias("ts"), "score", "gt", (F.col("gt") > 0.5).alias("hit"))


def ended(spark, sf, delay_hours: int):
    """The newest time that the watermark surely passed."""
    return timed(spark, sf).agg((F.max("ts") - F.expr(f"INTERVAL {delay_hours} HOURS")).alias("upto"))


BITEMPORAL = decay_sql("frames", "score", 0.9, "d") + gauss_sql("d", "v", 2.0, "g") + scaled_sql("g")


def groups(spark, sf) -> int:
    """Groups of videos whose state is kept together."""
    return S.groups_of(spark, table(spark, sf, "events").count())


@query("stream_incremental_scores", "frames", BITEMPORAL)
@query("stream_incremental_curve", "frames", BITEMPORAL)
def stream_incremental_scores(spark, sf):
    """The calibrated curves after the last batch, kept up from each video's open tail; the same as in one batch."""
    return S.incremental_bitemporal(spark, S.replay(spark, timed(spark, sf)), groups=groups(spark, sf)).select("video_id", "idx", r6("calibrated").alias("calibrated"))


#: Every chunk's window as a curve of its own: scored anew, averaged by frame; then the segments of the averaged curve.
TRAILING = (
    """, nn AS (SELECT video_id AS vid, count(*) AS n FROM frames GROUP BY 1), ch AS (SELECT vid, c, least(8 * c + 8, n) AS upto FROM (SELECT vid, n, unnest(range(CAST(ceil(n / 8.0) AS BIGINT))) AS c FROM nn)),
w AS (SELECT vid * 1000000 + c AS video_id, idx - greatest(upto - 300, 0) AS idx, score, vid, idx AS fr FROM ch JOIN frames f ON f.video_id = vid AND idx >= upto - 300 AND idx < upto)"""
    + decay_sql("w", "score", 0.9, "d") + gauss_sql("d", "v", 2.0, "g")
    + """, tp AS (SELECT video_id, max(v) AS top FROM g GROUP BY 1), gl AS (SELECT video_id, max(score) AS goal FROM w GROUP BY 1),
sc AS (SELECT vid, fr, least(greatest(CASE WHEN top > 0 THEN v * goal / top ELSE v END, 0), 1) AS x FROM g JOIN w USING (video_id, idx) JOIN tp USING (video_id) JOIN gl USING (video_id)),
cv AS (SELECT vid AS video_id, fr AS idx, count(*) AS n, sum(x) / count(*) AS mean FROM sc GROUP BY 1, 2)"""
    + runs_sql("r1", "cv", "mean > 0.4") + ", k1 AS (SELECT video_id, s, e FROM r1 WHERE e - s >= 1)" + merge_sql("m1", "k1", 2)
    + ", f2 AS (SELECT *, median(mean) OVER (PARTITION BY video_id) AS th FROM cv WHERE video_id NOT IN (SELECT video_id FROM m1))" + runs_sql("r2", "f2", "mean > th") + ", k2 AS (SELECT video_id, s, e FROM r2 WHERE e - s >= 1)" + merge_sql("m2", "k2", 2)
    + """, ev AS (SELECT video_id AS v, s, e FROM m1 UNION ALL SELECT video_id, s, e FROM m2)
SELECT video_id, idx, CAST(n AS INT) AS n, round(mean, 6) AS mean, CAST(s AS DOUBLE) AS event_start, CAST(e AS DOUBLE) AS event_end FROM cv LEFT JOIN ev ON v = video_id AND idx BETWEEN s AND e"""
)


@query("stream_trailing_buffer", "frames", TRAILING)
@query("stream_trailing_buffer_curve", "frames", TRAILING)
def stream_trailing_buffer(spark, sf):
    """The averaged curve of trailing buffers scored anew with every eight frames, with the event that a frame is in."""
    stream = S.replay(spark, timed(spark, sf).withColumn("n_frames", F.count("*").over(video())))
    c = S.trailing_curve(spark, stream, groups=groups(spark, sf))
    inside = T.rows_inside(T.threshold_segments(c, "mean", 0.4), c.select("video_id", "idx"), "idx")
    events = inside.select("video_id", "idx", F.col("start").alias("event_start"), F.col("end").alias("event_end"))
    return c.join(events, ["video_id", "idx"], "left").select("video_id", "idx", "n", r6("mean").alias("mean"), "event_start", "event_end")


@query("stream_running_means", "frames", "SELECT video_id, count(*) AS n, round(avg(score), 6) AS mean FROM frames GROUP BY 1")
def stream_running_means(spark, sf):
    """Counts and means by video, merged batch by batch."""
    path = shared_folder(spark)

    def each(batch, number):
        batch.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("score").alias("s")).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    S.run_batches(spark, S.replay(spark, timed(spark, sf)), each)
    return spark.read.parquet(path).groupBy("video_id").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean")).select("video_id", "n", r6("mean").alias("mean"))


UPTO = ", u AS (SELECT max(ts) - INTERVAL 12 HOUR AS upto FROM frames)"


@query("stream_tumbling_segments", "frames", UPTO + ", w AS (SELECT video_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, min(CASE WHEN gt > 0.5 THEN ts END) AS t, avg(CASE WHEN gt > 0.5 THEN score END) AS conf FROM frames GROUP BY 1, 2) SELECT video_id, CAST(floor(epoch(start)) AS BIGINT) AS start, CAST(floor(epoch(t)) AS BIGINT) AS t, round(conf, 6) AS conf FROM w CROSS JOIN u WHERE conf > 0.25 AND start + INTERVAL 6 HOUR <= upto")
def stream_tumbling_segments(spark, sf):
    out = S.run_to_table(spark, S.tumbling_hits(S.replay(spark, timed(spark, sf)), "6 hours", "1 hour", 0.25))
    out = out.crossJoin(F.broadcast(ended(spark, sf, 12))).where(F.col("start") + F.expr("INTERVAL 6 HOURS") <= F.col("upto"))  # one row
    return out.select("video_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("t").alias("t"), r6("conf").alias("conf"))


@query("stream_sliding_windows", "frames", UPTO + ", x AS (SELECT video_id, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS b, score FROM frames), y AS (SELECT video_id, b AS start, score FROM x UNION ALL SELECT video_id, b - INTERVAL 3 HOUR, score FROM x) SELECT video_id, CAST(floor(epoch(start)) AS BIGINT) AS start, round(avg(score), 6) AS mean, count(*) AS n FROM y CROSS JOIN u WHERE start + INTERVAL 6 HOUR <= upto GROUP BY 1, 2")
def stream_sliding_windows(spark, sf):
    out = S.run_to_table(spark, S.sliding_means(S.replay(spark, timed(spark, sf)), "6 hours", "3 hours", "1 hour"))
    out = out.crossJoin(F.broadcast(ended(spark, sf, 12))).where("end <= upto")  # one row
    return out.select("video_id", F.unix_timestamp("start").alias("start"), r6("mean").alias("mean"), "n")


@query("stream_session_merge", "frames", ", h AS (SELECT video_id, ts FROM frames WHERE gt > 0.5), p AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS nw FROM h), i AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY ts) AS island FROM p), s AS (SELECT video_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM i GROUP BY video_id, island), u AS (SELECT max(ts) - INTERVAL 24 HOUR AS upto FROM frames) SELECT video_id, CAST(floor(epoch(start)) AS BIGINT) AS start, CAST(floor(epoch(last)) AS BIGINT) AS last, n FROM s CROSS JOIN u WHERE last <= upto")
def stream_session_merge(spark, sf):
    hits = timed(spark, sf).where("hit")
    out = S.run_to_table(spark, S.session_hits(S.replay(spark, hits), "8 hours", "1 hour"))
    out = out.crossJoin(F.broadcast(ended(spark, sf, 24))).where("last <= upto")  # one row
    return out.select("video_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("last").alias("last"), "n")


@query("stream_extend_clip", "frames", ", s AS (SELECT video_id, CAST(idx / 4 AS BIGINT) AS segment, max(gt) > 0.8 AS hit FROM (SELECT video_id, floor(idx / 4.0) * 4 AS idx, gt FROM frames) x GROUP BY 1, 2), h AS (SELECT *, CASE WHEN segment - lag(segment) OVER (PARTITION BY video_id ORDER BY segment) = 1 THEN 0 ELSE 1 END AS nw FROM s WHERE hit), i AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY segment) - 1 AS clip FROM h) SELECT video_id, CAST(clip AS BIGINT) AS clip, min(segment) AS start, max(segment) AS \"end\" FROM i GROUP BY 1, 2")
def stream_extend_clip(spark, sf):
    f = frames(spark, sf).select("video_id", F.floor(F.col("idx") / 4.0).cast("long").alias("segment"), "gt", F.col("ts").cast("timestamp").alias("ts"))
    segments = f.groupBy("video_id", "segment").agg((F.max("gt") > 0.8).alias("hit"), F.max("ts").alias("ts"))
    out = S.run_to_table(spark, S.extend_clips(S.replay(spark, segments), groups(spark, sf)))
    return out.groupBy("video_id", "clip").agg(F.min("start").alias("start"), F.max("end").alias("end"))


