"""Top-k, selection, set operations, reshaping and sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.scalars import r6
from tideline.operators import highlights
from tideline.operators import select as S
from tideline.operators import timeline as T
from tideline.operators.tables import seeded, top_k
from tideline.plans.registry import query
from tideline.plans.timeline import GROWN, NMS, decay_sql, gauss_sql, merge_sql
from tideline.sources.views import SQL, frames, shots, table, video

# of equal sums the set that a table of shots in order keeps: the one whose last shot is the earliest, then the last but one, and so on; means count in whole units of 1e-9, so sums are exact in any order
KNAP = """, sm AS (SELECT s.video_id, shot_id, end_f - start_f + 1 AS len, CAST(round(avg(score) * 1e9) AS BIGINT) AS mean, max(end_f) OVER (PARTITION BY s.video_id) AS last FROM shots s JOIN frames f ON f.video_id = s.video_id AND f.idx BETWEEN start_f AND end_f GROUP BY s.video_id, shot_id, start_f, end_f),
ks AS (WITH RECURSIVE k AS (SELECT video_id, -1 AS shot, 0 AS used, CAST(0 AS BIGINT) AS v, CAST([] AS INT[]) AS l, CAST(floor((max(last) + 1) * 0.15) AS INT) AS cap FROM sm GROUP BY video_id UNION ALL
SELECT k.video_id, s.shot_id, k.used + t * s.len, k.v + t * s.mean, CASE WHEN t = 1 THEN list_append(l, s.shot_id) ELSE l END, cap FROM k JOIN sm s ON s.video_id = k.video_id AND s.shot_id = k.shot + 1 CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 1) x WHERE k.used + t * s.len <= cap) SELECT video_id, list(l ORDER BY v DESC, list_reverse(l))[1] AS l FROM k GROUP BY video_id),
kc AS (SELECT video_id, unnest(l) AS shot_id FROM ks)
"""


def chosen_shots(spark, sf):
    m = S.shot_means(shots(spark, sf), frames(spark, sf))
    return m, S.budget_knapsack(m)


@query("budget_knapsack", "shots frames", KNAP + "SELECT video_id, shot_id FROM kc")
def budget_knapsack(spark, sf):
    return chosen_shots(spark, sf)[1]


@query("summary_mask", "shots frames", KNAP + "SELECT f.video_id, f.idx, CAST(CASE WHEN kc.video_id IS NULL THEN 0 ELSE 1 END AS INT) AS selected FROM frames f LEFT JOIN kc ON kc.video_id = f.video_id AND kc.shot_id = CAST(floor(f.idx / 7.0) AS INT)")
def summary_mask(spark, sf):
    m, c = chosen_shots(spark, sf)
    return S.summary_mask(m, c)


# one ranked clip a step: parts that earlier clips leave free, the widest of them, and what the budget allows of it
PLACED = """, worth AS (SELECT *, max(frame_score) OVER (PARTITION BY video_id) AS best FROM clips),
rk AS (SELECT video_id, start, "end", peak, frame_score AS score, row_number() OVER (PARTITION BY video_id ORDER BY round(frame_score, 9) DESC, start, peak) AS rn FROM worth WHERE frame_score >= 0.35 * best),
pl AS (WITH RECURSIVE s AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s DOUBLE, e DOUBLE)[]) AS taken, CAST(20 AS DOUBLE) AS room, false AS stopped, false AS ok, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS e, CAST(NULL AS DOUBLE) AS peak, CAST(NULL AS DOUBLE) AS score FROM rk UNION ALL
SELECT video_id, rn, CASE WHEN ok THEN list_append(taken, {'s': nb, 'e': ne}) ELSE taken END, CASE WHEN ok THEN room - (ne - nb) ELSE room END, stopped, ok, nb, ne, peak, score FROM (
SELECT *, w >= 1.5 AND NOT stopped AS ok, CASE WHEN w > room THEN least(greatest(peak - room / 2, part.b), part.e - room) ELSE part.b END AS nb, CASE WHEN w > room THEN least(greatest(peak - room / 2, part.b), part.e - room) + room ELSE part.e END AS ne FROM (
SELECT * REPLACE (least(greatest(peak, part.b), part.e) AS peak), part.e - part.b AS w, part.e - part.b >= 1.5 AND part.e - part.b > room AND room < 1.5 AS stopped FROM (
SELECT video_id, rn, taken, room, peak, score, list_filter(parts, lambda x: x.e - x.b = list_max(list_transform(parts, lambda y: y.e - y.b)))[1] AS part FROM (
SELECT s.video_id, r.rn, s.taken, s.room, r.peak, r.score, list_transform(list_zip(list_concat([-1e18], list_sort(list_transform(s.taken, lambda x: x.e))), list_concat(list_sort(list_transform(s.taken, lambda x: x.s)), [1e18])), lambda g: {'b': greatest(g[1], r.start), 'e': least(g[2], r."end")}) AS parts
FROM s JOIN rk r ON r.video_id = s.video_id AND r.rn = s.rn + 1 WHERE NOT s.stopped AND len(s.taken) < 6 AND s.room > 0) a) b) c) d) SELECT video_id, b AS s, e, peak, score FROM s WHERE ok)
"""


# the edit of `greedy_clip_selection`: 30 seconds, eight clips, two seconds at least
EDIT = PLACED.replace("CAST(20 AS DOUBLE) AS room", "CAST(30 AS DOUBLE) AS room").replace("1.5", "2").replace("len(s.taken) < 6", "len(s.taken) < 8")


@query("greedy_clip_selection", "frames", GROWN + EDIT + merge_sql("m", "pl", 0.5, ", arg_max(peak, round(score, 9) - s * 1e-12) AS peak, sum(score * (e - s)) / sum(e - s) AS score, CAST(count(*) AS INT) AS merged") + 'SELECT video_id, round(s, 6) AS start, round(e, 6) AS "end", round(peak, 6) AS peak, round(score, 6) AS score, merged FROM m')
def greedy_clip_selection(spark, sf):
    """Clips of each video under a budget of 30 seconds."""
    d = S.greedy_clip_selection(T.peak_grow(frames(spark, sf)).withColumnRenamed("frame_score", "score"), target=30.0, most=8, least=2.0)
    return d.select("video_id", *[r6(c).alias(c) for c in ("start", "end", "peak", "score")], "merged")


# the calibrated curve takes the place of the frames' score; the kept clips, verified and led in, that of the grown ones
RUN = (
    f"WITH raw AS ({SQL['frames']})" + decay_sql("raw", "score", 0.9, "d0") + gauss_sql("d0", "v", 2.0, "g0")
    + """, frames AS (SELECT r.video_id, r.idx, r.t, r.gt, round(least(greatest(CASE WHEN max(v) OVER w > 0 THEN v * max(r.score) OVER w / max(v) OVER w ELSE v END, 0), 1), 9) AS score FROM raw r JOIN g0 USING (video_id, idx) WINDOW w AS (PARTITION BY r.video_id))"""
    + NMS.replace("4.0), 12.0)", "2.0), 6.0)").replace("b - a < 4 OR b - a > 12", "b - a < 2 OR b - a > 6")
    + """, kc AS (SELECT c.*, row_number() OVER (PARTITION BY c.video_id ORDER BY round(frame_score, 9) DESC, c.p) AS rn FROM clips c JOIN nms k ON k.video_id = c.video_id AND k.p = c.p),
fr AS (SELECT r.video_id, r.p, list(f.gt ORDER BY f.idx) AS l, count(*) AS n FROM kc r JOIN frames f ON f.video_id = r.video_id AND f.t >= r.start AND f.t < r."end" WHERE rn <= 8 GROUP BY 1, 2),
cs AS (SELECT video_id, p, list_avg(list_transform(range(0, least(4, n)), lambda i: l[1 + CAST(round(i * (n - 1) / CAST(greatest(least(4, n) - 1, 1) AS DOUBLE)) AS INT)])) AS s FROM fr),
led AS (SELECT c.video_id, c.p, peak, greatest(0, start - 5) AS start, "end", coalesce(0.5 * frame_score + 0.5 * s, frame_score) AS frame_score FROM kc c LEFT JOIN cs ON cs.video_id = c.video_id AND cs.p = c.p)"""
    + PLACED.replace("FROM clips)", "FROM led)")
    + merge_sql("m", "pl", 0.5, ", arg_max(peak, round(score, 9) - s * 1e-12) AS peak, sum(score * (e - s)) / sum(e - s) AS score, CAST(count(*) AS INT) AS merged")
    + 'SELECT video_id, round(s, 6) AS start, round(e, 6) AS "end", round(peak, 6) AS peak, round(score, 6) AS score, merged FROM m'
)


@query("highlight_run", "", RUN)
def highlight_run(spark, sf):
    """Scores, calibrated curve, proposals, suppression, verification, re-ranked selection, as one job: the clips of each video's edit."""
    f = frames(spark, sf).select("video_id", "idx", "t", "gt", F.col("score").alias("signal"))
    d = highlights.highlight_run(f, lambda: lambda rows: rows["signal"], lambda rows: rows["gt"].mean())
    return d.select("video_id", *[r6(c).alias(c) for c in ("start", "end", "peak", "score")], "merged")


@query("rank_score_topk", "frames", GROWN + """, s AS (SELECT video_id, p, frame_score, CASE WHEN p % 2 = 0 THEN (p * 13 % 10) / 10.0 END AS clip_score FROM clips), r AS (SELECT video_id, p, coalesce(0.5 * frame_score + 0.5 * clip_score, frame_score) AS rank_score FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(rank_score, 9) DESC, p) AS rank FROM r) SELECT video_id, p, round(rank_score, 6) AS rank_score FROM t WHERE rank <= 8""")
def rank_score_topk(spark, sf):
    c = T.peak_grow(frames(spark, sf)).withColumn("clip_score", F.when(F.col("p") % 2 == 0, F.col("p") * 13 % 10 / 10.0))
    c = c.withColumn("rank_score", F.coalesce(0.5 * F.col("frame_score") + 0.5 * F.col("clip_score"), F.col("frame_score")))
    return top_k(c, ["video_id"], [F.round("rank_score", 9).desc(), F.asc("p")], 8).select("video_id", "p", r6("rank_score").alias("rank_score"))


@query("recent_k", "frames", ", r AS (SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY idx DESC) AS rn FROM frames WHERE gt > 0.7) SELECT video_id, idx FROM r WHERE rn <= 3")
def recent_k(spark, sf):
    return top_k(frames(spark, sf).where("gt > 0.7"), ["video_id"], [F.desc("idx")], 3).select("video_id", "idx")


@query("best_checkpoint_argmax", "frames", ", e AS (SELECT video_id % 5 AS split, idx % 12 AS epoch, corr(score, gt) + avg(gt) AS q FROM frames GROUP BY 1, 2) SELECT split, CAST(epoch AS INT) AS epoch, round(q, 6) AS q, round(max(q) OVER (PARTITION BY split ORDER BY epoch), 6) AS best_so_far, row_number() OVER (PARTITION BY split ORDER BY round(q, 9) DESC, epoch) = 1 AS best FROM e")
def best_checkpoint_argmax(spark, sf):
    e = frames(spark, sf).groupBy((F.col("video_id") % 5).alias("split"), (F.col("idx") % 12).alias("epoch")).agg((F.corr("score", "gt") + F.avg("gt")).alias("q"))
    by = Window.partitionBy("split")
    best = F.row_number().over(by.orderBy(F.round("q", 9).desc(), "epoch")) == 1
    return e.select("split", "epoch", r6("q").alias("q"), r6(F.max("q").over(by.orderBy("epoch"))).alias("best_so_far"), best.alias("best"))


@query("quantile_topk_pool", "frames", ", r AS (SELECT video_id, idx, greatest(1, floor(count(*) OVER (PARTITION BY video_id) * 0.25)) AS k, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, idx) AS hi, row_number() OVER (PARTITION BY video_id ORDER BY score, idx) AS lo FROM frames) SELECT video_id, idx, CASE WHEN hi <= k THEN 'high' ELSE 'low' END AS pool FROM r WHERE hi <= k OR lo <= k")
def quantile_topk_pool(spark, sf):
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(video()) * 0.25))
    rank = lambda o: F.row_number().over(video().orderBy(o, "idx"))
    r = frames(spark, sf).select("video_id", "idx", k.alias("k"), rank(F.desc("score")).alias("hi"), rank(F.asc("score")).alias("lo"))
    return r.where("hi <= k or lo <= k").select("video_id", "idx", F.when(F.col("hi") <= F.col("k"), "high").otherwise("low").alias("pool"))


@query("key_union_distinct", "frames", "SELECT DISTINCT video_id FROM frames WHERE video_id % 5 <> 4 UNION SELECT video_id FROM frames WHERE video_id % 7 = 0 ORDER BY 1")
def key_union_distinct(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("video_id"))
    return e.where("video_id % 5 <> 4").union(e.where("video_id % 7 = 0")).distinct().orderBy("video_id")


@query("tagged_union", "frames", "SELECT 'base' AS model, video_id, idx, round(score, 6) AS s, CAST(NULL AS DOUBLE) AS extra FROM frames UNION ALL SELECT 'tuned', video_id, idx, round((score + gt) / 2, 6), round(gt, 6) FROM frames")
def tagged_union(spark, sf):
    f = frames(spark, sf)
    a = f.select(F.lit("base").alias("model"), "video_id", "idx", r6("score").alias("s"))
    b = f.select(F.lit("tuned").alias("model"), "video_id", "idx", r6((F.col("score") + F.col("gt")) / 2).alias("s"), r6("gt").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("long_series", "frames", "SELECT video_id, idx, 'score' AS series, round(score, 6) AS v FROM frames UNION ALL SELECT video_id, idx, 'gt', round(gt, 6) FROM frames UNION ALL SELECT video_id, idx, 'threshold', 0.5 FROM frames")
def long_series(spark, sf):
    f = frames(spark, sf).select("video_id", "idx", r6("score").alias("score"), r6("gt").alias("gt"), F.lit(0.5).alias("threshold"))
    return f.unpivot(["video_id", "idx"], ["score", "gt", "threshold"], "series", "v")


@query("random_split", "frames", ", v AS (SELECT DISTINCT video_id FROM frames), r AS (SELECT video_id, row_number() OVER (ORDER BY md5(concat_ws('|', video_id, '42'))) AS rn, count(*) OVER () AS n FROM v) SELECT video_id, CASE WHEN rn <= greatest(1, floor(n * 0.1)) THEN 'val' WHEN rn <= greatest(1, floor(n * 0.1)) + greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS role FROM r")
def random_split(spark, sf):
    from tideline.operators.reshape import random_split as split

    return split(table(spark, sf, "events").select(F.col("user_id").alias("video_id")).distinct(), "video_id", 0.1, 0.2, 42)


@query("first_fraction_holdout", "frames", ", v AS (SELECT DISTINCT video_id, video_id % 5 AS split FROM frames), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY video_id) AS rn, count(*) OVER (PARTITION BY split) AS n FROM v) SELECT split, video_id, rn <= greatest(1, floor(n * 0.2)) AS held_out FROM r")
def first_fraction_holdout(spark, sf):
    v = frames(spark, sf).select("video_id", (F.col("video_id") % 5).alias("split")).distinct()
    by = Window.partitionBy("split")
    return v.select("split", "video_id", (F.row_number().over(by.orderBy("video_id")) <= F.greatest(F.lit(1), F.floor(F.count("*").over(by) * 0.2))).alias("held_out"))


@query("interleaved_shards", "frames", ", v AS (SELECT DISTINCT video_id FROM frames) SELECT video_id, CAST((row_number() OVER (ORDER BY video_id) - 1) % 4 AS INT) AS shard FROM v")
def interleaved_shards(spark, sf):
    from tideline.operators.reshape import interleaved_shards as shards

    return shards(table(spark, sf, "events").select(F.col("user_id").alias("video_id")).distinct(), "video_id", 4)


def subsample(spark, sf, most):
    return top_k(table(spark, sf, "embeddings").select("label", "vec_id"), ["label"], [seeded("vec_id", seed=3)], most)


SUBSAMPLE = (", r".replace(", r", "WITH r", 1) + " AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', vec_id, '3'))) AS rn FROM embeddings) SELECT label, vec_id FROM r WHERE rn <= 2000")


@query("class_subsample", "", SUBSAMPLE)
@query("class_subsample_reference", "", SUBSAMPLE)
def class_subsample(spark, sf):
    return subsample(spark, sf, 2000)
