"""Join queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.scalars import r6
from tideline.operators import intervals as I
from tideline.operators import joins as J
from tideline.operators import timeline as T
from tideline.operators.tables import seeded, top_k
from tideline.plans.registry import query
from tideline.plans.timeline import runs_sql
from tideline.sources.views import video, conversations_text, frame_features, frames, heat, pair_results, run_log, segments, table

COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) * list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


def video_manifest(spark, sf):
    """One row a video: key, number of frames."""
    return frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("n_frames"))


@query("manifest_key_join", "frames", ", m AS (SELECT video_id, count(*) AS n_frames FROM frames GROUP BY video_id) SELECT video_id, video_id % 5 AS split, n_frames FROM m WHERE video_id % 3 <> 0")
def manifest_key_join(spark, sf):
    m = video_manifest(spark, sf)
    keys = m.select("video_id", (F.col("video_id") % 5).alias("split"))
    return keys.join(m.where("video_id % 3 <> 0"), "video_id").select("video_id", "split", "n_frames")


@query("split_semi_join", "frames", "SELECT video_id, idx, round(score, 6) AS score FROM frames WHERE video_id % 5 = 2")
def split_semi_join(spark, sf):
    keys = table(spark, sf, "events").where("user_id % 5 = 2").select(F.col("user_id").alias("video_id")).distinct()
    return frames(spark, sf).join(keys, "video_id", "left_semi").select("video_id", "idx", r6("score").alias("score"))


@query("contains_join_first", "", "SELECT l.lang, arg_min(p.page_id, p.page_id) AS page_id FROM (SELECT DISTINCT lang FROM documents) l JOIN pages p ON contains(p.url, '/' || l.lang || '/') GROUP BY l.lang")
def contains_join_first(spark, sf):
    from tideline.operators.tables import contains_join_first as first

    names = table(spark, sf, "documents").select("lang").distinct()
    return first(names, table(spark, sf, "pages").select("page_id", "url"), F.concat(F.lit("/"), F.col("lang"), F.lit("/")), "lang", "url", "page_id")


@query("tolerance_match_unique", "", """WITH near AS (SELECT d.doc_id AS probe_id, b.item_id AS build_id FROM documents d JOIN benchmark b ON length(b.text) BETWEEN d.n_chars - 2 AND d.n_chars + 2),
p AS (SELECT probe_id, row_number() OVER (ORDER BY probe_id) AS rn FROM (SELECT DISTINCT probe_id FROM near) x),
m AS (WITH RECURSIVE u AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS probe_id, CAST(NULL AS BIGINT) AS build_id UNION ALL
SELECT rn, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, probe_id, b FROM (SELECT p.rn, u.used, p.probe_id, CAST(min(n.build_id) AS BIGINT) AS b FROM u JOIN p ON p.rn = u.rn + 1 LEFT JOIN near n ON n.probe_id = p.probe_id AND NOT list_contains(u.used, n.build_id) GROUP BY 1, 2, 3) x) SELECT probe_id, build_id FROM u)
SELECT probe_id, build_id FROM m WHERE build_id IS NOT NULL""")
def tolerance_match_unique(spark, sf):
    """Documents matched one-to-one with benchmark items of nearly equal length."""
    probe = table(spark, sf, "documents").select(F.col("doc_id").alias("probe_id"), F.col("n_chars").cast("long").alias("length"))
    build = table(spark, sf, "benchmark").select(F.col("item_id").alias("build_id"), F.length("text").cast("long").alias("length"))
    return J.tolerance_match(probe, build, 2)


@query("point_in_interval_first", "segments", ", p AS (SELECT DISTINCT conv_id AS video_id, CAST(turn * 37 + 5 AS DOUBLE) AS t FROM conversations) SELECT p.video_id, p.t, coalesce((SELECT arg_min(text, seg_start) FROM segments s WHERE s.video_id = p.video_id AND s.seg_start <= p.t AND p.t <= s.seg_end), 'none') AS text FROM p")
def point_in_interval_first(spark, sf):
    p = conversations_text(spark, sf).select(F.col("conv_id").alias("video_id"), (F.col("turn") * 37 + 5).cast("double").alias("t")).distinct()
    return J.first_containing(p, segments(spark, sf), "t", "seg_start", "seg_end", "text", 30.0, "none")


@query("frames_in_clip_join", "frames", """, c AS (SELECT video_id, CAST(unnest([3.2, 20.5, 41.0, 60.3]) AS DOUBLE) AS s FROM (SELECT DISTINCT video_id FROM frames)), i AS (SELECT c.video_id, s, f.idx FROM c JOIN frames f ON f.video_id = c.video_id AND f.t >= s AND f.t < s + 4)
SELECT video_id, s, idx FROM i UNION ALL SELECT c.video_id, c.s, arg_min(f.idx, abs(f.t - c.s)) FROM c JOIN frames f USING (video_id) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.video_id = c.video_id AND i.s = c.s) GROUP BY 1, 2""")
def frames_in_clip_join(spark, sf):
    f = frames(spark, sf).select("video_id", "idx", "t")
    c = f.select("video_id").distinct().select("video_id", F.explode(F.array(*map(F.lit, (3.2, 20.5, 41.0, 60.3)))).alias("s")).withColumn("e", F.col("s") + 4)
    inside = J.range_join_points(f, c, "t", "s", "e", 8.0).where("t < e").select("video_id", "s", "idx")
    empty = c.join(inside, ["video_id", "s"], "left_anti").select("video_id", F.col("s").cast("double").alias("t"))
    rest = J.asof_nearest(empty, f.select("video_id", F.col("t").cast("double").alias("t"), F.col("idx").alias("v")), "idx")
    return inside.unionByName(rest.select("video_id", F.col("t").alias("s"), "idx"))


IV = runs_sql("r1", "frames", "score > 0.3") + runs_sql("r2", "frames", "gt > 0.6") + ", a AS (SELECT video_id, CAST(s AS DOUBLE) AS s, CAST(e + 1 AS DOUBLE) AS e FROM r1), b AS (SELECT video_id, CAST(s AS DOUBLE) AS s, CAST(e + 1 AS DOUBLE) AS e FROM r2)\n"


def both_runs(spark, sf):
    f = frames(spark, sf)
    iv = lambda c: T.runs(f, c).select("video_id", F.col("start_i").cast("double").alias("s"), (F.col("end_i") + 1).cast("double").alias("e"))
    return iv(F.col("score") > 0.3), iv(F.col("gt") > 0.6)


@query("interval_iou_join", "frames", IV + """, j AS (SELECT a.video_id, a.s AS ps, b.s AS gs, least(a.e, b.e) - greatest(a.s, b.s) AS i, a.e - a.s + b.e - b.s AS len, greatest(a.e, b.e) - least(a.s, b.s) AS hull FROM a JOIN b USING (video_id))
SELECT video_id, ps, gs, round(i / (len - i), 6) AS iou, round(i / hull, 6) AS iou_hull FROM j WHERE i > 0""")
def interval_iou_join(spark, sf):
    """Pairs that overlap; all others have an IoU of 0."""
    x = [F.col(c) for c in ("s", "e", "s2", "e2")]
    return I.overlapping(*both_runs(spark, sf)).select("video_id", F.col("s").alias("ps"), F.col("s2").alias("gs"), r6(I.iou(*x)).alias("iou"), r6(I.iou(*x, hull=True)).alias("iou_hull"))


@query("overlap_fraction_semi", "frames", IV + "SELECT a.video_id, a.s, max(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) >= 0.5 * (a.e - a.s) AS checked FROM a JOIN b USING (video_id) GROUP BY a.video_id, a.s, a.e")
def overlap_fraction_semi(spark, sf):
    a, b = both_runs(spark, sf)
    top = I.overlapping(a, b).groupBy("video_id", "s", "e").agg(F.max(I.overlap(*[F.col(c) for c in ("s", "e", "s2", "e2")])).alias("o"))
    j = a.join(b.select("video_id"), "video_id", "left_semi").join(top, ["video_id", "s", "e"], "left")
    return j.select("video_id", "s", (F.coalesce("o", F.lit(0.0)) >= 0.5 * (F.col("e") - F.col("s"))).alias("checked"))


#: All pairs, numbered in order of both sides' gt; the drawn numbers.
MINING = """, p AS (SELECT a.video_id, a.idx AS i, b.idx AS j, a.gt AS ga, b.gt AS gb, CASE WHEN b.gt <= a.gt - 0.3 THEN 0 ELSE 1 END AS kind FROM frames a JOIN frames b USING (video_id) WHERE b.gt <= a.gt - 0.3 OR (a.gt > 0.7 AND b.score > 0.6 AND b.gt < 0.2)),
q AS (SELECT video_id, i, j, row_number() OVER (PARTITION BY video_id ORDER BY ga, i, kind, gb, j) - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM p),
t AS (SELECT video_id, n, m, unnest(range(m)) AS t FROM (SELECT DISTINCT video_id, n, least(n, 1000) AS m FROM q)), d AS (SELECT video_id, (t * n) // m + CAST(floor((CAST('0x' || substr(md5(concat_ws('|', video_id, t, '7')), 1, 8) AS BIGINT) / 4294967296.0) * (((t + 1) * n) // m - (t * n) // m)) AS BIGINT) AS p FROM t)
SELECT video_id, i, j FROM q JOIN d USING (video_id, p)"""


@query("margin_pair_mining", "frames", MINING)
@query("margin_pair_mining_reference", "frames", MINING)
def margin_pair_mining(spark, sf):
    """Up to 1,000 pairs a video with a gap of 0.3, or hard negatives."""
    return J.draw_margin_pairs(frames(spark, sf), 0.3, 1000, 7)


@query("peak_valley_pairing", "frames", """, v AS (SELECT *, top - gt AS below, row_number() OVER w - 1 AS k, sum(top - gt) OVER w - (top - gt) AS start FROM (SELECT video_id, idx AS valley, gt, max(gt) OVER (PARTITION BY video_id) AS top FROM frames WHERE gt < 0.3) x WINDOW w AS (PARTITION BY video_id ORDER BY gt DESC, valley)),
n AS (SELECT video_id, count(*) AS n, max(top) AS top, sum(below) AS s FROM v GROUP BY 1),
p AS (SELECT f.video_id, f.idx AS peak, n, s, n * (gt - top) AS alike, CAST('0x' || substr(md5(concat_ws('|', f.video_id, idx, '5')), 1, 8) AS BIGINT) / 4294967296.0 AS u, CAST('0x' || substr(md5(concat_ws('|', f.video_id, idx, 'v', '5')), 1, 8) AS BIGINT) / 4294967296.0 AS u2 FROM frames f JOIN n ON n.video_id = f.video_id WHERE gt > 0.8)
SELECT p.video_id, peak, valley FROM p JOIN v ON v.video_id = p.video_id AND k = CAST(floor(u2 * n) AS INT) WHERE u * (alike + s) < alike
UNION ALL SELECT p.video_id, peak, arg_max(valley, start) FROM p JOIN v ON v.video_id = p.video_id AND below > 0 AND start <= u2 * s WHERE NOT u * (alike + s) < alike GROUP BY 1, 2""")
def peak_valley_pairing(spark, sf):
    """One valley a peak, in proportion to the gap."""
    f = frames(spark, sf)
    peaks = f.where("gt > 0.8").select("video_id", F.col("idx").alias("peak"), F.col("gt").alias("score"))
    return J.draw_valleys(peaks, f.where("gt < 0.3").select("video_id", F.col("idx").alias("valley"), F.col("gt").alias("score")), 5)


POOL = """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), c AS (SELECT video_id, CAST(floor(idx / 8) AS INT) AS clip, avg(gt) AS m FROM frames JOIN n USING (video_id) WHERE floor(idx / 8) * 8 < n - 8 GROUP BY 1, 2),
k AS (SELECT *, greatest(1, CAST(floor(count(*) OVER (PARTITION BY video_id) * 0.4) AS INT)) AS k, row_number() OVER (PARTITION BY video_id ORDER BY round(m, 9) DESC, clip) AS hi, row_number() OVER (PARTITION BY video_id ORDER BY round(m, 9), clip) AS lo FROM c)
"""


@query("clip_preference_pools", "frames", POOL + """, best AS (SELECT video_id, max(m) AS top FROM k WHERE lo <= k GROUP BY 1), ch AS (SELECT k.* FROM k JOIN best USING (video_id) WHERE hi <= k AND m >= top + 0.05),
p AS (SELECT ch.video_id, ch.clip AS chosen, r.clip AS rejected, row_number() OVER (PARTITION BY ch.video_id, ch.clip ORDER BY md5(concat_ws('|', ch.video_id, ch.clip, r.clip, '9'))) AS rn FROM ch JOIN k r ON r.video_id = ch.video_id AND r.lo <= r.k) SELECT video_id, chosen, rejected FROM p WHERE rn = 1""")
def clip_preference_pools(spark, sf):
    from tideline.operators.pairs import clip_pools, pair_pools

    return pair_pools(clip_pools(frames(spark, sf), 8, 0.4), 0.05, 9)


@query("windowed_similarity_edges", "frame_features", ", e AS (SELECT a.video_id, a.idx AS i, b.idx AS j, greatest(" + COS.format(a="a.feature", b="b.feature") + ", 0) AS w FROM frame_features a JOIN frame_features b ON a.video_id = b.video_id AND b.idx > a.idx AND b.idx <= a.idx + 10), q AS (SELECT video_id, quantile_cont(w, 0.8) AS cut FROM e GROUP BY 1) SELECT video_id, i, j, round(w, 6) AS w FROM e JOIN q USING (video_id) WHERE w >= cut")
def windowed_similarity_edges(spark, sf):
    return J.similarity_edges(frame_features(spark, sf), 10, quantile=0.8).select("video_id", "i", "j", r6("w").alias("w"))


@query("global_similarity_edges", "frame_features", ", e AS (SELECT a.video_id, a.idx AS i, b.idx AS j, " + COS.format(a="a.feature", b="b.feature") + " AS w FROM frame_features a JOIN frame_features b ON a.video_id = b.video_id AND b.idx > a.idx) SELECT video_id, i, j, round(least(w, 1), 6) AS w FROM e WHERE w > 0.3")
def global_similarity_edges(spark, sf):
    return J.similar_pairs(frame_features(spark, sf), 0.3).select("video_id", "i", "j", r6(F.least("w", F.lit(1.0))).alias("w"))


@query("step_aligned_join", "run_log", ", a AS (SELECT run, step, value FROM run_log), b AS (SELECT run + 1 AS run, step, value AS v2 FROM run_log), j AS (SELECT run, step, value, v2, row_number() OVER (PARTITION BY run ORDER BY step) AS rn, count(*) OVER (PARTITION BY run) AS n FROM a JOIN b USING (run, step)) SELECT run, step, value, v2 FROM j WHERE rn > 5 AND rn < n")
def step_aligned_join(spark, sf):
    a = run_log(spark, sf)
    j = a.join(a.select((F.col("run") + 1).alias("run"), "step", F.col("value").alias("v2")), ["run", "step"])
    by = Window.partitionBy("run")
    j = j.withColumn("rn", F.row_number().over(by.orderBy("step"))).withColumn("n", F.count("*").over(by))
    return j.where("rn > 5 and rn < n").select("run", "step", "value", "v2")


@query("paired_state_transition", "pair_results", ", s AS (SELECT CASE WHEN base_gap > 0 AND tuned_gap > 0 THEN 'maintained' WHEN base_gap > 0 THEN 'regressed' WHEN tuned_gap > 0 THEN 'rescued' ELSE 'unresolved' END AS state FROM pair_results) SELECT state, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM s GROUP BY state")
def paired_state_transition(spark, sf):
    p = pair_results(spark, sf)
    a, b = p.select("video_id", "chosen", "rejected", (F.col("base_gap") > 0).alias("x")), p.select("video_id", "chosen", "rejected", (F.col("tuned_gap") > 0).alias("y"))
    state = F.when(F.col("x") & F.col("y"), "maintained").when(F.col("x"), "regressed").when(F.col("y"), "rescued").otherwise("unresolved")
    g = a.join(b, ["video_id", "chosen", "rejected"]).groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).select("state", "n", r6(100.0 * F.col("n") / F.col("all")).alias("percent"))  # four rows


def knots(spark, sf):
    return heat(spark, sf).select("video_id", ((F.col("start_time") + F.col("end_time")) / 2).alias("t"), F.col("value").alias("v"))


KNOTS = ", k AS (SELECT video_id, (start_time + end_time) / 2 AS t, value AS v FROM heat)\n"
LINEAR = KNOTS + """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t) AS a, row_number() OVER (PARTITION BY video_id ORDER BY t DESC) AS z, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS t2, lead(v) OVER (PARTITION BY video_id ORDER BY t) AS v2 FROM k),
s AS (SELECT video_id, CASE WHEN a = 1 THEN -1e18 ELSE t END AS lo, CASE WHEN z = 2 THEN 1e18 ELSE t2 END AS hi, t, v, t2, v2 FROM o WHERE t2 IS NOT NULL)
"""


@query("asof_linear", "heat frames", LINEAR + """, y AS (SELECT f.video_id, f.t, s.v + (s.v2 - s.v) * (f.t - s.t) / (s.t2 - s.t) AS y FROM frames f JOIN s ON s.video_id = f.video_id AND f.t >= lo AND f.t < hi),
c AS (SELECT f.video_id, f.t, CASE WHEN f.t < s.t THEN s.v WHEN f.t > s.t2 THEN s.v2 ELSE s.v + (s.v2 - s.v) * (f.t - s.t) / (s.t2 - s.t) END AS y FROM frames f JOIN s ON s.video_id = f.video_id AND f.t >= lo AND f.t < hi) SELECT y.video_id, y.t, round(y.y, 6) AS extrapolated, round(c.y, 6) AS constant FROM y JOIN c ON y.video_id = c.video_id AND y.t = c.t""")
def asof_linear(spark, sf):
    t, k = frames(spark, sf).select("video_id", "t"), knots(spark, sf)
    a, b = J.asof_linear(t, k, out="x"), J.asof_linear(t, k, "constant", out="y")
    return a.join(b, ["video_id", "t"]).select("video_id", "t", r6("x").alias("extrapolated"), r6("y").alias("constant"))


@query("asof_previous", "heat frames", KNOTS + "SELECT f.video_id, f.t, round(k.v, 6) AS v FROM frames f ASOF LEFT JOIN k ON f.video_id = k.video_id AND f.t >= k.t")
def asof_previous(spark, sf):
    return J.asof(frames(spark, sf).select("video_id", "t"), knots(spark, sf)).select("video_id", "t", r6("p_v").alias("v"))


@query("asof_nearest", "heat frames", KNOTS + "SELECT f.video_id, f.t, round(arg_min(k.v, abs(k.t - f.t) + k.t * 1e-9), 6) AS v FROM frames f JOIN k USING (video_id) GROUP BY 1, 2")
def asof_nearest(spark, sf):
    return J.asof_nearest(frames(spark, sf).select("video_id", "t"), knots(spark, sf)).select("video_id", "t", r6("v").alias("v"))


@query("resample_length", "heat frames", """, h AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_time) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n, value AS v FROM heat), x AS (SELECT f.video_id, idx, idx * (h.n - 1) / CAST(max(idx) OVER (PARTITION BY f.video_id) AS DOUBLE) AS p, h.n FROM frames f JOIN (SELECT DISTINCT video_id, n FROM h) h USING (video_id))
SELECT x.video_id, x.idx, round(a.v + (b.v - a.v) * (p - floor(p)), 6) AS v FROM x JOIN h a ON a.video_id = x.video_id AND a.i = floor(p + 1e-9) JOIN h b ON b.video_id = x.video_id AND b.i = least(floor(p + 1e-9) + 1, x.n - 1)""")
def resample_length(spark, sf):
    by = Window.partitionBy("video_id")
    h = heat(spark, sf).select("video_id", ((F.row_number().over(by.orderBy("start_time")) - 1) / (F.count("*").over(by) - 1)).alias("t"), F.col("value").alias("v"))
    x = frames(spark, sf).select("video_id", "idx", (F.col("idx") / F.max("idx").over(video())).alias("t"))
    return J.asof_linear(x.select("video_id", "t"), h, "constant").join(x, ["video_id", "t"]).select("video_id", "idx", r6("v").alias("v"))


def samples(spark, sf):
    return run_log(spark, sf).select(F.col("run").alias("video_id"), "step", F.col("value").cast("double").alias("value"))


def sample_windows(s, v):
    """video_id, idx, n_samples, mean: the 15 samples around each frame, missing ones as 0."""
    w = v.select("video_id", "idx", F.explode(F.sequence(F.col("idx") * 10 - 5, F.col("idx") * 10 + 9)).alias("step"))
    g = w.join(s, ["video_id", "step"], "left").groupBy("video_id", "idx")
    return g.agg(F.count("value").alias("n_samples"), r6(F.sum(F.coalesce("value", F.lit(0.0))) / 15).alias("mean"))


WINDOWS = (""", n AS (SELECT video_id, idx, CAST(unnest(range(idx * 10 - 5, idx * 10 + 10)) AS INT) AS step FROM frames)
SELECT n.video_id, n.idx, count(s.value) AS n_samples, round(coalesce(sum(CAST(s.value AS DOUBLE)), 0) / 15, 6) AS mean FROM n LEFT JOIN run_log s ON s.run = n.video_id AND s.step = n.step GROUP BY 1, 2""")


@query("aligned_sample_windows", "run_log frames", WINDOWS)
@query("aligned_sample_windows_all", "run_log frames", WINDOWS)
def aligned_sample_windows(spark, sf):
    return sample_windows(samples(spark, sf), frames(spark, sf))


@query("skip_existing_antijoin", "frames", "SELECT DISTINCT video_id FROM frames WHERE video_id % 4 <> 1")
def skip_existing_antijoin(spark, sf):
    v = frames(spark, sf).select("video_id").distinct()
    stored = table(spark, sf, "events").where("user_id % 4 = 1").select(F.col("user_id").alias("video_id")).distinct()
    return v.join(stored, "video_id", "left_anti")


@query("param_grid_cross", "frames", """, g AS (SELECT th, md FROM (SELECT unnest([0.3, 0.4, 0.5]) AS th) CROSS JOIN (SELECT unnest([0.1, 0.2]) AS md)), f AS (SELECT th, md, video_id, sum(CASE WHEN score > th AND gt > 0.5 + md THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score > th THEN 1 ELSE 0 END) AS p, sum(CASE WHEN gt > 0.5 + md THEN 1 ELSE 0 END) AS g FROM frames CROSS JOIN g GROUP BY 1, 2, 3),
m AS (SELECT th, md, avg(CASE WHEN p + g > 0 THEN 2.0 * tp / (p + g) ELSE 0 END) AS f1 FROM f GROUP BY 1, 2) SELECT CAST(th AS DOUBLE) AS th, CAST(md AS DOUBLE) AS md, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 9) DESC, th, md) = 1 AS best FROM m""")
def param_grid_cross(spark, sf):
    grid = spark.createDataFrame([(t, m) for t in (0.3, 0.4, 0.5) for m in (0.1, 0.2)], "th double, md double")  # six rows
    f = frames(spark, sf).select("video_id", "score", "gt").crossJoin(F.broadcast(grid))
    hit, true = F.col("score") > F.col("th"), F.col("gt") > 0.5 + F.col("md")
    one = f.groupBy("th", "md", "video_id").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit).alias("p"), F.count_if(true).alias("g"))
    m = one.groupBy("th", "md").agg(F.avg(F.when(F.col("p") + F.col("g") > 0, 2.0 * F.col("tp") / (F.col("p") + F.col("g"))).otherwise(0.0)).alias("f1"))
    best = m.agg(F.min(F.struct((-F.round("f1", 9)).alias("o"), "th", "md")).alias("b"))
    return m.crossJoin(F.broadcast(best)).select("th", "md", r6("f1").alias("f1"), ((F.col("th") == F.col("b.th")) & (F.col("md") == F.col("b.md"))).alias("best"))
