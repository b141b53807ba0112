"""Aggregation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.scalars import r6, sigmoid
from tideline.operators import metrics as M
from tideline.operators.joins import cosine
from tideline.operators.pairs import preference_losses
from tideline.operators.tables import quantiles, seeded, top_k
from tideline.plans.joins import COS, IV, both_runs
from tideline.plans.registry import query
from tideline.sources.views import video, annotations, frame_features, frames, pair_results, run_log, scored_labels, shots, table

CORR = ", c AS (SELECT video_id, video_id % 5 AS split, corr(score, gt) AS r, avg(score) AS m FROM frames GROUP BY 1, 2)"


def per_video(spark, sf):
    return frames(spark, sf).groupBy("video_id", (F.col("video_id") % 5).alias("split")).agg(F.corr("score", "gt").alias("r"), F.avg("score").alias("m"))


@query("split_mean_of_means", "frames", CORR + ", s AS (SELECT split, avg(r) AS r, avg(m) AS m FROM c GROUP BY 1) SELECT round(avg(r), 6) AS r, round(avg(m), 6) AS m, (SELECT round(avg(r), 6) FROM c) AS r_rows FROM s")
def split_mean_of_means(spark, sf):
    v = per_video(spark, sf)
    s = v.groupBy("split").agg(F.avg(F.nanvl("r", F.lit(None))).alias("r"), F.avg("m").alias("m"))
    return s.agg(r6(F.avg("r")).alias("r"), r6(F.avg("m")).alias("m")).crossJoin(v.agg(r6(F.avg(F.nanvl("r", F.lit(None)))).alias("r_rows")))  # single rows


@query("dataset_correlation_summary", "frames", CORR + " SELECT split, round(avg(r), 6) AS r, count(*) AS n FROM c GROUP BY ROLLUP (split)")
def dataset_correlation_summary(spark, sf):
    return per_video(spark, sf).rollup("split").agg(r6(F.avg("r")).alias("r"), F.count("*").alias("n"))


@query("model_comparison", "frames", """, c AS (SELECT video_id % 5 AS split, video_id, corr(score, gt) AS base, corr(score + gt, gt) AS tuned FROM frames GROUP BY 1, 2) SELECT split, round(avg(base), 6) AS base, round(avg(tuned), 6) AS tuned FROM c GROUP BY ROLLUP (split)""")
def model_comparison(spark, sf):
    f = frames(spark, sf)
    tagged = f.select("video_id", "gt", F.lit("base").alias("model"), F.col("score").alias("s")).unionByName(f.select("video_id", "gt", F.lit("tuned").alias("model"), (F.col("score") + F.col("gt")).alias("s")))
    v = tagged.groupBy("video_id", "model").agg(F.corr("s", "gt").alias("r")).withColumn("split", F.col("video_id") % 5)
    one = v.groupBy("split").pivot("model", ["base", "tuned"]).agg(F.avg("r"))
    both = one.unionByName(v.groupBy(F.lit(None).cast("long").alias("split")).pivot("model", ["base", "tuned"]).agg(F.avg("r")))
    return both.select(F.col("split").cast("bigint").alias("split"), r6("base").alias("base"), r6("tuned").alias("tuned"))


F1 = """, m AS (SELECT video_id, idx, CASE WHEN score > 0.3 THEN 1 ELSE 0 END AS s FROM frames), g AS (SELECT video_id, annotator, CAST(sum(CASE WHEN value >= 0.8 THEN s ELSE 0 END) AS DOUBLE) AS tp, sum(s) AS p, sum(CASE WHEN value >= 0.8 THEN 1 ELSE 0 END) AS t FROM annotations JOIN m USING (video_id, idx) GROUP BY 1, 2),
f AS (SELECT video_id, annotator, CASE WHEN tp > 0 THEN 2 * tp / (p + t) ELSE 0 END AS f1 FROM g)
"""


@query("summary_f1", "annotations", F1 + "SELECT video_id, round(max(f1), 6) AS f1_max, round(avg(f1), 6) AS f1_mean FROM f GROUP BY video_id")
def summary_f1(spark, sf):
    m = frames(spark, sf).select("video_id", "idx", (F.col("score") > 0.3).cast("int").alias("s"))
    a = annotations(spark, sf).select("video_id", "annotator", "idx", (F.col("value") >= 0.8).cast("int").alias("u"))
    return M.summary_f1(m, a).groupBy("video_id").agg(r6(F.max("f1")).alias("f1_max"), r6(F.avg("f1")).alias("f1_mean"))


@query("pearson", "frames", "SELECT video_id, round(corr(score, gt), 6) AS r FROM frames GROUP BY video_id HAVING stddev_pop(score) > 1e-6 AND stddev_pop(gt) > 1e-6")
def pearson(spark, sf):
    g = frames(spark, sf).groupBy("video_id").agg(F.corr("score", "gt").alias("r"), F.stddev_pop("score").alias("a"), F.stddev_pop("gt").alias("b"))
    return g.where("a > 1e-6 and b > 1e-6").select("video_id", r6("r").alias("r"))


RANKS = ", r AS (SELECT video_id, rank() OVER (PARTITION BY video_id ORDER BY score) + (count(*) OVER (PARTITION BY video_id, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY video_id ORDER BY gt) + (count(*) OVER (PARTITION BY video_id, gt) - 1) / 2.0 AS b FROM frames), rho AS (SELECT video_id, corr(a, b) AS rho FROM r GROUP BY 1)\n"


@query("spearman", "frames", RANKS + "SELECT video_id, round(rho, 6) AS rho FROM rho")
def spearman(spark, sf):
    return M.spearman(frames(spark, sf), ["video_id"], "score", "gt").select("video_id", r6("rho").alias("rho"))


@query("kendall_tau_b", "frames", "SELECT a.video_id, round(sum(sign(a.score - b.score) * sign(a.gt - b.gt)) / sqrt(CAST(sum(abs(sign(a.score - b.score))) AS DOUBLE) * sum(abs(sign(a.gt - b.gt)))), 6) AS tau FROM frames a JOIN frames b ON a.video_id = b.video_id AND a.idx < b.idx GROUP BY 1")
def kendall_tau_b(spark, sf):
    return M.kendall_tau_b(frames(spark, sf), ["video_id"], "score", "gt").select("video_id", r6("tau").alias("tau"))


@query("annotator_mean_curve", "annotations", ", m AS (SELECT video_id, idx, avg(value) AS m FROM annotations GROUP BY 1, 2), p AS (SELECT video_id, annotator, corr(annotations.value, score) AS r FROM annotations JOIN frames USING (video_id, idx) GROUP BY 1, 2), v AS (SELECT video_id, avg(r) AS r FROM p GROUP BY 1) SELECT video_id, idx, round(m, 6) AS mean, round(r, 6) AS r FROM m JOIN v USING (video_id)")
def annotator_mean_curve(spark, sf):
    a = annotations(spark, sf)
    m = a.groupBy("video_id", "idx").agg(r6(F.avg("value")).alias("mean"))
    p = a.join(frames(spark, sf).select("video_id", "idx", "score"), ["video_id", "idx"]).groupBy("video_id", "annotator").agg(F.corr("value", "score").alias("r"))
    return m.join(p.groupBy("video_id").agg(r6(F.avg("r")).alias("r")), "video_id")


@query("soft_ece", "frames", ", b AS (SELECT video_id, least(greatest(ceil(score * 10 - 1), 0), 9) AS bin, count(*) AS n, avg(score) AS c, avg(gt) AS a FROM frames GROUP BY 1, 2) SELECT video_id, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def soft_ece(spark, sf):
    b = M.bins(frames(spark, sf), ["video_id"], M.ceil_bin(F.col("score"), 10), "score", F.col("gt"))
    return M.ece(b, ["video_id"]).select("video_id", r6("ece").alias("ece"))


@query("soft_ece_floor", "frames", ", x AS (SELECT video_id, score, CASE WHEN (round_even(score, 0) = 1) = (gt >= 0.5) THEN gt ELSE 1 - gt END AS acc FROM frames), b AS (SELECT video_id, least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS c, avg(acc) AS a FROM x GROUP BY 1, 2) SELECT video_id, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def soft_ece_floor(spark, sf):
    right = (F.rint("score") == 1) == (F.col("gt") >= 0.5)
    b = M.bins(frames(spark, sf), ["video_id"], M.floor_bin(F.col("score"), 10), "score", F.when(right, F.col("gt")).otherwise(1 - F.col("gt")))
    return M.ece(b, ["video_id"]).select("video_id", r6("ece").alias("ece"))


@query("ece_half_open", "frames", ", n AS (SELECT video_id, count(*) AS n_all FROM frames GROUP BY 1), b AS (SELECT video_id, floor(score * 10) AS bin, count(*) AS n, avg(score) AS c, avg(gt) AS a FROM frames WHERE floor(score * 10) < 10 GROUP BY 1, 2) SELECT video_id, round(sum(n * abs(a - c)) / max(n_all), 6) AS ece FROM b JOIN n USING (video_id) GROUP BY 1")
def ece_half_open(spark, sf):
    f = frames(spark, sf).withColumn("n_all", F.count("*").over(video()))
    b = f.where(F.floor(F.col("score") * 10) < 10).groupBy("video_id", F.floor(F.col("score") * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg("gt").alias("acc"), F.max("n_all").alias("n_all"))
    return M.ece(b, ["video_id"], F.max("n_all")).select("video_id", r6("ece").alias("ece"))


REL = ", d AS (SELECT CAST(unnest(range(0, 10)) AS INT) AS bin), b AS (SELECT CAST(least(floor(conf * 10), 9) AS INT) AS bin, count(*) AS n, avg(conf) AS c, avg(gt) AS a FROM scored_labels GROUP BY 1)\n"


@query("reliability_table", "scored_labels", REL + "SELECT d.bin, coalesce(n, 0) AS n, round(c, 6) AS conf, round(a, 6) AS acc, round(a - c, 6) AS gap FROM d LEFT JOIN b USING (bin)")
def reliability_table(spark, sf):
    b = M.bins(scored_labels(spark, sf), [], M.floor_bin(F.col("conf"), 10), "conf", F.col("gt"))
    d = spark.range(10).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left")
    return d.select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r6("conf").alias("conf"), r6("acc").alias("acc"), r6(F.col("acc") - F.col("conf")).alias("gap"))


@query("conditional_reliability", "frames", ", d AS (SELECT h, CAST(bin AS INT) AS bin FROM (SELECT unnest([true, false]) AS h) CROSS JOIN (SELECT unnest(range(0, 10)) AS bin)), b AS (SELECT gt >= 0.5 AS h, CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, avg(score) AS c, avg(gt) AS a FROM frames GROUP BY 1, 2) SELECT h, d.bin, coalesce(n, 0) AS n, round(c, 6) AS conf, round(a, 6) AS acc, round(sum(n * abs(a - c)) OVER (PARTITION BY h) / sum(n) OVER (PARTITION BY h), 6) AS ece FROM d LEFT JOIN b USING (h, bin)")
def conditional_reliability(spark, sf):
    b = M.bins(frames(spark, sf).withColumn("h", F.col("gt") >= 0.5), ["h"], M.floor_bin(F.col("score"), 10), "score", F.col("gt"))
    d = spark.range(20).select((F.col("id") < 10).alias("h"), (F.col("id") % 10).cast("int").alias("bin"))
    j = d.join(b, ["h", "bin"], "left").join(M.ece(b, ["h"]), "h", "left")
    return j.select("h", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r6("conf").alias("conf"), r6("acc").alias("acc"), r6("ece").alias("ece"))


@query("bin_strength", "frames", ", b AS (SELECT gt >= 0.5 AS h, CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, sum(score) AS s FROM frames GROUP BY 1, 2) SELECT h, bin, round(n / sum(n) OVER (PARTITION BY h), 6) AS share, round(sum(s) OVER (PARTITION BY h) / sum(n) OVER (PARTITION BY h), 6) AS class_mean FROM b")
def bin_strength(spark, sf):
    f = frames(spark, sf).groupBy((F.col("gt") >= 0.5).alias("h"), M.floor_bin(F.col("score"), 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    by = Window.partitionBy("h")  # at most 20 rows
    return f.select("h", "bin", r6(F.col("n") / F.sum("n").over(by)).alias("share"), r6(F.sum("s").over(by) / F.sum("n").over(by)).alias("class_mean"))


@query("binned_error_band", "frames", ", d AS (SELECT CAST(unnest(range(0, 19)) AS INT) AS bin), b AS (SELECT CAST(least(floor(score * 19), 18) AS INT) AS bin, avg(abs(score - gt)) AS m, stddev_samp(abs(score - gt)) AS s FROM frames GROUP BY 1) SELECT d.bin, round(coalesce(m, 0), 6) AS mean, round(coalesce(s, 0), 6) AS std FROM d LEFT JOIN b USING (bin)")
def binned_error_band(spark, sf):
    e = F.abs(F.col("score") - F.col("gt"))
    b = frames(spark, sf).groupBy(M.floor_bin(F.col("score"), 19).cast("int").alias("bin")).agg(F.avg(e).alias("m"), F.stddev_samp(e).alias("s"))
    d = spark.range(19).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left")
    return d.select("bin", r6(F.coalesce("m", F.lit(0.0))).alias("mean"), r6(F.coalesce("s", F.lit(0.0))).alias("std"))


@query("histogram_density", "frames", ", e AS (SELECT min(score - gt) AS lo, max(score - gt) AS hi, count(*) AS a FROM frames), b AS (SELECT CAST(least(floor((score - gt - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM frames CROSS JOIN e GROUP BY 1) SELECT bin, n, round(n / (a * ((hi - lo) / 20)), 6) AS density FROM b CROSS JOIN e")
def histogram_density(spark, sf):
    return M.histogram(frames(spark, sf).select((F.col("score") - F.col("gt")).alias("e")), "e", 20).select("bin", "n", r6("density").alias("density"))


@query("descriptive_stats", "frames", "SELECT round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS lo, round(max(score), 6) AS hi, round(avg(abs(score - gt)), 6) AS mae, round(avg(score - gt), 6) AS bias, CASE WHEN avg(score - gt) > 0 THEN 'over' ELSE 'under' END AS direction, round(stddev_samp(score - gt), 6) AS bias_std, round(avg((score - gt) * (score - gt)), 6) AS mse, round(corr(score, gt), 6) AS r FROM frames")
def descriptive_stats(spark, sf):
    s, b = F.col("score"), F.col("score") - F.col("gt")
    return frames(spark, sf).agg(
        r6(F.avg(s)).alias("mean"), r6(F.stddev_samp(s)).alias("std"), r6(F.min(s)).alias("lo"), r6(F.max(s)).alias("hi"), r6(F.avg(F.abs(b))).alias("mae"), r6(F.avg(b)).alias("bias"),
        F.when(F.avg(b) > 0, "over").otherwise("under").alias("direction"), r6(F.stddev_samp(b)).alias("bias_std"), r6(F.avg(b * b)).alias("mse"), r6(F.corr("score", "gt")).alias("r"),
    )


@query("quadrant_stats", "frames", ", q AS (SELECT CASE WHEN score > 0.5 AND gt > 0.5 THEN 'hit' WHEN score > 0.5 THEN 'false' WHEN gt > 0.5 THEN 'miss' ELSE 'rest' END AS kind, value FROM frames) SELECT kind, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(max(value), 6) AS hi FROM q GROUP BY 1")
def quadrant_stats(spark, sf):
    kind = F.when((F.col("score") > 0.5) & (F.col("gt") > 0.5), "hit").when(F.col("score") > 0.5, "false").when(F.col("gt") > 0.5, "miss").otherwise("rest")
    v = F.col("value").cast("string").try_cast("double")
    f = frames(spark, sf).select(kind.alias("kind"), v.alias("v")).dropna()
    return f.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.median("v")).alias("median"), r6(F.stddev_samp("v")).alias("std"), r6(F.max("v")).alias("hi"))


@query("macro_class_means", "frames", ", v AS (SELECT video_id, avg(CASE WHEN gt > 0.5 THEN score END) AS a, avg(CASE WHEN gt <= 0.5 THEN score END) AS b FROM frames GROUP BY 1) SELECT round(avg(a), 6) AS inside, round(stddev_pop(a), 6) AS inside_std, round(avg(b), 6) AS outside, round(stddev_pop(b), 6) AS outside_std FROM v")
def macro_class_means(spark, sf):
    v = frames(spark, sf).groupBy("video_id").agg(F.avg(F.when(F.col("gt") > 0.5, F.col("score"))).alias("a"), F.avg(F.when(F.col("gt") <= 0.5, F.col("score"))).alias("b"))
    return v.agg(r6(F.avg("a")).alias("inside"), r6(F.stddev_pop("a")).alias("inside_std"), r6(F.avg("b")).alias("outside"), r6(F.stddev_pop("b")).alias("outside_std"))


@query("pair_accuracy_by_quantile", "pair_results", """, q AS (SELECT quantile_cont(human_gap, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM pair_results), b AS (SELECT human_gap, base_gap, tuned_gap, CASE WHEN human_gap <= e[2] THEN 0 WHEN human_gap <= e[3] THEN 1 WHEN human_gap <= e[4] THEN 2 WHEN human_gap <= e[5] THEN 3 ELSE 4 END AS bin FROM pair_results CROSS JOIN q)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(human_gap), 6) AS gap, round(avg(CASE WHEN base_gap > 0 THEN 1.0 ELSE 0 END), 6) AS base, round(avg(CASE WHEN tuned_gap > 0 THEN 1.0 ELSE 0 END), 6) AS tuned FROM b GROUP BY 1""")
def pair_accuracy_by_quantile(spark, sf):
    p = pair_results(spark, sf)
    e = quantiles(p, "human_gap", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).select(F.array_distinct("q").alias("e"))
    b = p.crossJoin(F.broadcast(e)).withColumn("bin", F.size(F.filter(F.slice("e", 2, 4), lambda x: x < F.col("human_gap"))))  # one row of edges
    share = lambda c: r6(F.avg((F.col(c) > 0).cast("double")))
    return b.groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg("human_gap")).alias("gap"), share("base_gap").alias("base"), share("tuned_gap").alias("tuned"))


@query("selective_accuracy", "pair_results", ", c AS (SELECT unnest([1.0, 0.8, 0.6, 0.4, 0.2]) AS c), t AS (SELECT c, quantile_cont(abs(p.tuned_gap), 1 - CAST(c AS DOUBLE)) AS cut FROM (SELECT 1) x CROSS JOIN c CROSS JOIN pair_results p GROUP BY c)".replace("quantile_cont(abs(p.tuned_gap), 1 - CAST(c AS DOUBLE)) AS cut FROM (SELECT 1) x CROSS JOIN c CROSS JOIN pair_results p GROUP BY c", "list_extract((SELECT quantile_cont(abs(tuned_gap), [0.0, 0.2, 0.4, 0.6, 0.8]) FROM pair_results), CAST(round((1 - c) * 5) AS INT) + 1) AS cut FROM c") + " SELECT CAST(c AS DOUBLE) AS coverage, count(*) AS n, round(avg(CASE WHEN tuned_gap > 0 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM t JOIN pair_results ON abs(tuned_gap) >= cut - 1e-12 GROUP BY 1")
def selective_accuracy(spark, sf):
    p = pair_results(spark, sf).select("tuned_gap", F.abs("tuned_gap").alias("g"))
    levels = (1.0, 0.8, 0.6, 0.4, 0.2)
    cuts = quantiles(p, "g", [1 - c for c in levels], "cut")
    level = lambda k: F.col("g") >= F.col("cut")[k] - 1e-12
    sums = [F.struct(F.lit(c).alias("coverage"), F.count_if(level(k)).alias("n"), F.count_if(level(k) & (F.col("tuned_gap") > 0)).alias("right")) for k, c in enumerate(levels)]
    t = p.crossJoin(F.broadcast(cuts)).agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("n > 0")  # one row of cuts
    return t.select("coverage", "n", r6(F.col("right") / F.col("n")).alias("accuracy"))


@query("pair_ranking_accuracy", "pair_results", "SELECT video_id, round(avg(CASE WHEN base_gap > 0 THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM pair_results GROUP BY 1")
def pair_ranking_accuracy(spark, sf):
    return pair_results(spark, sf).groupBy("video_id").agg(r6(F.avg((F.col("base_gap") > 0).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


@query("preference_diagnostics", "pair_results", """, z AS (SELECT video_id % 4 AS epoch, video_id, tuned_gap - base_gap AS z, human_gap, tuned_gap AS p, base_gap AS r FROM pair_results), v AS (SELECT epoch, video_id, avg(z) AS logit, avg(CASE WHEN z > 0.05 THEN 1.0 ELSE 0 END) AS acc, avg(p) AS p, avg(r) AS r, avg(z * z) AS mse FROM z GROUP BY 1, 2),
w AS (SELECT epoch, sum(CASE WHEN 1 / (1 + exp(-z)) < 0.5 THEN human_gap ELSE 0 END) / sum(human_gap) AS hard_share FROM z GROUP BY 1) SELECT epoch, round(avg(logit), 6) AS logit, round(stddev_pop(logit), 6) AS logit_std, round(avg(acc), 6) AS acc, round(avg(p - r), 6) AS drift, round(avg(mse), 6) AS mse, round(max(hard_share), 6) AS hard_share FROM v JOIN w USING (epoch) GROUP BY epoch""")
def preference_diagnostics(spark, sf):
    z = pair_results(spark, sf).select((F.col("video_id") % 4).alias("epoch"), "video_id", (F.col("tuned_gap") - F.col("base_gap")).alias("z"), "human_gap", F.col("tuned_gap").alias("p"), F.col("base_gap").alias("r"))
    v = z.groupBy("epoch", "video_id").agg(F.avg("z").alias("logit"), F.avg((F.col("z") > 0.05).cast("double")).alias("acc"), (F.avg("p") - F.avg("r")).alias("drift"), F.avg(F.col("z") * F.col("z")).alias("mse"))
    hard = F.sum(F.when(sigmoid(F.col("z")) < 0.5, F.col("human_gap")).otherwise(0.0)) / F.sum("human_gap")
    e = v.groupBy("epoch").agg(r6(F.avg("logit")).alias("logit"), r6(F.stddev_pop("logit")).alias("logit_std"), r6(F.avg("acc")).alias("acc"), r6(F.avg("drift")).alias("drift"), r6(F.avg("mse")).alias("mse"))
    return e.join(z.groupBy("epoch").agg(r6(hard).alias("hard_share")), "epoch")


@query("preference_losses", "pair_results", "SELECT video_id, round(avg(-ln(1 / (1 + exp(-tuned_gap)))), 6) AS dpo, round(avg(tuned_gap * tuned_gap), 6) AS ipo, round(avg(pow(1 - 1 / (1 + exp(-tuned_gap)), 2) * -ln(1 / (1 + exp(-tuned_gap)))), 6) AS focal, round(avg(least(greatest(exp(-tuned_gap), 0.1), 5)), 6) AS weight FROM pair_results GROUP BY 1")
def preference_losses_query(spark, sf):
    return pair_results(spark, sf).groupBy("video_id").agg(*[r6(F.avg(c)).alias(k) for k, c in preference_losses(F.col("tuned_gap")).items()])


@query("pointwise_losses", "frames", ", p AS (SELECT video_id, least(greatest(score, 1e-6), 1 - 1e-6) AS p, score, gt FROM frames WHERE k <> 0), x AS (SELECT video_id, score, gt, gt * ln(p) + (1 - gt) * ln(1 - p) AS ll FROM p) SELECT video_id, round(avg(0.25 * pow(1 - exp(ll), 2) * -ll), 6) AS focal, round(avg(CASE WHEN abs(score - gt) < 1 THEN 0.5 * (score - gt) * (score - gt) ELSE abs(score - gt) - 0.5 END), 6) AS smooth_l1, round(avg((score - gt) * (score - gt)), 6) AS mse FROM x GROUP BY 1")
def pointwise_losses(spark, sf):
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    ll = F.col("gt") * F.log(p) + (1 - F.col("gt")) * F.log(1 - p)
    d = F.abs(F.col("score") - F.col("gt"))
    focal = 0.25 * F.pow(1 - F.exp(ll), F.lit(2)) * -ll
    return frames(spark, sf).where("k <> 0").groupBy("video_id").agg(r6(F.avg(focal)).alias("focal"), r6(F.avg(F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5))).alias("smooth_l1"), r6(F.avg(d * d)).alias("mse"))


@query("quantile_pair_hinge", "frames", """, q AS (SELECT video_id, quantile_cont(gt, 0.75) AS hi, quantile_cont(gt, 0.25) AS lo FROM frames GROUP BY 1 HAVING count(*) >= 10), h AS (SELECT f.video_id, score, row_number() OVER (PARTITION BY f.video_id ORDER BY md5(concat_ws('|', f.video_id, idx, 'h', '1'))) AS rn FROM frames f JOIN q USING (video_id) WHERE gt >= hi),
l AS (SELECT f.video_id, score, row_number() OVER (PARTITION BY f.video_id ORDER BY md5(concat_ws('|', f.video_id, idx, 'l', '1'))) AS rn FROM frames f JOIN q USING (video_id) WHERE gt <= lo) SELECT video_id, round(avg(greatest(0, 0.2 - (h.score - l.score))), 6) AS loss FROM h JOIN l USING (video_id, rn) WHERE rn <= 64 GROUP BY 1""")
def quantile_pair_hinge(spark, sf):
    f = frames(spark, sf)
    q = f.groupBy("video_id").agg(F.percentile("gt", 0.75).alias("hi"), F.percentile("gt", 0.25).alias("lo"), F.count("*").alias("n")).where("n >= 10")
    j = f.join(q, "video_id")
    rn = lambda tag: F.row_number().over(Window.partitionBy("video_id").orderBy(seeded("video_id", "idx", F.lit(tag), seed=1)))
    h = j.where("gt >= hi").select("video_id", rn("h").alias("rn"), F.col("score").alias("a"))
    low = j.where("gt <= lo").select("video_id", rn("l").alias("rn"), F.col("score").alias("b"))
    return h.join(low, ["video_id", "rn"]).where("rn <= 64").groupBy("video_id").agg(r6(F.avg(F.greatest(F.lit(0.0), 0.2 - (F.col("a") - F.col("b"))))).alias("loss"))


NDCG = ", nr AS (SELECT video_id, gt, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, idx) AS r, row_number() OVER (PARTITION BY video_id ORDER BY gt DESC, idx) AS i FROM frames), nd AS (SELECT video_id, sum(CASE WHEN r <= 10 THEN gt / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN gt / log2(i + 1) ELSE 0 END) AS ndcg FROM nr GROUP BY 1)\n"


@query("ndcg_at_k", "frames", NDCG + "SELECT video_id, round(ndcg, 6) AS ndcg FROM nd")
def ndcg_at_k(spark, sf):
    return M.ndcg(frames(spark, sf), "video_id", "score", "gt", 10).select("video_id", r6("ndcg").alias("ndcg"))


EVENTS = IV + """, pr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s) AS rank FROM a), pm AS (SELECT pr.video_id, rank, b.s AS ts, (least(pr.e, b.e) - greatest(pr.s, b.s)) / (greatest(pr.e, b.e) - least(pr.s, b.s)) AS iou FROM pr JOIN b USING (video_id) WHERE least(pr.e, b.e) > greatest(pr.s, b.s)),
po AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank, -round(iou, 9), ts) AS o FROM pm WHERE iou >= 0.3), pv AS (SELECT video_id FROM a UNION SELECT video_id FROM b),
fm AS (WITH RECURSIVE m AS (SELECT video_id, CAST(0 AS BIGINT) AS o, CAST([] AS BIGINT[]) AS rs, CAST([] AS DOUBLE[]) AS ts FROM pv UNION ALL SELECT m.video_id, p.o, CASE WHEN list_contains(rs, p.rank) OR list_contains(m.ts, p.ts) THEN rs ELSE list_append(rs, p.rank) END, CASE WHEN list_contains(rs, p.rank) OR list_contains(m.ts, p.ts) THEN m.ts ELSE list_append(m.ts, p.ts) END FROM m JOIN po p ON p.video_id = m.video_id AND p.o = m.o + 1)
SELECT video_id, max(len(rs)) AS tp FROM m GROUP BY 1), ef AS (SELECT v.video_id, tp, (SELECT count(*) FROM a WHERE a.video_id = v.video_id) AS np, (SELECT count(*) FROM b WHERE b.video_id = v.video_id) AS nt FROM pv v JOIN fm USING (video_id)),
ev AS (SELECT video_id, CAST(tp AS BIGINT) AS tp, np AS n_pred, nt AS n_true, CASE WHEN tp > 0 THEN 2.0 * tp / (np + nt) ELSE 0 END AS f1 FROM ef)
"""


def matched_events(spark, sf):
    a, b = both_runs(spark, sf)
    return M.event_f1(a.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("s"))), b, 0.3)


@query("event_f1", "frames", EVENTS + "SELECT video_id, tp, n_pred, n_true, round(f1, 6) AS f1 FROM ev")
def event_f1(spark, sf):
    return matched_events(spark, sf).select("video_id", "tp", "n_pred", "n_true", r6("f1").alias("f1"))


@query("evaluation_report", "frames", EVENTS + NDCG + RANKS + ", pe AS (SELECT video_id, corr(score, gt) AS r FROM frames GROUP BY 1) SELECT round(avg(rho), 6) AS rho, round(stddev_pop(rho), 6) AS rho_std, round(avg(r), 6) AS r, round(avg(ndcg), 6) AS ndcg, round(avg(f1), 6) AS f1, round(stddev_pop(f1), 6) AS f1_std, count(*) AS n FROM pe LEFT JOIN rho USING (video_id) LEFT JOIN nd USING (video_id) LEFT JOIN ev USING (video_id)")
def evaluation_report(spark, sf):
    f = frames(spark, sf)
    j = f.groupBy("video_id").agg(F.corr("score", "gt").alias("r")).join(M.spearman(f, ["video_id"], "score", "gt"), "video_id", "left").join(M.ndcg(f, "video_id", "score", "gt", 10), "video_id", "left")
    j = j.join(matched_events(spark, sf).select("video_id", "f1"), "video_id", "left")
    return j.agg(r6(F.avg("rho")).alias("rho"), r6(F.stddev_pop("rho")).alias("rho_std"), r6(F.avg("r")).alias("r"), r6(F.avg("ndcg")).alias("ndcg"), r6(F.avg("f1")).alias("f1"), r6(F.stddev_pop("f1")).alias("f1_std"), F.count("*").alias("n"))


@query("affine_fit", "frames", ", z AS (SELECT video_id, regr_slope(gt, score) AS a, regr_intercept(gt, score) AS b, avg(gt - score) AS d, max(score) - min(score) AS rg FROM frames GROUP BY 1 HAVING count(*) >= 3) SELECT video_id, round(CASE WHEN a > 0 AND rg > 1e-6 THEN a ELSE 1 END, 6) AS a, round(CASE WHEN a > 0 AND rg > 1e-6 THEN b ELSE d END, 6) AS b FROM z")
def affine_fit(spark, sf):
    g = frames(spark, sf).groupBy("video_id").agg(F.regr_slope("gt", "score").alias("a"), F.regr_intercept("gt", "score").alias("b"), F.avg(F.col("gt") - F.col("score")).alias("d"), (F.max("score") - F.min("score")).alias("rg"), F.count("*").alias("n"))
    good = (F.col("a") > 0) & (F.col("rg") > 1e-6)
    return g.where("n >= 3").select("video_id", r6(F.when(good, F.col("a")).otherwise(1.0)).alias("a"), r6(F.when(good, F.col("b")).otherwise(F.col("d"))).alias("b"))


COHESION = ("SELECT a.video_id AS c1, b.video_id AS c2, round(avg(" + COS.format(a="a.feature", b="b.feature") + "), 6) AS mean, round(stddev_pop(" + COS.format(a="a.feature", b="b.feature") + "), 6) AS std FROM frame_features a JOIN frame_features b ON a.video_id < b.video_id OR (a.video_id = b.video_id AND a.idx < b.idx) GROUP BY 1, 2")


@query("class_cohesion", "frame_features", COHESION)
@query("class_cohesion_whole", "frame_features", COHESION)
def class_cohesion(spark, sf):
    """Every pair of rows of every class, by sums."""
    c = M.cohesion(frame_features(spark, sf), "video_id", "feature")
    return c.select("c1", "c2", r6("mean").alias("mean"), r6("std").alias("std"))


DIMS = ", e AS (SELECT video_id, idx, unnest(range(0, 64)) AS dim, CAST(unnest(feature) AS DOUBLE) AS x FROM frame_features)\n"


@query("class_centroid_delta", "frame_features", DIMS + ", c AS (SELECT video_id % 2 AS side, dim, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT a.dim, a.m - b.m AS delta FROM c a JOIN c b ON a.dim = b.dim AND a.side = 1 AND b.side = 0) SELECT CAST(dim AS INT) AS dim, round(delta, 6) AS delta, CAST(row_number() OVER (ORDER BY round(abs(delta), 9) DESC, dim) AS INT) AS rank FROM d")
def class_centroid_delta(spark, sf):
    c = frame_features(spark, sf).select((F.col("video_id") % 2).alias("side"), F.posexplode("feature").alias("dim", "x")).groupBy("dim").agg(F.avg(F.when(F.col("side") == 1, F.col("x").cast("double"))).alias("a"), F.avg(F.when(F.col("side") == 0, F.col("x").cast("double"))).alias("b"))
    d = c.select("dim", (F.col("a") - F.col("b")).alias("delta"))  # one row a dimension
    return d.select("dim", r6("delta").alias("delta"), F.row_number().over(Window.orderBy(F.round(F.abs("delta"), 9).desc(), "dim")).alias("rank"))


@query("centroid_deviation", "frame_features", DIMS + ", c AS (SELECT video_id, dim, avg(x) AS m FROM e GROUP BY 1, 2) SELECT e.video_id, idx, round(1 - sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS deviation FROM e JOIN c ON e.video_id = c.video_id AND e.dim = c.dim GROUP BY 1, 2")
def centroid_deviation(spark, sf):
    f = frame_features(spark, sf)
    return f.join(M.centroids(f, ["video_id"], "feature"), "video_id").select("video_id", "idx", r6(1 - cosine(F.col("feature"), F.col("centroid"))).alias("deviation"))


@query("background_relevance", "frame_features", DIMS + ", sc AS (SELECT video_id, idx, (idx * 37 % 101) / 100.0 AS score FROM frame_features), q AS (SELECT video_id, quantile_cont(score, 0.95) AS cut FROM sc GROUP BY 1), c AS (SELECT e.video_id, dim, avg(x) AS m FROM e JOIN sc USING (video_id, idx) JOIN q ON q.video_id = e.video_id WHERE score < cut GROUP BY 1, 2), d AS (SELECT e.video_id, idx, 1 - sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS d FROM e JOIN c ON e.video_id = c.video_id AND e.dim = c.dim GROUP BY 1, 2) SELECT video_id, idx, round(d / avg(d) OVER (PARTITION BY video_id), 6) AS relevance FROM d")
def background_relevance(spark, sf):
    f = frame_features(spark, sf).withColumn("score", (F.col("idx") * 37 % 101) / 100.0)
    q = f.groupBy("video_id").agg(F.percentile("score", 0.95).alias("cut"))
    c = M.centroids(f.join(q, "video_id").where("score < cut"), ["video_id"], "feature")
    d = f.join(c, "video_id").select("video_id", "idx", (1 - cosine(F.col("feature"), F.col("centroid"))).alias("d"))
    return d.select("video_id", "idx", r6(F.col("d") / F.avg("d").over(video())).alias("relevance"))


def axis_sql(matrix: str, out: str) -> str:
    """The first axis of a covariance matrix (one row m, a list of rows): the matrix is squared again and again, and any of its columns is the axis then. w, its variance, and the matrix without it."""
    return f""", {out}_p AS (WITH RECURSIVE q AS (SELECT 0 AS k, m FROM {matrix} UNION ALL SELECT k + 1, list_transform(n, lambda r: list_transform(n, lambda s: list_dot_product(r, s))) FROM (SELECT k, list_transform(m, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(m, lambda s, i: s[i])))) AS n FROM q WHERE k < 26)) SELECT m FROM q WHERE k = 26),
{out}_c AS (SELECT m[list_position(list_transform(m, lambda r, i: r[i]), list_max(list_transform(m, lambda r, i: r[i])))] AS c FROM {out}_p), {out}_u AS (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM {out}_c),
{out}_w AS (SELECT list_transform(u, lambda x: x * sign(u[list_position(list_transform(u, lambda y: round(abs(y), 9)), list_max(list_transform(u, lambda y: round(abs(y), 9))))])) AS w FROM {out}_u),
{out}_l AS (SELECT o.w, list_dot_product(o.w, list_transform(g.m, lambda r: list_dot_product(r, o.w))) AS l, g.m FROM {out}_w o, {matrix} g),
{out} AS (SELECT w, l, list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * w[i] * w[j])) AS m FROM {out}_l)
"""


@query(
    "pca_project", "frame_features",
    """, v AS (SELECT video_id, idx, CAST(feature AS DOUBLE[]) AS x FROM frame_features), mn AS (SELECT i, avg(x[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1), ml AS (SELECT list(m ORDER BY i) AS mean FROM mn),
cv AS (SELECT i, j, avg((x[i] - mean[i]) * (x[j] - mean[j])) AS c FROM v, ml, range(1, 65) a(i), range(1, 65) b(j) GROUP BY 1, 2), rw AS (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY 1), m0 AS (SELECT list(r ORDER BY i) AS m FROM rw)"""
    + axis_sql("m0", "a1") + axis_sql("a1", "a2")
    + """, tr AS (SELECT list_sum(list_transform(m, lambda r, i: r[i])) AS t FROM m0)
SELECT video_id, idx, round(list_dot_product(x, a1.w) - list_dot_product(mean, a1.w), 5) AS pc1, round(list_dot_product(x, a2.w) - list_dot_product(mean, a2.w), 5) AS pc2, round(a1.l / t, 6) AS explained1, round(a2.l / t, 6) AS explained2 FROM v, ml, a1, a2, tr""",
)
def pca_project(spark, sf):
    """Two principal components of the vectors, and their shares of the variance."""
    from tideline.operators.models import pca

    d = pca(frame_features(spark, sf), "feature", 2)
    return d.select("video_id", "idx", *[F.round(c, 5).alias(c) for c in ("pc1", "pc2")], *[r6(c).alias(c) for c in ("explained1", "explained2")])


@query("shot_mean_score", "shots frames", "SELECT s.video_id, shot_id, CAST(max(end_f) - min(start_f) + 1 AS INT) AS length, round(avg(score), 6) AS mean FROM shots s JOIN frames f ON f.video_id = s.video_id AND f.idx BETWEEN start_f AND end_f GROUP BY 1, 2")
def shot_mean_score(spark, sf):
    from tideline.operators.select import shot_means

    return shot_means(shots(spark, sf), frames(spark, sf)).select("video_id", "shot_id", "length", r6("mean").alias("mean"))


@query("second_max_pool", "frames", ", s AS (SELECT video_id, CAST(floor(t / 2.5) AS INT) AS second, max(value) AS v FROM frames GROUP BY 1, 2) SELECT video_id, second, round((v - min(v) OVER (PARTITION BY video_id)) / (max(v) OVER (PARTITION BY video_id) - min(v) OVER (PARTITION BY video_id) + 1e-8), 6) AS pooled FROM s")
def second_max_pool(spark, sf):
    from tideline.functions.scalars import minmax

    s = frames(spark, sf).groupBy("video_id", F.floor(F.col("t") / 2.5).cast("int").alias("second")).agg(F.max("value").alias("v"))
    return s.select("video_id", "second", r6(minmax(F.col("v"), video())).alias("pooled"))


@query("segment_argmax_hit", "frames", "SELECT video_id, CAST(floor(t / 16) AS INT) AS segment, arg_max(t, score - idx * 1e-12) AS t, round(max(score), 6) AS score FROM frames GROUP BY 1, 2 HAVING max(score) > 0.5")
def segment_argmax_hit(spark, sf):
    g = frames(spark, sf).groupBy("video_id", F.floor(F.col("t") / 16).cast("int").alias("segment")).agg(F.max_by("t", F.struct("score", -F.col("idx"))).alias("t"), F.max("score").alias("s"))
    return g.where("s > 0.5").select("video_id", "segment", "t", r6("s").alias("score"))


@query("segment_hit_gate", "frames", "SELECT video_id, CAST(floor(t / 16) AS INT) AS segment, min(CASE WHEN gt > 0.5 THEN t END) AS t, round(avg(CASE WHEN gt > 0.5 THEN score END), 6) AS conf FROM frames GROUP BY 1, 2 HAVING avg(CASE WHEN gt > 0.5 THEN score END) > 0.25")
def segment_hit_gate(spark, sf):
    from tideline.operators.select import hit_gate

    return hit_gate(frames(spark, sf).withColumn("segment", F.floor(F.col("t") / 16).cast("int")), ["video_id", "segment"], F.col("gt") > 0.5, "score", "t", 0.25).select("video_id", "segment", "t", r6("conf").alias("conf"))


@query("distinct_predictions", "frames", "SELECT video_id, count(DISTINCT round(score, 3)) AS n FROM frames GROUP BY 1")
def distinct_predictions(spark, sf):
    return frames(spark, sf).groupBy("video_id").agg(F.count_distinct(F.round("score", 3)).alias("n"))


@query("tail_mean_ratio", "run_log", ", r AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM run_log), m AS (SELECT run, avg(value) AS m FROM r WHERE rn <= 10 GROUP BY 1) SELECT a.run, round(a.m, 4) AS tail, round(a.m / b.m, 6) AS ratio FROM m a JOIN m b ON b.run = a.run + 1")
def tail_mean_ratio(spark, sf):
    m = top_k(run_log(spark, sf), ["run"], [F.desc("step")], 10).groupBy("run").agg(F.avg("value").alias("m"))
    return m.join(m.select((F.col("run") - 1).alias("run"), F.col("m").alias("m2")), "run").select("run", F.round("m", 4).alias("tail"), r6(F.col("m") / F.col("m2")).alias("ratio"))


@query("curve_range_report", "frames", "SELECT video_id, count(*) AS n, round(min(score), 6) AS lo, round(avg(score), 6) AS mean, round(max(score), 6) AS hi, CAST(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS selected FROM frames GROUP BY 1")
def curve_range_report(spark, sf):
    return frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("n"), r6(F.min("score")).alias("lo"), r6(F.avg("score")).alias("mean"), r6(F.max("score")).alias("hi"), F.count_if(F.col("score") > 0.5).alias("selected"))
