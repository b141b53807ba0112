"""Sources and sinks: each query writes tables derived from the given ones in a format, and reads them back."""

from pyspark.sql import functions as F

from tideline.functions.scalars import mmss, r6
from tideline.operators import timeline as T
from tideline.plans.registry import query
from tideline.plans.timeline import GROWN
from tideline.sources import files as IO
from tideline.sources.views import annotations, frames, heat, pair_results, run_log, segments, table


#: Ids of videos that share a line of a split file.
SHARD = 10_000


def videos(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("video_id")).distinct()


@query("split_manifest", "frames", ", v AS (SELECT DISTINCT video_id FROM frames), s AS (SELECT CAST(unnest(range(0, 5)) AS INT) AS split) SELECT split, CASE WHEN video_id % 5 = split THEN 'test' ELSE 'train' END AS role, CAST(video_id AS VARCHAR) AS video_id FROM v CROSS JOIN s")
def split_manifest(spark, sf):
    path = IO.shared_folder(spark)
    v = videos(spark, sf).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(4))))
    test = F.col("video_id").cast("long") % 5 == F.col("split")
    keys = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("video_id"))))
    # a line is a split's keys of one shard, so no row grows with the table
    shards = v.withColumn("shard", F.floor(F.col("video_id").cast("long") / SHARD))
    one = shards.groupBy("split", "shard").agg(keys(~test).alias("train_keys"), keys(test).alias("test_keys"))
    one.select(F.to_json(F.struct("split", "train_keys", "test_keys"))).write.text(f"{path}/json")
    x = F.concat(F.when(test, "test").otherwise("train"), F.lit("/"), F.col("video_id"))
    shards.groupBy("split", "shard").agg(F.array_join(F.sort_array(F.collect_list(x)), ",").alias("l")).select(F.concat_ws(",", F.col("split").cast("string"), "l")).write.text(f"{path}/text")
    return IO.read_splits(spark, f"{path}/json").intersect(IO.read_split_text(spark, f"{path}/text"))


@query("annotation_tsv", "annotations", ", a AS (SELECT video_id, annotator, idx, value / max(value) OVER (PARTITION BY video_id, annotator) AS v FROM annotations) SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(annotator AS INT) AS annotator, CAST(idx / 15 AS INT) AS pos, round(v, 6) AS value FROM a WHERE idx % 15 = 0")
def annotation_tsv(spark, sf):
    path = IO.shared_folder(spark)
    s = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"].cast("string")), ",")
    annotations(spark, sf).groupBy(F.col("video_id").cast("string").alias("video_id"), F.concat(F.lit("A"), F.col("annotator")).alias("category")).agg(s.alias("scores")).write.csv(path, sep="\t")
    return IO.read_annotations(spark, path).select("video_id", "annotator", "pos", r6("value").alias("value"))


@query("info_tsv_lookup", "frames", "SELECT DISTINCT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN video_id % 3 <> 0 THEN 'Title ' || video_id ELSE CAST(video_id AS VARCHAR) END AS title FROM frames")
def info_tsv_lookup(spark, sf):
    path, v = IO.shared_folder(spark), videos(spark, sf)
    v.where("cast(video_id as long) % 3 <> 0").select("video_id", F.concat(F.lit("Title "), "video_id").alias("title")).write.csv(path, sep="\t", header=True)
    return IO.title_lookup(v, spark, path).select("video_id", "title")


def write_heat(spark, sf, path):
    h = heat(spark, sf).select(F.col("video_id").cast("string").alias("id"), "start_time", "end_time", "value")
    g = h.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_time", "end_time", "value"))).alias("heat"))
    g.select(F.col("id").alias("video_id"), "heat").write.json(f"{path}/heat")
    title, kept = F.when(F.col("id") % 4 != 0, F.concat(F.lit("t"), "id")), F.when(F.col("id") % 5 != 0, F.col("heat")).otherwise(F.slice("heat", 1, 0))
    g.select("id", title.alias("title"), F.array_max(F.transform("heat", lambda x: x["end_time"])).alias("duration"), kept.alias("heat")).write.json(f"{path}/crawl")


@query("heatmap_json", "heat", "SELECT CAST(video_id AS VARCHAR) AS video_id, start_time, end_time, (start_time + end_time) / 2 AS mid, round(value, 6) AS value FROM heat")
def heatmap_json(spark, sf):
    path = IO.shared_folder(spark)
    write_heat(spark, sf, path)
    return IO.read_heat(spark, f"{path}/heat").select("video_id", "start_time", "end_time", "mid", r6("value").alias("value"))


@query("crawl_info_manifest", "heat", "SELECT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN video_id % 4 <> 0 THEN 't' || video_id ELSE 'Unknown' END AS title, max(end_time) AS duration, CAST(count(*) AS INT) AS heatmap_points FROM heat WHERE video_id % 5 <> 0 GROUP BY video_id")
def crawl_info_manifest(spark, sf):
    path = IO.shared_folder(spark)
    write_heat(spark, sf, path)
    return IO.crawl_manifest(spark, f"{path}/crawl").where("source_file <> ''").drop("source_file")


def write_arrays(spark, sf, path):
    g = frames(spark, sf).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("idx", "gt", "score", "k"))).alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c])
    g.select("video_id", part("idx").alias("picks"), part("gt").alias("gtscore"), part("score").alias("score"), part("k").alias("k")).write.parquet(path)


@query("frame_table_scan", "frames", "SELECT video_id, idx, idx AS picks, round(gt, 6) AS gtscore FROM frames")
def frame_table_scan(spark, sf):
    path = IO.shared_folder(spark)
    write_arrays(spark, sf, path)
    return IO.frame_table(spark, path, ["picks", "gtscore"]).select("video_id", "idx", "picks", r6("gtscore").alias("gtscore"))


@query("optional_column_fallback", "frames", "SELECT video_id, CAST(CASE WHEN video_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_annotators, CAST(count(*) AS INT) AS n_frames FROM frames GROUP BY video_id")
def optional_column_fallback(spark, sf):
    g = frames(spark, sf).groupBy("video_id").agg(F.collect_list((F.col("gt") > 0.5).cast("int")).alias("gtsummary"))
    d = g.withColumn("user_summary", F.when(F.col("video_id") % 2 == 0, F.array("gtsummary", "gtsummary")))
    u = IO.annotators_or_single(d)
    return d.select("video_id", F.size(u).alias("n_annotators"), F.size(u[0]).alias("n_frames"))


@query("score_cache_union", "frames", "SELECT video_id, idx, round(CASE WHEN video_id % 3 = 0 THEN gt WHEN video_id % 2 = 0 THEN score ELSE 0.5 END, 6) AS score FROM frames")
def score_cache_union(spark, sf):
    path, f = IO.shared_folder(spark), frames(spark, sf)
    f.where("video_id % 2 = 0").select("video_id", "idx", "score").write.parquet(f"{path}/a")
    f.where("video_id % 3 = 0").select("video_id", "idx", F.col("gt").alias("score")).write.parquet(f"{path}/b")
    return IO.merge_score_caches(spark, [f"{path}/a", f"{path}/b"], f.select("video_id", "idx")).select("video_id", "idx", r6("score").alias("score"))


@query("feature_cache_sink", "frames", "SELECT 'd' || (video_id % 2) AS dataset, 'm1' AS model, video_id, count(*) AS n, round(avg(score), 6) AS mean FROM frames GROUP BY 1, 2, 3")
def feature_cache_sink(spark, sf):
    path = IO.shared_folder(spark)
    IO.write_features(frames(spark, sf).select(F.concat(F.lit("d"), F.col("video_id") % 2).alias("dataset"), F.lit("m1").alias("model"), "video_id", "idx", "score", "gt"), path)
    return spark.read.parquet(path).groupBy("dataset", "model", "video_id").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean"))


PAIRS = "SELECT CAST(video_id % 5 AS INT) AS split, count(*) AS n, round(avg(CASE WHEN base_gap > 0 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(human_gap), 6) AS gap FROM pair_results GROUP BY 1"


def pair_rows(spark, sf):
    return pair_results(spark, sf).select("human_gap", F.col("base_gap").alias("model_gap"), (F.col("base_gap") > 0).alias("correct_ranking"), (F.col("video_id") % 5).cast("int").alias("split"))


def summed(d):
    return d.groupBy("split").agg(F.count("*").alias("n"), r6(F.avg(F.col("correct_ranking").cast("double"))).alias("accuracy"), r6(F.avg("human_gap")).alias("gap"))


@query("pair_csv_sink_and_reload", "pair_results", PAIRS)
def pair_csv_sink_and_reload(spark, sf):
    path = IO.shared_folder(spark)
    IO.pairs_or_reload(spark, path, lambda: pair_rows(spark, sf))
    return summed(IO.pairs_or_reload(spark, path, lambda: pair_rows(spark, sf).limit(0)))


@query("multi_csv_concat", "pair_results", PAIRS)
def multi_csv_concat(spark, sf):
    path = IO.shared_folder(spark)
    pair_rows(spark, sf).withColumn("part", F.col("split")).write.partitionBy("part").csv(path, header=True)
    return summed(IO.concat_complete(spark, [f"{path}/part={k}" for k in range(5)], "human_gap double, model_gap double, correct_ranking boolean, split int", "split", 5))


def logs_reloaded(spark, log):
    """Each run's log as a folder of its own, and all of them read back; a task writes the folders of many runs."""
    path = IO.shared_folder(spark)
    runs = log.select("run", F.col("step").alias("Step"), F.col("value").cast("double").alias("Value"))
    IO.write_each(runs.withColumn("x", F.concat(F.lit("run_"), F.col("run"))).drop("run"), "x", "csv", path, header=True)
    return IO.read_scalars(spark, path)


LOGS =  "SELECT CAST(run AS VARCHAR) AS run, step, CAST(value AS DOUBLE) AS value FROM run_log"


@query("scalar_log_scan", "run_log", LOGS)
@query("scalar_log_scan_all", "run_log", LOGS)
def scalar_log_scan(spark, sf):
    return logs_reloaded(spark, run_log(spark, sf))


@query("nested_json_sink", "frames", GROWN + 'SELECT CAST(video_id AS BIGINT) AS video_id, count(*) AS n, round(min(round(start, 2)), 2) AS first_start, round(max("end"), 1) AS last_end FROM clips GROUP BY 1')
def nested_json_sink(spark, sf):
    path = IO.shared_folder(spark)
    IO.nested_results(T.peak_grow(frames(spark, sf))).select("json").write.text(path)
    d = spark.read.schema("video_id long, proposals array<struct<start:double,end:double,frame_score:double>>").json(path)
    return d.select("video_id", F.inline("proposals")).groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.min("start"), 2).alias("first_start"), F.round(F.max("end"), 1).alias("last_end"))


@query("transcript_segments_io", "segments", "SELECT CAST(video_id AS BIGINT) AS video_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM segments GROUP BY 1")
def transcript_segments_io(spark, sf):
    path, s = IO.shared_folder(spark), segments(spark, sf)
    s.select("video_id", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "text").write.json(f"{path}/json")
    line = F.concat(F.lit("["), mmss(F.col("seg_start")), F.lit("] "), F.regexp_replace("text", "\n", " "))
    IO.write_each(s.select("video_id", line.alias("line")), "video_id", "text", f"{path}/text")  # one transcript a video
    d = spark.read.schema("video_id long, start double, end double, text string").json(f"{path}/json")
    with IO.few_listers(spark):
        said = spark.read.schema("value string, video_id long").text(f"{path}/text")
    said = said.select("video_id", F.regexp_extract("value", r"^\[\d+:\d\d\] (.*)$", 1).alias("text"))
    totals = lambda x: x.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return totals(d).intersect(totals(said))  # both forms read back the same


def stored_media(spark, v):
    """stem, ext of the files found after each video's are written; a task writes those of many videos."""
    path = IO.shared_folder(spark)
    kinds = F.when(F.col("video_id").cast("long") % 2 == 0, F.array(F.lit("mp4"), F.lit("webm"), F.lit("txt"))).otherwise(F.array(F.lit("mp4"), F.lit("txt")))
    files = v.select(F.concat(F.lit("v"), "video_id").alias("stem"), F.explode(kinds).alias("e"), F.lit("x").alias("body"))
    IO.write_files(files.select(F.concat_ws(".", "stem", "e").alias("file"), "body"), path)
    return IO.media_inventory(spark, path).select(F.regexp_replace("stem", "^file=", "").alias("stem"), "ext")


MEDIA = "SELECT DISTINCT 'v' || video_id AS stem, CASE WHEN video_id % 2 = 0 THEN 'webm' ELSE 'mp4' END AS ext FROM frames"


@query("media_inventory", "frames", MEDIA)
@query("media_inventory_all", "frames", MEDIA)
def media_inventory(spark, sf):
    return stored_media(spark, videos(spark, sf))
