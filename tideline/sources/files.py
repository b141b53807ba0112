"""Readers and writers of the formats around scored videos. Paths may be in any store that Spark reads."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAT = "array<struct<start_time:double,end_time:double,value:double>>"


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode, where none is named. A cluster's executors share no temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="files-")).rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the scratch folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def write_each(df: DataFrame, by: str, form: str, path: str, **options) -> None:
    """A folder of `path` for each value of `by`, each written by one task, as many at a time as the session shuffles to.

    Small rows with a file each are work by number and not by bytes, so adaptive execution must not put them into one task; and files move to their place as their task
    commits, not one by one in the driver at the end.
    """
    d = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(by))  # by a hash: a shuffle by the column itself would fall away where there is one
    d.write.partitionBy(by).options(**{"mapreduce.fileoutputcommitter.algorithm.version": "2"}, **options).format(form).save(path)


def mounted(spark: SparkSession, path: str) -> str | None:
    """`path` in the file system that driver and executors have mounted; None if it is in another store, which only Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_files(df: DataFrame, path: str) -> None:
    """A file for each row of `file` (its name) and `body` (its line), in a new folder `path`.

    Spark's writer starts four processes (chmod) for a file of a mounted folder, so tasks write there themselves, each to a folder of its own. A row's task goes by a
    hash, so a task that runs again writes the same bytes to the same place, and doesn't empty the file first. In other stores each file is a folder by Spark's writer.
    """
    folder = mounted(df.sparkSession, path)
    if folder is None:
        return write_each(df, "file", "text", path)
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        for b in batches:
            os.makedirs(here, exist_ok=True)
            for name, body in zip(b.column("file").to_pylist(), b.column("body").to_pylist()):
                with open(f"{here}/{name}", "wb", opener=lambda f, flags: os.open(f, flags & ~os.O_TRUNC, 0o666)) as f:
                    f.write(f"{body}\n".encode())
            yield pa.RecordBatch.from_pydict({"files": [b.num_rows]})

    d = df.select("file", "body").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("file"))
    d.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def _hidden(name: bytes) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(b".") or (name.startswith(b"_") and b"=" not in name) or name.endswith(b"._COPYING_")


def _opened(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of files as they are, and in place of a folder's row its files and folders, or all files below it if `deep`."""
    kinds = pa.schema([("path", pa.binary()), ("length", pa.int64()), ("folder", pa.bool_())])

    def inside(root: bytes) -> Iterator[tuple[bytes, int, bool]]:
        left = [root]
        while left:
            with os.scandir(left.pop()) as found:
                for e in found:
                    if _hidden(e.name):
                        continue
                    if e.is_dir():
                        if deep:
                            left.append(e.path)
                        else:
                            yield e.path, 0, True
                        continue
                    try:
                        length = e.stat().st_size
                    except FileNotFoundError:  # a link to nothing, or gone by now
                        continue
                    if length:
                        yield e.path, length, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for r in zip(*[b.column(c).to_pylist() for c in kinds.names]) for x in (inside(r[0]) if r[2] else (r,)))
        for some in batched(rows, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds.types)], schema=kinds)

    return run


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files below `path` that Spark's readers see (not hidden, not empty). Contents aren't read.

    Tasks list a mounted folder, one or more of its folders each, so no list of all files is in the driver. In other stores Spark's reader lists, which holds one there.
    """
    folder = mounted(spark, path)
    if folder is None or not os.path.isdir(folder):  # the reader takes a pattern or one file too
        with few_listers(spark):
            return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    schema = "path binary, length long, folder boolean"
    root = spark.range(0, 1, 1, 1).select(F.lit(folder).cast("binary").alias("path"), F.lit(0).cast("long").alias("length"), F.lit(True).alias("folder"))
    top = root.mapInArrow(_opened(False), schema)
    every = top.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_opened(True), schema)
    return every.select(F.concat(F.lit("file:"), F.col("path").cast("string")).alias("path"), "length")


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks a core with many folders each, and not by a task a folder."""
    key, old = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.conf.set(key, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """split, role, video_id of JSON lines {split, train_keys, test_keys}; a split may have several lines."""
    d = spark.read.schema("split int, train_keys array<string>, test_keys array<string>").json(path)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_keys").alias("keys")) for r in ("train", "test")])
    return d.select("split", F.explode(roles).alias("r")).select("split", F.col("r.role").alias("role"), F.explode("r.keys").alias("video_id"))


def read_split_text(spark: SparkSession, path: str) -> DataFrame:
    """split, role, video_id of lines "name,role/key,role/key,...", one split a line, in the older text form."""
    d = spark.read.text(path).select(F.split("value", ",").alias("f"))
    e = d.select(F.element_at("f", 1).cast("int").alias("split"), F.explode(F.slice("f", 2, F.size("f"))).alias("x"))
    return e.select("split", F.split("x", "/")[0].alias("role"), F.split("x", "/")[1].alias("video_id"))


def read_annotations(spark: SparkSession, path: str, every: int = 15) -> DataFrame:
    """video_id, annotator, pos, value of a TSV (video, category, "s1,s2,..."): divided by the row's maximum, every 15th score."""
    d = spark.read.csv(path, sep="\t", schema="video_id string, category string, scores string")
    s = F.transform(F.split("scores", ","), lambda x: x.cast("double"))
    by = Window.partitionBy("video_id").orderBy("category", "scores")
    d = d.select("video_id", (F.row_number().over(by) - 1).alias("annotator"), s.alias("s")).withColumn("top", F.array_max("s"))
    kept = F.filter(F.transform("s", lambda x: x / F.col("top")), lambda x, i: i % every == 0)
    return d.select("video_id", "annotator", F.posexplode(kept).alias("pos", "value"))


def title_lookup(videos: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """videos with title from a TSV with header, the id itself where it has none. The join is Spark's choice: it broadcasts a list that its size allows."""
    info = spark.read.csv(path, sep="\t", header=True, schema="video_id string, title string")
    return videos.join(info, "video_id", "left").withColumn("title", F.coalesce("title", "video_id"))


def read_heat(spark: SparkSession, path: str) -> DataFrame:
    """video_id, start_time, end_time, mid, value of engagement curves."""
    d = spark.read.schema(f"video_id string, heat {HEAT}").json(path)
    return d.select("video_id", F.inline("heat")).withColumn("mid", (F.col("start_time") + F.col("end_time")) / 2)


def crawl_manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, title, duration, heatmap_points of crawl documents that have a curve, and the file that each comes from."""
    d = spark.read.schema(f"id string, title string, duration double, heat {HEAT}").json(path).withColumn("source_file", F.input_file_name())
    return d.where(F.size("heat") > 0).select(F.col("id").alias("video_id"), F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.size("heat").alias("heatmap_points"), "source_file")


def frame_table(spark: SparkSession, path: str, arrays: list[str]) -> DataFrame:
    """video_id, idx and the named arrays' elements of a Parquet table of aligned arrays; the others aren't read."""
    d = spark.read.parquet(path).select("video_id", F.posexplode(F.arrays_zip(*arrays)).alias("idx", "z"))
    return d.select("video_id", "idx", *[F.col(f"z.{a}").alias(a) for a in arrays])


def annotators_or_single(df: DataFrame, many: str = "user_summary", single: str = "gtsummary") -> Column:
    """The annotators' arrays, or the single summary as the only one; either column may be absent."""
    one = F.array(single) if single in df.columns else None
    if many not in df.columns:
        return one
    return F.coalesce(many, one) if one is not None else F.col(many)


def merge_score_caches(spark: SparkSession, paths: list[str], videos: DataFrame, default: float = 0.5) -> DataFrame:
    """videos (video_id, idx) with score from Parquet caches: a later folder overrides an earlier one, and what none has gets `default`."""
    parts = [spark.read.parquet(p).select("video_id", "idx", "score", F.lit(k).alias("file")) for k, p in enumerate(paths)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    best = d.groupBy("video_id", "idx").agg(F.max_by("score", "file").alias("score"))
    return videos.join(best, ["video_id", "idx"], "left").withColumn("score", F.coalesce("score", F.lit(default)))


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("dataset", "model").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pairs_or_reload(spark: SparkSession, path: str, make) -> DataFrame:
    """Pair rows from CSV by split, made and written first if they aren't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").partitionBy("split").csv(path, header=True)
    return spark.read.csv(path, header=True, schema="human_gap double, model_gap double, correct_ranking boolean, split int")


def concat_complete(spark: SparkSession, paths: list[str], schema: str, key: str, expected: int) -> DataFrame:
    """All CSV files as one table, but only if `expected` different keys are there."""
    d = spark.read.csv(paths, header=True, schema=schema)
    if d.select(key).distinct().count() != expected:
        raise ValueError(f"{key}: not all {expected} parts are there")
    return d


def read_scalars(spark: SparkSession, path: str) -> DataFrame:
    """run, step, value of logs (Step, Value), the run from the folder name run_<label>."""
    with few_listers(spark):
        d = spark.read.option("recursiveFileLookup", True).csv(path, header=True, schema="Step int, Value double")
    return d.select(F.regexp_extract(F.input_file_name(), r"run_([^/]+)/", 1).alias("run"), F.col("Step").alias("step"), F.col("Value").alias("value"))


def nested_results(clips: DataFrame) -> DataFrame:
    """video_id, json: one document a video with its clips in order, scores rounded."""
    c = F.struct(F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.round("frame_score", 4).alias("frame_score"))
    g = clips.groupBy("video_id").agg(F.sort_array(F.collect_list(c)).alias("proposals"))
    return g.select("video_id", F.to_json(F.struct("video_id", "proposals")).alias("json"))


def media_inventory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("webm", "mp4")) -> DataFrame:
    """stem, ext, path, length: one file a stem by priority of extension. A file is one of that name, or Spark's file in a folder of that name. File contents aren't read."""
    last, above = F.substring_index("path", "/", -1), F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    d = list_files(spark, path).withColumn("name", F.when(last.rlike(r"^part-\d+-[-0-9a-f]{36}"), above).otherwise(last))  # cut first: a pattern over a whole path tries each of its places
    d = d.select("path", "length", *[F.regexp_extract("name", r"^([^/]+)\.([a-z0-9]+)$", k).alias(c) for k, c in ((1, "stem"), (2, "ext"))]).where(F.col("ext").isin(*extensions))
    order = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("stem").orderBy(order, "path"))).where("r = 1").drop("r")
