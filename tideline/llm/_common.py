"""Small helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none is named (tests, a laptop)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of an Arrow batch that goes to a Python worker, at most (beyond one row).
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, so that a worker's memory doesn't follow the length of texts; a smaller bound of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(name)) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *keys: str) -> DataFrame:
    """The key columns and the text, a null text as an empty one."""
    return df.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long): rows (node, component), component = smallest node reachable.

    Alternates large-star and small-star steps, each of which is a grouped minimum and a join, until the edges are all
    (node, smallest node). No neighbour list is ever gathered; a hub's rows are split by adaptive execution's skew join.
    The round limit is a guard against a bug and raises an error; it does not cut the work short.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(low).distinct()
        now = cut(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = seen
    raise RuntimeError("connected components did not settle")


def by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            now = tuple(k[:, at].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last = now
    if held:
        yield pa.Table.from_batches(held)
