"""Splits and shards over the rows of a whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.graph import cut_lineage
from tideline.operators.tables import seeded


def global_row_number(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with `out`, from 0, in order: a range sort, then the number in the partition plus the sizes of those before it."""
    d = cut_lineage(df.orderBy(*order).withColumn("p__", F.spark_partition_id()).withColumn("i__", F.monotonically_increasing_id()))
    sizes = d.groupBy("p__").count()
    before = sizes.withColumn("b__", F.coalesce(F.sum("count").over(Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")  # one row a partition
    d = d.withColumn("r__", F.row_number().over(Window.partitionBy("p__").orderBy("i__")) - 1).join(before, "p__")
    return d.withColumn(out, F.col("r__") + F.col("b__")).drop("p__", "i__", "r__", "b__")


def random_split(keys: DataFrame, key: str, val: float, test: float, seed: int) -> DataFrame:
    """key, role: seeded shuffle, at least one key in val and in test."""
    d = global_row_number(keys, [seeded(key, seed=seed), key], "rn")
    n = keys.count()
    n_val, n_test = max(1, int(n * val)), max(1, int(n * test))
    return d.select(key, F.when(F.col("rn") < n_val, "val").when(F.col("rn") < n_val + n_test, "test").otherwise("train").alias("role"))


def interleaved_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    return global_row_number(df, [key], "rn").withColumn("shard", (F.col("rn") % shards).cast("int")).drop("rn")
