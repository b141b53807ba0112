"""Whole-table operators: normalisation, first rows of groups, ranks, seeded order, cache merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(df: DataFrame, columns: list[str], method: str = "minmax") -> DataFrame:
    """Columns scaled over the whole table: minmax, or symmetric (0.5 + 0.5 * v / max |v|). Absent columns are skipped.

    One aggregate row is broadcast back; there is no window over the whole table.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    ends = df.agg(*[F.min(c).alias(f"{c}__lo") for c in columns], *[F.max(c).alias(f"{c}__hi") for c in columns], *[F.max(F.abs(c)).alias(f"{c}__top") for c in columns])
    j = df.crossJoin(F.broadcast(ends))  # one row
    scaled = {c: (F.col(c) - F.col(f"{c}__lo")) / (F.col(f"{c}__hi") - F.col(f"{c}__lo")) if method == "minmax" else 0.5 + 0.5 * F.col(c) / F.col(f"{c}__top") for c in columns}
    return j.withColumns(scaled).select(*df.columns)


def first_per(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group. With plain columns that cover the rest, one aggregate; the order decides."""
    rest = [c for c in df.columns if c not in keys]
    if all(isinstance(o, str) for o in order) and set(order) <= set(rest):
        best = F.min(F.struct(*order, *[c for c in rest if c not in order]))
        return df.groupBy(*keys).agg(best.alias("b__")).select(*keys, *[F.col(f"b__.{c}").alias(c) for c in rest]).select(*df.columns)
    return df.withColumn("r__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r__ = 1").drop("r__")


def seeded(*parts: str | Column, seed: int = 0) -> Column:
    """A sort key that looks random and is the same under any partitioning, and in any engine with md5."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed))).cast("binary"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("r__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r__") <= k).drop("r__")


def average_rank(by: list[str], value: str) -> Column:
    """Rank from 1 with ties averaged."""
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(same) - 1) / 2


def contains_join_first(names: DataFrame, files: DataFrame, needle: Column, name: str, path: str, ordinal: str, gram: int = 4) -> DataFrame:
    """For each name the first file (by ordinal) whose path contains the needle; an empty needle is in every path, a null one in none.

    One rule at every size: what decides is contains(path, needle). A path that contains a needle contains each run of `gram` characters of it,
    so needles meet only paths that hold their rarest run; needles shorter than that meet the paths by their whole text.
    """
    n = names.select(name, needle.alias("needle__")).where("needle__ is not null").distinct()
    f = files.select(path, ordinal).where(F.col(path).isNotNull())

    def runs(text: str, size: Column | int) -> Column:
        """The distinct runs of `size` characters."""
        last = F.length(text) - size + 1
        return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(F.col(text), k, F.lit(size) if isinstance(size, int) else size)))).otherwise(F.array().cast("array<string>"))

    # runs of up to `gram` characters that paths have, each with its paths' number
    keys = f.select(path, ordinal, F.explode(F.array_union(runs(path, gram), F.flatten(F.array(*[runs(path, k) for k in range(1, gram)])))).alias("key__"))
    size = F.least(F.length("needle__"), F.lit(gram))
    asked = n.where("needle__ <> ''").select(name, "needle__", F.explode(runs("needle__", size)).alias("key__"))
    wanted = keys.join(asked.select("key__").distinct(), "key__", "left_semi")
    often = wanted.groupBy("key__").agg(F.count("*").alias("n__"))
    rarest = asked.join(often, "key__", "left").groupBy(name, "needle__").agg(F.min(F.struct(F.coalesce("n__", F.lit(0)).alias("n__"), "key__"))["key__"].alias("key__"))
    j = wanted.join(rarest, "key__").where(F.contains(F.col(path), F.col("needle__")))
    some = j.groupBy(name).agg(F.min(ordinal).alias(ordinal))
    every = n.where("needle__ = ''").select(name).distinct().crossJoin(F.broadcast(f.agg(F.min(ordinal).alias(ordinal)).where(F.col(ordinal).isNotNull())))  # one row
    return some.unionByName(every).groupBy(name).agg(F.min(ordinal).alias(ordinal))


def quantiles(df: DataFrame, value: str, shares: list[float], out: str = "q") -> DataFrame:
    """One row with `out`: the exact quantiles of `value` over the whole table, interpolated between neighbours as `percentile` does; nulls don't count.

    Distinct values are counted and range-sorted; a partition's total tells which of them hold a wanted rank, and only these are numbered. No task holds all values.
    """
    from tideline.operators.graph import cut_lineage

    d = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    d = cut_lineage(d.orderBy("v").withColumn("p", F.spark_partition_id()))
    parts = d.groupBy("p").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("before", F.sum("m").over(Window.orderBy("p")) - F.col("m"))  # one row a partition
    wanted = parts.agg(F.sum("m").alias("all")).where("all > 0").select(F.posexplode(F.transform(F.array(*map(F.lit, shares)), lambda s: s * (F.col("all") - 1))).alias("k", "at"))
    wanted = wanted.select("k", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()  # two rows a share
    here = wanted.join(F.broadcast(parts), (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m"))).select("k", "at", "rank", "p", "before")
    few = d.join(F.broadcast(here.select("p", "before").distinct()), "p")  # at most two rows a share
    few = few.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("v")) + F.col("before"))
    got = few.join(F.broadcast(here.drop("before")), "p").where((F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    got = got.groupBy("k", "at").agg((low + (high - low) * (F.col("at") - F.floor("at"))).alias("x"))
    return got.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(out))  # one row a share
