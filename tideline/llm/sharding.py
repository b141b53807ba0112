"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at `virtual` places of a ring of 2^63 positions. A document starts at the hash of its key and goes to the next place clockwise; where that shard
is full it continues clockwise to the next one that isn't. No shard takes more than (1 + slack) times the mean, so balance doesn't depend on luck, and what a
change of shards or documents moves stays near the least that has to move.

Who is placed first is part of the definition, so that the result depends on rows and not on their order:

* Long documents (more than a 2^-14 of all bytes; there are fewer than 2^14 of them, whatever the table) one by one, the longest first. One that fits
  nowhere goes to the shard with the least bytes.
* The others by ring arc, in ring order: a shard keeps its own arcs up to its bound; what is left of an arc continues clockwise, arc by arc. An arc is cut
  between two documents, so a bound is passed by less than a short document for each time that a shard fills up.

Sums by arc (`shards` * `virtual` of them) and the long documents' sizes are all that the driver sees; both have a size that doesn't grow with the table.
Documents are sorted once around the ring, by ranges, with a number of their own as last key, so a key that repeats in many rows is split over tasks.

Law `bytes`: with 16 shards and a slack of 0.001, the largest shard has 1.001 times the mean and the smallest 0.985 times at worst, give or take the
documents at the cuts (a document longer than all room left, in small tables, breaks these bounds). Equal texts are rows like others and not kept together.

A null text has no bytes (size 1), a null key is a key; repeated rows stand at one position and are told apart by a number, so which of them comes first may
differ, but not what goes where. Long texts are measured whole. An empty table gives an empty result. Extra columns are ignored by `assign`, whatever their
names, and kept by `write`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tideline.llm._bytes import mix
from tideline.llm._common import cut, small_batches, table

#: A document is long from this share of all bytes on.
LONG_SHARE = 1 / (1 << 14)
SCHEMA = "doc_id long, size long, text_crc32 long, position long, p int, shard int, local long"


class Ring:
    """Places of the virtual nodes in order, the shard of each, and for every arc all shards in the order that a walk clockwise meets them."""

    def __init__(self, shards: int, virtual: int, seed: int):
        at = np.arange(shards * virtual, dtype=np.uint64)
        # a node's places depend on its shard's number only, so they stay when shards are added
        shard, number = at // np.uint64(virtual), at % np.uint64(virtual)
        place = mix(mix(shard + mix(np.array([seed], np.uint64))) + mix(number + np.uint64(0xD1B54A32D192ED03))) >> np.uint64(1)
        order = np.lexsort((shard, place))
        self.places, self.owner, self.shards = place[order].astype(np.int64), shard[order].astype(np.int64), shards
        n = len(order)
        soon = np.full(shards, 2 * n)  # by shard, its next place at or after the arc
        for k in range(n - 1, -1, -1):
            soon[self.owner[k]] = k + n
        self.walk = np.empty((n, shards), np.int64)
        for k in range(n - 1, -1, -1):
            soon[self.owner[k]] = k
            self.walk[k] = np.argsort(soon, kind="stable")

    def arc(self, position: np.ndarray) -> np.ndarray:
        """The arc of each position: the number of the first place at or after it; the last arc ends where the ring closes."""
        return np.searchsorted(self.places, position, "left") % len(self.places)


def place_long(ring: Ring, arcs: np.ndarray, sizes: np.ndarray, load: np.ndarray, bound: float) -> np.ndarray:
    """Shards of long documents, in the order given; `load` (by shard) is updated."""
    out = np.empty(len(arcs), np.int64)
    for k, (arc, size) in enumerate(zip(arcs, sizes)):
        way = ring.walk[arc]
        fits = np.flatnonzero(load[way] + size <= bound)
        out[k] = way[fits[0]] if len(fits) else int(np.argmin(load))
        load[out[k]] += size
    return out


def place_arcs(ring: Ring, sums: np.ndarray, load: np.ndarray, bound: float) -> list[list[tuple[float, int]]]:
    """For each arc, runs (end, shard): bytes from the arc's beginning up to `end` go to `shard`. All arcs to their own shards first, then what is left, clockwise."""
    runs: list[list[tuple[float, int]]] = [[] for _ in sums]
    room = np.maximum(bound - load, 0.0)
    left = []
    for k in np.flatnonzero(sums):
        own = ring.owner[k]
        taken = min(float(sums[k]), room[own])
        if taken > 0:
            room[own] -= taken
            runs[k].append((taken, int(own)))
        if taken < sums[k]:
            left.append((k, taken))
    for k, begin in left:
        for s in ring.walk[k]:
            taken = min(float(sums[k]) - begin, room[s])
            if taken > 0:
                room[s] -= taken
                begin += taken
                runs[k].append((begin, int(s)))
            if begin >= sums[k]:
                break
        end, last = runs[k][-1] if runs[k] else (0.0, int(np.argmax(room)))
        runs[k] = [*runs[k][:-1], (float("inf"), last)]  # what rounding leaves goes with the last run
    return runs


def _measured(docs: DataFrame, ring: Ring, key: Column, *carry: Column) -> DataFrame:
    """doc_id, size, text_crc32, position, arc, tie of every row."""
    arc = F.arrow_udf(lambda position: pa.array(ring.arc(position.to_numpy()).astype(np.int32)), IntegerType())
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    position = F.shiftrightunsigned(F.xxhash64(key, F.lit(23)), 1)
    rows = docs.select(*carry, (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), position.alias("position"), F.monotonically_increasing_id().alias("tie"))
    return rows.withColumn("arc", arc("position"))


def _assigned(runs: list[list[tuple[float, int]]], starts: np.ndarray, before: dict[int, int], long: dict[tuple[int, int], int], long_size: float, shards: int):
    """Rows of one sorted partition each: their shard, and their number among the partition's rows of that shard."""
    ends = [np.array([e for e, _ in r]) for r in runs]
    owners = [np.array([s for _, s in r], np.int64) for r in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, counts = None, np.zeros(shards, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            size, arc, p, tie = (batch.column(c).to_numpy() for c in ("size", "arc", "p", "tie"))
            running = before[int(p[0])] if running is None else running
            short = size <= long_size
            begin = running + np.cumsum(np.where(short, size, 0)) - np.where(short, size, 0)
            running = int(begin[-1] + (size[-1] if short[-1] else 0))
            begin = begin - starts[arc]  # from the arc's own beginning
            shard = np.empty(len(size), np.int64)
            cuts = np.r_[0, np.flatnonzero(arc[1:] != arc[:-1]) + 1, len(arc)]
            for at, to in zip(cuts, cuts[1:]):
                k = arc[at]
                if len(ends[k]):
                    shard[at:to] = owners[k][np.minimum(np.searchsorted(ends[k], begin[at:to], "right"), len(ends[k]) - 1)]
            for k in np.flatnonzero(~short):
                shard[k] = long[int(p[k]), int(tie[k])]
            local = np.empty(len(size), np.int64)
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                local[own] = counts[s] + np.arange(len(own))
                counts[s] += len(own)
            kept = {c: batch.column(c) for c in ("doc_id", "size", "text_crc32", "position", "p")}
            yield pa.record_batch(kept | {"shard": pa.array(shard.astype(np.int32)), "local": pa.array(local)})

    return run


def assign(docs: DataFrame, shards: int = 16, slack: float = 0.001, virtual: int = 1024, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of `docs` (doc_id long, text): slots count a shard's rows from 0, around the ring."""
    spark = docs.sparkSession
    small_batches(spark)
    ring = Ring(shards, virtual, seed)
    rows = cut(_measured(docs, ring, F.col(key), F.col("doc_id")))
    ordered = cut(rows.orderBy("arc", "position", "size", "text_crc32", "tie").withColumn("p", F.spark_partition_id()))
    total = ordered.agg(F.sum("size")).first()[0] or 0
    long_size, bound = total * LONG_SHARE, (1 + slack) * total / shards

    # fewer than 1 / LONG_SHARE rows
    found = sorted(ordered.where(F.col("size") > long_size).select("size", "arc", "position", "text_crc32", "p", "tie").collect(), key=lambda r: (-r["size"], r["position"], r["text_crc32"], r["p"], r["tie"]))
    load = np.zeros(shards)
    placed = place_long(ring, np.array([r["arc"] for r in found], np.int64), np.array([r["size"] for r in found], np.float64), load, bound)
    long = {(r["p"], r["tie"]): int(s) for r, s in zip(found, placed)}

    # a row for each arc and, where a partition ends within one, one more
    sums = ordered.where(F.col("size") <= long_size).groupBy("p", "arc").agg(F.sum("size").alias("size")).collect()
    by_arc, by_part = np.zeros(len(ring.places), np.int64), {}
    for r in sums:
        by_arc[r["arc"]] += r["size"]
        by_part[r["p"]] = by_part.get(r["p"], 0) + r["size"]
    n_parts = ordered.rdd.getNumPartitions()
    before = dict(zip(range(n_parts), np.r_[0, np.cumsum([by_part.get(p, 0) for p in range(n_parts)])].tolist()))
    runs, starts = place_arcs(ring, by_arc, load, bound), np.cumsum(by_arc) - by_arc

    out = cut(ordered.mapInArrow(_assigned(runs, starts, before, long, long_size, shards), SCHEMA))
    ahead = Window.partitionBy("shard").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy("shard", "p").agg(F.count("*").alias("n")).select("shard", "p", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return out.join(counts, ["shard", "p"]).select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("local")).alias("slot"))


def moved(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: bytes of two assignments of the same documents (unique ids), those that change their shard, and those that change between shards of `a`."""
    both = a.select("doc_id", "size", F.col("shard").alias("x")).join(b.select("doc_id", F.col("shard").alias("y")), "doc_id")
    other = F.col("x") != F.col("y")
    old = F.col("y") <= F.lit(a.agg(F.max("shard")).first()[0])
    return both.agg(F.sum("size").alias("bytes"), F.sum(F.when(other, F.col("size")).otherwise(0)).alias("moved"), F.sum(F.when(other & old, F.col("size")).otherwise(0)).alias("between_old"))


def write(docs: DataFrame, assigned: DataFrame, folder: str, files_a_shard: int = 1) -> None:
    """The rows of `docs` (unique ids) as Parquet folders shard=0, shard=1, ..., each in slot order within its files; all columns of the documents are kept."""
    slots = assigned.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), "slot")
    named = docs.join(slots, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id").withColumnRenamed("_shard", "shard")
    part = F.pmod(F.col("slot"), F.lit(files_a_shard))
    named.withColumn("file", part).repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").drop("file").write.partitionBy("shard").parquet(folder)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """Law `bytes`. Null texts have size 1; null and repeated ids, equal texts and extra columns don't matter; an empty table gives no rows."""
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
