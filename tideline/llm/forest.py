"""Near-duplicate vectors by a random-projection tree forest with spill.

Vectors are compared within a label. Each tree splits a label's vectors again and again along a random direction, where few vectors lie, between the
quartiles; vectors near the cut go to both sides, near being measured by how far apart two vectors at the threshold lie along a direction of the given dimension. What goes to both
sides is bounded: over all levels of a tree a vector is in about `copies` leaves on average, whatever the depth, and many trees make up for what a cut still separates. Only a node that
is a group of near copies, because much of its sample links, stays a leaf. A label that no tree splits has one tree.

Trees are fitted on a bounded sample of each label (`sample`, by hash), and every vector is sent down every tree. Below the depth that the sample
supports, a leaf's further splits share one direction a level, with the medians of the leaf's own sample, as deep as the label's full count asks for;
so a leaf's expected size doesn't grow with the table.

Equal vectors of a label are one class with a count, so copies cost nothing. Leaves are compared block by block: a leaf's classes are dealt to blocks of bounded size and
each pair of blocks is one group, so no task holds a whole hot leaf. Every pair in a leaf is compared exactly in double precision. A pair that shares an earlier leaf (the
vectors carry their leaves) is skipped, which makes link counts sums; a block pair gives counts, and of its links only a star for each of
its components, so that nothing of the size of all pairs leaves a task. Counting the links of a group of G near copies takes their G * G / 2 products.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing; vectors of different lengths don't link. Components may be as large or
small as a double can be: vectors are scaled by their largest one. Repeated rows, and equal vectors, link like others; repeated ids are one vector each (by row). Rows
without an id link and count, and are a component's smallest id only where all are without. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._common import by_key, components, cut, small_batches, table

#: Half-width about a cut within which vectors go to both sides, where the bound on copies allows it: in units of the spread of a linking pair's difference along a direction.
WIDTH = 1.2
#: A node is a group of near copies, and isn't cut, if this share of the pairs of its sample links. So many rows are looked at.
LINKED, LOOKED_AT = 0.3, 192
#: Rows that are sent down next to one copy of their label's forest.
ROWS_A_FOREST = 32_768


def _directions(seed: tuple[int, ...], dim: int) -> np.ndarray:
    d = np.random.default_rng(list(seed)).normal(size=dim)
    return d / np.linalg.norm(d)


class Tree:
    """Splits (direction by number, cut, half-width of the spill) fitted on a sample; node k has children 2k and 2k + 1."""

    def __init__(self, x: np.ndarray, n: int, seed: tuple[int, ...], leaf: int, copies: float, cosine: float = 0.98):
        self.seed, self.dim, self.cosine = seed, x.shape[1], cosine
        self.cuts: dict[int, tuple[int, float, float]] = {}
        self.extra: dict[int, list[tuple[int, float, float]]] = {}
        levels = max(np.log2(max(n / leaf, 1)), 1)
        self.share = copies ** (1 / levels) - 1  # of a node's vectors, how many may go to both sides
        #: vectors at the threshold differ by this much along a direction (one standard deviation): the wider a cut's spill, the fewer of their pairs are parted
        self.width = WIDTH * np.sqrt(max(2 - 2 * cosine, 0) / self.dim)
        ratio = n / max(len(x), 1)
        todo = [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) * ratio <= leaf or node >= 1 << 40 or self._linked(x[rows]):
                continue
            if len(rows) < 32:  # the sample ends here: shared directions, medians of what there is
                deeper = int(np.ceil(np.log2(len(rows) * ratio / leaf))) if len(rows) > 4 else 0
                self.extra[node] = [s for level in range(deeper) if (s := self._few(x[rows], level))]
                continue
            split = min((self._split(x[rows], node * 4 + k) for k in range(3)), key=lambda s: s[0])
            self.cuts[node] = split[1:]
            p = x[rows] @ self.direction(1, split[1])
            sides = rows[p < split[2] + split[3]], rows[p >= split[2] - split[3]]
            if max(map(len, sides)) == len(rows):  # nothing is parted: vectors that are all but equal
                del self.cuts[node]
                continue
            todo += [(2 * node, sides[0]), (2 * node + 1, sides[1])]

    def direction(self, kind: int, number: int) -> np.ndarray:
        return _directions((*self.seed, kind, number), self.dim)

    def _linked(self, x: np.ndarray) -> bool:
        """Whether the node is a group of near copies: comparing all of it is the work that its links take anyway."""
        some = x[:: max(len(x) // LOOKED_AT, 1)][:LOOKED_AT]
        n = len(some)
        return n > 4 and np.count_nonzero(some @ some.T >= self.cosine) - n >= LINKED * n * (n - 1)

    def _split(self, x: np.ndarray, number: int) -> tuple[float, int, float, float]:
        """Share of vectors about the cut, number of the direction, cut and half-width: the cut where fewest vectors lie, between the quartiles."""
        p = np.sort(x @ self.direction(1, number))
        at = np.linspace(p[len(p) // 4], p[3 * len(p) // 4], 33)
        about = (np.searchsorted(p, at + self.width) - np.searchsorted(p, at - self.width)) / len(p)
        best = int(np.argmin(about + 1e-3 * np.abs(np.arange(33) - 16)))  # near the median among equals
        apart = np.sort(np.abs(p - at[best]))
        return float(about[best]), number, float(at[best]), min(self.width, float(apart[min(int(self.share * len(p)), len(p) - 1)]))

    def _few(self, x: np.ndarray, level: int) -> tuple[int, float, float] | None:
        """A cut at the median of few vectors along a level's direction; the spill's share of vectors is read from their quartiles."""
        p = np.sort(x @ self.direction(0, level))
        spread = float(p[3 * len(p) // 4] - p[len(p) // 4])
        return (level, float(np.median(p)), min(self.width, self.share * spread)) if spread > 0 else None

    def leaves(self, x: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(rows, leaf number) of every leaf that rows of x reach."""
        out, todo = [], [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node in self.cuts:
                number, at, width = self.cuts[node]
                p = x[rows] @ self.direction(1, number)
                todo += [(2 * node, rows[p < at + width]), (2 * node + 1, rows[p >= at - width])]
                continue
            parts = [(rows, node)]
            for number, at, width in self.extra.get(node, ()):
                d = self.direction(0, number)
                parts = [(r[side], 2 * k + b) for r, k in parts for b, side in enumerate((x[r] @ d < at + width, x[r] @ d >= at - width))]
            out += [(r, k) for r, k in parts if len(r)]
        return out


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length from lists of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _grow(trees: int, leaf: int, copies: float, seed: int, cosine: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x, n = _unit(t["v"].combine_chunks()), t["n"][0].as_py()
        group = key[0].as_py()
        fitted: list[Tree] = []
        for k in range(trees):
            fitted.append(Tree(x, n, (seed, k, group & 0xFFFFFFFF, (group >> 32) & 0xFFFFFFFF), leaf, copies, cosine))
            if not fitted[-1].cuts and not fitted[-1].extra:  # one leaf: another tree would compare the same pairs
                fitted = fitted[-1:]
                break
        return pa.table({"g": pa.array([group], pa.int64()), "forest": pa.array([pickle.dumps(fitted)], pa.binary())})

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and salt, each group's forest first: every class with the leaves that it reaches."""
    forest = None
    for batch in batches:
        at = 0
        ids, sealed = batch.column("cls").to_numpy(zero_copy_only=False), batch.column("forest")
        while at < batch.num_rows:
            if ids[at] < 0:
                forest = pickle.loads(sealed[at].as_py())
                at += 1
                continue
            following = np.flatnonzero(ids[at : at + 4096] < 0)
            to = min(at + (int(following[0]) if len(following) else 4096), batch.num_rows)
            part = batch.slice(at, to - at)
            x = _unit(part.column("v"))
            row, cell = [], []
            for k, tree in enumerate(forest):
                for rows, number in tree.leaves(x):
                    row.append(rows)
                    cell.append(np.full(len(rows), (k << 56) + number))
            row, cell = np.concatenate(row), np.concatenate(cell)
            order = np.lexsort((cell, row))
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[order], pa.int64()))
            yield pa.record_batch({c: part.column(c) for c in ("g", "cls", "n", "v")} | {"cells": cells})
            at = to


def _link_leaves(cosine: float):
    """Rows sorted by group, leaf and pair of blocks: for each class the rows that it links with, and stars (a, b) that join linked classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "g", "cell", "lo", "hi"):
            x, cls, n, own = _unit(t["v"].combine_chunks()), t["cls"].to_numpy(), t["n"].to_numpy(), t["own"].to_numpy()
            cell, lo, hi = (t[c][0].as_py() for c in ("cell", "lo", "hi"))
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            lists = t["cells"].combine_chunks()
            flat, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy())
            kinds, local = np.unique(flat[flat < cell], return_inverse=True)
            before = np.zeros((len(x), len(kinds) // 64 + 1), np.uint64)  # the earlier leaves of each class, as bits
            np.bitwise_or.at(before, (who[flat < cell], local >> 6), np.uint64(1) << (local & 63).astype(np.uint64))
            links, top = np.zeros(len(x), np.int64), np.arange(len(x))
            for k in range(0, len(left), 256):
                i, j = np.nonzero(x[left[k : k + 256]] @ x[right].T >= cosine)
                i, j = left[k + i], right[j]
                if lo == hi:
                    i, j = i[i < j], j[i < j]
                new = ~(before[i] & before[j]).any(1)
                i, j = i[new], j[new]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                while len(i) and np.any(top[i] != top[j]):  # smallest place reachable
                    least = np.minimum(top[i], top[j])
                    np.minimum.at(top, top[i], least)
                    np.minimum.at(top, top[j], least)
                    top = top[top]
            while np.any(top[top] != top):
                top = top[top]
            some, arms = np.flatnonzero(links), np.flatnonzero(top != np.arange(len(x)))
            if len(some):
                none = lambda k: pa.nulls(k, pa.int64())
                yield pa.record_batch({"cls": pa.concat_arrays([pa.array(cls[some]), none(len(arms))]), "n": pa.concat_arrays([pa.array(links[some]), none(len(arms))]), "a": pa.concat_arrays([none(len(some)), pa.array(cls[arms])]), "b": pa.concat_arrays([none(len(some)), pa.array(cls[top[arms]])])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, trees: int = 8, leaf: int = 256, copies: float = 1.6, block: int = 1024, sample: int = 32_768, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id long, embedding array, label)."""
    small_batches(vectors.sparkSession)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    d = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    largest = F.array_max(F.transform("v", lambda e: F.abs(e)))
    scaled = F.transform("v", lambda e: e / F.col("largest") + 0.0)  # + 0.0: no negative zeros
    d = d.withColumn("good", good).withColumn("largest", largest).withColumn("v", F.when(F.col("good"), scaled))
    g = F.xxhash64("label", F.size("v"))
    d = cut(d.select("row", "vec_id", F.when(F.col("good"), g).alias("g"), F.when(F.col("good"), F.xxhash64("v", "label")).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(1), "v")).alias("h2"), "v"))

    # Equal vectors of a group are one class, by two 64-bit hashes.
    classes = cut(d.where("g is not null").groupBy("g", "h1", "h2").agg(F.min("row").alias("cls"), F.count("*").alias("n"), F.first("v").alias("v")))
    counts = cut(classes.groupBy("g").agg(F.count("*").alias("n")))

    # Fit: a bounded number of classes a group.
    picked = classes.select("g", "cls", "v").join(counts, "g").where(F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1 << 60)) < F.lit(float(sample) * (1 << 60)) / F.col("n"))
    forests = cut(picked.select("g", "v", "n").groupBy("g").applyInArrow(_grow(trees, leaf, copies, seed, cosine), "g long, forest binary"))

    # Send every class down its group's trees, in salted runs next to a copy of the forest.
    salts = counts.select("g", F.ceil(F.col("n") / ROWS_A_FOREST).cast("int").alias("salts"))
    salted = classes.join(salts, "g").select("g", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), "cls", "n", "v", F.lit(None).cast("binary").alias("forest"))
    first = forests.join(salts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("cls"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("v"), "forest")
    both = salted.unionByName(first).repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", "cls")
    placed = cut(both.mapInArrow(_place, "g long, cls long, n long, v array<double>, cells array<long>"))

    cells = placed.select("g", F.explode("cells").alias("cell")).groupBy("g", "cell").agg(F.count("*").alias("size")).where("size > 1")
    blocks = cells.select("g", "cell", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = placed.select("g", "cls", "n", "v", "cells", F.explode("cells").alias("cell")).join(blocks, ["g", "cell"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(seed + 1)), F.col("blocks")).cast("int"))
    # a row meets every block of its leaf once: with its own block as the lower or the higher one
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    rows = rows.select("g", "cell", "lo", "hi", "own", "cls", "n", "v", "cells").repartition(parts, "g", "cell", "lo", "hi").sortWithinPartitions("g", "cell", "lo", "hi")
    found = cut(rows.mapInArrow(_link_leaves(cosine), "cls long, n long, a long, b long"))

    n_links = found.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("links"))
    top = components(found.where("a is not null").select("a", "b")).select(F.col("node").alias("cls"), F.col("component").alias("top"))
    of_class = classes.select("g", "h1", "h2", "cls", "n").join(n_links, "cls", "left").join(top, "cls", "left")
    of_class = of_class.select("g", "h1", "h2", F.coalesce("top", "cls").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    joined = cut(d.select("row", "vec_id", "g", "h1", "h2").join(of_class, ["g", "h1", "h2"], "left").select("row", "vec_id", F.coalesce("top", "row").alias("top"), "links"))
    smallest = joined.groupBy("top").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(smallest, "top")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Null labels and vectors that are null, zero or not finite link with nothing; equal vectors and repeated rows link; repeated ids are vectors each; an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
