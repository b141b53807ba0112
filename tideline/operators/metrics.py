"""Agreement and calibration metrics as grouped aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.groups import map_groups, spread
from tideline.operators.tables import average_rank


def f1(tp: Column, predicted: Column, true: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1 of counts; 0 where undefined."""
    p = F.when(predicted > 0, tp / predicted).otherwise(0.0)
    r = F.when(true > 0, tp / true).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def summary_f1(machine: DataFrame, annotators: DataFrame) -> DataFrame:
    """video_id, annotator, precision, recall, f1 of 0/1 summaries: machine (video_id, idx, s), annotators (video_id, annotator, idx, u)."""
    g = annotators.join(machine, ["video_id", "idx"]).groupBy("video_id", "annotator").agg(F.sum(F.col("s") * F.col("u")).alias("tp"), F.sum("s").alias("p"), F.sum("u").alias("t"))
    p, r, f = f1(F.col("tp"), F.col("p"), F.col("t"))
    return g.select("video_id", "annotator", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Spearman's rank correlation of each group, ties averaged."""
    d = df.select(*by, average_rank(by, x).alias("a"), average_rank(by, y).alias("b"))
    return d.groupBy(*by).agg(F.corr("a", "b").alias(out))


def inversions(rank: np.ndarray) -> int:
    """Pairs i < j with rank[i] > rank[j] (whole numbers from 0): bit by bit from the highest, within runs of equal higher bits the ones that stand before a zero."""
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        run = rank >> (bit + 1)
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        before = np.cumsum(one) - one
        before = before - np.repeat(before[begin], np.diff(np.r_[begin, len(run)]))
        total += int(before[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return total


def kendall_tau_b(df: DataFrame, by: list[str], x: str, y: str, out: str = "tau") -> DataFrame:
    """Kendall's tau-b of each group of two rows or more: inversions are counted by bits of ranks, groups in parallel; null where a side is constant."""
    kinds = dict(df.dtypes)

    def pairs(*values: np.ndarray) -> float:
        """Pairs of rows that agree in all sorted `values`."""
        n = np.diff(np.r_[np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in values], axis=0)]), len(values[0])]).astype(float)
        return float((n * (n - 1) / 2).sum())

    def one(t: pa.Table) -> pa.Table | None:
        if len(t) < 2:
            return None
        a, b = (t[c].to_numpy().astype(float) for c in (x, y))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        kind, rank = np.unique(b, return_inverse=True)
        n0, nx, ny, nxy = len(a) * (len(a) - 1) / 2, pairs(a), pairs(np.sort(b)), pairs(a, b)
        tau = (n0 - nx - ny + nxy - 2 * inversions(rank)) / ((n0 - nx) * (n0 - ny)) ** 0.5 if n0 > nx and n0 > ny else None
        return pa.table({**{c: t[c].slice(0, 1) for c in by}, out: pa.array([tau], pa.float64())})

    some = spread(df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), *by)
    return map_groups(some, by, [], one, ", ".join(f"{b} {kinds[b]}" for b in by) + f", {out} double")


def bins(df: DataFrame, by: list[str], bin_: Column, conf: str, acc: Column) -> DataFrame:
    return df.groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("conf"), F.avg(acc).alias("acc"))


def ece(binned: DataFrame, by: list[str], total: Column | None = None) -> DataFrame:
    """Expected calibration error from bins; `total` when rows outside all bins count in the denominator."""
    gap = F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf")))
    return binned.groupBy(*by).agg((gap / (total if total is not None else F.sum("n"))).alias("ece"))


def ceil_bin(conf: Column, n: int) -> Column:
    return F.least(F.greatest(F.ceil(conf * n - 1), F.lit(0)), F.lit(n - 1))


def floor_bin(conf: Column, n: int) -> Column:
    """1.0 falls into the last bin."""
    return F.least(F.floor(conf * n), F.lit(n - 1))


def ndcg(df: DataFrame, by: str, score: str, gain: str, k: int) -> DataFrame:
    """nDCG@k with `gain` as gain; ties go by idx."""
    rank = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), "idx"))
    d = df.select(by, F.col(gain).alias("g"), rank(score).alias("r"), rank(gain).alias("i"))
    dcg = lambda r: F.sum(F.when(F.col(r) <= k, F.col("g") / F.log2(F.col(r) + 1)).otherwise(0.0))
    return d.groupBy(by).agg(dcg("r").alias("d"), dcg("i").alias("i")).select(by, F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0).alias("ndcg"))


def event_f1(predicted: DataFrame, true: DataFrame, threshold: float = 0.5, width: float = 16.0) -> DataFrame:
    """video_id, tp, n_pred, n_true, precision, recall, f1: events (video_id, rank, s, e) matched one-to-one, best-ranked prediction first, each with its best free event of IoU >= threshold.

    Pairs meet by cells. In a round every free prediction proposes to its best free event, which accepts if no free prediction that reaches it ranks higher; such a match is final, as nobody
    before could want the event. Both sides empty is 1, one side empty is 0.
    """
    from tideline.operators.graph import cut_lineage
    from tideline.operators.intervals import iou, overlapping

    met = overlapping(predicted.select("video_id", "rank", "s", "e"), true.select("video_id", "s", "e"), width)
    met = met.withColumn("iou", iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).where(F.col("iou") >= threshold)
    free = cut_lineage(met.select("video_id", "rank", F.col("s2").alias("ts"), (-F.round("iou", 9)).alias("o")))
    matched = None
    while not free.isEmpty():
        wish = free.groupBy("video_id", "rank").agg(F.min(F.struct("o", "ts"))["ts"].alias("ts"))
        first = free.groupBy("video_id", "ts").agg(F.min("rank").alias("rank"))
        new = cut_lineage(wish.join(first, ["video_id", "ts", "rank"]))
        matched = new if matched is None else matched.unionByName(new)
        free = cut_lineage(free.join(new, ["video_id", "rank"], "left_anti").join(new, ["video_id", "ts"], "left_anti"))
    n = predicted.groupBy("video_id").agg(F.count("*").alias("n_pred")).join(true.groupBy("video_id").agg(F.count("*").alias("n_true")), "video_id", "full")
    n = n.join(matched.groupBy("video_id").agg(F.count("*").alias("tp")), "video_id", "left") if matched is not None else n.withColumn("tp", F.lit(0).cast("long"))
    n = n.fillna(0)
    p, r, f = f1(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return n.select("video_id", "tp", "n_pred", "n_true", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def histogram(df: DataFrame, value: str, n: int) -> DataFrame:
    """bin, n, density over n equal bins between the ends, which one aggregate row gives."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("all"))
    d = df.crossJoin(F.broadcast(ends))  # one row
    b = d.groupBy(F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n)), F.lit(n - 1)).cast("int").alias("bin"), "lo", "hi", "all").agg(F.count("*").alias("n"))
    return b.select("bin", "n", (F.col("n") / (F.col("all") * ((F.col("hi") - F.col("lo")) / n))).alias("density"))


def centroids(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by, centroid: the mean vector of each group."""
    d = df.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return d.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def cohesion(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """c1 <= c2, mean, std: of the cosines of all pairs of rows of two classes, or of one class (each pair once, no row with itself).

    No pair is made: with unit vectors u the cosines of two classes add up to the product of their sums, and the squared ones to that of
    their sums of u u'. A task keeps one such sum a class. Null vectors and those of length 0 have no cosine and are left out.
    """
    import numpy as np
    import pandas as pd

    def sums(parts):
        total = {}
        for part in parts:
            for key, g in part.groupby("c"):
                x = np.stack(g["x"].to_numpy()).astype("float64")
                n = np.sqrt((x * x).sum(axis=1))
                u = x[n > 0] / n[n > 0, None]
                t = total.setdefault(key, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
                t[0], t[1], t[2] = t[0] + len(u), t[1] + u.sum(axis=0), t[2] + u.T @ u
        for key, (n, s, m) in total.items():
            values = np.concatenate([[n], s, m.ravel()])
            yield pd.DataFrame({"c": key, "dim": len(s), "pos": np.arange(len(values)), "v": values})

    d = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("c"), F.col(vector).alias("x"))
    t = d.mapInPandas(sums, f"c {dict(d.dtypes)['c']}, dim long, pos long, v double").groupBy("c", "dim", "pos").agg(F.sum("v").alias("v"))
    j = t.select(F.col("c").alias("c1"), "dim", "pos", F.col("v").alias("v1")).join(t.select(F.col("c").alias("c2"), "dim", "pos", F.col("v").alias("v2")), ["dim", "pos"]).where("c1 <= c2")
    part = lambda low, high: F.sum(F.when(F.col("pos").between(low, high), F.col("v1") * F.col("v2")).otherwise(0.0))
    g = j.groupBy("c1", "c2").agg(part(F.lit(0), F.lit(0)).alias("n"), part(F.lit(1), F.col("dim")).alias("s"), part(F.col("dim") + 1, F.lit(2**62)).alias("q"))
    same = F.col("c1") == F.col("c2")
    own = F.sqrt("n")  # a row with itself has cosine 1
    g = g.select("c1", "c2", *[F.when(same, (F.col(k) - own) / 2).otherwise(F.col(k)).alias(k) for k in ("s", "q")], F.when(same, (F.col("n") - own) / 2).otherwise(F.col("n")).alias("n")).where("n > 0.5")
    mean = F.col("s") / F.col("n")
    return g.select("c1", "c2", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
