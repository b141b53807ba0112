"""Mix sources to target weights by entropy balancing.

A document of size x gets the rate min(cap, exp(l * x / mean size)): of all rates under the cap that meet its source's word
target these stay closest, in relative entropy, to one copy each. Each source's multiplier l solves a convex dual, by Newton
steps kept inside a bracket. The rate depends on source and size only, so the steps run over (source, size, count) rows,
which one aggregation makes from all documents, and every step is a grouped sum over them.

Rates become whole copies by cumulative rounding in order of size: the copies of all documents up to a size differ from the
sum of their rates by half a copy at most. Which documents of equal size get the extra copy goes by a hash of the id, dealt over
salted groups so that no group of equal documents meets in one task. What is left of a source's target is met by giving or taking copies: again and again the move that
brings the source closest is made, of all that give or take some copies of one size or exchange one copy for one of another size, until none brings it closer; where more than a word
is left, one copy of each size is also tried both ways with others making up for it. So what is left is at most half of the smallest document that could still be given (or taken), and
less wherever sizes differ by little.

A null source is a source, the last one; null and empty texts have size 0 and take nothing; equal rows, and rows without an id, are
told apart by a number in their own group, so each row has copies of its own. Long texts are counted whole. An empty table gives an empty result; extra columns are ignored
by `mix` and kept by `repeat`. Reruns agree: nothing depends on partitions or order. A source's distinct sizes meet in one task (`rates` and `copies`);
their number is bounded by the longest text and not by the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tideline.llm import _bytes
from tideline.llm._common import cut, small_batches, table

#: The weights that the contract gives to the sources in order.
WEIGHTS = (3, 1, 2)
#: Groups that a cell is dealt to: so many at least, and as many as keep a group near so many rows.
SALTS, ROWS_A_GROUP = 64, 65_536


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Words of each whole text."""
    return pa.array(_bytes.word_counts(text))


def keyed(docs: DataFrame, *carry: Column) -> DataFrame:
    """The columns `carry`, k, size, h and tie of every row. k sorts like the sources by code point, null last, and is never null; h and tie order a cell's rows."""
    small_batches(docs.sparkSession)
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    text = F.col("text").cast("string")
    return docs.select(*carry, key.alias("k"), word_count(text).alias("size"), F.xxhash64(F.col("doc_id"), F.lit(7)).alias("h"), F.xxhash64(text).alias("tie"))


def targets(by_source: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """k, source_size, target: `share` times all sizes, shared by weight; nobody above cap * size, the excess reshared.

    Filling up: with w the weight and c the most of a source, its target is min(c, t * w), and t makes the sum right. A source is full
    at levels t >= c / w, so a few grouped sums find t.
    """
    n = len(weights)
    # One row a source; positions come from a range sort, partition by partition.
    parts = cut(by_source.select("k", "source_size").orderBy("k").withColumn("p", F.spark_partition_id()))
    before = parts.groupBy("p").count().withColumn("before", F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    place = parts.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("k"))).join(before, "p")
    place = place.select("k", "source_size", (F.coalesce("before", F.lit(0)) + F.col("r") - 1).alias("place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int"))
    s = cut(place.select("k", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(cap)).alias("c")).withColumn("at", F.col("c") / F.col("w")))
    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round fixes the sources that are full at the level so far, one more at least, and ends otherwise
        full, open_w = s.agg(F.coalesce(F.sum(F.when(F.col("at") <= level, F.col("c"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("at") > level, F.col("w"))), F.lit(0.0))).first()
        new = (total - full) / open_w if open_w else level
        if not open_w or new <= level * (1 + 1e-12):
            break
        level = new
    return s.select("k", "source_size", F.least(F.col("c"), F.lit(level) * F.col("w")).alias("target"))


def _rate(cap: float):
    return F.least(F.lit(cap), F.exp(F.least(F.col("l") * F.col("x"), F.lit(50.0))))


def rates(cells: DataFrame, target: DataFrame, cap: float = 2.0, steps: int = 80) -> DataFrame:
    """cells (k, size, n) with target and rate: the dual's Newton steps for all sources at once.

    They end when every source is within a millionth of its target (the rounding makes up for the rest).
    """
    whole = Window.partitionBy("k")
    c = cells.where("size > 0").withColumn("x", F.col("size") / (F.sum(F.col("size") * F.col("n")).over(whole) / F.sum("n").over(whole)))
    c = cut(c.join(target.where("source_size > 0"), "k").withColumn("full", F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)))
    now = target.where("source_size > 0").select("k", F.lit(0.0).alias("l"), F.lit(-64.0).alias("lo"), F.lit(64.0).alias("hi"))
    for _ in range(steps):
        r = _rate(cap)
        g = c.join(now, "k").groupBy("k").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"),
            F.sum(F.when(r < cap, F.col("n") * F.col("size") * F.col("x") * r).otherwise(0.0)).alias("slope"),
            *[F.first(x).alias(x) for x in ("target", "full", "l", "lo", "hi")],
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("l")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("l")).otherwise(F.col("hi"))
        newton = F.col("l") - gap / F.col("slope")
        done = F.col("full") | (F.abs(gap) <= 1e-6 * F.col("target")) | (hi - lo < 1e-13)
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        now = cut(g.select("k", F.when(done, F.col("l")).otherwise(step).alias("l"), lo.alias("lo"), hi.alias("hi"), done.alias("done")))
        if now.where("not done").isEmpty():
            break
    else:
        raise RuntimeError("rates did not settle")  # a bracket is halved at worst, so this is a bug
    rate = F.when(F.col("full"), F.lit(cap)).otherwise(_rate(cap))
    return c.join(now, "k").select("k", "size", "n", "target", rate.alias("rate"))


def _filled(size: np.ndarray, room: np.ndarray, words: float, but: int) -> tuple[float, list[tuple[int, int]]]:
    """What is left of `words` after taking sizes from the longest down, as many of each as fit, without size number `but`; and (size number, copies)."""
    used, k = [], len(size)
    while words > 0:
        k = min(k - 1, int(np.searchsorted(size, words, "right")) - 1)
        if k < 0:
            break
        t = int(min(room[k], words // size[k])) if k != but else 0
        if t:
            used.append((k, t))
            words -= t * float(size[k])
    return words, used


def _long_moves(size: np.ndarray, n: np.ndarray, held: np.ndarray, gap: float, cap: int) -> np.ndarray | None:
    """`held` after giving or taking one copy of some size and making up for it by others, if that comes closer to the target."""
    best, change = abs(gap) - 1e-9, None
    for sign, first in ((1, held < cap * n), (-1, held > 0)):
        for k in np.flatnonzero(first):
            after = gap - sign * float(size[k])
            way = 1 if after > 0 else -1
            room = cap * n - held if way > 0 else held
            some = np.flatnonzero(room > 0)
            left, used = _filled(size[some], room[some], abs(after), int(np.searchsorted(some, k)) if room[k] else -1)
            if left < best:
                best, change = left, [(k, sign), *((some[j], way * t) for j, t in used)]
    if change is None:
        return None
    out = held.copy()
    for k, t in change:
        out[k] += t
    return out


def close_gap(size: np.ndarray, n: np.ndarray, held: np.ndarray, gap: float, cap: int) -> np.ndarray:
    """`held` (copies of all documents of each size, sizes distinct and ascending) after the moves that bring `gap` (words that are missing) closest to 0.

    Every document holds 0 to cap copies. A move gives or takes some copies of one size, or exchanges one copy for another; the best one is made until none helps. If
    more than a word is missing then, one copy of each size is tried both ways, with the others making up for it.
    """
    held = held.copy()
    while gap != 0:
        room = cap * n - held if gap > 0 else held
        t = np.minimum(room, np.maximum(np.rint(abs(gap) / size), 1)).astype(np.int64)
        left = np.where(t > 0, np.abs(abs(gap) - t * size), np.inf)
        best = int(np.argmin(left))
        moves = [(left[best], 0, best, best)]
        give, take = np.flatnonzero(held < cap * n), np.flatnonzero(held > 0)
        if len(give) and len(take):  # of each size to give, the size to take that fits best
            want = size[give] - gap
            at = np.searchsorted(size[take], want)
            for k in (np.maximum(at - 1, 0), np.minimum(at, len(take) - 1)):
                off = np.abs(size[take[k]] - want)
                i = int(np.argmin(off))
                moves.append((off[i], 1, int(give[i]), int(take[k[i]])))
        off, kind, a, b = min(moves)
        if not off < abs(gap) - 1e-9:
            longer = _long_moves(size, n, held, gap, cap) if abs(gap) > 1 else None
            if longer is None:
                break
            gap -= float(size @ (longer - held))
            held = longer
        elif kind:
            held[a] += 1
            held[b] -= 1
            gap -= float(size[a] - size[b])
        else:
            step = int(t[a]) if gap > 0 else -int(t[a])
            held[a] += step
            gap -= float(step * size[a])
    return held


def copies(cells: DataFrame, cap: int = 2) -> DataFrame:
    """cells (k, size, n, target, rate) with base and extra: every document gets base copies, `extra` of the n one more."""
    up = Window.partitionBy("k").orderBy("size")
    c = cells.withColumn("base", F.floor("rate")).withColumn("part", F.col("n") * (F.col("rate") - F.floor("rate")))
    c = c.withColumn("sum", F.sum("part").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("extra", F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("part") + 0.5))
    c = c.withColumn("extra", F.least(F.greatest("extra", F.lit(0)), F.col("n")).cast("long"))

    def close(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("size")
        size, n, held = (t[x].to_numpy() for x in ("size", "n", "held"))
        held = close_gap(size, n, held, t["target"][0].as_py() - float(size @ held), cap)
        return pa.table({"k": t["k"], "size": size, "base": held // n, "extra": held % n})

    held = c.select("k", "size", F.col("n").cast("long").alias("n"), "target", (F.col("base") * F.col("n") + F.col("extra")).cast("long").alias("held"))
    return held.groupBy("k").applyInArrow(close, "k string, size long, base long, extra long")


def quotas(rows: DataFrame, share: float, cap: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(quota, target) from rows (k, size, salt): quota has base and give of each (k, size, salt), that is, every row gets base copies and the first `give` one more."""
    groups = cut(rows.groupBy("k", "size", "salt").agg(F.count("*").alias("n")))
    cells = cut(groups.groupBy("k", "size").agg(F.sum("n").alias("n")))
    target = cut(targets(cells.groupBy("k").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, cap, weights))
    quota = cut(copies(rates(cells, target, cap), cap))
    # The extra copies of a cell go to its salted groups in order, and in a group by hash of the id.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    q = groups.join(quota, ["k", "size"])
    return cut(q.select("k", "size", "salt", "base", F.greatest(F.lit(0), F.least("n", F.col("extra") - before)).alias("give"))), target


def _salted(rows: DataFrame, n_rows: int) -> DataFrame:
    """With salt: a cell's rows are dealt to so many groups that none holds much more than ROWS_A_GROUP, even if all rows are in one cell."""
    salts = max(SALTS, -(-n_rows // ROWS_A_GROUP))
    return rows.withColumn("salt", F.pmod(F.xxhash64("h", "tie"), F.lit(salts)).cast("int"))


def _counted(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """rows with copies: base, and one more for the first ones of each salted group."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("k", "size", "salt").orderBy("h", "tie")))
    out = ranked.join(quota, ["k", "size", "salt"], "left")
    return out.withColumn("copies", (F.coalesce("base", F.lit(0)) + F.when(F.col("r") <= F.col("give"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of `docs` (doc_id, source, text)."""
    rows = cut(keyed(docs, F.col("doc_id"), F.col("source")))
    rows = _salted(rows, rows.count())
    quota, target = quotas(rows, share, cap, weights)
    out = _counted(rows, quota).join(target, "k")
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of `docs` (doc_id, source, text, ...), each as often as the mix takes it; all columns as they are, whatever their names."""
    whole = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    small = cut(keyed(docs))
    n = small.count()
    quota, _ = quotas(_salted(small, n), share, cap, weights)
    taken = _counted(_salted(whole, n), quota).where("copies > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("whole.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have size 0 and take nothing; a null source is the last one; repeated and tied rows have copies of their own; long texts count whole; an empty table gives no rows."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
