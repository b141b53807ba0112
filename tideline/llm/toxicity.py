"""Toxicity classifier that is regularised with counterfactual sentences.

A text's features are the presence of words and of word beginnings (4 to 7 letters), case folded, marks cut off. Which ones count is
learnt from the training sample: a first pass counts features of toxic and other documents by hash range in arrays of
fixed size, a second counts exactly those whose range looks telling, and the `n_features` with the strongest association stay.
A logistic model over them is fitted with a penalty on score changes: in the training texts each identity term is swapped for
another of its group, and the squared difference of the two logits is added to the loss, so that a neutral mention of a group can't carry weight of
its own.

The training sample is bounded: `fit_rows` labelled ids, at most half of them of the larger class while there are enough of both. It is drawn from
the labels, by hash of the id, before any text is read, so that only its texts are kept; a class that is drawn more thinly weighs more. Copies
and near copies in the sample, seen by two min-hashes of word shingles, share the weight of one row, so that a text copied a thousand times doesn't fill the features.

Null and empty texts have no feature and get the score of the intercept. Only rows labelled 0 or 1 train; without both classes the score is a
constant; an empty table gives an empty result. Repeated label rows count once; an id with both labels trains as both. Of rows of `docs` that repeat a drawn id one trains, the
text of least hash, so repeats can't widen the sample. A null id is never drawn, and its row is scored like others. Long texts are read whole, in slices. Each input row gives one output row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes
from tideline.llm._common import cut, small_batches, table
from tideline.llm.quality import crc_fold

#: Identity terms, by group; a counterfactual takes the next term of the group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("old", "young"), ("disabled", "abled"), ("immigrant", "native"), ("immigrants", "natives"), ("refugees", "citizens"),
)
NEXT_TERM = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}
_TERMS = re.compile(r"(?i)(?<![^\W\d_])(?:" + "|".join(sorted(NEXT_TERM, key=len, reverse=True)) + r")(?![^\W\d_])")
BEGINNINGS = (4, 5, 6, 7)
RANGES, BLOCK = 1 << 20, 1 << 12


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words and word beginnings, repeats included."""
    data = _bytes.lower(data)
    first, last, row = _bytes.word_bounds(data, offsets, _bytes.LETTERS)
    if not len(first):
        return row, np.zeros(0, np.uint64)
    rows, hashes = [row], [_bytes.range_hashes(data, first, last)]
    for k in BEGINNINGS:
        long = np.flatnonzero(last - first + 1 >= k)
        rows.append(row[long])
        hashes.append(_bytes.range_hashes(data, first[long], first[long] + k - 1) ^ np.uint64(0x5851F42D4C957F2D * k & (2**64 - 1)))
    return np.concatenate(rows), np.concatenate(hashes)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, RANGES))
    for batch in batches:
        y, w = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("w").to_numpy(zero_copy_only=False)
        for at, data, offsets in _bytes.slices(batch.column("text")):
            row, h = _bytes.distinct(*features(data, offsets))
            of, weight = y[at + row], w[at + row]
            for label in (0, 1):
                total[label] += np.bincount((h[of == label] >> np.uint64(44)).astype(np.int64), weights=weight[of == label], minlength=RANGES)
    if total.any():
        parts = total.astype(np.float32).reshape(2, -1, BLOCK).transpose(1, 0, 2)
        yield pa.record_batch({"block": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in _bytes.slices(batch.column("text")):
            n = len(offsets) - 1
            row, h = _bytes.shingle_sets(data, offsets)
            out = {"text": batch.column("text").slice(at, n), "y": batch.column("y").slice(at, n)}
            begin = np.searchsorted(row, np.arange(n))
            some = np.bincount(row, minlength=n) > 0
            for k in (1, 2):
                least = np.zeros(n, np.uint64)
                if some.any():
                    least[some] = np.minimum.reduceat(_bytes.mix(h ^ np.uint64(k)), begin[some])
                out[f"m{k}"] = pa.array(least.view(np.int64))
            yield pa.record_batch(out)


def weigh_copies(train: DataFrame) -> DataFrame:
    """text, y, w: each row's weight is one over the rows of its label that share a min-hash with it. train is a bounded sample, so are the counts."""
    t = cut(train.mapInArrow(_min_hashes, "text string, y int, m1 long, m2 long"))
    for k in ("1", "2"):
        t = t.join(F.broadcast(t.groupBy("y", f"m{k}").agg(F.count("*").alias(f"c{k}"))), ["y", f"m{k}"])
    return cut(t.select("text", "y", (1 / F.greatest("c1", "c2")).alias("w")))


def _telling(n_pos: float, n_neg: float, keep: int):
    """Which ranges of a block have shares of toxic and other documents that differ clearly."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BLOCK))
        for batch in batches:
            for v in batch.column("counts"):
                total += np.frombuffer(v.as_py(), np.float32).reshape(2, BLOCK)
        z = association(total[1], total[0], n_pos, n_neg)
        best = np.argsort(-z)[:keep]
        best = best[z[best] > 2.0]
        yield pa.record_batch({"range": pa.array(best + key[0].as_py() * BLOCK, pa.int32())})

    return add


def association(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """How far, in standard errors, the log odds of presence in toxic documents lie above those in others."""
    a, b = pos + 0.5, neg + 0.5
    lift = np.log(a / (n_pos + 1)) - np.log(b / (n_neg + 1))
    return lift / np.sqrt(1 / a + 1 / b)


def choose_features(train: DataFrame, n_features: int) -> np.ndarray:
    """Hashes of the features that count, ascending. train: text, y (0/1), w."""
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.sum("w").alias("n")).collect()}
    n_pos, n_neg = float(n.get(1, 0)), float(n.get(0, 0))
    ranges = train.mapInArrow(_ranges, "block int, counts binary").groupBy("block").applyInArrow(_telling(n_pos, n_neg, 64), "range int").collect()
    wanted = np.zeros(RANGES, bool)
    wanted[[r["range"] for r in ranges]] = True
    picked = train.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(picked.value).astype(bool)
        for batch in batches:
            y, w = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("w").to_numpy(zero_copy_only=False)
            for at, data, offsets in _bytes.slices(batch.column("text")):
                row, h = features(data, offsets)
                hit = keep[(h >> np.uint64(44)).astype(np.int64)]
                row, h = _bytes.distinct(row[hit], h[hit])
                u, back = np.unique(h, return_inverse=True)
                of, weight = y[at + row], w[at + row]
                yield pa.record_batch({"h": pa.array(u.view(np.int64)), "pos": pa.array(np.bincount(back, weights=of * weight, minlength=len(u))), "neg": pa.array(np.bincount(back, weights=(1 - of) * weight, minlength=len(u)))})

    counts = train.mapInArrow(exact, "h long, pos double, neg double").groupBy("h").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    z = (F.log(a / (n_pos + 1)) - F.log(b / (n_neg + 1))) / F.sqrt(1 / a + 1 / b)
    best = counts.where("a >= 2").orderBy(z.desc(), "h").limit(n_features).collect()
    return np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64))


def _presence(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place of a chosen feature)."""
    row, h = features(data, offsets)
    if not len(h) or not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    hit = chosen[at] == h
    key = np.unique(row[hit].astype(np.int64) * len(chosen) + at[hit])
    return key // len(chosen), key % len(chosen)


def swap_terms(text: str) -> str:
    """The text with each identity term replaced by the next of its group."""
    return _TERMS.sub(lambda m: NEXT_TERM[m[0].lower()], text)


def _fitting_rows(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in _bytes.slices(batch.column("text")):
                n = len(offsets) - 1
                row, place = _presence(data, offsets, chosen)
                own = np.split(place, np.searchsorted(row, np.arange(1, n)))
                swapped, changes = [], []
                for i in range(n):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    if _TERMS.search(text):
                        changes.append(i)
                        swapped.append(swap_terms(text))
                other = [None] * n
                if changes:
                    raw = [s.encode() for s in swapped]
                    row, place = _presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), chosen)
                    for i, p in zip(changes, np.split(place, np.searchsorted(row, np.arange(1, len(raw))))):
                        other[i] = p.tolist()
                yield pa.record_batch({"y": batch.column("y").slice(at, n), "w": batch.column("w").slice(at, n), "own": pa.array([p.tolist() for p in own], pa.list_(pa.int32())), "other": pa.array(other, pa.list_(pa.int32()))})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, change: np.ndarray, weight: np.ndarray | None = None, change_weight: np.ndarray | None = None, ridge: float = 0.15, fairness: float = 20.0, steps: int = 30) -> np.ndarray:
    """Newton's method for logistic regression of weighted rows; the last weight is the intercept.

    change: rows of feature differences (swapped minus own); their squared logit change is penalised.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    v = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.r_[np.full(x.shape[1] - 1, ridge), 1e-6])
    if len(change):
        c = np.hstack([change, np.zeros((len(change), 1))])
        penalty = penalty + fairness * (c.T @ (c if change_weight is None else c * change_weight[:, None]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (v * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_ids(labels: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, y of the drawn ids, and how much a row of each class weighs. labels: doc_id, y (0/1).

    A class of n ids gives those whose hash lies under its share of `fit_rows`: half, or what the other class leaves.
    """
    one = cut(labels.where("doc_id is not null").distinct())
    n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    half = fit_rows // 2
    most = {y: max(half, fit_rows - n.get(1 - y, 0)) for y in n}
    share = {y: min(1.0, most[y] / n[y]) for y in n}
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 60)) / float(1 << 60)
    drawn = one.where(at < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    even = sum(n.values()) / max(sum(n[y] * share[y] for y in n), 1)
    return drawn, {y: 1 / (share[y] * even) for y in n}


def fit(train: DataFrame, weights: dict[int, float] | None = None, n_features: int = 384, fairness: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, weights with the intercept last) from train (text, y 0/1), a bounded number of rows; weights: of a row, by class."""
    weights = weights or {0: 1.0, 1: 1.0}
    n = dict(train.groupBy("y").count().collect())
    if len(n) < 2:
        p = 0.5 if not n else min(max(float(next(iter(n))), 0.02), 0.98)
        return np.zeros(0, np.uint64), np.array([np.log(p / (1 - p))])
    train = weigh_copies(train.select("text", "y"))
    chosen = choose_features(train, n_features)
    rows = train.mapInArrow(_fitting_rows(chosen), "y int, w double, own array<int>, other array<int>").groupBy("y", "own", "other").agg(F.sum("w").alias("w")).collect()
    x, change, times = np.zeros((len(rows), len(chosen))), [], []
    for i, r in enumerate(rows):
        x[i, r["own"]] = 1
        if r["other"] is not None:
            d = -x[i]
            d[r["other"]] += 1
            if d.any():
                change.append(d)
                times.append(r["w"])
    y = np.array([r["y"] for r in rows], float)
    v = np.array([r["w"] * weights[r["y"]] for r in rows])
    return chosen, fit_logistic(x, y, np.array(change), v, np.array(times), fairness=fairness)


def score(docs: DataFrame, chosen: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id, score of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in _bytes.slices(batch.column("text")):
                n = len(offsets) - 1
                row, place = _presence(data, offsets, chosen)
                logit = np.bincount(row, weights=weights[:-1][place], minlength=n) + weights[-1] if len(row) else np.full(n, weights[-1])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, n), "score": pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5, fit_rows: int = 30_000) -> DataFrame:
    """doc_id, held_out, score, predicted of all `docs`, learnt from at most about `fit_rows` ids of `labels` (doc_id, toxic) outside the held-out fold."""
    y = labels.where(F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    small_batches(docs.sparkSession)
    drawn, weights = training_ids(y, fit_rows)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")  # fit_rows bounds it
    one = train.groupBy("doc_id", "y").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    chosen, w = fit(one.select("text", "y"), weights)
    out = score(docs, chosen, w)
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity_classifier(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts get the intercept's score; long ones are read whole; repeated rows get equal scores and train once; an empty table gives no rows."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
