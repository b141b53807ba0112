"""Quality classifier: kernel ridge regression on document statistics, calibrated.

Each whole text becomes a row of statistics, counted from its bytes and words. Random Fourier features, cos(w x + b) with Gaussian
w and uniform b, approximate a Gaussian kernel over the standardised statistics. The normal equations of ridge regression are sums over labelled
documents: each partition adds up its own (a matrix of fixed size), an aggregation by matrix row adds those, and the driver solves one
small system. Raw scores are then calibrated by isotonic regression over a histogram of fixed size.

Null and empty texts have all-zero statistics and get a score like any other. Only rows labelled 0 or 1 train; without any, or with one class only,
the score is the share of label 1 (0.5 without rows). Repeated rows and label rows count as often as they occur; each input row gives one
output row, also where its id is null (such a row is scored and doesn't train). Long texts are counted whole, in slices. Equal texts have equal scores. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes
from tideline.llm._common import cut, small_batches, table

#: Characters that running text rarely has.
SYMBOLS = "#*$%&|<>{}[]\\^~=+_@"
STATISTICS = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "exclamation", "other_punctuation", "blank", "beyond_ascii", "lines_per_word", "repeated_words", "same_as_before", "upper_words", "symbol_words", "short_words", "long_words", "repeated_lines", "symbol_words_max", "stop_marks")


def _class_table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


_UPPER, _LOWER, _DIGIT = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class_table("abcdefghijklmnopqrstuvwxyz"), _class_table("0123456789")
_SYMBOL, _SHOUT, _STOP = _class_table(SYMBOLS), _class_table("!"), _class_table(".,;:?")
_OTHER, _BLANK, _LINE = _class_table("\"'()-/`"), _class_table(" \t\n\v\f\r"), _class_table("\n")
_BEYOND = (np.arange(256) >= 128).astype(np.int64)
_NOT_LINE = ~_LINE.astype(bool)


def _sums(flags: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.r_[0, np.cumsum(flags)]
    return c[end] - c[first]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    size = np.diff(offsets)
    first, last, row = _bytes.word_bounds(data, offsets)
    words = np.bincount(row, minlength=n)
    some, w1 = np.maximum(size, 1), np.maximum(words, 1)
    per_byte = lambda t: _sums(t[data], offsets[:-1], offsets[1:])
    per_row = lambda flags: np.bincount(row, weights=flags, minlength=n)
    upper, lower = _UPPER[data], _LOWER[data]
    hashes = _bytes.range_hashes(_bytes.lower(data), first, last) if len(first) else np.zeros(0, np.uint64)
    kinds = np.bincount(_bytes.distinct(row, hashes)[0], minlength=n) if len(first) else np.zeros(n)
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    in_word = lambda flags: _sums(flags, first, last + 1)
    ups, lows = in_word(upper), in_word(lower)
    marks = in_word(_SYMBOL[data] + _SHOUT[data])
    length = last - first + 1
    l_first, l_last, l_row = _bytes.word_bounds(data, offsets, _NOT_LINE)
    lines = np.bincount(l_row, minlength=n)
    l_kinds = np.bincount(_bytes.distinct(l_row, _bytes.range_hashes(data, l_first, l_last))[0], minlength=n) if len(l_first) else np.zeros(n)
    worst = np.zeros(n)
    if len(l_first):  # the line with the largest share of marked words, if it has three words
        at = np.searchsorted(l_first, first, "right") - 1
        l_words, l_marked = np.bincount(at, minlength=len(l_first)), np.bincount(at, weights=(marks > 0) | ((ups > 0) & (lows == 0)), minlength=len(l_first))
        np.maximum.at(worst, l_row, np.where(l_words >= 3, l_marked / np.maximum(l_words, 1), 0))
    columns = (
        np.log1p(size), np.log1p(words), (size - per_byte(_BLANK)) / w1, per_byte(_UPPER) / some, per_byte(_DIGIT) / some, per_byte(_SYMBOL) / some, per_byte(_SHOUT) / some, per_byte(_OTHER) / some,
        per_byte(_BLANK) / some, per_byte(_BEYOND) / some, per_byte(_LINE) / w1, 1 - kinds / w1, per_row(again) / w1, per_row((ups > 0) & (lows == 0)) / w1, per_row(marks > 0) / w1, per_row(length <= 2) / w1,
        per_row(length >= 16) / w1, 1 - l_kinds / np.maximum(lines, 1), worst, per_byte(_STOP) / w1,
    )
    for k, x in enumerate(columns):
        out[:, k] = np.where(size > 0, x, 0)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one column per statistic."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in _bytes.slices(batch.column("text")):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(x)), *[pa.array(x[:, k]) for k in range(x.shape[1])]], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


class Features:
    """Standardised statistics, their random Fourier features, and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, n_random: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), n_random))
        self.b = rng.uniform(0, 2 * np.pi, n_random)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / 8, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])


def normal_equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows (statistics and y) of f f' and f y: one matrix of fixed size a partition, added by matrix row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                f = features(_matrix(batch))
                f = np.hstack([f, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
                total = f.T @ f if total is None else total + f.T @ f
        if total is not None:
            yield pa.record_batch({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for v in batch.column("v"):
                total = total + np.frombuffer(v.as_py())
        yield pa.record_batch({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    got = rows.mapInArrow(part, "i int, v binary").groupBy("i").applyInArrow(add, "i int, v binary").collect()
    m = np.array([np.frombuffer(r["v"]) for r in sorted(got, key=lambda r: r["i"])])
    return m[:-1, :-1], m[:-1, -1]


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing shares of ones over ordered bins; each bin starts from a weak prior."""
    prior = ones.sum() / max(n.sum(), 1)
    blocks: list[list[float]] = []
    for w, s in zip(n + 1e-3, ones + 1e-3 * prior):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / w) for w, s, k in blocks])


BINS = 512


class Model:
    """Weights over Features, and calibrated probabilities at the histogram's bins."""

    def __init__(self, features: Features, weights: np.ndarray):
        self.features, self.weights, self.levels = features, weights, None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        at = (raw + 0.5) / 2 * BINS - 0.5
        p = np.interp(at, np.arange(BINS), self.levels)
        return np.clip(0.998 * p + 0.002 * (raw + 0.5) / 2, 0, 1)  # the small term keeps the order inside a pooled block


def fit(rows: DataFrame, n_random: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 11) -> Model | float:
    """A model from rows (statistics, y 0.0/1.0); a constant if the rows have fewer than two classes."""
    got = rows.agg(F.count("*"), F.avg("y"), *[F.avg(s) for s in STATISTICS], *[F.stddev_pop(s) for s in STATISTICS]).first()
    if not got[0] or got[1] in (0.0, 1.0):
        return 0.5 if not got[0] else float(got[1])
    k = len(STATISTICS)
    features = Features(np.array(got[2 : 2 + k]), np.array(got[2 + k :]), n_random, width, seed)
    a, b = normal_equations(rows, features)
    model = Model(features, np.linalg.solve(a + ridge * got[0] * np.diag(np.r_[np.full(len(a) - 1, 1.0), 1e-9]) * 0.1, b))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(((model.raw(_matrix(batch)) + 0.5) / 2 * BINS).astype(np.int32), 0, BINS - 1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            n, ones = np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)
            some = np.flatnonzero(n)
            yield pa.record_batch({"bin": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64()), "ones": pa.array(ones[some])})

    n, ones = np.zeros(BINS), np.zeros(BINS)
    for r in rows.mapInArrow(bins, "bin int, n long, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():
        n[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    model.levels = isotonic(np.arange(BINS), n, ones)
    return model


def score(stats: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score of rows of statistics."""
    if isinstance(model, float):
        return stats.select("doc_id", F.lit(model).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(_matrix(batch)))})

    return stats.mapInArrow(run, "doc_id long, score double")


def train(stats: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model | float:
    """A model from rows of statistics and `labels` (doc_id, quality) outside the held-out fold."""
    y = labels.where(F.col("quality").isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    return fit(cut(stats.join(y, "doc_id").drop("doc_id")))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of all `docs`, learnt from `labels` (doc_id, quality) outside the held-out fold."""
    stats = cut(with_statistics(docs))
    out = score(stats, train(stats, labels, folds, held_out))
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, all columns as they are. Texts aren't shuffled: they are scored where they are
    read, and Python gives back a truth value for each."""
    model = train(cut(with_statistics(docs)), labels)
    if isinstance(model, float):
        return docs if model >= threshold else docs.where("false")

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        scores = [model.score(statistics(data, offsets)) for _, data, offsets in _bytes.slices(text)]
        return pa.array(np.concatenate([np.zeros(0), *scores]) >= threshold, pa.bool_())

    return docs.where(good(F.col("text").cast("string")))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored by their zero statistics, long ones whole; repeated rows and ties get equal scores; labels of other values, or of held-out ids, don't train; an empty table gives no rows."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
