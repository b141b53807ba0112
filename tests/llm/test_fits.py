"""The classifiers' fits against direct solutions, and odd rows of op1, op3, op8 and op9."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, quality, toxicity, wordpiece


def test_normal_equations_are_the_direct_solution(spark):
    """Partition sums, ridge scores and calibration of random statistics, against NumPy on all rows at once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(quality.STATISTICS))) * rng.uniform(0.1, 5, len(quality.STATISTICS))
    y = (x[:, 0] + 0.3 * rng.normal(size=500) * x[:, 0].std() > 0).astype(float)
    d = spark.createDataFrame([(*r, t) for r, t in zip(x.tolist(), y.tolist())], ", ".join(f"{s} double" for s in quality.STATISTICS) + ", y double").repartition(7)
    model = quality.fit(d, n_random=32)
    features = quality.Features(x.mean(0), x.std(0), 32, 4.0, 11)
    f = features(x)
    a, b = quality.normal_equations(d, features)
    assert np.allclose(a, f.T @ f) and np.allclose(b, f.T @ y)
    penalty = np.sqrt(1e-3 * 500 * 0.1) * np.diag(np.r_[np.ones(f.shape[1] - 1), 0])
    w = np.linalg.lstsq(np.vstack([f, penalty]), np.r_[y, np.zeros(f.shape[1])], rcond=None)[0]
    assert np.allclose(model.raw(x), np.clip(f @ w, -0.5, 1.5), atol=1e-6)
    at = np.clip(((model.raw(x) + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    shares = quality.isotonic(np.arange(quality.BINS), np.bincount(at, minlength=quality.BINS).astype(float), np.bincount(at, y, quality.BINS))
    assert np.allclose(model.levels, shares)


def test_logistic_weights_by_plain_descent():
    """The penalised optimum is where a slow descent on the written-out loss ends."""
    rng = np.random.default_rng(5)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0.5, 0, 1, -2] - 0.3)))).astype(float)
    v, change, times = rng.uniform(0.2, 2, 300), rng.choice([-1.0, 0.0, 1.0], (40, 6)), rng.uniform(0.5, 2, 40)
    got = toxicity.fit_logistic(x, y, change, v, times, ridge=0.15, fairness=2.0)

    def gradient(w):
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        g = np.r_[x.T @ (v * (p - y)), (v * (p - y)).sum()]
        g[:-1] += 0.15 * w[:-1] + 2.0 * change.T @ (times * (change @ w[:-1]))
        g[-1] += 1e-6 * w[-1]
        return g

    w = np.zeros(7)
    for _ in range(20_000):
        w -= 0.002 * gradient(w)
    assert np.abs(gradient(w)).max() < 1e-6 and np.allclose(got, w, atol=1e-5)


def rows_of(spark, extra=()):
    rng = random.Random(7)
    word = lambda: rng.choice(["river", "stone", "bright", "walks", "under", "the", "scum", "vile"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 60)))) for i in range(200)] + [(None, "no id"), (7, None), (8, ""), (9, "river " * 50_000), *extra]
    return spark.createDataFrame([(i, t, 0.5, True, 1, "x", 3) for i, t in rows], "doc_id long, text string, score double, held_out boolean, predicted int, h string, y int")


def labels_of(spark, name):
    return spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 1), (2, None), (3, 7), (None, 1)], f"doc_id long, {name} int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_odd_rows_of_the_classifiers(spark, kind):
    run = quality.quality_scores if kind == "quality" else toxicity.toxicity_scores
    d = rows_of(spark)
    got = run(d, labels_of(spark, kind)).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.7 if kind == "quality" else 0.5)) for r in got)
    assert {r.score for r in got if r.doc_id == 8} <= {r.score for r in got}
    # repeated rows change nothing in what toxicity learns, and equal texts get equal scores
    more = run(rows_of(spark, [(5, "river stone scum")] * 300 if kind == "quality" else [(10_000 + k, "river stone scum") for k in range(300)]), labels_of(spark, kind)).collect()
    assert len(more) == 504 and len({r.score for r in more[-300:]}) >= 1
    assert run(d.where("false"), labels_of(spark, kind)).count() == 0


def test_repeated_ids_train_once(spark):
    d = rows_of(spark).where("doc_id is not null")
    one = {r.doc_id: r.score for r in toxicity.toxicity_scores(d.dropDuplicates(["doc_id"]), labels_of(spark, "toxic")).collect()}
    again = toxicity.toxicity_scores(d.dropDuplicates(["doc_id"]).crossJoin(spark.range(5).select(F.lit(1).alias("again"))), labels_of(spark, "toxic")).collect()
    assert len(again) == 5 * len(one) and all(r.score == pytest.approx(one[r.doc_id]) for r in again)


def test_odd_rows_of_the_tokenizers(spark):
    d = spark.createDataFrame([(1, "Some words, twice"), (1, "Some words, twice"), (None, "Some words, twice"), (2, None), (3, ""), (4, "word " * 40_000)], "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("n_tokens", "ids", "word", "h")})
    vocabulary = bpe.default_vocabulary()
    encoder = bpe.Encoder(spark, d, vocabulary)
    got = bpe.decode(bpe.encode(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), encoder), encoder).collect()
    assert len(got) == 6 and all(r.decoded == r.text for r in got)
    assert len({tuple(r.ids) for r in got if r.text.startswith("Some")}) == 1
    none = d.where("false").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    empty = bpe.Encoder(spark, none, vocabulary)
    assert bpe.decode(bpe.encode(none, empty), empty).count() == 0
    pieces = wordpiece.read_pieces(wordpiece.default_vocabulary())
    counts = wordpiece.token_counts(d, pieces).collect()
    n = {(r.doc_id, r.n_tokens) for r in counts}
    assert len(counts) == 6 and len({k for i, k in n if i in (1, None)}) == 1 and {(2, 0), (3, 0)} <= n
    assert wordpiece.token_counts(d.where("false"), pieces).count() == 0
