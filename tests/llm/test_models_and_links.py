"""Classifiers by held-out accuracy, vector links against brute force, quotations, and the pipeline."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import forest, quality, quotes, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(rows, labels, held_out=True):
    hit = [r.predicted == labels[r.doc_id] for r in rows if r.held_out == held_out and labels.get(r.doc_id) is not None]
    return sum(hit) / len(hit)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, {r.doc_id: r.quality for r in labels.collect()}) > 0.9


def test_quality_without_labels_or_texts(spark):
    d = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "some words", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(d, none).collect()} == {0.5}
    assert quality.quality_scores(d.where("false"), none).count() == 0


def test_isotonic_is_monotone_and_pools():
    n, ones = np.array([4.0, 4, 4, 0, 4]), np.array([0.0, 3, 1, 0, 4])
    p = quality.isotonic(np.arange(5), n, ones)
    assert np.all(np.diff(p) >= -1e-12) and p[1] == pytest.approx(p[2]) and p[1] == pytest.approx(0.5, abs=0.01)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count() and accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()}) > 0.93


def test_counterfactual_penalty_lowers_identity_weights(spark):
    random.seed(1)
    filler = lambda: " ".join(random.choice(("the", "walks", "river", "stone", "under", "bright")) for _ in range(12))
    rows = [(i, f"{filler()} {'women scum' if i % 3 == 0 else 'women' if i % 9 == 1 else ''} {filler()}", int(i % 3 == 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, y int")
    chosen, w = toxicity.fit(d)
    neutral = spark.createDataFrame([(1, "the women walk by the river"), (2, "you scum"), (3, None), (4, "")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(neutral, chosen, w).collect()}
    assert s[1] < 0.5 < s[2] and s[3] == s[4] < 0.5
    assert toxicity.swap_terms("Women and black cats") == "men and white cats"


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    assert {r.score for r in toxicity.toxicity_scores(d, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.5}


def test_forest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 64))
    for i in range(0, 900, 3):
        x[i + 1] = x[i] + rng.normal(size=64) * rng.uniform(0.02, 0.3)
    x[600:900] = x[600] + rng.normal(size=(300, 64)) * 0.1  # a hot group
    label = np.arange(900) // 300
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(900)]
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [1.0, 2.0], 1), (1004, rows[0][1], None), (1005, rows[0][1], 0), (1006, [None] * 64, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit(1))
    got = {r.vec_id: r for r in forest.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    every = [(i, np.array(v), g) for i, v, g in rows if v is not None and len(v) == 64 and None not in v and np.all(np.isfinite(v)) and np.any(v) and g is not None]
    u, ids, g = np.array([v / np.linalg.norm(v) for _, v, _ in every]), [i for i, _, _ in every], np.array([g for _, _, g in every])
    near = (u @ u.T >= 0.98) & (g[:, None] == g[None, :])
    np.fill_diagonal(near, False)
    n = near.sum(1)
    found = np.array([got[i].n_links for i in ids])
    assert np.all(found <= n) and found.sum() >= 0.97 * n.sum() and n.sum() > 50_000
    for i in (1000, 1001, 1002, 1003, 1004, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[1005].component_id == 0 and not got[1005].kept
    assert forest.near_duplicates(d.where("false")).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "a", "> Hello there\n> How are you?\nFine, thanks."), (1, 2, "b", "> > hello THERE\n> > how are you\n> Fine thanks\nGreat"),
        (1, 3, "c", "> How are you?\nAlso fine"), (1, 4, "d", "> never said\nhm"), (2, 0, "u", None), (2, 1, "u", ""), (2, 1, "u", ""), (None, 0, "x", "> q\nt"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(3))
    got = {(r.conv_id, r.turn, r.role): r for r in quotes.format_chats(d).collect()}
    one = [got[1, t, r] for t, r in ((0, "user"), (1, "a"), (2, "b"), (3, "c"), (4, "d"))]
    assert [r.text for r in one] == ["Hello there\nHow are you?", "Fine, thanks.", "Great", "Also fine", "hm"]
    assert [r.reply_to for r in one] == [None, 0, 1, 0, 3] and [r.n_linked for r in one] == [0, 1, 2, 1, 0]
    assert [r.depth for r in one] == [0, 1, 2, 1, 1] and [r.position for r in one] == [0, 1, 2, 3, 4]
    assert quotes.format_chats(d).count() == len(rows) and quotes.format_chats(d.where("false")).count() == 0


def test_quotes_of_some_lines_and_messages_without_conversation(spark):
    from tideline.llm import quotes

    rows = [
        (1, 0, "a", "one\ntwo\nthree\nfour"), (1, 1, "b", "something else"), (1, 2, "c", "> two\n> three\nI agree"), (1, 3, "d", "> not said\n> something else\nno"), (1, 4, "e", "> one\n> two\n> three\n> four\nall"),
        (None, 0, "x", "> q\nmy own\nwords"), (None, 0, "y", "my own\nwords"), (None, 1, "z", None),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.role: r for r in quotes.format_chats(d).collect()}
    assert [got[k].reply_to for k in "abcde"] == [None, 0, 0, 1, 0] and [got[k].n_linked for k in "abcde"] == [0, 0, 1, 1, 1]
    assert [got[k].depth for k in "abcde"] == [0, 0, 1, 1, 1]
    assert sorted(got[k].position for k in "abcde") == list(range(5)) and got["c"].text == "I agree"
    assert [got[k].text for k in "xyz"] == ["my own\nwords", "my own\nwords", ""] and [got[k].n_quotes for k in "xyz"] == [1, 0, 0]
    assert all(got[k].reply_to is None and got[k].n_linked == got[k].depth == got[k].position == 0 for k in "xyz")


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    one = p.STAGES[0][1](spark, docs, SF).cache()
    kept = {r.doc_id for r in one.select("doc_id").collect()}
    assert one.columns == docs.columns and sum(labels[d] == 1 and d not in kept for d in labels) < 10
    two = p.STAGES[1][1](spark, one, SF).cache()
    assert two.columns == docs.columns and 0 < two.count() < one.count() and two.select("text").distinct().count() == two.count()
    three = p.STAGES[2][1](spark, two, SF).cache()
    assert three.count() == two.count() and three.where("text like '%[SECRET]%'").count() > 0
    four = p.STAGES[3][1](spark, three, SF).cache()
    times = collections.Counter(r.doc_id for r in four.select("doc_id").collect())
    assert max(times.values()) == 2 and set(times) <= {r.doc_id for r in three.select("doc_id").collect()}
    five = p.STAGES[4][1](spark, four, SF)
    assert five.count() == four.count() and five.where("not round_trip").count() == 0
