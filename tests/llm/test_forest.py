"""Trees at the dimensions and cones of real embeddings: leaves stay small, and pairs at the threshold and above meet."""

import numpy as np
import pytest

from tideline.llm import forest


def vectors(n, dim, cone, pairs, seed=1):
    """n vectors, whose mean cosine is `cone`, and for the first `pairs` of them one with a cosine of 0.98 to 1."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / np.sqrt(dim)
    if cone:
        x = x * np.sqrt(1 / cone - 1) + np.eye(dim)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = rng.normal(size=(pairs, dim))
    v -= (v * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = rng.uniform(0.98, 1.0, (pairs, 1))
    return np.vstack([x, c * x[:pairs] + np.sqrt(1 - c * c) * v])


def indexed(x, pairs, trees=8, sample=32_768):
    """Products a row, largest leaf, share of the planted pairs that meet in a leaf."""
    picked = x[np.random.default_rng(0).permutation(len(x))[:sample]]
    met, products, largest = np.zeros(pairs, bool), 0, 0
    for k in range(trees):
        tree = forest.Tree(picked, len(x), (5, k, 1, 1), 256, 1.6, 0.98)
        for rows, _ in tree.leaves(x):
            inside = np.zeros(len(x), bool)
            inside[rows] = True
            met |= inside[:pairs] & inside[-pairs:]
            products, largest = products + len(rows) ** 2 / 2, max(largest, len(rows))
    return products / len(x), largest, met.mean()


@pytest.mark.parametrize("dim,cone", [(64, 0), (384, 0), (768, 0), (64, 0.89), (384, 0.89), (768, 0.7)])
def test_products_grow_in_proportion(dim, cone):
    small, large = (indexed(vectors(n, dim, cone, 200), 200) for n in (4000, 16_000))
    for products, largest, recall in (small, large):
        assert products < 2000 and largest <= 512 and recall >= 0.9
    assert large[0] < 1.5 * small[0]


def test_beyond_the_sample():
    """Most splits lie below the depth that the sample supports."""
    products, largest, recall = indexed(vectors(30_000, 64, 0, 200), 200, sample=1500)
    assert products < 6000 and recall >= 0.9


def test_groups_of_near_copies_stay_whole():
    """A third of all rows within the threshold of each other is one leaf in every tree; the others are split about it."""
    rng = np.random.default_rng(3)
    group = np.eye(128)[0] + rng.normal(size=(3000, 128)) * 0.005
    x = np.vstack([vectors(6000, 128, 0, 100), group / np.linalg.norm(group, axis=1, keepdims=True)])
    tree = forest.Tree(x, len(x), (5, 0, 1, 1), 256, 1.6, 0.98)
    leaves = [set(rows.tolist()) for rows, _ in tree.leaves(x)]
    copies = set(range(len(x) - 3000, len(x)))
    whole = max(leaves, key=lambda s: len(s & copies))
    assert len(whole & copies) > 2900 and sum(len(s) for s in leaves if s != whole) < 2.5 * len(x)


def test_labels_with_one_leaf_have_one_tree(spark):
    x = vectors(180, 384, 0.9, 20)
    d = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(d).collect()}
    link = x @ x.T >= 0.98
    assert all(got[i][0] == link[i].sum() - 1 for i in range(200))
