"""Targets of small and heavy-tailed sources, and quotes of messages that begin and end alike."""

import itertools
import random

import numpy as np
import pytest

from tideline.llm import mixing, quotes


def reachable(sizes, n, cap):
    """All sums of words that copies of documents can give (as a set), for few documents."""
    sums = {0}
    for x, k in zip(sizes, n):
        sums = {s + x * c for s in sums for c in range(cap * k + 1)}
    return sums


@pytest.mark.parametrize("seed", range(12))
def test_gap_against_all_sums(seed):
    """No giving, taking or exchanging brings the sum closer, and the best sum of all is seldom closer."""
    rng = np.random.default_rng(seed)
    size = np.unique(np.r_[rng.integers(1, 60, 9), rng.integers(300, 4000, 3)])
    n = rng.integers(1, 4, len(size))
    held = np.array([rng.integers(0, 2 * k + 1) for k in n])
    target = float(rng.integers(0, int(2 * size @ n))) + 0.5
    got = mixing.close_gap(size, n, held, target - float(size @ held), 2)
    assert (got >= 0).all() and (got <= 2 * n).all()
    gap = target - float(size @ got)
    movable = size[got < 2 * n] if gap > 0 else size[got > 0]
    assert not len(movable) or abs(gap) <= movable.min() / 2
    best = min(abs(target - s) for s in reachable(size.tolist(), n.tolist(), 2))
    assert abs(gap) <= best + size.min() / 2


def test_sources_of_few_documents(spark):
    """The longest documents outweigh the rest; every source still ends within half a document of its target."""
    random.seed(11)
    rows = []
    for s in ("a", "b", "c", None):
        sizes = [random.randint(1, 400) for _ in range(58)] + [random.randint(5000, 9000) for _ in range(2)]
        rows += [(f"{s}{k}", s, n) for k, n in enumerate(sizes)]
    d = spark.createDataFrame([(i, "w " * n, s) for i, (_, s, n) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r["source"] == s]
        gap = mine[0]["target"] - sum(r["taken"] for r in mine)
        assert all(0 <= r["copies"] <= 2 for r in mine)
        movable = [r["size"] for r in mine if (r["copies"] < 2 if gap > 0 else r["copies"] > 0)]
        assert abs(gap) <= 1e-6 or not movable or abs(gap) <= min(movable) / 2
        assert abs(gap) <= 1.0


def test_many_sources_fill_up_one_by_one(spark):
    """A chain of sources of growing size: each level fills the next one."""
    d = spark.createDataFrame([(k, "w " * int(1.35**k + 1), f"s{k:03d}") for k in range(26)], "doc_id long, text string, source string")
    rows = mixing.mix(d).collect()
    total = sum(r["source_size"] for r in rows)
    assert sum(r["target"] for r in rows) == pytest.approx(1.5 * total)
    weight = dict(zip(sorted(r["source"] for r in rows), itertools.cycle((3, 1, 2))))
    level = [r["target"] / weight[r["source"]] for r in rows if r["target"] < 2 * r["source_size"] - 1e-9]
    assert all(x == pytest.approx(level[0]) for x in level)
    assert all(r["target"] / weight[r["source"]] <= level[0] + 1e-9 for r in rows)


def chats(spark, rows):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, msg string, level int")
    return {(r.conv_id, r.turn): (r.reply_to, r.text) for r in quotes.format_chats(d).collect()}


def test_most_lines_decide(spark):
    rows = [(1, 0, "u", "Hi all,\nfirst topic\nbye"), (1, 1, "u", "Hi all,\nsecond topic one\nbye"), (1, 2, "u", "> Hi all,\n> second topic one\nanswer"), (1, 3, "u", "> bye\nonly a greeting"), (1, 4, "u", "> Hi all,\n> first topic\nother")]
    got = chats(spark, rows)
    assert [got[1, k][0] for k in range(5)] == [None, 0, 1, 0, 0]
    # a line that stands in many messages has no vote: the rarer one decides although it comes later
    rows = [(2, k, "u", f"hello\n{k} own\nregards") for k in range(12)] + [(2, 12, "u", "> hello\n> 7 own\n> regards\nyes"), (2, 13, "u", "> hello\nwho")]
    got = chats(spark, rows)
    assert got[2, 12] == (7, "yes") and got[2, 13] == (0, "who")


def test_quotes_between_greetings_and_signatures(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(25):
        said = []
        for turn in range(rng.randint(2, 16)):
            own = ["Hi all,", *[f"{rng.randint(0, 10**9)} {conv} {turn} {k}" for k in range(rng.randint(1, 3))], f"Best, {rng.choice(['Ann', 'Bo', 'Cy'])}"]
            text, parent = list(own), turn - 1 if turn else None
            if turn and rng.random() < 0.7:
                parent = rng.randrange(turn)
                own_lines = said[parent]
                a = rng.choice([0, 1])
                text = [f"> {x}" for x in own_lines[a : rng.randint(2, len(own_lines))]] + text
            said.append(own)
            rows.append((conv, turn, "u", "\n".join(text)))
            want[conv, turn] = (parent, "\n".join(own))
    assert chats(spark, rows) == want


def test_long_and_missing_messages(spark):
    rows = [(1, 0, "u", "word " * 60_000 + "\nlast line"), (1, 1, "u", "> last line\nyes"), (1, 1, "u", "> last line\nyes"), (1, None, None, None), (None, 0, "u", "> last line\nno")]
    got = chats(spark, rows)
    assert got[1, 1] == (0, "yes") and got[None, 0] == (None, "no") and got[1, None][1] == ""
    assert chats(spark, [(1, 0, "u", "x")])[1, 0] == (None, "x")
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.format_chats(d).count() == 0
