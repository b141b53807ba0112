"""Structured texts against the hashes, decisions by row in the pipeline's stages, deep trees, and the counterfactual penalty."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tideline.llm import _bytes, bpe, forest, jaccard, mixing, quotes, secrets, toxicity


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s


@pytest.fixture(scope="module")
def pair():
    a = thue_morse(1024)
    return a, a.translate({97: 98, 98: 97})


def test_words_with_regular_structure_have_different_hashes(pair):
    w = [x.encode() for x in pair] + [b"a" * k for k in range(1, 40)]
    ends = np.cumsum([0, *map(len, w)])
    data = np.frombuffer(b"".join(w), np.uint8)
    assert len(np.unique(_bytes.range_hashes(data, ends[:-1], ends[1:] - 1))) == len(w)


def test_ranges_of_one_hash_are_told_apart(monkeypatch):
    w = [b"one", b"two", b"one", b"three", b"two"]
    ends = np.cumsum([0, *map(len, w)])
    monkeypatch.setattr(_bytes, "range_hashes", lambda data, first, last: np.zeros(len(first), np.uint64))
    at, back = _bytes.distinct_ranges(np.frombuffer(b"".join(w), np.uint8), ends[:-1], ends[1:] - 1)
    assert [w[at[k]] for k in back] == w


def test_structured_words_in_encoding_and_join(spark, pair):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    d = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, None)], "doc_id long, text string").coalesce(1)
    encoder = bpe.Encoder(spark, d, bpe.default_vocabulary(), lexicon_words=0)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(d, encoder), encoder).collect()}
    assert all(got[k].ids == library.encode(t, add_special_tokens=False).ids and got[k].decoded == t for k, t in ((1, pair[0]), (2, pair[1]), (3, "")))
    assert {r.component_id for r in jaccard.similar_documents(d).where("doc_id < 3").collect()} == {1, 2}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, d1 string, size int, row string, whole string, spans int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, null and empty texts, and columns named like the operators' own."""
    random.seed(11)
    words = lambda n: " ".join(random.choice("bcdfg") + random.choice("aeiou") + random.choice("lmnr") for _ in range(n))
    base = [words(60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(3, base[3], "en", "s0")] * 2 + [(3, words(40), "en", None), (None, base[5], "en", "s1"), (None, words(50), None, "s1"), (None, words(50), None, "s1")]
    rows += [(20, base[0] + " more", "en", "s2"), (21, None, "en", "s0"), (21, None, "en", "s0"), (22, "", "en", "s0"), (23, " \n", "en", "s0")]
    rows += [(1, "my token = 'q9Zk3vB7xW2mT5rY' here", "en", "s1"), (1, "no secret but a long enough sentence", "en", "s1"), (None, "password: 'h4Lq8Zt2Nc6Vx0Pd'", "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 7, "r", "w", 0) for r in rows], SCHEMA).repartition(3), rows


def test_one_row_of_each_group(spark, odd):
    d, rows = odd
    got = sorted(((r.doc_id, r.text) for r in p.ngram_jaccard_join(spark, d, "").collect()), key=str)

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    groups: list[list] = []
    want = [(i, t) for i, t, *_ in rows if not shingles(t)]
    for i, t, *_ in rows:
        if s := shingles(t):
            near = [g for g in groups if any(100 * len(s & shingles(x)) >= 75 * len(s | shingles(x)) for _, x in g)]
            groups = [g for g in groups if g not in near] + [sum(near, []) + [(i, t)]]
    want += [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    assert got == sorted(want, key=str)
    assert p.ngram_jaccard_join(spark, d, "").columns == d.columns


def test_redaction_stays_on_its_row(spark, odd):
    d, rows = odd
    got = sorted((str(r.doc_id), str(r.text)) for r in p.secret_scans(spark, d, "").collect())
    marked = lambda t: t and t.replace("q9Zk3vB7xW2mT5rY", "[SECRET]").replace("h4Lq8Zt2Nc6Vx0Pd", "[SECRET]")
    assert got == sorted((str(i), str(marked(t))) for i, t, *_ in rows)


def test_spans_of_a_text_with_many_matches(spark):
    t = " ".join(f"é0123456789abcde{i % 10}" for i in range(1500))
    r = secrets.find_secrets(spark.createDataFrame([(1, t, "a", "b")], "doc_id long, text string, source string, lang string")).first()
    assert [(s.start, s.end) for s in r.spans if s.kind == "hex"] == [(18 * i + 1, 18 * i + 17) for i in range(1500)]


def test_rows_are_repeated_as_the_mix_says(spark, odd):
    d, rows = odd
    out = p.mixing_sources(spark, d, "")
    assert out.columns == d.columns
    taken = {r["source"]: r["n"] for r in mixing.mix(d).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert {k: v for k, v in taken.items() if v} == got
    most = {}
    for i, t, _, s in rows:
        most[i, t, s] = most.get((i, t, s), 0) + 2
    assert all(r["count"] <= most[r["doc_id"], r["text"], r["source"]] for r in out.groupBy("doc_id", "text", "source").count().collect())


def test_stages_on_an_empty_table(spark, odd):
    none = odd[0].where("false")
    for stage in (p.ngram_jaccard_join, p.secret_scans, p.mixing_sources):
        assert stage(spark, none, "").columns == none.columns and stage(spark, none, "").count() == 0


def test_deep_trees_keep_recall_with_bounded_copies():
    """More vectors than the fitting sample holds, so that leaves lie below its depth."""
    rng = np.random.default_rng(5)
    n, dim = 40_000, 64
    x = rng.normal(size=(n, dim))
    x[1::2] = x[::2] + rng.normal(size=(n // 2, dim)) * 0.17  # cosines about 0.985
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = (u[::2] * u[1::2]).sum(1)
    near = np.flatnonzero(cosines >= 0.98)
    found, copies = np.zeros(n // 2, bool), []
    for k in range(8):
        t = forest.Tree(u[rng.choice(n, 2048, False)], n, (1, k), 256, 1.6)
        leaves = t.leaves(u)
        copies.append(sum(len(r) for r, _ in leaves) / n)
        for r, _ in leaves:
            here = np.zeros(n, bool)
            here[r] = True
            found |= here[::2] & here[1::2]
    assert max(copies) < 2.5 and found[near].mean() >= 0.9


def test_vectors_of_any_size_and_length(spark):
    rows = [(1, [1e200, 0.0, 1e200], "a"), (2, [1e200, 0.0, 1e200], "a"), (3, [1e-300, 0.0, 1e-300], "a"), (4, [1.0, 1.0], "a"), (5, [2.0, 2.0], "a"), (6, [1.0, 1.0], "b"), (None, [3.0, 3.0], "a"), (7, [], "a"), (8, [float("inf"), 1.0], "a")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("row", F.lit(0)).withColumn("g", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(d).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (2, 4, True), 5: (2, 4, False), None: (2, 4, False), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True)}


def test_the_penalty_takes_weight_off_identity_terms(spark):
    random.seed(1)
    filler = lambda: " ".join(random.choice(("the", "walks", "river", "stone", "under", "bright")) for _ in range(12))
    rows = [(f"{filler()} {'women scum' if i % 3 == 0 else 'women' if i % 9 == 1 else ''} {filler()}", int(i % 3 == 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "text string, y int")
    neutral = spark.createDataFrame([(1, "the women walk by the river"), (2, "the men walk by the river")], "doc_id long, text string")
    apart = {}
    for fairness in (0.0, 20.0):
        s = {r.doc_id: r.score for r in toxicity.score(neutral, *toxicity.fit(d, fairness=fairness)).collect()}
        apart[fairness] = abs(np.log(s[1] / (1 - s[1])) - np.log(s[2] / (1 - s[2])))
    assert apart[20.0] < 0.2 * apart[0.0]


def test_quotes_against_a_generator(spark):
    """Random conversations whose messages quote earlier ones, also at depth two; the generator knows who answers whom."""
    random.seed(8)
    rows, want = [], {}
    for conv in range(30):
        said: list[list[str]] = []
        for turn in range(random.randint(2, 9)):
            own = [f"{random.randint(0, 10**9)} words of {conv} {turn} line {k}" for k in range(random.randint(1, 4))]
            text, parent = list(own), turn - 1 if turn else None
            if turn and random.random() < 0.7:
                parent = random.randrange(turn)
                a = random.randrange(len(said[parent]))
                quoted = said[parent][a : a + random.randint(1, 3)]
                text = [f"> {x}" for x in quoted] + text
                if parent and random.random() < 0.4:
                    text = [f"> > {x}" for x in said[random.randrange(parent)][:1]] + text
            said.append(own)
            rows.append((conv, turn, "u", "\n".join(text)))
            want[conv, turn] = (parent, "\n".join(own))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.text) for r in quotes.format_chats(d).collect()}
    assert got == want
