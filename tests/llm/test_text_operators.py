"""Operators on texts against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import _bytes, bpe, jaccard, mixing, rules, secrets, wordpiece

WORD = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORD, t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = words(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def texts():
    random.seed(7)
    base = [[random.choice("abcdefghij") + random.choice("klmnopqrst") for _ in range(random.randint(1, 90))] for _ in range(40)]
    out = [None, "", " \n\t", "One two", "one TWO", "word " * 9000]
    hot = [random.choice("xyz") * random.randint(1, 9) for _ in range(60)]
    for w in base:
        out.append(" ".join(w))
        for _ in range(random.randint(0, 3)):
            v = list(w)
            for _ in range(random.randint(0, 3)):
                v[random.randrange(len(v))] = random.choice("uvw") + random.choice("uvw")
            out.append(" ".join(v))
        if random.random() < 0.4:
            out.append(" ".join(w + hot))
    return out + out[5:12]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 5, 1, "r", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, rank int, row string, size int").repartition(5)


def test_word_and_shingle_bytes(texts):
    col = pa.array(texts)
    assert list(_bytes.word_counts(col)) == [len(words(t)) for t in texts]
    got = [0] * len(texts)
    for at, data, offsets in _bytes.slices(col, 700):
        for r in _bytes.shingle_sets(data, offsets)[0]:
            got[at + r] += 1
    assert got == [len(shingles(t)) for t in texts]


def brute_components(sets):
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {d: find(d) for d in sets}


def test_similar_documents(docs, texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert sum(want[i] != i for i in want) > 10


def test_merge_lists_across_batches():
    random.seed(1)
    for _ in range(150):
        nr = {d: random.randint(5, 9) << 32 | random.randint(0, 1) for d in range(6)}
        rows = [(h, d, nr[d]) for h, d in sorted((random.randint(0, 6), random.randint(0, 5)) for _ in range(random.randint(0, 40)))]
        batches, i = [], 0
        while i < len(rows):
            k = random.randint(1, 5)
            batches.append(pa.record_batch({n: pa.array([x[c] for x in rows[i : i + k]], pa.int64()) for c, n in enumerate(("h", "d1", "nr"))}))
            i += k
        out = [r for b in jaccard._merge_lists(75)(iter(batches)) for r in b.to_pylist()]
        lists = collections.defaultdict(list)
        for h, d, _ in rows:
            if d not in lists[h]:
                lists[h].append(d)
        assert sorted((r["h"], r["a"]) for r in out if r["h"] is not None) == sorted((h, x) for h, v in lists.items() if len(v) > 2 for x in v[1:])
        assert {(r["a"], r["b"]) for r in out if r["h"] is None} <= {tuple(sorted((v[0], x))) for v in lists.values() for x in v[1:]}


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert jaccard.similar_documents(none).count() == mixing.mix(none).count() == secrets.find_secrets(none).count() == rules.judge(none).count() == 0


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f", "x", "y"), (3, "a b c d e f", "x", "y"), (None, None, None, None)], "doc_id long, text string, source string, lang string")
    assert jaccard.similar_documents(d).count() == mixing.mix(d).count() == secrets.find_secrets(d).count() == rules.judge(d).count() == 3


def test_mix_meets_targets(spark):
    random.seed(3)
    rows = [(i, " ".join(["w"] * int(random.paretovariate(1.1) * 5)), None if i % 7 == 0 else f"s{i % 5}") for i in range(1500)] + [(9001, None, "s1"), (9002, "", "empty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total, weights = sum(len(words(t)) for _, t, _ in rows), {}
    for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or ""))):
        weights[s] = (3, 1, 2)[k % 3]
    size = {s: sum(r["size"] for r in v) for s, v in by.items()}
    left, open_, target = 1.5 * total, set(by), {}
    while True:
        t = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= t * weights[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: t * weights[s] for s in open_}
    for s, v in by.items():
        assert v[0].target == pytest.approx(target[s]) and v[0].source_size == size[s]
        assert abs(sum(r.taken for r in v) - target[s]) <= 0.01 * target[s] + 3
    again = {r.doc_id: r.taken for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t or "") if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16])


def test_secrets(spark):
    random.seed(2)
    parts = ["token", "PASSWORD", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH0123", "0123456789abcdef", "deadbeef", "secret", "\n", "é\U0001f600", "x", "-", "/"]
    texts = [None, ""] + ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(600)]
    d = spark.createDataFrame([(i, t, f"src{i % 3}", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(d)).collect()}
    for i, t in enumerate(texts):
        b = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in b).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[3] == k for x in b) for k in ("assign", "access", "hex")]


def test_copied_examples_are_told_from_live_secrets(spark):
    example, live = "token = 'exampleexample12'", "token = 'ownersecret99xyz'"
    rows = [(i, f"intro {example} end", f"owner{i}", "r") for i in range(8)] + [(8, f"a {live} b", "owner1", "r"), (9, "no secret", "owner2", "r"), (10, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("spans", F.lit(1))
    flags = {r.doc_id: [s.live for s in r.spans] for r in secrets.find_secrets(d).collect()}
    assert flags == {i: [False] for i in range(8)} | {8: [True], 9: [], 10: []}
    out = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert out[8] == "a token = '[SECRET]' b" and out[0] == rows[0][1] and out[10] is None and len(out) == 11


def brute_counts(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if re.search(WORD, x)]
    n, covered = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, docs, texts):
    random.seed(4)
    more = ["a b c d e", "a b c d e f", "a a a a a a"] + ["".join(random.choice(["a", "b", "c", " ", " ", "\n", "#", "é", "\U0001f600"]) for _ in range(random.randint(0, 80))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    for frame, have in ((d, more), (docs, texts)):
        got = {r.doc_id: r for r in rules.judge(frame).collect()}
        assert all(tuple(got[i][1:6]) == brute_counts(t) for i, t in enumerate(have))
        assert all(not r.kept or not r.base_failed for r in got.values())


def test_weak_supervision_rejects_what_one_precise_rule_sees(spark):
    random.seed(5)
    clean = [" ".join(random.choice("bcdfg") + random.choice("aeiou") + random.choice("mnrst") + random.choice("aeiou") for _ in range(60)) + "." for _ in range(150)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:15]] + [t.upper() for t in clean[15:30]]
    d = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in rules.judge(d).where("kept").collect()}
    assert kept == set(range(150))


def greedy(word, vocabulary):
    s, i, n = (*word, wordpiece.END), 0, 0
    while i < len(s):
        j = next((j for j in range(len(s), i, -1) if s[i:j] in vocabulary), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_longest_match_counts(spark):
    random.seed(5)
    for k in range(120):
        pieces = list({(bytes(random.choice(b"abc") for _ in range(random.randint(1, 5))), random.random() < 0.5) for _ in range(random.randint(1, 14))} | ({(bytes([c]), e) for c in b"abc" for e in (False, True)} if k % 2 else set()))
        vocabulary = {(*p, *([wordpiece.END] * e)) for p, e in pieces}
        w = [bytes(random.choice(b"abc") for _ in range(random.randint(1, 12))) for _ in range(40)]
        ends = np.cumsum([0, *map(len, w)])
        got = wordpiece.Automaton(pieces).lengths(np.frombuffer(b"".join(w), np.uint8), ends[:-1], ends[1:] - 1)
        assert list(got) == [greedy(x, vocabulary) for x in w]
    d = spark.createDataFrame([(1, "Ab c"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(d, [(b"a", False), (b"b", True)]).collect()}
    assert got == {1: (2, 3), 2: (0, 0), 3: (0, 0)}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    random.seed(3)
    parts = ["a", "s", "'", "re", "ll", " ", "  ", "\n", "\t", "1", "é", "!", "''", "　", "\xa0", "\x85", " ", "ß", "²", "Ⅷ", "中", "<|endoftext|>", "d", "'s", "\x1c", "​", "﻿", "\U0001f600", "<|end", "|>"]
    texts = [None, ""] + ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(1500)] + ["".join(random.choice("aeiourstnl") for _ in range(3000))]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    encoder = bpe.Encoder(spark, d, path, lexicon_words=200)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(d, encoder), encoder).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].decoded == library.decode(want, skip_special_tokens=False) and got[i].n == 1


def test_lexicon_numbers_words_and_shares_endings():
    w = sorted({(a + b + c).encode() for a in ("", "x", "xx") for b in ("ab", "abc", "cd") for c in ("ing", "ed", "")})
    lexicon = bpe.compile_lexicon(w)
    ends = np.cumsum([0, *map(len, w)])
    assert list(bpe.look_up(lexicon, np.frombuffer(b"".join(w), np.uint8), ends[:-1], ends[1:] - 1)) == list(range(len(w)))
    assert len(lexicon["final"]) < sum(map(len, w)) / 4
    assert list(bpe.look_up(bpe.compile_lexicon([]), np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([1]))) == [-1]
