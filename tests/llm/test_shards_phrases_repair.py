"""Shards, phrases and repaired conversations against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import _bytes, collocations, repair, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, key string"


def docs(spark, rows):
    """rows of (doc_id, text, lang), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", 0, -1, -1, "k") for i, t, lang in rows], DOCS)


# Shards


def plain_shards(rows, shards, slack, virtual, seed):
    """The ring's rule, one document at a time; rows: (position, size, crc)."""
    ring = sharding.Ring(shards, virtual, seed)
    total = sum(r[1] for r in rows)
    bound, load, out = (1 + slack) * total / shards, [0.0] * shards, {}
    places = list(zip(ring.places.tolist(), ring.owner.tolist()))

    def arc(position):
        return next((k for k, (at, _) in enumerate(places) if at >= position), 0)

    def clockwise(k):
        seen = []
        for step in range(len(places)):
            s = places[(k + step) % len(places)][1]
            if s not in seen:
                seen.append(s)
        return seen

    long = sorted((r for r in rows if r[1] > total * sharding.LONG_SHARE), key=lambda r: (-r[1], r[0], r[2]))
    for r in long:
        s = next((s for s in clockwise(arc(r[0])) if load[s] + r[1] <= bound), None)
        s = load.index(min(load)) if s is None else s
        load[s] += r[1]
        out[r] = s
    return out, load, bound


def test_long_documents_go_clockwise(spark):
    rng = random.Random(3)
    d = docs(spark, [(i, "x" * rng.choice([40, 50, 400, 3000]), "en") for i in range(400)])
    got = sharding.assign(d, shards=5, slack=0.05, virtual=16, seed=2)
    position = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(23)), 1)
    rows = [tuple(r) for r in got.select(position, "size", "text_crc32", "shard").collect()]
    want, load, bound = plain_shards([r[:3] for r in rows], 5, 0.05, 16, 2)  # here every document is long
    assert {r[:3]: r[3] for r in rows} == want
    assert max(load) <= bound


def test_short_documents_fill_shards_evenly(spark):
    n = 120_000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('a', cast(10 + id % 90 as int))").alias("text"))
    a = sharding.assign(d).cache()
    sums = a.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    mean = sum(r["b"] for r in sums) / 16
    assert len(sums) == 16 and max(r["b"] for r in sums) <= 1.0015 * mean and min(r["b"] for r in sums) >= 0.984 * mean
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 == r["d"] - 1 for r in sums)
    again = sharding.assign(d.repartition(7))
    assert a.exceptAll(again).count() == 0
    row = sharding.moved(a, sharding.assign(d, shards=17)).first()
    assert row["moved"] < 0.09 * row["bytes"] and row["between_old"] < 0.03 * row["bytes"]  # 1/17 has to move


def test_arcs_go_clockwise_when_full():
    ring = sharding.Ring(3, 4, 1)
    sums = np.full(12, 10)
    runs = sharding.place_arcs(ring, sums, np.zeros(3), 41.0)
    got = np.zeros(3)
    for k, r in enumerate(runs):
        at = 0.0
        for end, s in r:
            got[s] += min(end, 10.0) - at
            at = min(end, 10.0)
        assert at == 10.0
    assert got.sum() == 120 and got.max() <= 41
    # beyond its bound a shard's arcs start elsewhere: the first other shard clockwise that has room
    runs = sharding.place_arcs(ring, sums, np.array([41.0, 0, 0]), 61.0 + 41)
    assert all(r[0][1] == ring.owner[k] for k, r in enumerate(runs))


def test_odd_shards(spark):
    rows = [(1, None, None), (2, "", "en"), (None, "ä", "en"), (None, "ä", "en"), (3, "same", "en"), (3, "same", "en"), (3, "other", "en"), (4, "long " * 40_000, "en")]
    got = sharding.assign(docs(spark, rows))
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got.collect()) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert all(0 <= r["shard"] < 16 for r in got.collect())
    assert sharding.assign(docs(spark, [])).count() == 0


def test_one_key_holds_a_third(spark):
    d = docs(spark, [(None if i % 3 == 0 else i, "t" * 20, "en") for i in range(3000)])
    sums = [r["b"] for r in sharding.assign(d).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 16 and max(sums) <= 1.02 * sum(sums) / 16


def test_written_shards(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i}", "en") for i in range(200)], "doc_id long, text string, lang string")
    a = sharding.assign(d, shards=4)
    sharding.write(d, a, str(tmp_path / "out"), files_a_shard=2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert set(got.columns) == {"doc_id", "text", "lang", "shard", "slot"}
    assert got.select("doc_id", "shard", "slot").exceptAll(a.select("doc_id", "shard", "slot")).count() == 0 and got.count() == 200


# Phrases


def plain_phrases(rows, least, most, percent=100):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(x for x in re.split(r"[ \t]+", piece) if x)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    f = {k: v for k, v in f.items() if v >= least}
    covered = {}
    for (lang, w), a in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, w[i : i + k]
                covered[key] = max(covered.get(key, 0), a)
    out = {}
    for (lang, w), a in f.items():
        if len(w) == 1 or 100 * covered.get((lang, w), -1) >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:most]))


def phrase_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "of", "a", "new", "york", "city", "ö", "x-ray", "\x1f", "deep", "sea"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text + rng.choice(["", "new york city of a", "NEW YORK CITY deep sea the"]), rng.choice(["en", "de", None, "und", ""])))
    return rows + [(None, None, None), (-1, "", "en"), (-1, "of a " * 20_000, "en"), (5, "the of", "en"), (5, "the of", "en")]


@pytest.mark.parametrize("hot_rows,bucket_rows,hot_pairs", [(200_000, 400_000, 1_000_000), (50, 100, 1_000_000), (50, 100, 3)])
def test_phrases(spark, monkeypatch, hot_rows, bucket_rows, hot_pairs):
    """Also with few rows a bucket, with hot pairs, and with more of them than a task is told of."""
    for name, value in (("HOT_ROWS", hot_rows), ("BUCKET_ROWS", bucket_rows), ("HOT_PAIRS", hot_pairs)):
        monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows(1)
    got = sorted(map(tuple, collocations.collocations(docs(spark, rows), least=7, most=40).collect()))
    assert got == plain_phrases(rows, 7, 40)


@pytest.mark.parametrize("known", [1 << 22, 30, 4])
def test_tasks_send_no_suffix_that_is_counted_before(spark, monkeypatch, known):
    """Pairs and runs of three are counted before, so tasks send no suffixes of two or three words; but those with words or pairs that have no number."""
    monkeypatch.setattr(collocations, "KNOWN", known, raising=False)
    inner, sent = collocations._suffixes, spark.sparkContext.accumulator(0)

    def counting(*args):
        run = inner(*args)

        def counted(batches):
            for batch in run(batches):
                sent.add(sum(w == 0 for w in batch["w4"].to_pylist()))
                yield batch

        return counted

    monkeypatch.setattr(collocations, "_suffixes", counting)
    rows = phrase_rows(3)
    got = sorted(map(tuple, collocations.collocations(docs(spark, rows), least=7, most=1000).collect()))
    assert got == plain_phrases(rows, 7, 1000)
    assert (sent.value == 0) == (known > 30)


class Passing:
    """A filter that all keys pass, or none, in place of a shared one."""

    def __init__(self, all_pass):
        self.value = lambda keys: np.full(len(keys), all_pass)


@pytest.mark.parametrize("runs_pass,held_rows", [(True, 1 << 18), (False, 1 << 18), (True, 4)])
def test_a_task_sends_each_suffix_once(monkeypatch, runs_pass, held_rows):
    """Rows of a task follow its distinct suffixes and not its slices; a run of three that isn't frequent cuts a suffix; what isn't held any longer is sent in parts."""
    monkeypatch.setattr(collocations, "SLICE_BYTES", 64)
    monkeypatch.setattr(collocations, "HELD_ROWS", held_rows)
    texts = ["a new york city of the deep sea", "of the new york city", "one"] * 40
    batch = pa.record_batch({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)})
    sent = [pa.Table.from_batches([b]) for b in collocations._suffixes(Passing(True), Passing(runs_pass), 30, None, 5)(iter([batch.slice(0, 50), batch.slice(50)]))]
    want = Counter(tuple(w[i : i + (5 if runs_pass else 2)]) for t in texts for w in [t.split()] for i in range(len(w) - 1))
    got = pa.concat_tables(sent).select([f"w{k + 1}" for k in range(collocations.DEPTH)] + ["n"]).to_pylist()
    counts = Counter()
    for r in got:
        counts[tuple(r[f"w{k + 1}"] for k in range(collocations.DEPTH))] += r["n"]
    assert sorted(counts.values()) == sorted(want.values())
    assert sorted(sum(x != 0 for x in c) for c in counts) == sorted(map(len, want))
    assert len(got) == len(want) if held_rows > 4 else len(got) > len(want)


def test_mixed_bits_come_back():
    x = np.random.default_rng(3).integers(0, 1 << 64, 1000, np.uint64)
    assert (_bytes.unmix(_bytes.mix(x)) == x).all()


def test_covering_share_and_empty_tables(spark):
    rows = phrase_rows(2, 120)
    got = sorted(map(tuple, collocations.collocations(docs(spark, rows), least=5, most=1000, percent=60).collect()))
    assert got == plain_phrases(rows, 5, 1000, 60)
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, "too few words", "en"), (2, None, None)])).count() == 0


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(5)
    for size, kinds in ((1, 1), (2000, 3), (3000, 40), (500, 1)):
        words = rng.integers(1, kinds + 1, (collocations.DEPTH, size)).astype(np.uint64)
        length = rng.integers(1, collocations.DEPTH + 1, size)
        words[np.arange(collocations.DEPTH)[:, None] >= length] = 0
        n = rng.integers(1, 4, size)
        want = Counter()
        for k in range(size):
            for d in range(1, int(length[k]) + 1):
                want[tuple(words[:d, k].tolist())] += int(n[k])
        got = {}
        for at, places, d in collocations.frequent_prefixes(words, n, 9):
            for p, c in zip(at, places):
                assert tuple(words[:d, p].tolist()) not in got
                got[tuple(words[:d, p].tolist())] = int(c)
        assert got == {k: c for k, c in want.items() if c >= 9}


# Repaired conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_signature(rows):
    """Symbols and counts of one conversation's damaged rows, in order."""
    symbols, seen, counts = [], set(), Counter()
    for _, _, role, text in rows:
        solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        symbols.append((role[:1], fault))
    counts["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
    turns = [t for _, t, _, _ in rows if t is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return symbols, counts


def least_audit(symbols):
    """All audits by increasing cost: the least (cost, audit) whose roles have the wanted shape. Exponential; for short conversations."""
    best = None

    def walk(i, cost, audit, roles):
        nonlocal best
        if best and (cost, audit) > best and cost > best[0] or cost > 4 * len(symbols) or not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if i < len(symbols):
            role, fault = symbols[i]
            walk(i + 1, cost + 4, audit + "D", roles)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                walk(i + 1, cost + more, audit + "K", roles + (role or "?"))
                for r in "ua":
                    walk(i + 1, cost + 3 + more, audit + "R", roles + r)
        for r in "ua":
            walk(i, cost + 3, audit + "I", roles + r)

    walk(0, 0, "", "")
    return best


def edited(rows, audit):
    out, due, rest = [], "user", iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)[2:]
        if letter == "D":
            continue
        role = role if letter == "K" else due
        out.append((role, text))
        due = "assistant" if role[:1] == "u" else "user"
    return out


def test_every_short_signature():
    """All signatures of up to four rows over roles and faults, with the shared path, against all audits."""
    kinds = [(r, f) for r in ("s", "u", "a", "x") for f in ("", "truncated")] + [("u", "blank")]
    name = lambda role, fault: "x" if fault in ("blank", "duplicate") else (("o" if role == "x" else role).upper() if fault else ("o" if role == "x" else role))
    sample = [c for n in range(4) for c in itertools.product(kinds, repeat=n)] + random.Random(1).sample(list(itertools.product(kinds, repeat=4)), 150) + random.Random(2).sample(list(itertools.product(kinds, repeat=5)), 60)
    by = {"".join(name(*s) for s in c): c for c in sample}
    import pyarrow as pa

    batches = [pa.record_batch({"signature": pa.array(part)}) for part in np.array_split(np.array(sorted(by, key=lambda s: s[::-1]), object), 7) if len(part)]
    got = {r["signature"]: (r["cost"], r["audit"]) for b in repair._repairs(iter(batches)) for r in b.to_pylist()}
    assert len(got) == len(by)
    for s, symbols in by.items():
        assert got[s] == least_audit(symbols), s


def test_automaton_stays_small():
    auto = repair.Automaton()
    todo, seen = [auto.end], {auto.end}
    while todo:
        node = todo.pop()
        for symbol in "suaoSUAOx":
            to = auto.step(node, symbol)[0]
            if to not in seen:
                seen.add(to)
                todo.append(to)
    assert len(seen) == len(auto.costs) < 500


def conversation_rows():
    rng = random.Random(4)
    texts = ["Yes.", "No", "  ", None, "", "Why? ", "ok.\n", "é!", "a b c"]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(None, t, "user", "Hello.") for t in (None, 1, 2)] + [(77, None, "user", "a."), (77, None, "assistant", "b."), (78, None, "user", "only.")]
    return rows + [(79, 2, "user", "twice."), (79, 2, "user", "twice."), (79, 5, "assistant", "then.")] + [(80, 0, "user", "x" * 200_000 + ".")]


def test_repaired_conversations(spark):
    rows = conversation_rows()
    given = spark.createDataFrame([(*r, -1, "", 0) for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string, symbol int")
    damaged = repair.damage(given)
    found = repair.audits(damaged)
    got = {r["conv_id"]: r for r in repair.repaired(damaged, found, digest=True).collect()}
    whole = {}
    for r in repair.repaired(damaged, found).orderBy("conv_id", "position").collect():
        whole.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = sorted((r for r in plain_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        symbols, counts = plain_signature(mine)
        cost, audit = least_audit(symbols)
        r = got[conv]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == tuple(counts[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), conv
        assert (r["cost"], r["audit"]) == (cost, audit), conv
        after = edited(mine, audit)
        assert after == whole.get(conv, [])
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in after).encode()).hexdigest()


def test_long_and_empty_conversations(spark):
    n = 30_000
    given = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("line "), F.col("id"), F.lit(".")).alias("text"))
    damaged = repair.damage(given)
    r = repair.repaired(damaged, repair.audits(damaged), digest=True).first()
    rows = sorted(plain_damage([(7, t, "assistant" if t % 2 else "user", f"line {t}.") for t in range(n)]), key=lambda r: r[1])
    after = edited(rows, r["audit"])
    assert re.fullmatch("(ua)+", "".join(a[0] for a, _ in after)) and len(r["audit"].replace("I", "")) == len(rows)
    assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in after).encode()).hexdigest()
    none = given.where("false")
    assert repair.repaired(repair.damage(none), repair.audits(repair.damage(none)), digest=True).count() == 0
