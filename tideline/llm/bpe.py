"""Byte-level BPE: exact encoding and decoding with a published vocabulary.

Encoding has three parts.

1. The corpus' words (the vocabulary's pre-tokens) are counted by one aggregation over all documents; the `lexicon_words`
   most frequent go to the driver (a bound that doesn't depend on the corpus), are merged there and compiled into a minimal
   acyclic transducer: states with equal futures are shared, and the numbers on a word's path add up to its place in the
   table of id lists.
2. The transducer's arrays are one file, which Spark gives to every executor and which tasks map into memory.
3. Each task cuts its texts into words with array operations, runs a slice's distinct words through the transducer in
   lockstep, and merges the words that it doesn't hold exactly, by merge rank.

Decoding concatenates the bytes of the ids; invalid UTF-8 becomes U+FFFD.

Null and empty texts give no ids and decode to an empty text. `<|endoftext|>` in a text is the special token, as the library
has it. Very long words are merged with a heap; long texts are encoded whole. Repeated rows and rows with a null id are rows like others; words that tie in frequency go by their bytes, which
decides what the transducer holds and not the ids. An empty table gives an empty result. Extra columns of the input stay as they are.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes
from tideline.llm._common import cut, small_batches, table, texts

#: The contraction endings that are words of their own after an apostrophe, in order of precedence.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        out[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def words(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte and row of each pre-token, and whether it is the special token."""
    n_bytes = len(data)
    none = np.zeros(0, np.int64)
    if not n_bytes:
        return none, none, none, none.astype(bool)
    raw = data.tobytes()
    edges, specials = offsets, none
    if special and special in raw:
        found, at = [], raw.find(special)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            inside = bool(at + len(special) <= offsets[row + 1])
            found += [at] * inside
            at = raw.find(special, at + (len(special) if inside else 1))
        specials = np.array(found, np.int64)
        edges = np.unique(np.r_[offsets, specials, specials + len(special)])
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    cls = _classes()[cp]
    row_start = np.zeros(n + 1, bool)
    row_start[np.searchsorted(pos, edges)] = True
    row_start[0] = row_start[n] = True
    new = row_start[:n].copy()
    new[1:] |= cls[1:] != cls[:-1]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], n]
    kind = cls[s]
    opens, closes = row_start[s], row_start[e]
    blank = cp == 0x20
    joined = np.zeros(len(s), bool)  # a space before the run belongs to it
    joined[1:] = ~opens[1:] & (kind[1:] != SPACE) & blank[s[1:] - 1]
    token = np.zeros(n + 1, bool)
    solid = kind != SPACE
    token[s[solid] - joined[solid]] = True
    gap = ~solid
    long = gap & (e - s > 1)
    token[s[long]] = True
    inner = gap & ~closes
    ends_blank = blank[e - 1]
    token[e[inner] - 1] = True  # the last one stands alone, or starts the next word if it is a space
    token[s[gap & closes]] = True
    token[s[inner & (e - s == 1) & ~ends_blank]] = True
    # contractions
    k = np.flatnonzero((kind[1:] == LETTER) & ~opens[1:] & (kind[:-1] == OTHER) & (e[:-1] - s[:-1] == 1) & ~joined[:-1]) + 1
    k = k[cp[s[k] - 1] == ord("'")]
    if len(k):
        a = cp[s[k]]
        b = np.where(s[k] + 1 < e[k], cp[np.minimum(s[k] + 1, n - 1)], 0)
        size = np.zeros(len(k), np.int64)
        for ending in reversed(CONTRACTIONS):
            hit = (a == ord(ending[0])) & ((b == ord(ending[1])) if len(ending) == 2 else True)
            size[hit] = len(ending)
        k, size = k[size > 0], size[size > 0]
        token[s[k]] = False
        rest = s[k] + size < e[k]
        token[s[k][rest] + size[rest]] = True
    if len(specials):
        is_special = np.zeros(n + 1, bool)
        begin = np.searchsorted(pos, specials)
        for b0, b1 in zip(begin, np.searchsorted(pos, specials + len(special))):
            token[b0 + 1 : b1] = False
            token[b0] = is_special[b0] = True
    first = np.flatnonzero(token[:n])
    last = np.r_[first[1:], n] - 1
    byte_end = np.r_[pos[1:], n_bytes]
    flag = is_special[first] if len(specials) else np.zeros(len(first), bool)
    return pos[first], byte_end[last] - 1, np.searchsorted(offsets, pos[first], "right") - 1, flag


class Vocabulary:
    """Byte strings by id and merges by rank, from a tokenizer's JSON file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = spec["model"]["vocab"]
        self.special = spec["added_tokens"][0]["content"].encode() if spec["added_tokens"] else b""
        self.special_id = spec["added_tokens"][0]["id"] if spec["added_tokens"] else -1
        size = max([*vocab.values(), self.special_id]) + 1
        self.tokens = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = bytes(to_byte[c] for c in t) if i != self.special_id else self.special
        if self.special_id >= 0:
            self.tokens[self.special_id] = self.special
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)
        self.bytes_ids = np.array([vocab[next(c for c, v in to_byte.items() if v == b)] for b in range(256)], np.int32)


NEVER = 1 << 62


def merge(word: bytes, byte_ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Ids of one word: the pair of lowest rank is merged first, the leftmost among equals.

    ranks: rank of the pair (a, b) at a << 32 | b; made: the id that a rank's pair becomes.
    """
    ids = [byte_ids[b] for b in word]
    get = ranks.get
    if len(ids) <= 200:
        rank = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while rank:
            low = min(rank)
            if low == NEVER:
                break
            i = rank.index(low)
            ids[i] = made[low]
            del ids[i + 1], rank[i]
            if i:
                rank[i - 1] = get(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(rank):
                rank[i] = get(ids[i] << 32 | ids[i + 1], NEVER)
        return ids
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(a << 32 | b for a, b in zip(ids, ids[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, p = heapq.heappop(heap)
        j = after[i]
        if j >= n or ids[i] < 0 or ids[j] < 0 or ids[i] << 32 | ids[j] != p:
            continue
        ids[i], ids[j] = made[rank], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (q := ids[x] << 32 | ids[y]) in ranks:
                heapq.heappush(heap, (ranks[q], x, q))
    return [i for i in ids if i >= 0]


def merge_table(merges: np.ndarray) -> tuple[dict[int, int], list[int]]:
    """ranks and made of `merge` from rows (left id, right id, merged id) in rank order."""
    rows = merges.reshape(-1, 3).tolist()
    return {a << 32 | b: r for r, (a, b, _) in enumerate(rows)}, [c for _, _, c in rows]


def compile_lexicon(sorted_words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, with numbers on the edges that add up to a word's place."""
    nodes: list[list] = [[False, []]]  # final?, [label, node]...
    shared: dict[tuple, int] = {}
    path = [0]
    previous = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to + 1:
            node = path.pop()
            key = (nodes[node][0], tuple(map(tuple, nodes[node][1])))
            if (same := shared.setdefault(key, node)) != node:
                nodes[path[-1]][1][-1][1] = same

    for w in sorted_words:
        common = 0
        while common < min(len(w), len(previous)) and w[common] == previous[common]:
            common += 1
        settle(common)
        for b in w[common:]:
            nodes.append([False, []])
            nodes[path[-1]][1].append([b, len(nodes) - 1])
            path.append(len(nodes) - 1)
        nodes[path[-1]][0] = True
        previous = w
    settle(0)
    place, order, stack = {}, [], [0]
    while stack:
        x = stack.pop()
        if x not in place:
            place[x] = len(order)
            order.append(x)
            stack.extend(t for _, t in nodes[x][1])
    below: dict[int, int] = {}

    def words_below(x: int) -> int:
        todo = [x]
        while todo:
            y = todo[-1]
            open_ = [t for _, t in nodes[y][1] if t not in below]
            if open_:
                todo.extend(open_)
            else:
                below[y] = nodes[y][0] + sum(below[t] for _, t in nodes[y][1])
                todo.pop()
        return below[x]

    words_below(0)
    keys, targets, numbers = [], [], []
    for x in order:
        number = int(nodes[x][0])
        for b, t in nodes[x][1]:
            keys.append(place[x] * 256 + b)
            targets.append(place[t])
            numbers.append(number)
            number += below[t]
    return {"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "numbers": np.array(numbers, np.int64), "final": np.array([nodes[x][0] for x in order], np.int64)}


def look_up(lexicon: dict[str, np.ndarray], data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of each byte range in the lexicon, -1 where it isn't a word of it. All ranges advance by a byte at a time."""
    keys = lexicon["keys"]
    out = np.full(len(first), -1, np.int64)
    if not len(keys):
        return out
    alive = np.arange(len(first))
    state, number = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    step = 0
    while len(alive):
        key = state * 256 + data[first[alive] + step]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        at, alive = at[hit], alive[hit]
        state, number = lexicon["targets"][at], number[hit] + lexicon["numbers"][at]
        step += 1
        done = last[alive] - first[alive] + 1 == step
        good = done & (lexicon["final"][state] == 1)
        out[alive[good]] = number[good]
        alive, state, number = alive[~done], state[~done], number[~done]
    return out


def _count(special: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        give = lambda: pa.record_batch({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
        for batch in batches:
            for _, data, offsets in _bytes.slices(batch.column("text")):
                first, last, _, flag = words(data, offsets, special)
                first, last = first[~flag], last[~flag]
                if not len(first):
                    continue
                at, back = _bytes.distinct_ranges(data, first, last)
                n = np.bincount(back, minlength=len(at))
                raw = data.tobytes()
                for a, b, k in zip(first[at].tolist(), last[at].tolist(), n.tolist()):
                    w = raw[a : b + 1]
                    counts[w] = counts.get(w, 0) + k
                if len(counts) > 50_000:  # memory; the next stage adds up
                    yield give()
                    counts = {}
        if counts:
            yield give()

    return run


def word_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word (binary), n: how often each pre-token occurs in all texts."""
    return docs.select("text").mapInArrow(_count(vocabulary.special), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, most: int) -> list[bytes]:
    """The most frequent words, at most `most`: all words from the count on, in steps of a sixteenth of an octave, that few enough reach."""
    counted = word_frequencies(docs, vocabulary).where("length(word) <= 64")
    counted = cut(counted.withColumn("step", F.floor(16 * F.log2("n")).cast("int")))
    lowest = total = 0
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):  # a few hundred rows at most
        total += n
        if total > most:
            lowest = step + 1
            break
    return [bytes(r["word"]) for r in counted.where(F.col("step") >= lowest).select("word").collect()]


class Encoder:
    """A compiled vocabulary and lexicon; `name` is a file that Spark has given to every executor."""

    def __init__(self, spark, docs: DataFrame, path: str, lexicon_words: int = 65_536):
        small_batches(spark)
        v = Vocabulary(path)
        listed = sorted(frequent_words(docs, v, lexicon_words))
        ranks, made = merge_table(v.merges)
        byte_ids = v.bytes_ids.tolist()
        ids = [merge(w, byte_ids, ranks, made) for w in listed]
        arrays = compile_lexicon(listed)
        arrays |= {"merges": v.merges, "byte_ids": v.bytes_ids, "special": np.frombuffer(v.special, np.uint8), "special_id": np.array([v.special_id])}
        arrays |= {"list_ends": np.cumsum([0, *map(len, ids)]), "list_ids": np.array([i for x in ids for i in x], np.int32)}
        arrays |= {"token_ends": np.cumsum([0, *map(len, v.tokens)]), "token_bytes": np.frombuffer(b"".join(v.tokens), np.uint8)}
        self.name = f"bpe-{uuid.uuid4().hex}.bin"
        folder = tempfile.mkdtemp()
        head, at = {}, 0
        with open(os.path.join(folder, self.name), "wb") as f:
            for k, x in arrays.items():
                head[k] = (x.dtype.str, x.size, at)
                f.write(x.tobytes())
                f.write(b"\0" * (-x.nbytes % 8))
                at += x.nbytes + -x.nbytes % 8
        self.head = head
        spark.sparkContext.addFile(os.path.join(folder, self.name))

    def arrays(self) -> dict[str, np.ndarray]:
        """The arrays, mapped from the executor's copy of the file; once per Python worker."""
        if self.name not in _MAPPED:
            _MAPPED.clear()
            whole = np.memmap(SparkFiles.get(self.name), np.uint8, "r")
            x = {k: whole[at : at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in self.head.items()}
            x["ranks"], x["made"] = merge_table(x["merges"])
            x["byte_list"] = x["byte_ids"].tolist()
            x["cache"] = {}
            _MAPPED[self.name] = x
        return _MAPPED[self.name]


_MAPPED: dict[str, dict] = {}


def _ids_of(x: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a slice, and how many each row has."""
    n_rows = len(offsets) - 1
    first, last, row, flag = words(data, offsets, x["special"].tobytes())
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(n_rows, np.int64)
    at, back = _bytes.distinct_ranges(data, first, last)
    first, last, flag = first[at], last[at], flag[at]
    place = look_up(x, data, first, last)
    ends, known = x["list_ends"], place >= 0
    size = np.zeros(len(at), np.int64)
    size[known] = ends[place[known] + 1] - ends[place[known]]
    raw, cache, extra = data.tobytes(), x["cache"], []
    byte_list, ranks, made = x["byte_list"], x["ranks"], x["made"]
    unknown = np.flatnonzero(~known)
    places, sizes = [], []
    for a, b, special in zip(first[unknown].tolist(), (last[unknown] + 1).tolist(), flag[unknown].tolist()):
        if special:
            got = [int(x["special_id"][0])]
        else:
            w = raw[a:b]
            got = cache.get(w)
            if got is None:
                got = merge(w, byte_list, ranks, made)
                if len(cache) > 20_000:
                    cache.clear()
                if b - a <= 64:
                    cache[w] = got
        places.append(len(extra))
        sizes.append(len(got))
        extra += got
    size[unknown] = sizes
    pool = np.r_[x["list_ids"], np.array(extra, np.int32)] if extra else x["list_ids"]
    begin = np.zeros(len(at), np.int64)
    begin[known] = ends[place[known]]
    begin[unknown] = np.array(places, np.int64) + len(x["list_ids"])
    times = size[back]
    index = np.arange(times.sum()) + np.repeat(begin[back] - (np.cumsum(times) - times), times)
    return pool[index], np.bincount(row, weights=times, minlength=n_rows).astype(np.int64)


def encode(docs: DataFrame, encoder: Encoder, column: str = "ids") -> DataFrame:
    """`docs` with `column`, array<int>: the ids of its text."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema if f.name != column)}, `{column}` array<int>"
    names = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = encoder.arrays()
        for batch in batches:
            for at, data, offsets in _bytes.slices(batch.column("text")):
                n = len(offsets) - 1
                ids, count = _ids_of(x, data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, n) for c in names], lists], [*names, column])

    return docs.mapInArrow(run, schema)


def _decoded(ids: np.ndarray, ends: np.ndarray, x: dict) -> pa.Array:
    """Texts of lists of ids; `ends`: where each list ends, from 0."""
    begin = x["token_ends"][ids]
    size = x["token_ends"][ids + 1] - begin
    stop = np.r_[0, np.cumsum(size)]
    data = x["token_bytes"][np.arange(stop[-1]) + np.repeat(begin - stop[:-1], size)]
    offsets = stop[ends]
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
        inner = offsets[offsets < len(data)]
        if np.any((data[inner] & 0xC0) == 0x80):
            raise ValueError
        return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())
    except ValueError:
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.string())


def decode(df: DataFrame, encoder: Encoder, column: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with `out`, string: the text of the ids in `column` (null: empty)."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name != out)}, `{out}` string"
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = encoder.arrays()
        for batch in batches:
            at = 0
            lists = batch.column(column)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.r_[0, np.cumsum(size)]
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            while at < len(size):  # a bounded number of ids at a time
                to = min(max(int(np.searchsorted(total, total[at] + 500_000, "right")) - 1, at + 1), len(size))
                text = _decoded(ids[total[at] : total[to]], total[at : to + 1] - total[at], x)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, to - at) for c in names], text], [*names, out])
                at = to

    return df.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_encode_decode(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """A null text is empty and has no token; long texts are encoded whole; repeated and null ids are rows like others, equal texts have equal ids; an empty table gives no rows."""
    docs = texts(table(spark, sf_dir, "documents"), "doc_id")
    encoder = Encoder(spark, docs, path or default_vocabulary())
    both = decode(encode(docs, encoder).select("doc_id", "ids"), encoder)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
