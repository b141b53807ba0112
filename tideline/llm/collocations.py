"""Phrases that are more frequent than their parts would make them: suffix pointers, sorted by multikey three-way quicksort.

A text's pieces (between marks of punctuation and line ends) are runs of words; a phrase is a run of up to five words of a piece, and every place in a piece is
a suffix pointer. Everything is counted by language. Five passes over the texts:

1. Words are counted, exactly, by their text. From here on a word is a 64-bit key of its language and bytes.
2. Frequent words have numbers, and pairs of neighbours that are frequent words are counted by their two numbers: exactly, and the words can be told from the count's key.
3. Runs of three words, of which both pairs are frequent, are counted in the same way, by the numbers of their two pairs.
4. Runs of four, of which both runs of three are frequent, are counted by as many bits of their key as make 64 values for each word of the table: never too low, and what is
   too high is settled in pass 5.
5. A suffix is cut where its next pair, run of three or run of four isn't frequent: no frequent phrase reaches beyond. What is left repeats, so a task adds up its equal
   suffixes (HELD_ROWS of them at once) before it sends them. Most suffixes are cut after two or three words; no task sends these, as the passes before have told how many
   places each pair and run of three has: one row for each joins the longer suffixes, and what these leave of its places are the suffixes that end there. Suffixes are
   routed by their leading two words, so all of a phrase's places meet in one bucket; there the pointers are sorted by multikey three-way quicksort to five words at most.
   A partition of equal words is a phrase, and its size the phrase's count; a partition below the least count is abandoned, with all below it.

Buckets have a bounded size: a pair with more than HOT_ROWS places is routed by its whole suffix (the short ones too), its partial counts are kept whatever their size,
and one more grouped sum adds them up. Frequent runs reach the tasks as Bloom filters of at most 32 MB; more of them make a filter less sharp, never wrong,
because what passes by mistake is infrequent and abandoned in its bucket. Numbers of words and of pairs take 32 MB at most each: beyond KNOWN the rarer ones pass by a
filter, and what has them in it is counted by bits of a key and sent as suffixes. Keys of 64 bits stand for words after the first pass, so counts are exact unless two words of
the table share a key. Scores are whole numbers from decimals of 38 digits.

Null texts are empty, a null language is `und`. Long texts are read whole, and repeated rows count as often as they stand there; ties are ordered as the contract says, to the
phrase itself, so the result is one order. An empty table, and one without frequent phrases, gives no rows. Extra columns are ignored, whatever their names; ids aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tideline.llm import _bytes
from tideline.llm._common import by_key, cut, small_batches, table

#: Words of a phrase, at most.
DEPTH = 5
#: The bytes that end a piece and those that only end a word.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text that a task holds at once, beyond one text.
SLICE_BYTES = 1 << 22
#: Rows of a bucket; a pair with more places than HOT_ROWS is dealt to several buckets. Hot pairs that a task is told of: beyond so many, every pair counts as hot.
BUCKET_ROWS, HOT_ROWS, HOT_PAIRS = 400_000, 200_000, 1_000_000
#: Different suffixes that a task holds before it sends them, about.
HELD_ROWS = 1 << 18
#: Words of the table for each range of pair keys; a range is summed at once. Every slice sends a row for each range, so ranges are to be few.
PAIR_RANGE = 1_000_000
#: 64-bit words of a filter: so many at most (32 MB).
FILTER_WORDS = 1 << 22
#: Frequent words, and frequent pairs, that have numbers, at most (32 MB of keys).
KNOWN = 1 << 22

_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_INSIDE = ~_ENDS
_INSIDE[list(WORD_ENDS)] = False


def _languages(lang: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, number of each row's name, hash of each name."""
    coded = lang.fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = [b"\x00" + n.encode() for n in names]
    ends = np.cumsum([len(r) for r in raw])
    hashes = _bytes.range_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends - 1)
    return names, coded.indices.to_numpy(), hashes


def _spelled_keys(lang: pa.Array, word: pa.Array) -> pa.Array:
    """The keys of words, as `_words` has them; 0 for no word."""
    _, of_row, hashes = _languages(lang)
    raw = pc.fill_null(word.cast(pa.large_string()), "")
    at = np.flatnonzero(pc.utf8_length(raw).to_numpy() > 0)
    _, where, data = raw.buffers()
    ends = np.frombuffer(where, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    out = np.zeros(len(raw), np.uint64)
    if len(at):
        out[at] = _word_keys(np.frombuffer(data, np.uint8), ends[at], ends[at + 1] - 1, hashes[of_row[at]])
    return pa.array(out.view(np.int64))


def _word_keys(data: np.ndarray, first: np.ndarray, last: np.ndarray, lang: np.ndarray) -> np.ndarray:
    key = _bytes.mix(_bytes.range_hashes(data, first, last) ^ lang)
    key[key == 0] = 1  # 0: no word
    return key


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For slices of a batch: bytes, first and last byte of each word, its key, whether it goes on from the word before in one piece, and names and numbers of languages."""
    names, of_row, hashes = _languages(batch.column("lang"))
    for at, data, offsets in _bytes.slices(batch.column("text"), SLICE_BYTES):
        data = _bytes.lower(data)
        first, last, row = _bytes.word_bounds(data, offsets, _INSIDE)
        if not len(first):
            continue
        lang = of_row[at + row]
        key = _word_keys(data, first, last, hashes[lang])
        ends = np.cumsum(_ENDS[data])[first]
        goes_on = np.zeros(len(first), bool)
        goes_on[1:] = (row[1:] == row[:-1]) & (ends[1:] == ends[:-1])
        yield data, first, last, key, goes_on, names, lang


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of a slice's distinct words; and one row of each language, without a word, for all of its words."""
    for batch in batches:
        for data, first, last, key, _, names, lang in _words(batch):
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            ends = np.cumsum((last - first + 1)[at])
            begin = np.r_[0, ends[:-1]]
            text = data[np.repeat(first[at] - begin, ends - begin) + np.arange(ends[-1])]
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            total = np.bincount(lang, minlength=len(names))
            some = np.flatnonzero(total)
            yield pa.record_batch({
                "lang": pa.array(names).take(pa.array(np.r_[lang[at], some])), "word": pa.concat_arrays([words, pa.nulls(len(some), pa.string())]),
                "n": pa.array(np.r_[n, total[some]]),
            })


def joined_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _bytes.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def pair_bits(n: int) -> int:
    """Bits of a pair's key, for n words in all: few are to be shuffled, and pairs that share them are to be rare."""
    return min(max(n.bit_length() + 6, 16), 56)


def pair_keys(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return joined_keys(a, b) >> np.uint64(64 - bits)


def run_keys(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    return pair_keys(joined_keys(a, b), c, bits)


class Filter:
    """A Bloom filter over 64-bit keys, made by a grouped bit_or: three bits of one word a key. Its size follows the count of keys, to FILTER_WORDS."""

    def __init__(self, keys: DataFrame, count: int):
        size = 1 << min(max(int(count // 4).bit_length(), 10), FILTER_WORDS.bit_length() - 1)
        bit = lambda shift: f"shiftleft(1L, cast(shiftrightunsigned(key, {shift}) & 63 as int))"
        rows = keys.select(F.col("key").bitwiseAND(size - 1).alias("at"), F.expr(" | ".join(map(bit, self.SHIFTS))).alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.bits = np.zeros(size, np.uint64)
        self.bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    SHIFTS = (26, 34, 42)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(keys), np.uint64)
        for s in self.SHIFTS:
            mask |= np.uint64(1) << ((keys >> np.uint64(s)) & np.uint64(63))
        return self.bits[(keys & np.uint64(len(self.bits) - 1)).astype(np.int64)] & mask == mask


def _spread(key):
    """The column of keys, their bits spread as a filter needs them."""
    return F.arrow_udf(lambda key: pa.array(_bytes.mix(key.to_numpy().view(np.uint64)).view(np.int64)), LongType())(key)


class Numbers:
    """The numbers of frequent words (or pairs), places among their sorted keys; and keys of pairs that these make, from which both can be told.

    `rows` (key, n, numbered): only the numbered ones may have numbers.
    """

    SPREAD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    GATHER = tuple(np.uint64(pow(m, -1, 1 << 64)) for m in SPREAD)

    def __init__(self, rows: DataFrame):
        count, can = rows.agg(F.count("*"), F.count_if("numbered")).first()
        known = rows.where("numbered")
        if can > KNOWN:
            known = known.orderBy(F.desc("n"), "key").limit(KNOWN)
        self.keys = np.sort(known.select("key").toArrow()["key"].to_numpy().view(np.uint64))
        self.rest = Filter(rows.select(_spread("key").alias("key")), count) if count > len(self.keys) else None
        self.half = np.uint64(max(len(self.keys).bit_length(), 12))
        self.mask = np.uint64((1 << 2 * int(self.half)) - 1)
        self.bits = 2 * int(self.half) + (self.rest is not None)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, -1 without one; and whether it may be frequent."""
        number = np.full(len(key), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            number = np.where(self.keys[at] == key, at, -1)
        return number, number >= 0 if self.rest is None else (number >= 0) | self.rest(_bytes.mix(key))

    def pairs(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Keys of the pairs of words a and b, of the numbers i and j; those of words without a number are hashes, and beyond the others."""
        x = (i.astype(np.uint64) << self.half | j.astype(np.uint64)) * np.uint64(self.SPREAD[0]) & self.mask
        x = (x ^ x >> self.half) * np.uint64(self.SPREAD[1]) & self.mask
        other = np.flatnonzero((i | j) < 0)
        x[other] = pair_keys(a[other], b[other], self.bits - 1) | np.uint64(1 << self.bits - 1)
        return x

    def known(self, pair: np.ndarray) -> np.ndarray:
        return pair <= self.mask

    def told(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both words of known pairs."""
        x = pair * self.GATHER[1] & self.mask
        x = (x ^ x >> self.half) * self.GATHER[0] & self.mask
        return self.keys[x >> self.half], self.keys[x & self.mask >> self.half]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers with their lowest bytes first, then the next ones, and so on: what is small leaves runs of zeros, which a shuffle's compression takes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _frequent(key: np.ndarray, goes_on: np.ndarray, bits: int, words=None, pairs=None, runs=None, fours=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(at, key) of a slice's pairs of words that may be frequent; then, with the filter `pairs`, of runs of three, and with `runs`, of four and five words, of which both shorter runs pass.

    `words` and `pairs` are `Numbers`, of which the keys are made; without `words`, `pairs` is a filter, and keys are hashes of `bits` bits, as those of longer runs are.
    Runs of five have no key.
    """
    held = np.zeros(len(key) + DEPTH, bool)

    def neighbours(at: np.ndarray) -> np.ndarray:
        """The places that go on to the next one: both are in `at`."""
        held[:] = False
        held[at] = True
        return at[held[at + 1]]

    if words is None:
        at = np.flatnonzero(goes_on[1:])
        found = pair_keys(key[at], key[at + 1], bits)
    else:
        number, good = words.value(key)
        at = np.flatnonzero(good[:-1] & good[1:] & goes_on[1:])
        found = words.value.pairs(key[at], key[at + 1], number[at], number[at + 1])
    if pairs is None:
        return [(at, found)]

    lead = _bytes.mix(found)
    if words is None:
        good = pairs.value(lead)
    else:
        of, good = pairs.value(lead)
        pair, number = np.zeros(len(key), np.uint64), np.full(len(key), -1)
        pair[at], number[at] = lead, of
    out = [(at[good], found[good])]
    for size, passing in ((3, runs), (4, fours), (5, None)):
        at = neighbours(out[-1][0])
        if size == 3 and words is not None:
            found = pairs.value.pairs(pair[at], pair[at + 1], number[at], number[at + 1])
        elif size == 3:
            found = run_keys(key[at], key[at + 1], key[at + 2], bits)
        else:
            found = run_keys(joined_keys(key[at], key[at + 1]), key[at + 2], key[at + 3], bits) if size == 4 else at
        if passing is not None:
            good = passing.value(_bytes.mix(found))
            at, found = at[good], found[good]
        out.append((at, found))
        if runs is None:
            break
    return out


def _count_runs(words, bits: int, key_bits: int, ranges: int, *filters):
    """bucket, keys, n of a slice's distinct pairs of frequent words: a row for each range of keys, with the differences of neighbouring keys, and counts.

    With filters, those of its runs of three or four words of which both shorter runs pass. `key_bits`: those of a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, key, goes_on, _, _ in _words(batch):
                _, found = _frequent(key, goes_on, bits, words, *filters)[len(filters)]
                found, n = np.unique(found, return_counts=True)
                bucket = (found >> np.uint64(key_bits - ranges.bit_length() + 1)).astype(np.int64)
                begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(found) else np.zeros(0, np.int64)
                step = np.diff(found, prepend=np.uint64(0))
                step[begin] = found[begin]
                cuts = [*begin.tolist(), len(found)]
                yield pa.record_batch({
                    "bucket": pa.array(bucket[begin]), "keys": pa.array([_packed(step[i:j]) for i, j in zip(cuts, cuts[1:])], pa.binary()), "n": pa.array([_packed(n[i:j]) for i, j in zip(cuts, cuts[1:])], pa.binary()),
                })

    return run


def _sum_pairs(least: int):
    """key, n of the keys of each range that have `least` places, from the rows of `_count_pairs` sorted by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "bucket"):
            key = np.concatenate([np.cumsum(_unpacked(k)) for k in t["keys"].to_pylist()])
            n = np.concatenate([_unpacked(k) for k in t["n"].to_pylist()]).astype(np.int64)
            order = np.argsort(key)
            key = key[order]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.add.reduceat(n[order], begin)
            yield pa.record_batch({"key": pa.array(key[begin][n >= least].view(np.int64)), "n": pa.array(n[n >= least])})

    return run


def _slice_suffixes(key: np.ndarray, goes_on: np.ndarray, pairs, runs, bits: int, words=None, fours=None, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole, words, n): keys, words (DEPTH columns; 0: no word) and counts of a slice's distinct suffixes of two words or more, cut where a pair or a longer run doesn't pass its filter.

    Without those of two and three words that have been counted by numbers and don't begin with a hot pair: `_counted` has these.
    """
    (at, pair), (three, run), (four, _), (five, _) = _frequent(key, goes_on, bits, words, pairs, runs, fours)
    size = np.zeros(len(key), np.int8)  # words of the suffix at each place
    for k, places in enumerate((at, three, four, five)):
        size[places] = k + 2
    if words is not None and hot is not None:
        new = ~words.value.known(pair) | np.isin(_bytes.mix(pair), hot)  # to be sent whatever their length
        alone = np.ones(len(key), bool)
        alone[three] = ~pairs.value.known(run)
        at = at[new | np.where(size[at] == 3, alone[at], size[at] > 3)]
    size = size[at]
    w = np.zeros((len(at), DEPTH), np.uint64)
    w[:, 0], w[:, 1] = key[at], key[at + 1]
    whole = joined_keys(w[:, 0], w[:, 1])
    for k in range(2, DEPTH):
        goes = size > k
        w[goes, k] = key[at[goes] + k]
        whole = joined_keys(whole, w[:, k])
    whole, one, count = np.unique(whole, return_index=True, return_counts=True)
    return whole, w[one], count


def _added_up(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes of several slices as one, with the sum of their counts."""
    whole, one, of = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    return whole, np.concatenate([p[1] for p in parts])[one], np.bincount(of, np.concatenate([p[2] for p in parts]), len(whole)).astype(np.int64)


def _suffixes(pairs, runs, bits: int, hot: np.ndarray | None, buckets: int, words=None, fours=None):
    """bucket, hot, total, w1 to w5, n of a task's suffixes (`_slice_suffixes`), equal ones added up as far as HELD_ROWS reach."""

    def sent(parts: list[tuple]) -> pa.RecordBatch:
        whole, w, count = _added_up(parts)
        a, b = w[:, 0], w[:, 1]
        lead = _bytes.mix(pair_keys(a, b, bits) if words is None else words.value.pairs(a, b, words.value(a)[0], words.value(b)[0]))
        order = np.argsort(lead)  # neighbours that begin alike take less room in a shuffle
        whole, w, count, lead = whole[order], w[order], count[order], lead[order]
        warm = np.ones(len(lead), bool) if hot is None else np.isin(lead, hot)
        bucket = (np.where(warm, whole, lead) % np.uint64(buckets)).astype(np.int32)
        columns = {f"w{k + 1}": pa.array(np.ascontiguousarray(w[:, k]).view(np.int64)) for k in range(DEPTH)}
        return pa.record_batch({"bucket": pa.array(bucket), "hot": pa.array(warm), "total": pa.array(np.zeros(len(warm), bool))} | columns | {"n": pa.array(count)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for _, _, _, key, goes_on, _, _ in _words(batch):
                held.append(_slice_suffixes(key, goes_on, pairs, runs, bits, words, fours, hot))
                if sum(len(h[0]) for h in held) > HELD_ROWS:
                    held = [_added_up(held)]
                    if len(held[0][0]) > HELD_ROWS // 2:  # too many differ
                        yield sent(held)
                        held = []
        if held:
            yield sent(held)

    return run


def _counted(words, pairs, hot: np.ndarray, buckets: int):
    """Rows like those of `_suffixes`, one of each pair (with `pairs`: run of three) that numbers tell and that doesn't begin with a hot pair, with all of its places (`total`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column("found").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            known = (words if pairs is None else pairs).value.known(found)
            found, n = found[known], n[known]
            if pairs is None:
                lead = _bytes.mix(found)
                w = [*words.value.told(found)]
            else:
                lead, second = pairs.value.told(found)
                w = [*words.value.told(_bytes.unmix(lead)), words.value.told(_bytes.unmix(second))[1]]
            mine = ~np.isin(lead, hot)
            none = np.zeros(int(mine.sum()), np.int64)
            columns = [k[mine].view(np.int64) for k in w] + [none] * (DEPTH - len(w))
            bucket = (lead[mine] % np.uint64(buckets)).astype(np.int32)
            yield pa.record_batch({"bucket": pa.array(bucket), "hot": pa.array(none > 0), "total": pa.array(none == 0)} | {f"w{k + 1}": pa.array(c) for k, c in enumerate(columns)} | {"n": pa.array(n[mine])})

    return run


def _ending(words: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Counts of suffixes, where runs with all of their places (`total`) stand for those of their suffixes that aren't among the others: of three words, then of two."""
    n, size = n.copy(), np.where(total, np.where(words[2] == 0, 2, 3), DEPTH + 1)
    for k in (3, 2):
        begins = joined_keys(words[0], words[1])
        _, of = np.unique(begins if k == 2 else joined_keys(begins, words[2]), return_inverse=True)
        longer = np.bincount(of, np.where(size > k, n, 0)).astype(np.int64)
        n = np.where(size == k, n - longer[of], n)
    return n


def frequent_prefixes(words: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Multikey three-way quicksort of pointers to the columns of `words` (DEPTH rows; 0 ends a suffix), each standing for n places.

    Yields (pointers, counts, words): a pointer to each prefix of so many words that has `least` places or more. All partitions of a round are split at once, each by its own
    pivot into smaller, equal and larger; equal ones go on with the next word. Partitions with fewer than `least` places are abandoned.
    """
    ptr, size, depth = np.arange(words.shape[1]), np.array([words.shape[1]]), np.zeros(1, np.int64)
    while len(ptr):
        begin = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(size)), size)
        key = words[depth[seg], ptr]
        three = np.sort(key[np.stack([begin, begin + size // 2, begin + size - 1])], axis=0)
        pivot = three[1][seg]
        side = np.where(key == pivot, 1, np.where(key < pivot, 0, 2))
        part = 3 * seg + side
        sizes = np.bincount(part, minlength=3 * len(size))
        places = np.bincount(part, n[ptr], minlength=3 * len(size)).astype(np.int64)
        to = (np.cumsum(sizes) - sizes)[part]
        for k in range(3):  # each pointer's number among those of its part
            mine = side == k
            run = np.cumsum(mine) - mine
            to[mine] += (run - run[begin[seg]])[mine]
        out = np.empty_like(ptr)
        out[to] = ptr
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        first = np.cumsum(sizes) - sizes
        keep = (places >= least) & (sizes > 0)
        equal = np.flatnonzero(keep & (np.arange(len(sizes)) % 3 == 1))
        ended = three[1][equal // 3] == 0
        keep[equal[ended]] = False
        equal = equal[~ended]
        for d in np.unique(deeper[equal]):
            here = equal[deeper[equal] == d]
            yield out[first[here]], places[here], int(d)
        keep[equal[deeper[equal] == DEPTH]] = False
        ptr, size, depth = out[np.repeat(keep, sizes)], sizes[keep], deeper[keep]


def _sorted_buckets(least: int):
    """Rows sorted by bucket: words (keys), n of phrases of two words or more; of hot pairs whatever the count, as it is a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "bucket"):
            words = np.stack([t[f"w{k + 1}"].to_numpy().view(np.uint64) for k in range(DEPTH)])
            n, hot, total = (t[c].to_numpy() for c in ("n", "hot", "total"))
            for mine, floor in ((~hot, least), (hot, 1)):
                if not mine.any():
                    continue
                w = words[:, mine]
                for at, places, d in frequent_prefixes(w, _ending(w, n[mine], total[mine]) if total.any() else n[mine], floor):
                    if d > 1 and len(at):
                        flat = pa.array(w[:d, at].T.reshape(-1).view(np.int64))
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * len(at) + 1, d, dtype=np.int32)), flat)
                        yield pa.record_batch({"words": lists, "n": pa.array(places)})

    return run


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, languages): words (keys), n of every phrase of one to five words with `least` places; lang, word, key of frequent words; lang, n of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("lang", F.col("text").cast("string").alias("text"))
    counted = cut(docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull()).withColumn("key", F.arrow_udf(_spelled_keys, LongType())("lang", "word")))
    languages, vocabulary = counted.where("word is null").select("lang", "n"), counted.where("word is not null")

    n_words = languages.agg(F.sum("n")).first()[0] or 0
    bits = pair_bits(n_words)
    ranges = 1 << max((n_words // PAIR_RANGE).bit_length(), 6)

    def counted_runs(key_bits: int, *filters) -> DataFrame:
        sent = docs.mapInArrow(_count_runs(words, bits, key_bits, ranges, *filters), "bucket long, keys binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
        return cut(sent.mapInArrow(_sum_pairs(least), "key long, n long").select(F.col("key").alias("found"), _spread("key").alias("key"), "n"))

    words = Numbers(vocabulary.select("key", "n", F.lit(True).alias("numbered")))
    word_bits, all_told, words = words.bits, int(words.mask), spark.sparkContext.broadcast(words)
    pairs = counted_runs(word_bits)

    places, n_hot = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > HOT_ROWS, 1))).first()
    hot = None if n_hot > HOT_PAIRS else pairs.where(F.col("n") > HOT_ROWS).select("key").toArrow()["key"].to_numpy().view(np.uint64)
    buckets = int(places // BUCKET_ROWS) + 1
    good_pairs = Numbers(pairs.select("key", "n", (F.col("found") <= all_told).alias("numbered")))
    run_bits, good_pairs = good_pairs.bits, spark.sparkContext.broadcast(good_pairs)
    runs = counted_runs(run_bits, good_pairs)
    good_runs = _shared(spark, runs.select("key"))
    good_fours = _shared(spark, counted_runs(bits, good_pairs, good_runs).select("key"))
    columns = "bucket int, hot boolean, total boolean, " + ", ".join(f"w{k + 1} long" for k in range(DEPTH)) + ", n long"
    routed = docs.mapInArrow(_suffixes(good_pairs, good_runs, bits, hot, buckets, words, good_fours), columns)
    if hot is not None:
        routed = routed.union(pairs.mapInArrow(_counted(words, None, hot, buckets), columns)).union(runs.mapInArrow(_counted(words, good_pairs, hot, buckets), columns))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    longer = routed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_buckets(least), "words array<long>, n long")
    longer = longer.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    phrases = vocabulary.select(F.array("key").alias("words"), "n").union(longer)
    return cut(phrases), vocabulary.select("lang", "word", "key"), languages


def _shared(spark: SparkSession, keys: DataFrame):
    return spark.sparkContext.broadcast(Filter(keys, keys.count()))


def scored(phrases: DataFrame, vocabulary: DataFrame, languages: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no longer one covers."""
    size = F.size("words")
    long = phrases.where(size > 1)
    # what stands within a longer phrase, and how often the most frequent of these stands there
    span = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k)))))
    within = phrases.where(size > 2).select(span.alias("words"), "n").groupBy("words").agg(F.max("n").alias("covered"))
    kept = long.join(within, "words", "left").where(F.coalesce(100 * F.col("covered") < percent * F.col("n"), F.lit(True))).select("words", F.col("n").alias("a"))

    part = F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), F.slice("words", 1, k).alias("left"), F.slice("words", k + 1, F.size("words")).alias("right"))))
    cuts = kept.select("words", "a", part.alias("cut")).select("words", "a", "cut.*")
    parts = phrases.select(F.col("words").alias("part"), "n")
    cuts = cuts.join(parts.select(F.col("part").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("n").alias("r")), "right")
    cuts = cuts.join(vocabulary.select(F.col("key"), "lang"), F.element_at("words", 1) == F.col("key")).join(languages, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", (whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn("under", (whole("l") * whole("r")).cast("decimal(38,0)"))
    lowest = F.min(F.struct(F.expr("top div under").alias("score"), "k", "l", "r")).alias("low")
    found = cuts.groupBy("words", "lang", "a", "n").agg(lowest).select("words", "lang", "a", "low.l", "low.r", "n", "low.score")

    spelled = kept.select("words", F.posexplode("words").alias("i", "key")).join(vocabulary.select("key", "word"), "key")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    return found.join(spelled, "words").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of `docs` (text, lang)."""
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(*frequent_phrases(docs, least), percent).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """Null texts are empty, a null language is `und`; repeated rows count each; ties go by count, then phrase; an empty table gives no rows."""
    return collocations(table(spark, sf_dir, "documents"))
