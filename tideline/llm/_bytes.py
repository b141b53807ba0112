"""Vectorised work on the UTF-8 bytes of an Arrow string column.

A column of texts is cut into slices of about half a megabyte (never inside a text).
Words, their hashes and their owners then come out of a handful of NumPy passes over
the bytes, so that a task needs memory for one slice and not for one Arrow batch.
Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

#: The six bytes that end a word (space, tab, line feed, vertical tab, form feed, carriage return).
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_UNMIX = [np.uint64(pow(m, -1, 1 << 64)) for m in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def unmix(x: np.ndarray) -> np.ndarray:
    """The integers that `mix` has spread."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * _UNMIX[0]
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * _UNMIX[1]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


#: Bytes of a block, and by how many of them a range's last block keeps, the mask of its integer.
BLOCK_BYTES = 8
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(BLOCK_BYTES)] + [2**64 - 1], np.uint64)


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yield (first row, bytes, offsets) for runs of rows of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: Bytes of letters: A-Z, a-z and all of multi-byte characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each word, and the row that it stands in. `inside`: by byte, whether it belongs to a word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = inside[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after)
    return first, last, np.searchsorted(offsets, first, "right") - 1


def _blocks(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges' bytes in integers of eight: the integers, each one's number in its range, and where each range begins among them."""
    size = last - first + 1
    count = (size + BLOCK_BYTES - 1) // BLOCK_BYTES
    begin = np.cumsum(count) - count
    number = np.arange(count.sum()) - np.repeat(begin, count)
    padded = np.zeros(len(data) + BLOCK_BYTES, np.uint8)
    padded[: len(data)] = data
    every = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    value = every[np.repeat(first, count) + number * BLOCK_BYTES]
    end = begin + count - 1
    value[end] &= _KEEP[size - (count - 1) * BLOCK_BYTES]
    return value, number.astype(np.uint64), begin


def range_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (ends included, none empty).

    Each block of eight bytes is mixed with its number before the sum, so that no arithmetic relation between texts carries over to their
    hashes, as it would to a polynomial's.
    """
    if not len(first):
        return np.zeros(0, np.uint64)
    value, number, begin = _blocks(data, first, last)
    mixed = mix(value + mix(number + np.uint64(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(mixed, begin) ^ mix((last - first + 1).astype(np.uint64)))


def distinct_ranges(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct byte range, and for each range which of these it equals. Ranges of one hash are told apart by their bytes."""
    _, at, back = np.unique(range_hashes(data, first, last), return_index=True, return_inverse=True)
    like = at[back]
    odd = (last - first) != (last - first)[like]
    same = np.flatnonzero(~odd & (like != np.arange(len(first))))
    if len(same):
        a, _, begin = _blocks(data, first[same], last[same])
        b, _, _ = _blocks(data, first[like[same]], last[like[same]])
        odd[same[np.add.reduceat((a != b).astype(np.int64), begin) > 0]] = True
    odd = np.flatnonzero(odd)
    if len(odd):  # a hash's second text: each such range stands for itself
        back[odd] = len(at) + np.arange(len(odd))
        at = np.r_[at, odd]
    return at, back


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each row."""
    out = np.zeros(len(column), np.int64)
    for at, data, offsets in slices(column):
        _, _, row = word_bounds(data, offsets)
        out[at : at + len(offsets) - 1] = np.bincount(row, minlength=len(offsets) - 1)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each row, ordered by row, then hash.

    A row with fewer words than `size`, but with one at least, has its whole word sequence as its only shingle.
    """
    data = lower(data)
    first, last, row = word_bounds(data, offsets)
    if not len(first):
        return row, np.zeros(0, np.uint64)
    words = range_hashes(data, first, last)
    step = np.uint64(0x9FB21C651E98DF25)
    n = len(words)
    rows, hashes = [], []
    if n >= size:
        whole = row[: n - size + 1] == row[size - 1 :]
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h = h * step + words[k : n - size + 1 + k]
        rows.append(row[: n - size + 1][whole])
        hashes.append(mix(h[whole]))
    count = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.cumsum(count) - count
    for r in np.flatnonzero((count > 0) & (count < size)):
        h = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for w in words[begin[r] : begin[r] + count[r]]:
                h = h * step + w
        rows.append(np.array([r]))
        hashes.append(mix(np.array([h ^ np.uint64(0xA5A5A5A5)], np.uint64)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    if np.any((h[order][1:] < h[order][:-1]) & (row[order][1:] == row[order][:-1])):  # 44 bits didn't tell two hashes of a row apart
        order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), ordered by row, then hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]
