"""Documents whose word-shingle sets are similar: an exact T-occurrence search over inverted lists (DivideSkip).

A document with n distinct shingles can only reach a Jaccard similarity of t with documents that hold at least
T = ceil(t * n) of its shingles. DivideSkip leaves the longest lists out of the merge and probes them afterwards. It is used twice.

Over the whole corpus, with the T - 1 longest lists left out: a partner then stands in at least one of the n - T + 1 short ones.

* List lengths come from a sketch of fixed size (counts of all documents' shingles by hash range), which orders shingles
  from rare to frequent. The order only decides which lists are long; any order gives the same result.
* Short lists are built by one shuffle on the shingle and merged in hash order within each partition, as a stream. Copies of one set are one
  entry. What comes out are families: sets that lists connect and that bounds don't tell apart. A bound never rejects a similar
  pair: it is the sets' sizes, and the Hamming distance of their parity bitmaps, which is at most the size of their symmetric
  difference; a bitmap has at least two bits a shingle. Families are found in two steps: every set against the first of its list (the list's center),
  then lists whose sets still are in several families, in full. So a group of near copies costs rows and not pairs.

In each family, with as many long lists left out as the cost rule says: each set travels once to its family's task (a family beyond a
fixed number of bytes is dealt to blocks, and each pair of blocks is a task). The family's own inverted lists are built; a set's short lists are merged with
counts of occurrence; sets that reach T less the number of long lists are candidates, and the long lists are probed for them by binary search until the
required overlap is reached or out of reach. Sets already joined aren't compared again, so that links leave a task as a spanning forest of its components.

Columns: one row per input row. Null and empty texts have no shingle and link with nothing; a text with 1 to 4 words is one
shingle. Ties and repeated rows are links like any other (similarity 1), null ids are rows like others and never a component's smallest id while there is another. Long texts
have large sets, whole. An empty table gives an empty result. Extra columns of the input are ignored by `similar_documents` and kept by `one_of_each`, whatever their names.
Hashes have 64 bits: the result is exact up to their collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tideline.llm import _bytes
from tideline.llm._common import by_key, components, cut, small_batches, table

#: Counters of the list-length sketch, and how many of them travel in one row.
SKETCH, BLOCK = 1 << 20, 1 << 12
#: Bits of a set's parity bitmap: at least so many, and at least two a shingle.
LEAST_BITS = 512
#: Sets of a list, and bytes of a family's sets, that one block holds.
LIST_BLOCK, FAMILY_BLOCK = 4096, 32 << 20
#: Bits of the filter that tells which documents' sets are wanted: sixteen a document between these bounds.
FILTER_LEAST, FILTER_MOST, FILTER_PARTS = 1 << 16, 1 << 27, 64


def _needed(n, percent: int):
    """Least overlap of a set of n with any similar set."""
    return -(-percent * n // 100)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for _, data, offsets in _bytes.slices(batch.column("text")):
            _, h = _bytes.shingle_sets(data, offsets)
            total += np.bincount((h >> np.uint64(64 - 20)).astype(np.int64), minlength=SKETCH)
    if total.any():
        blocks = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(-1, BLOCK)
        yield pa.record_batch({"block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array([b.tobytes() for b in blocks], pa.binary())})


def _add_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
    level = np.floor(2 * np.log2(total + 1)).astype(np.uint8)
    yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})


def list_levels(docs: DataFrame) -> np.ndarray:
    """Twice the log2 of how many (document, shingle) rows fall into each hash range: one byte a range, 1 MB in all."""
    rows = docs.select("text").mapInArrow(_sketch, "block int, counts binary").groupBy("block").applyInArrow(_add_blocks, "block int, levels binary").collect()
    out = np.zeros((SKETCH // BLOCK, BLOCK), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def _set_hashes(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit digest of each row's set."""
    count = np.bincount(row, minlength=n)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_bytes.mix(h ^ np.uint64(0x1234567)), out=sums[1:])
    ends = np.cumsum(count)
    return count, _bytes.mix(sums[ends] - sums[ends - count] + count.astype(np.uint64))


def _parity_maps(row: np.ndarray, h: np.ndarray, count: np.ndarray) -> pa.Array:
    """Bit i of a row's bitmap: whether an odd number of its hashes fall on i. The number of bits is a power of two that follows the size."""
    bits = np.where(count > 0, np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * count, 2))).astype(np.int64)), 0)
    end = np.cumsum(bits // 64)
    flat = np.zeros(end[-1] if len(end) else 0, np.uint64)
    place = h & (bits[row] - 1).astype(np.uint64)
    np.bitwise_xor.at(flat, (end - bits // 64)[row] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(np.r_[0, end * 8].astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps as those of `words` words: what falls on a bit of the shorter one is the parity of what falls on its bits in the longer one."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _apart(map_: bytes, others: list[bytes]) -> np.ndarray:
    """Hamming distances of one bitmap and others, each pair at the length of its shorter one."""
    out = np.zeros(len(others), np.int64)
    words = np.array([len(m) // 8 for m in others])
    own = np.frombuffer(map_, np.uint64)[None, :]
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        both = np.frombuffer(b"".join([others[i] for i in at]), np.uint64).reshape(len(at), w)
        least = min(int(w), own.shape[1])
        out[at] = np.bitwise_count(_folded(both, least) ^ _folded(own, least)).sum(1)
    return out


def _can_be_near(n: int, map_: bytes, sizes: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """Which of the other sets the bounds don't tell apart from the one of n shingles."""
    out = np.minimum(n, sizes) * 100 >= np.maximum(n, sizes) * percent
    at = np.flatnonzero(out)
    if len(at):
        out[at] = _apart(map_, [maps[i] for i in at]) * (100 + percent) <= (n + sizes[at]) * (100 - percent)
    return out


class Recent:
    """Keys seen lately, in a table of fixed size: what was pushed out of it counts as new again."""

    def __init__(self, slots: int = 1 << 16):
        self.keys = np.zeros(slots, np.uint64)

    def new(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        _, first = np.unique(keys, return_index=True)
        slot = (keys[first] % np.uint64(len(self.keys))).astype(np.int64)
        out[first] = self.keys[slot] != keys[first]
        self.keys[slot] = keys[first]
        return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for at, data, offsets in _bytes.slices(batch.column("text")):
            n = len(offsets) - 1
            row, h = _bytes.shingle_sets(data, offsets)
            count, a = _set_hashes(row, h, n)
            yield pa.record_batch({"doc_id": ids.slice(at, n), "n_shingles": pa.array(count, pa.int64()), "d1": pa.array(a.view(np.int64)), "map": _parity_maps(row, h, count)})


@F.arrow_udf(LongType())
def set_digest(text: pa.Array) -> pa.Array:
    """A text's set, by its digest; null for a text without a word."""
    parts = [pa.array([], pa.int64())]
    for _, data, offsets in _bytes.slices(text):
        row, h = _bytes.shingle_sets(data, offsets)
        count, a = _set_hashes(row, h, len(offsets) - 1)
        parts.append(pa.array(a.view(np.int64), mask=count == 0))
    return pa.concat_arrays(parts)


def _short_lists(levels, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, recent = levels.value, Recent()
        for batch in batches:
            for _, data, offsets in _bytes.slices(batch.column("text")):
                row, h = _bytes.shingle_sets(data, offsets)
                count, a = _set_hashes(row, h, len(offsets) - 1)
                new = recent.new(a)  # what isn't remembered is an entry again: the result is the same
                keep = new[row]
                row, h = row[keep], h[keep]
                count = np.where(new, count, 0)
                order = np.lexsort((h, level[(h >> np.uint64(64 - 20)).astype(np.int64)], row))
                row, h = row[order], h[order]
                begin = np.cumsum(count) - count
                rank = np.arange(len(h)) - begin[row]
                short = rank < (count - _needed(count, percent) + 1)[row]
                row, h, rank = row[short], h[short], rank[short]
                yield pa.record_batch({"h": pa.array(h.view(np.int64)), "d1": pa.array(a[row].view(np.int64)), "nr": pa.array(count[row] << 32 | rank, pa.int64())})

    return run


def _merge_lists(percent: int):
    """Rows sorted by list, then set: pairs (a, b) of each set with its list's first one, the center, that pass the bounds of size and rank;
    and the rows (h, a, nr) of lists with three sets or more, without the center, whose pairs are all given.

    Equal sets in a list are one row. What is carried from batch to batch is the last row and its list's center.
    """

    def reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = x >> 32, y >> 32
        rest = np.minimum(n - (x & 0xFFFFFFFF), m - (y & 0xFFFFFFFF))
        return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (rest * (100 + percent) >= (n + m) * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[int, int, int] | None = None  # h, d1, nr of the open list's center
        second: tuple[int, int, int] | None = None  # the open list's second set, not yet given as a row
        last = (None, None)
        for batch in batches:
            h, d, nr = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "d1", "nr"))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            new[0] = (h[0], d[0]) != last
            last = (h[-1], d[-1])
            h, d, nr = h[new], d[new], nr[new]
            carried = []
            if head is not None and len(h) and h[0] == head[0]:
                carried = [x for x in (head, second) if x is not None]
                h, d, nr = (np.r_[np.array([x[k] for x in carried], np.int64), v] for k, v in enumerate((h, d, nr)))
            if not len(h):
                continue
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[begin, len(h)])
            place = np.arange(len(h)) - np.repeat(begin, size)
            first = np.repeat(begin, size)
            fresh = place > 0
            fresh[: len(carried)] = False  # given before
            fresh &= reach(nr, nr[first])
            pairs = np.unique(np.stack([np.minimum(d, d[first])[fresh], np.maximum(d, d[first])[fresh]]), axis=1)
            yield pa.record_batch({"h": pa.nulls(pairs.shape[1], pa.int64()), "a": pa.array(pairs[0]), "b": pa.array(pairs[1]), "nr": pa.nulls(pairs.shape[1], pa.int64())})
            rows = np.repeat(size > 2, size) & (place > 0)
            long_before = head is not None and bool(carried) and len(carried) == 1 and second is None and last_size > 1
            if long_before:  # the list's earlier rows were given in the batches before
                rows[: size[0]] = place[: size[0]] > 0
            yield pa.record_batch({"h": pa.array(h[rows]), "a": pa.array(d[rows]), "b": pa.nulls(int(rows.sum()), pa.int64()), "nr": pa.array(nr[rows])})
            at = begin[-1]
            head = (int(h[at]), int(d[at]), int(nr[at]))
            open_size = int(size[-1])
            if long_before and len(begin) == 1:
                open_size = 3
            second = (int(h[at + 1]), int(d[at + 1]), int(nr[at + 1])) if open_size == 2 else None
            last_size = 3 if open_size > 2 else 1

    return run


def _near_pairs(percent: int):
    """The pairs (a, b) that the bounds don't tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("n_a", "n_b"))
            x, y = batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist()
            near = np.array([bool(_can_be_near(int(n[i]), x[i], m[i : i + 1], [y[i]], percent)[0]) for i in range(len(n))], bool)
            yield pa.record_batch({k: batch.column(k).filter(pa.array(near)) for k in ("a", "b")})

    return run


def _spread(percent: int):
    """Rows sorted by list and pair of blocks: edges (a, b) that join the families c whose sets in the list the bounds don't tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "h", "lo", "hi"):
            own, sizes, maps = t["own"].to_numpy(), t["n"].to_numpy(), t["map"].to_pylist()
            names, family = np.unique(t["c"].to_numpy(), return_inverse=True)
            one = t["lo"][0].as_py() == t["hi"][0].as_py()
            edges = []
            for i in range(len(own)):
                open_ = family != family[i]
                if one:
                    open_[: i + 1] = False
                else:
                    open_ &= own != own[i]
                at = np.flatnonzero(open_)
                if not len(at):
                    continue
                near = at[_can_be_near(int(sizes[i]), maps[i], sizes[at], [maps[k] for k in at], percent)]
                for other in np.unique(family[near]).tolist():
                    edges.append((names[family[i]], names[other]))
                    family[family == other] = family[i]
            if edges:
                yield pa.record_batch({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return run


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_bytes.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _wanted_sets(wanted, bits: int):
    """Set digests and sets of the rows whose id may be wanted; rows without an id always are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, recent = wanted.value, Recent()
        for batch in batches:
            ids = batch.column("doc_id")
            slot = _slots(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
            hit = np.flatnonzero(((table_[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False))
            if not len(hit):
                continue
            for _, data, offsets in _bytes.slices(batch.column("text").take(pa.array(hit))):
                n = len(offsets) - 1
                row, h = _bytes.shingle_sets(data, offsets)
                count, a = _set_hashes(row, h, n)
                ends = np.searchsorted(row, np.arange(n + 1))
                give = np.flatnonzero(recent.new(a) & (count > 0)).tolist()
                for k in range(0, len(give), 256):
                    part = give[k : k + 256]
                    yield pa.record_batch({"d1": pa.array(a[part].view(np.int64)), "shingles": pa.array([h[ends[i] : ends[i + 1]].tobytes() for i in part], pa.binary())})

    return run


def _filter_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros(bits // 8, np.uint8), False
        for batch in batches:
            slot = _slots(batch.column("rep").to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(out, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
            some |= len(slot) > 0
        if some:
            yield pa.record_batch({"part": pa.array(range(FILTER_PARTS), pa.int32()), "bits": pa.array([p.tobytes() for p in out.reshape(FILTER_PARTS, -1)], pa.binary())})

    return run


def _or_bits(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("bits"):
            one = np.frombuffer(x.as_py(), np.uint8)
            total = one.copy() if total is None else total | one
    yield pa.record_batch({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})


class Family:
    """Sets that may be similar, in one or two blocks: finds links that join its components."""

    #: How much dearer a probe is than a merged entry, in DivideSkip's rule for the number of long lists.
    PROBE = 0.01

    def __init__(self, sets: list[np.ndarray], own: np.ndarray, percent: int):
        self.sets, self.own, self.percent = sets, own, percent
        self.size = np.array([len(x) for x in sets])
        self.component = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []
        self.two = len(np.unique(own)) > 1

    def _fits(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the other sets those that are in the other block, if there are two, in another component, and of a size that can be similar."""
        n, m = self.size[i], self.size[others]
        ok = (self.component[others] != self.component[i]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent)
        return others[ok & (self.own[others] != self.own[i])] if self.two else others[ok]

    def _required(self, i: int, j: int) -> int:
        """Least overlap of two similar sets of these sizes."""
        return -(-self.percent * (int(self.size[i]) + int(self.size[j])) // (100 + self.percent))

    def _link(self, i: int, j: int) -> None:
        self.links.append((i, j))
        self.component[self.component == self.component[j]] = self.component[i]

    def _index(self, members: np.ndarray) -> None:
        """Inverted lists of the members: shingles in order, and beside each the member that holds it, members in order."""
        keys, owner = np.concatenate([self.sets[i] for i in members]), np.repeat(members, self.size[members])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def search(self, i: int) -> None:
        """Link set i with the indexed sets that are similar and not joined with it yet."""
        x, required = self.sets[i], int(_needed(int(self.size[i]), self.percent))
        begin, end = np.searchsorted(self.keys, x, "left"), np.searchsorted(self.keys, x, "right")
        length = end - begin
        longest = int(length.max())
        if not longest:
            return
        n_long = min(int(required / (self.PROBE * np.log2(longest + 1) + 1)), required - 1)
        order = np.argsort(length, kind="stable")
        short, long = order[: len(x) - n_long], order[len(x) - n_long :]
        n = length[short]
        entries = np.arange(n.sum()) + np.repeat(begin[short] - (np.cumsum(n) - n), n)
        who, occurs = np.unique(self.owner[entries], return_counts=True)  # the merge of the short lists
        reached = occurs >= required - n_long
        who, occurs = who[reached], occurs[reached]
        fits = np.isin(who, self._fits(i, who))
        for j, k in zip(who[fits].tolist(), occurs[fits].tolist()):
            if self.component[i] == self.component[j]:
                continue
            need = self._required(i, j)
            if k + n_long < need:
                continue
            y, probes = self.sets[j], x[long]
            for at in range(0, len(probes), 64):  # the long lists, by binary search for the candidate, until the overlap is reached or out of reach
                part = probes[at : at + 64]
                place = np.minimum(np.searchsorted(y, part), len(y) - 1)
                k += int(np.count_nonzero(y[place] == part))
                if k >= need or k + len(probes) - at - len(part) < need:
                    break
            if k >= need:
                self._link(i, j)

    def _from_center(self, center: int) -> None:
        """Link one set with all similar ones: its lists are merged in full."""
        others = self._fits(center, np.arange(len(self.sets)))
        if not len(others):
            return
        keys, owner = np.concatenate([self.sets[i] for i in others]), np.repeat(np.arange(len(others)), self.size[others])
        x = self.sets[center]
        both = np.bincount(owner[x[np.minimum(np.searchsorted(x, keys), len(x) - 1)] == keys], minlength=len(others))
        union = self.size[center] + self.size[others] - both
        for j in others[100 * both >= self.percent * union].tolist():
            if self.component[j] != self.component[center]:
                self._link(center, j)

    def solve(self, centers: int = 4) -> list[tuple[int, int]]:
        for _ in range(centers):  # a tight family is one component after that
            kinds, first, n = np.unique(self.component, return_index=True, return_counts=True)
            if len(kinds) == 1:
                return self.links
            self._from_center(int(first[np.argsort(-n, kind="stable")[_ % len(kinds)]]))
        kinds, n = np.unique(self.component, return_counts=True)
        if len(kinds) == 1:
            return self.links
        rest = np.flatnonzero(self.component != kinds[np.argmax(n)])  # a pair that isn't joined has at least one of these
        self._index(rest)
        for i in range(len(self.sets)):
            self.search(i)
        return self.links


def _family_links(percent: int):
    """Rows sorted by family, pair of blocks and set: links (a, b) between similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "family", "lo", "hi"):
            d, raw = t["d1"].to_numpy(), t["shingles"]
            new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            links = Family([np.frombuffer(raw[i].as_py(), np.uint64) for i in new.tolist()], t["own"].to_numpy()[new], percent).solve()
            if links:
                d = d[new]
                yield pa.record_batch({"a": pa.array([int(d[i]) for i, _ in links], pa.int64()), "b": pa.array([int(d[j]) for _, j in links], pa.int64())})

    return run


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with own, lo, hi: each row once for each pair of blocks that its own block is in; `blocks` is the number of its key. Sorted by key, pair and set."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.withColumn("own", F.pmod(F.xxhash64("d1", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return pairs.drop("other", "blocks").repartition(parts, *keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", "d1")


def _families(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """d1, family of the sets that aren't alone in theirs. lists: what `_merge_lists` gives."""
    of = lambda k: classes.select(F.col("d1").alias(k), F.col("n").alias(f"n_{k}"), F.col("map").alias(f"map_{k}"))
    pairs = lists.where("h is null").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    first = cut(components(pairs.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(_near_pairs(percent), "a long, b long")))
    known = first.select(F.col("node").alias("d1"), F.col("component").alias("c"))
    rows = lists.where("h is not null").select("h", F.col("a").alias("d1")).join(known, "d1", "left").select("h", "d1", F.coalesce("c", "d1").alias("c"))
    rows = cut(rows)
    still = rows.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("n_sets")).where("least < most")
    rows = rows.join(still.select("h", F.ceil(F.col("n_sets") / LIST_BLOCK).cast("int").alias("blocks")), "h").join(classes.select("d1", "n", "map"), "d1")
    more = cut(_dealt(rows, "h").select("h", "lo", "hi", "own", "c", "n", "map").mapInArrow(_spread(percent), "a long, b long"))
    second = cut(components(more))
    both = known.select("d1", "c").union(second.select(F.col("node").alias("d1"), F.col("node").alias("c")).join(known.select("d1"), "d1", "left_anti"))
    return both.join(second.select(F.col("node").alias("c"), F.col("component").alias("f")), "c", "left").select("d1", F.coalesce("f", "c").alias("family"))


def _links(docs: DataFrame, classes: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between similar sets of one family that join its components."""
    spark = docs.sparkSession
    members = cut(families.join(classes.select("d1", "n", "rep"), "d1"))
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") * 8 / FAMILY_BLOCK).cast("int").alias("blocks"))
    wanted = members.where("rep is not null").select("rep")
    bits = min(max(FILTER_LEAST, 1 << (16 * wanted.count()).bit_length()), FILTER_MOST)
    filled = np.zeros((FILTER_PARTS, bits // 8 // FILTER_PARTS), np.uint8)
    for r in wanted.mapInArrow(_filter_bits(bits), "part int, bits binary").groupBy("part").applyInArrow(_or_bits, "part int, bits binary").collect():  # at most FILTER_MOST bits
        filled[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    sets = docs.mapInArrow(_wanted_sets(spark.sparkContext.broadcast(filled.reshape(-1)), bits), "d1 long, shingles binary")
    rows = sets.join(members.join(blocks, "family").select("d1", "family", "blocks"), "d1")
    return cut(_dealt(rows, "family").select("family", "lo", "hi", "own", "d1", "shingles").mapInArrow(_family_links(percent), "a long, b long"))


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(profiles, groups): doc_id, n_shingles, d1 of every row; and d1, root, rep of every set: its component's key and the smallest id that has the set."""
    spark = docs.sparkSession
    small_batches(spark)
    profiles = cut(docs.mapInArrow(_profiles, "doc_id long, n_shingles long, d1 long, map binary"))
    classes = cut(profiles.where("n_shingles > 0").groupBy("d1").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("map").alias("map")))
    levels = spark.sparkContext.broadcast(list_levels(docs))
    lists = docs.select("text").mapInArrow(_short_lists(levels, percent), "h long, d1 long, nr long")
    lists = lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h", "d1")
    merged = cut(lists.mapInArrow(_merge_lists(percent), "h long, a long, b long, nr long"))
    links = _links(docs, classes, _families(merged, classes, percent), percent)
    joined = cut(components(links))
    groups = classes.select("d1", "rep").join(joined.select(F.col("node").alias("d1"), F.col("component").alias("root")), "d1", "left")
    return profiles.select("doc_id", "n_shingles", "d1"), cut(groups.select("d1", F.coalesce("root", "d1").alias("root"), "rep"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def similar_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id long, text): links at 100 * overlap >= percent * union."""
    profiles, groups = _grouped(_plain(docs), percent)
    smallest = groups.groupBy("root").agg(F.min("rep").alias("c"))
    label = groups.join(smallest, "root").select("d1", "c")
    out = profiles.where("n_shingles > 0").join(label, "d1").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.unionByName(profiles.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group of similar `docs` (doc_id, text, ...), the one of smallest id, all columns as they are; rows without a word all stay."""
    profiles, groups = _grouped(_plain(docs), percent)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "d1")).alias("w")).select("w.d1", F.col("w.rep").alias("id"))
    times = profiles.where("n_shingles > 0").groupBy("d1", F.col("doc_id").alias("id")).count().where("count > 1")
    best = best.join(times, best["d1"].eqNullSafe(times["d1"]) & best["id"].eqNullSafe(times["id"]), "left").select(best["d1"], best["id"], F.col("count").isNotNull().alias("again"))
    best = cut(best.select(F.col("d1").alias("w_d1"), F.col("id").alias("w_id"), "again"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(whole.alias("whole"), F.col("doc_id").cast("long").alias("id"), set_digest(F.col("text").cast("string")).alias("d1"))
    out = d.join(best, (d["d1"] == best["w_d1"]) & d["id"].eqNullSafe(best["w_id"]), "left")
    out = out.where("d1 is null or w_d1 is not null").select("whole", "d1", F.coalesce("again", F.lit(False)).alias("again"))
    if best.where("again").isEmpty():
        return out.select("whole.*")
    repeated = out.where("again").groupBy("d1").agg(F.first("whole").alias("whole"))  # one row a task goes into the shuffle
    return out.where("not again").select("whole.*").unionByName(repeated.select("whole.*"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts, and those without a word, link with nothing; long ones are compared whole; equal texts and repeated rows link; an empty table gives no rows."""
    return similar_documents(table(spark, sf_dir, "documents"))
