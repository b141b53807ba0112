"""Token counts by greedy longest match in linear time, without building the pieces.

The vocabulary's byte strings form a trie, and a word is matched as one string with an end mark, so that pieces that only end a word match at its end only.
A state's failure link leads to the state that is left after the longest matches at its front have been taken off, and carries how many pieces that took; so a word
costs one step a byte, plus failure steps that are paid for by earlier bytes. Links and counts are precomputed on the driver (the vocabulary bounds their size)
and broadcast; tasks step through a slice's distinct words in lockstep.

A word that can't be matched to its end is one unknown token. Words are runs of non-blanks, lower-cased (A-Z). Null and empty texts have no
words and no tokens; long texts are counted whole. Repeated rows, and rows with a null id, are counted each; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes
from tideline.llm._common import small_batches, table

END = 256
NONE = -1


class Automaton:
    """Arrays: sorted edge keys (state * 257 + symbol) with targets; failure state (NONE: no match possible) and popped pieces by state."""

    def __init__(self, pieces: list[tuple[bytes, bool]]):
        """pieces: byte strings, and whether each ends a word."""
        next_: list[dict[int, int]] = [{}]
        is_piece = [False]
        for p, ends in pieces:
            s = 0
            for b in (*p, *([END] * ends)):
                if b not in next_[s]:
                    next_[s][b] = len(next_)
                    next_.append({})
                    is_piece.append(False)
                s = next_[s][b]
            is_piece[s] = s != 0
        n = len(next_)
        fail, popped = [NONE] * n, [0] * n
        queue = deque((t, 0, b) for b, t in next_[0].items())
        while queue:
            s, parent, b = queue.popleft()
            if is_piece[s]:  # the whole path is the longest match at its front
                fail[s], popped[s] = 0, 1
            else:
                z, count = fail[parent], popped[parent]
                while z != NONE and b not in next_[z]:
                    count += popped[z]
                    z = fail[z]
                if z != NONE:
                    fail[s], popped[s] = next_[z][b], count
            queue.extend((t, s, c) for c, t in next_[s].items())
        edges = sorted((s * 257 + b, t) for s, d in enumerate(next_) for b, t in d.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([t for _, t in edges], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * 257 + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], NONE)

    def lengths(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Pieces of each word (byte ranges, ends included); 1 for a word that has no match."""
        size = last - first + 1
        out = np.ones(len(first), np.int64)
        if not len(self.keys):
            return out
        alive = np.arange(len(first))
        state, count, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        while len(alive):
            inside = at < size[alive]
            symbol = np.where(inside, data[np.minimum(first[alive] + at, last[alive])].astype(np.int64), np.int64(END))
            to = self._step(state, symbol)
            moved = to != NONE
            over = moved & ~inside  # the end mark is taken: what the state holds is matched from here without a symbol
            stuck = ~moved
            back = self.fail[state]
            count = np.where(stuck, count + self.popped[state], count)
            state = np.where(moved, to, back)
            at = np.where(moved, at + 1, at)
            lost = stuck & (back == NONE)
            if over.any():
                self._finish(out, alive[over], state[over], count[over])
            keep = ~(over | lost)
            alive, state, count, at = alive[keep], state[keep], count[keep], at[keep]
        return out

    def _finish(self, out: np.ndarray, who: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        while len(who):
            back = self.fail[state]
            count = count + self.popped[state]
            done = back == 0
            out[who[done]] = count[done]
            go = ~done & (back != NONE)
            who, state, count = who[go], back[go], count[go]


def read_pieces(path: str, end: str = "</w>") -> list[tuple[bytes, bool]]:
    """(byte string, ends a word) from a tokenizer's JSON file with a word-end suffix and the byte-level alphabet."""
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in spec["added_tokens"]}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for t in spec["model"]["vocab"]:
        if t not in special:
            ends = t.endswith(end)
            out.append((bytes(to_byte[c] for c in (t[: -len(end)] if ends else t)), ends))
    return out


def token_counts(docs: DataFrame, pieces: list[tuple[bytes, bool]]) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    small_batches(docs.sparkSession)
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for batch in batches:
            for at, data, offsets in _bytes.slices(batch.column("text")):
                n = len(offsets) - 1
                data = _bytes.lower(data)
                first, last, row = _bytes.word_bounds(data, offsets)
                tokens = np.zeros(n)
                if len(first):
                    one, back = _bytes.distinct_ranges(data, first, last)
                    tokens = np.bincount(row, weights=a.lengths(data, first[one], last[one])[back], minlength=n)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, n), "n_words": pa.array(np.bincount(row, minlength=n), pa.int64()), "n_tokens": pa.array(tokens.astype(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Null and empty texts have no token; long texts count whole; null and repeated ids are rows like others; an empty table gives no rows; extra columns are ignored."""
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(path or default_vocabulary()))
