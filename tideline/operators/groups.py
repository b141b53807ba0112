"""Work on whole groups in tasks that sort their rows: a group costs its rows, and not a call of a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of `keys`, in as many partitions as the session shuffles to: adaptive execution goes by bytes, and would put small rows with much work each into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the rows that begin one, from rows in which equal `keys` (nulls are equal) stand together. What a batch leaves open waits for the next."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        seen = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), t]) if held else t
        new = np.zeros(len(seen) - 1, bool)
        for k in keys:
            a, b = (x.combine_chunks() for x in (seen[k].slice(0, len(seen) - 1), seen[k].slice(1)))
            new |= pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.xor(a.is_null(), b.is_null()), pc.not_equal(a, b)).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new) + (0 if held else 1)
        if not len(begin):
            held.append(t)
            continue
        before = sum(len(h) for h in held)
        yield pa.concat_tables([*held, t.slice(0, begin[-1])]), np.r_[0, begin[:-1] + before]
        held = [t.slice(begin[-1])]
    if held:
        yield pa.concat_tables(held), np.array([0])


def map_groups(df: DataFrame, keys: list[str], order: list, solve: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """solve(rows) of each group of `keys`, its rows in `order`; None for a group without result. df is partitioned by `keys` (`spread`); a group is held by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, keys):
            t = t.combine_chunks()
            found = [solve(t.slice(a, b - a)) for a, b in zip(first, np.r_[first[1:], len(t)])]
            found = [f for f in found if f is not None]
            if found:
                yield from pa.concat_tables(found).combine_chunks().to_batches()

    return df.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
