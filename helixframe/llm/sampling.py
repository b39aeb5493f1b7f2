"""Uniform sample of fixed size from data of unknown length that arrives in pieces.

Method: every entry has an independent uniform 64-bit key, a seeded hash of its
id, so that repeated deliveries and recomputed tasks get the same key. Each
partition keeps a heap of the k smallest keys, and the heaps are merged by
keeping the k smallest again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import ints, mix, rechunk


#: Tasks that the first step of the merge is spread over.
MERGERS = 32


class BottomK:
    """The ``k`` distinct ids with the smallest keys."""

    def __init__(self, k: int, seed: int):
        self.k, self.seed = k, seed
        self.table: pa.Table | None = None

    def add(self, table: pa.Table, id_column: str) -> None:
        table = table.filter(table.column(id_column).is_valid())
        if self.table is not None:
            table = pa.concat_tables([self.table, table])
        ids = ints(table.column(id_column).combine_chunks())
        keys = mix(mix(ids.view(np.uint64), self.seed), self.seed + 1)
        if len(keys) > 4 * self.k:  # only rows at or below the k-th smallest key of enough distinct ones can stay
            distinct = np.unique(keys)
            if len(distinct) > self.k:
                table = table.filter(pa.array(keys <= distinct[self.k - 1]))
                ids, keys = ids[keys <= distinct[self.k - 1]], keys[keys <= distinct[self.k - 1]]
        order = np.lexsort((ids, keys))
        same = np.zeros(len(ids), bool)
        same[1:] = ids[order][1:] == ids[order][:-1]
        self.table = table.take(pa.array(order[~same][: self.k])).combine_chunks()


def fixed_size_sample(df: DataFrame, k: int = 256, id_column: str = "entry_id", seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """``k`` rows of distinct ids, every id equally likely; all distinct ids if there are fewer.

    How often an id was delivered, and in which piece or library, has no
    influence. Of differing rows of one id an arbitrary one is returned; rows
    with null id cannot be told apart and are not drawn. Equal keys of
    different ids are ordered by id. An empty table or k = 0 gives no rows.
    The same seed gives the same sample, whatever the partitioning.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    df = df.select(*(columns or df.columns))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = BottomK(k, seed)
        for table in rechunk(batches, 65_536):
            heap.add(table, id_column)
        if heap.table is not None:
            yield from heap.table.to_batches()

    if k == 0:
        return df.limit(0)
    # Heaps of k rows a task, merged in two steps; only the second reads them in one task, k rows from each of the first.
    merged = df.mapInArrow(keep, df.schema).repartition(MERGERS, id_column).mapInArrow(keep, df.schema)
    return merged.repartition(1).mapInArrow(keep, df.schema)
