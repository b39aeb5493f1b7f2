"""Most frequent items of a stream of weighted entries in bounded memory.

Method: majority-vote sketch. Each of ``rows`` x ``width`` cells holds the
total weight hashed into it, the candidate of a weighted majority vote and the
vote's surplus; two cells are merged by adding totals and cancelling votes.
A candidate's sum lies between surplus and (total + surplus) / 2, that of any
other item of the cell is at most (total - surplus) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import group_sums, ints, mix, rechunk

CELLS = "r int, cell int, total long, item long, surplus long"


def cells_of(items: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(items.astype(np.int64).view(np.uint64), row) % np.uint64(width)).astype(np.int64)


class VoteSketch:
    """Mergeable sketch over int64 items with non-negative int64 weights."""

    def __init__(self, rows: int, width: int):
        self.rows, self.width = rows, width
        self.total = np.zeros((rows, width), np.int64)
        self.item = np.zeros((rows, width), np.int64)
        self.surplus = np.zeros((rows, width), np.int64)

    def merge(self, row: int, cell: np.ndarray, total: np.ndarray, item: np.ndarray, surplus: np.ndarray) -> None:
        """Merge one summary into each of the distinct cells ``cell``."""
        mine, votes = self.item[row, cell], self.surplus[row, cell]
        same = mine == item
        self.total[row, cell] += total
        self.surplus[row, cell] = np.where(same, votes + surplus, np.abs(votes - surplus))
        self.item[row, cell] = np.where(same | (votes >= surplus), mine, item)

    def add(self, items: np.ndarray, weights: np.ndarray) -> None:
        """Add entries; a batch is summed exactly first, so its own summary is the tightest one."""
        items, weights = group_sums(items, weights)
        if not len(items):
            return
        for row in range(self.rows):
            cell = cells_of(items, row, self.width)
            order = np.lexsort((weights, cell))
            cell, it, w = cell[order], items[order], weights[order]
            last = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True])))
            first = np.concatenate(([0], last[:-1] + 1))
            total = np.add.reduceat(w, first)
            self.merge(row, cell[last], total, it[last], np.maximum(2 * w[last] - total, 0))

    def batch(self) -> pa.RecordBatch:
        row, cell = np.nonzero(self.total)
        columns = [row.astype(np.int32), cell.astype(np.int32), self.total[row, cell], self.item[row, cell], self.surplus[row, cell]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["r", "cell", "total", "item", "surplus"])

    def bounds(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each item's sum."""
        low, high = np.zeros(len(items), np.int64), np.full(len(items), np.iinfo(np.int64).max)
        for row in range(self.rows):
            cell = cells_of(items, row, self.width)
            total, surplus, leads = self.total[row, cell], self.surplus[row, cell], self.item[row, cell] == items
            low = np.maximum(low, np.where(leads, surplus, 0))
            high = np.minimum(high, np.where(leads, total + surplus, total - surplus) // 2)
        return low, high


@dataclass(frozen=True)
class Entries:
    """Which columns hold an entry's id, item and weight."""

    entry: str = "entry_id"
    item: str = "hnc"
    weight: str = "count"

    def of(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.entry).alias("entry"), F.col(self.item).cast("long").alias("item"), F.greatest(F.coalesce(F.col(self.weight).cast("long"), F.lit(0)), F.lit(0)).alias("weight"))


def once(entries: DataFrame) -> DataFrame:
    """Each entry once, however often it was delivered; entries without an id are all counted.

    The group key of an entry without id is its partition and row, which also
    spreads them.
    """
    keyed = entries.withColumn("alone", F.when(F.col("entry").isNull(), F.monotonically_increasing_id()))
    return keyed.groupBy("entry", "alone").agg(F.max(F.struct("weight", "item")).alias("e")).select("e.item", "e.weight")


def _fill(rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, itemless = VoteSketch(rows, width), 0
        for table in rechunk(batches, 100_000):
            item, weight = table.column("item").combine_chunks(), ints(table.column("weight").combine_chunks())
            known = item.is_valid().to_numpy(zero_copy_only=False)
            itemless += int(weight[~known].sum())
            sketch.add(ints(item)[known], weight[known])
        yield sketch.batch()
        if itemless:  # row -1 carries the weight that belongs to no item
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x], pa.int64()) for x in (itemless, 0, 0))], names=["r", "cell", "total", "item", "surplus"])

    return run


def vote_sketch(df: DataFrame, entries: Entries = Entries(), rows: int = 4, width: int = 2048) -> tuple[VoteSketch, int]:
    """The merged sketch of all entries, and the weight of all entries with and without an item.

    Each partition fills one sketch; cells are merged on the executors by vote
    cancellation, so rows x width cells reach the driver whatever the input's size.
    """
    vote = F.struct("surplus", "item")
    merged = F.aggregate(
        F.array_sort(F.collect_list(vote)),
        F.struct(F.lit(0).cast("long").alias("surplus"), F.lit(0).cast("long").alias("item")),
        lambda a, b: F.when(a.item == b.item, F.struct((a.surplus + b.surplus).alias("surplus"), a.item.alias("item")))
        .when(a.surplus >= b.surplus, F.struct((a.surplus - b.surplus).alias("surplus"), a.item.alias("item")))
        .otherwise(F.struct((b.surplus - a.surplus).alias("surplus"), b.item.alias("item"))),
    )
    cells = once(entries.of(df)).mapInArrow(_fill(rows, width), CELLS)
    cells = cells.groupBy("r", "cell").agg(F.sum("total").alias("total"), merged.alias("vote")).select("r", "cell", "total", "vote.item", "vote.surplus")
    sketch, itemless = VoteSketch(rows, width), 0
    for r, cell, total, item, surplus in cells.collect():
        if r < 0:
            itemless = total
        else:
            sketch.total[r, cell], sketch.item[r, cell], sketch.surplus[r, cell] = total, item, surplus
    return sketch, int(sketch.total[0].sum()) + itemless


def _possible(candidates: np.ndarray, doubtful: np.ndarray):
    """Keep entries of candidates, and of items that lie in a doubtful cell in every row."""
    rows, width = doubtful.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = batch.column("item")
            values = ints(item)
            hidden = np.ones(len(values), bool)
            for row in range(rows):
                hidden &= doubtful[row, cells_of(values, row, width)]
            keep = (hidden | np.isin(values, candidates)) & item.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(keep))

    return run


def heavy_items(df: DataFrame, share: float = 0.005, entries: Entries = Entries(), rows: int = 4, width: int = 2048) -> DataFrame:
    """Items whose summed weight is at least ``share`` of the summed weight of all entries.

    Columns item, low and high (the sketch's bounds), weight (the exact sum).
    First pass: the sketch. An item on or above the line is either the
    candidate of one of its cells, or lies in every row in a cell where the
    others' bound reaches the line. At most ``rows / share`` candidates and
    ``rows / (2 share)`` such doubtful cells exist, as the totals of a row add
    up to the whole. Second pass: exact sums over the entries of these items
    only, so none is missed and no other is reported.

    An entry id counts once however often it comes (the greatest of differing
    weights holds); entries without id all count; null or negative weights are
    0; entries without item add to the whole only. Ties all qualify; without
    any weight nothing does. Further columns are ignored.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    spark = df.sparkSession
    sketch, whole = vote_sketch(df, entries, rows, width)
    line = share * whole
    leading = np.unique(sketch.item[sketch.total > 0])
    low, high = sketch.bounds(leading)
    candidates = leading[high >= line] if whole else leading[:0]
    doubtful = (sketch.total - sketch.surplus) // 2 >= line
    kept = entries.of(df)
    if whole and doubtful.any(axis=1).all():
        kept = kept.mapInArrow(_possible(candidates, doubtful), "entry long, item long, weight long")
    else:
        kept = kept.filter(F.col("item").isin([int(x) for x in candidates]))
    bounds = spark.createDataFrame([(int(i), int(a), int(b)) for i, a, b in zip(leading, low, high) if b >= line], "item long, low long, high long")
    exact = once(kept).groupBy("item").agg(F.sum("weight").alias("weight")).filter((F.col("weight") >= F.lit(line)) & (F.lit(whole) > 0))
    return exact.join(F.broadcast(bounds), "item", "left").select("item", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(whole)).alias("high"), "weight")
