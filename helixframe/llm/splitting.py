"""Splitting oversized walks at natural boundaries.

A contig is a walk of nodes, each holding some k-mers; ``n`` consecutive
k-mers spell ``n + k - 1`` bases. A walk is cut into consecutive k-mer ranges,
so that each piece spells at most ``limit`` bases and shares ``overlap`` bases,
``k - 1`` at least, with the end of the one before; cuts fall between nodes
wherever the limit allows, and inside a node only if that node alone exceeds
the limit.

Method: every position where a cut may fall is joined to its farthest legal
successor, the overlap included; the successor table is then squared again and
again, which marks all cuts of all walks of a batch in a logarithmic number of
vector steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import flat_lists, ints
from .versions import by_deliveries

PIECES = (
    "contig_id long, k int, sample string, piece_no int, n_pieces int, from_kmer long, to_kmer long,"
    " first_node int, last_node int, bases long, ends string, inside boolean"
)


def cut_positions(lengths: np.ndarray, offsets: np.ndarray, most: np.ndarray, again: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All greedy cuts of many walks at once.

    ``lengths`` are the node sizes of all walks one after another, ``offsets``
    the walks' bounds in it, ``most`` the k-mers that fit into a piece of each
    walk, ``again`` those of them that repeat the piece before. Returns walk
    number, position in k-mers and whether the position is a node boundary,
    for every cut including the walks' starts and ends.
    """
    walks = len(offsets) - 1
    counts = np.diff(offsets)
    walk_of = np.repeat(np.arange(walks), counts)
    later = most - (again if again is not None else 0)  # what a piece behind the first one adds
    run = np.concatenate(([0], np.cumsum(lengths)))
    totals = run[offsets[1:]] - run[offsets[:-1]]
    # walks lie on one axis, so far apart that no step leads from one into the next
    base = np.concatenate(([0], np.cumsum(totals + most + 1)))[:-1]
    starts = base[walk_of] + run[:-1] - run[offsets[:-1]][walk_of]
    natural = np.unique(np.concatenate((base, starts, starts + lengths)))
    step = later[walk_of]
    first = np.where(starts == base[walk_of], most[walk_of], step)
    extra = np.where(lengths > first, (lengths - first - 1) // step + 1, 0)
    big = np.repeat(np.arange(len(lengths)), extra)
    number = np.arange(len(big)) - np.repeat(np.cumsum(extra) - extra, extra)
    inner = starts[big] + first[big] + number * step[big]
    points = np.union1d(natural, inner)
    owner = np.searchsorted(base, points, "right") - 1

    far = points + np.where(points == base[owner], most[owner], later[owner])
    last = natural[np.searchsorted(natural, far, "right") - 1]
    ends = base + totals
    target = np.where(last > points, last, np.minimum(far, ends[owner]))
    following = np.searchsorted(points, target)

    reached = np.zeros(len(points), bool)
    reached[np.searchsorted(points, base)] = True
    while True:
        reached[following[reached]] = True
        squared = following[following]
        if np.array_equal(squared, following):
            break
        following = squared
    cuts = points[reached]
    walk = owner[reached]
    at = np.searchsorted(natural, cuts)
    is_natural = (at < len(natural)) & (natural[np.minimum(at, len(natural) - 1)] == cuts)
    return walk, cuts - base[walk], is_natural


def _cut_batches(limit: int, with_kmers: bool, overlap: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, k = batch.column("contig_id"), batch.column("k")
        offsets, _, flat = flat_lists(batch.column("sizes"))
        sizes = ints(flat)
        ks = ints(k, 1)
        most = np.maximum(limit - (ks - 1), 1)
        again = np.clip((overlap or 0) - (ks - 1), 0, most - 1)
        walk, pos, natural = cut_positions(sizes, offsets, most, again)
        same = walk[1:] == walk[:-1]
        left = np.flatnonzero(same)
        owner, begin, end = walk[left], pos[left], pos[left + 1]
        begin = np.maximum(begin - again[owner], 0)
        n_pieces = np.bincount(owner, minlength=batch.num_rows)
        first_piece = np.cumsum(n_pieces) - n_pieces
        number = np.arange(len(owner)) - first_piece[owner]
        cut_inside = ~natural[left + 1]
        inside = np.bincount(owner, weights=cut_inside, minlength=batch.num_rows) > 0
        run = np.concatenate(([0], np.cumsum(sizes)))
        shift = run[offsets[:-1]][owner]
        first = np.searchsorted(run, begin + shift, "right") - 1 - offsets[:-1][owner]
        final = np.searchsorted(run, end + shift, "left") - 1 - offsets[:-1][owner]
        is_last = number == n_pieces[owner] - 1
        columns = {
            "contig_id": ids.take(pa.array(owner)),
            "k": k.take(pa.array(owner)),
            "sample": batch.column("sample").take(pa.array(owner)),
            "piece_no": pa.array(number, pa.int32()),
            "n_pieces": pa.array(n_pieces[owner], pa.int32()),
            "from_kmer": pa.array(begin, pa.int64()),
            "to_kmer": pa.array(end, pa.int64()),
            "first_node": pa.array(first, pa.int32()),
            "last_node": pa.array(final, pa.int32()),
            "bases": pa.array(end - begin + ks[owner] - 1, pa.int64()),
            "ends": pa.array(np.where(is_last, "end", np.where(cut_inside, "inside", "border")).astype(object), pa.string()),
            "inside": pa.array(inside[owner], pa.bool_()),
        }
        if with_kmers:
            _, _, nodes = flat_lists(batch.column("walk"))
            _, _, kmers = flat_lists(nodes)
            sizes_out = end - begin
            bounds = np.concatenate(([0], np.cumsum(sizes_out)))
            at = np.repeat(begin + shift - bounds[:-1], sizes_out) + np.arange(bounds[-1])
            columns["kmers"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), kmers.take(pa.array(at)))
        return pa.RecordBatch.from_pydict(columns)

    return lambda batches: (cut(b) for b in batches if b.num_rows)


def split_walks(contigs: DataFrame, limit: int = 1000, with_kmers: bool = False, overlap: int | None = None) -> DataFrame:
    """Pieces of at most ``limit`` bases of the current version of every walk.

    One row for each piece in walk order; a walk within the limit is one
    piece, whose ``n_pieces`` is 1. ``inside`` tells whether the walk has a cut
    inside a node, ``ends`` where this piece ends: ``border`` between two
    nodes, ``inside`` one, or ``end`` of the walk. With ``with_kmers`` the
    piece's k-mer hashes come along; put together in order they are the walk.

    Consecutive pieces share ``overlap`` bases; None, and anything below k-1,
    stands for the k-1 bases that no cut between k-mers can avoid. A piece
    always goes at least one k-mer beyond the one before.

    Of several rows of one contig_id the one with the latest written_at holds
    (nulls are oldest; repeated rows count once; of different rows with equal
    written_at the greatest in (k, sample, sizes) holds). Rows with null
    contig_id are versions of one nameless contig. Nodes that are null or
    whose abs_ind is null or empty add nothing; null or empty walks have no
    pieces. A null k counts as 1; where k exceeds the limit a piece holds one
    k-mer. Further columns are ignored. An empty table gives no rows.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if overlap is not None and not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    hashes = F.col("serialized_contigs.abs_ind")
    sizes = F.coalesce(F.transform(hashes, lambda a: F.coalesce(F.size(a), F.lit(0))), F.array().cast("array<int>"))
    kept = [F.col("written_at"), F.col("k"), F.col("sample"), sizes.alias("sizes")]
    if with_kmers:
        kept.append(F.coalesce(hashes, F.array().cast("array<array<bigint>>")).alias("walk"))
    rows = contigs.select("contig_id", F.struct(*kept).alias("row"))
    newest = lambda df: df.groupBy("contig_id").agg(F.max("row").alias("row"))
    if with_kmers:  # walks are large: only those with several versions are shuffled
        once, more = by_deliveries(rows, "contig_id")
        rows = once.unionByName(newest(more))
    else:
        rows = newest(rows)
    current = rows.select("contig_id", "row.*")
    current = current.filter(F.exists("sizes", lambda n: n > 0)).drop("written_at")
    schema = PIECES + (", kmers array<long>" if with_kmers else "")
    return current.mapInArrow(_cut_batches(limit, with_kmers, overlap), schema)


def oversized(contigs: DataFrame, limit: int = 1000) -> DataFrame:
    """contig_id and cut (``inside`` or ``border``) of every walk that had to be split."""
    pieces = split_walks(contigs, limit).filter((F.col("piece_no") == 0) & (F.col("n_pieces") > 1))
    return pieces.select("contig_id", F.when(F.col("inside"), "inside").otherwise("border").alias("cut"))
