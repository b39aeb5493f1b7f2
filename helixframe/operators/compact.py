"""Contraction of unbranched paths, walks of the residual graph, and their spelling.

Paths are found by pointer doubling over oriented nodes: every round a pointer
is replaced by its pointer's, so a path of n nodes takes log n rounds. Each
round is one equi-join, written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..plans.options import SpellingError
from ..session import cut_lineage
from .graph import ambiguous, without_nodes, without_self_loops

#: Oriented nodes that one task ranks in memory (some 60 bytes each); more are ranked by rounds over the cluster.
LOCAL_KEYS = 2_000_000
#: Where the partition number begins in an oriented key, as ids are given by `monotonically_increasing_id`.
ID_PARTITION_SHIFT = 34
#: Nodes whose bases are put together in one group; a path's chunks are joined afterwards.
CHUNK = 10_000


def _key(nid: str = "nid", orient: str = "orient"):
    """An oriented node as one number: twice the id, plus 1 for '-'."""
    return F.col(nid) * 2 + (F.col(orient) == "-").cast("long")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Edges that are the only one out of their source and the only one into their target, as oriented keys."""
    edges = edges.select(_key("src", "so").alias("u"), _key("dst", "do").alias("v"), (_key("src", "so").bitwiseXOR(F.lit(1))).alias("back"))
    out = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n = 1").select("u")
    alone = edges.join(out, "u", "left_semi")
    into = out.select((F.col("u").bitwiseXOR(F.lit(1))).alias("v"))
    return alone.join(into, "v", "left_semi").filter(F.shiftright("u", 1) != F.shiftright("v", 1)).select("u", "v")


def _rank_arrays(key: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Head, rank, least key and cyclic flag of every key, ``before`` being the place of its predecessor or -1."""
    n = len(key)
    ptr, rank, done = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64), before < 0
    least = np.minimum(key, key[ptr])
    active = np.flatnonzero(~done)
    for _ in range(n.bit_length() + 1):
        if not len(active):
            break
        at = ptr[active]
        step, low, far, ends = rank[at], least[at], ptr[at], done[at]
        rank[active] += step
        least[active] = np.minimum(least[active], low)
        ptr[active], done[active] = far, ends
        active = active[~ends]
    return key[ptr], rank, least, ~done


def _rank_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a partition's keys and predecessors ranked in memory; a predecessor that is not in the partition is none."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("key")
    key = table.column("key").to_numpy()
    prior = table.column("ptr").fill_null(-1).to_numpy()
    at = np.minimum(np.searchsorted(key, prior), len(key) - 1)
    head, rank, least, cyclic = _rank_arrays(key, np.where(key[at] == prior, at, -1))
    for first in range(0, len(key), 100_000):
        part = slice(first, first + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in (key, head, rank, least, cyclic)], names=["key", "head", "rank", "least", "cyclic"])


RANKED = "key long, head long, rank long, least long, cyclic boolean"


def rank_paths(keys: DataFrame, links: DataFrame, local: int = LOCAL_KEYS) -> DataFrame:
    """key, head and rank of every oriented node along its path; a cycle is opened at its least oriented key.

    ``keys`` (key) are all oriented nodes, ``links`` (u, v) a partial
    one-to-one relation. ``cyclic`` tells which paths were cycles. Up to
    ``local`` keys are ranked by one task in memory. More are first ranked
    within the partitions that their ids come from, which hold neighbours, and
    only the heads of these pieces by rounds over the cluster.
    """
    prior = cut_lineage(keys.join(links.select(F.col("v").alias("key"), F.col("u").alias("ptr")), "key", "left"))
    if prior.count() <= local:
        ranked = cut_lineage(prior.repartition(1).mapInArrow(_rank_batch, RANKED))
    else:
        ranked = _ranked_by_pieces(prior)
    paths = ranked.filter("not cyclic").select("key", "head", "rank", F.lit(False).alias("cyclic"))
    circling = ranked.filter("cyclic").select("key", "least")
    if circling.isEmpty():
        return paths
    # all of a cycle know its least key; without the link into it the cycle is a path
    opened = links.join(circling.select(F.col("key").alias("v"), "least"), "v").filter("v <> least").select("u", "v")
    return paths.unionByName(rank_paths(circling.select("key"), opened, local).withColumn("cyclic", F.lit(True)))


def _ranked_by_pieces(prior: DataFrame) -> DataFrame:
    """rank_paths for any number of keys: pieces by partition of the ids, then pointer doubling over the pieces."""
    home = F.shiftright("key", ID_PARTITION_SHIFT)
    inside = prior.withColumn("home", home).repartition("home")
    pieces = cut_lineage(inside.select("key", F.when(F.shiftright("ptr", ID_PARTITION_SHIFT) == F.col("home"), F.col("ptr")).alias("ptr")).mapInArrow(_rank_batch, RANKED))
    whole = pieces.filter("cyclic")  # cycles that lie in one partition
    pieces = pieces.filter("not cyclic")
    heads = pieces.groupBy("head").agg(F.count("*").alias("size"), F.min("least").alias("least")).withColumnRenamed("head", "key")
    # the link into a piece's head comes from the last key of another piece
    into = heads.join(prior, "key").filter("ptr is not null").join(pieces.select(F.col("key").alias("ptr"), F.col("head").alias("from")), "ptr").select("key", "from")
    state = heads.join(into, "key", "left")
    sizes = heads.select(F.col("key").alias("from"), F.col("size").alias("add"))
    state = state.join(sizes, "from", "left").select("key", F.coalesce("from", "key").alias("ptr"), F.coalesce("add", F.lit(0)).alias("rank"), F.col("from").isNull().alias("done"), "least")
    ranked = cut_lineage(_doubled(cut_lineage(state)).select(F.col("key").alias("head"), F.col("ptr").alias("first"), F.col("rank").alias("base"), F.col("least").alias("low"), ~F.col("done")))
    ranked = ranked.toDF("head", "first", "base", "low", "circling")
    joined = pieces.join(ranked, "head").select("key", F.col("first").alias("head"), (F.col("rank") + F.col("base")).alias("rank"), F.least("least", "low").alias("least"), F.col("circling").alias("cyclic"))
    return cut_lineage(joined.unionByName(whole))


def _doubled(state: DataFrame) -> DataFrame:
    """key, ptr, rank, done and least after pointer doubling; rows still not done lie on cycles and know the least of all of it."""
    for _ in range(math.ceil(math.log2(max(state.count(), 2))) + 1):
        if state.filter("not done").isEmpty():
            break
        far = state.select(F.col("key").alias("ptr"), F.col("ptr").alias("far"), F.col("rank").alias("more"), F.col("done").alias("far_done"), F.col("least").alias("far_least"))
        moved = state.filter("not done").join(far, "ptr").select("key", F.col("far").alias("ptr"), (F.col("rank") + F.col("more")).alias("rank"), F.col("far_done").alias("done"), F.least("least", "far_least").alias("least"))
        state = cut_lineage(state.filter("done").unionByName(moved))
    return state


def _paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked paths, each in one direction: that whose head is not above the reversed last node."""
    return _directed(nodes, cut_lineage(simple_edges(edges)))


def _directed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    keys = nodes.select(F.explode(F.array(F.col("nid") * 2, F.col("nid") * 2 + 1)).alias("key"))
    ranked = cut_lineage(rank_paths(keys, links))
    ends = ranked.groupBy("head").agg(F.max_by("key", "rank").alias("tail"), F.max("cyclic").alias("cyclic"))
    # a cycle's two directions open at different keys of the same node; keep the one that opens forwards
    keep = ends.filter(F.when(F.col("cyclic"), F.col("head") % 2 == 0).otherwise(F.col("head") <= F.col("tail").bitwiseXOR(F.lit(1))))
    return ranked.drop("cyclic").join(keep.select("head", "tail", "cyclic"), "head")


def contract(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame, bool]:
    """The graph with every unbranched path as one node, and whether anything changed.

    The new node has the id of the path's first node, the path's sequence, and
    the mean coverage weighted by k-mers. Cycles without a junction are opened
    at one place and keep the edge that closes them.
    """
    nodes, edges, made = contract_and_tell(nodes, edges, k)
    return nodes, edges, made is not None


def contract_and_tell(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """`contract`, and the nodes (nid) that were made of several; None if there are none."""
    links = cut_lineage(simple_edges(edges))
    if links.isEmpty():
        return nodes, edges, None
    merged = _spelled(nodes, _directed(nodes, links), k).select((F.shiftright("head", 1)).alias("nid"), "seq", "n_kmers", "cov", "head", "tail", "parts")
    merged = cut_lineage(merged)
    xor = lambda c: F.col(c).bitwiseXOR(F.lit(1))
    ends = merged.select(F.col("tail").alias("u"), F.col("nid").alias("src"), F.lit("+").alias("so")).union(merged.select(xor("head"), "nid", F.lit("-")))
    starts = merged.select(F.col("head").alias("v"), F.col("nid").alias("dst"), F.lit("+").alias("do")).union(merged.select(xor("tail"), "nid", F.lit("-")))
    keyed = edges.select(_key("src", "so").alias("u"), _key("dst", "do").alias("v"))
    new_edges = cut_lineage(keyed.join(ends, "u").join(starts, "v").select("src", "so", "dst", "do").distinct())
    return merged.select("nid", "seq", "n_kmers", "cov"), new_edges, merged.filter("parts > 1").select("nid")


def _spelled(nodes: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """head, tail, seq, n_kmers, parts (nodes) and cov of every path. Bases are gathered in chunks of bounded size first."""
    placed = paths.withColumn("nid", F.shiftright("key", 1)).join(nodes, "nid")
    read = F.when(F.col("key") % 2 == 0, F.col("seq")).otherwise(reverse_complement("seq"))
    added = F.when(F.col("rank") == 0, read).otherwise(F.substring(read, F.lit(k), F.length(read)))
    parts = placed.select("head", "tail", "cyclic", "rank", "n_kmers", "cov", added.alias("bases"))
    chunks = parts.groupBy("head", "tail", "cyclic", F.floor(F.col("rank") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "bases"))), lambda x: x.bases), "").alias("bases"), F.sum("n_kmers").alias("n_kmers"), F.sum(F.col("cov") * F.col("n_kmers")).alias("mass"), F.count("*").alias("parts"))
    whole = chunks.groupBy("head", "tail", "cyclic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bases"))), lambda x: x.bases), "").alias("seq"), F.sum("n_kmers").alias("n_kmers"), F.sum("mass").alias("mass"), F.sum("parts").alias("parts"))
    return whole.select("head", "tail", "cyclic", "seq", "n_kmers", "parts", (F.col("mass") / F.col("n_kmers")).alias("cov"))


def collapse(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Contigs (seq, len, cov, kind): junctions as they are, the paths and isolated nodes left without them, and cycles,
    whose n k-mers spell n+k-1 bases. Each is given in the lesser of its two orientations."""
    edges = cut_lineage(without_self_loops(edges))
    junctions = cut_lineage(ambiguous(nodes, edges))
    singles = nodes.join(junctions, "nid", "left_semi").select("seq", "cov", F.lit("junction").alias("kind"))
    rest, links = without_nodes(nodes, edges, junctions)
    rest = cut_lineage(rest)
    paths = _spelled(rest, _paths(rest, cut_lineage(links)), k).select("seq", "cov", F.when(F.col("cyclic"), "cycle").otherwise("path").alias("kind"))
    seq = F.least("seq", reverse_complement("seq"))
    return cut_lineage(singles.unionByName(paths).select(seq.alias("seq"), F.length("seq").alias("len"), "cov", "kind"))


def spell_walks(walks: DataFrame, k: int) -> DataFrame:
    """walk_id and seq of walks given as arrays of canonical k-mers, each overlapping the one before by k-1 bases.

    The first k-mer is oriented by its successor. A walk that is empty, holds
    a k-mer of another length, or breaks off raises.
    """
    if k < 2:
        raise SpellingError(f"no walk can be spelled with k = {k}")
    rc = reverse_complement
    first = F.element_at("kmers", 1)
    second = F.try_element_at("kmers", F.lit(2))
    touches = lambda a, b: F.right(a, F.lit(k - 1)) == F.left(b, F.lit(k - 1))
    start = F.when(second.isNull() | touches(first, second) | touches(first, rc(second)), first).otherwise(rc(first))
    step = lambda acc, x: F.when(F.right(acc, F.lit(k - 1)) == F.left(x, F.lit(k - 1)), F.concat(acc, F.right(x, F.lit(1)))).when(F.right(acc, F.lit(k - 1)) == F.left(rc(x), F.lit(k - 1)), F.concat(acc, F.right(rc(x), F.lit(1)))).otherwise(F.lit(None).cast("string"))
    seq = F.aggregate(F.slice("kmers", 2, F.greatest(F.size("kmers") - 1, F.lit(0))), start, step)
    problem = F.when(F.coalesce(F.size("kmers"), F.lit(0)) <= 0, "an empty walk").when(F.exists("kmers", lambda x: F.length(x) != k), "a k-mer of another length")
    return walks.select("walk_id", F.when(problem.isNotNull(), F.raise_error(problem)).when(seq.isNull(), F.raise_error(F.lit("not a walk"))).otherwise(seq).alias("seq"))


