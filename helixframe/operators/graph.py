"""The bidirected de Bruijn graph as two DataFrames.

``nodes``: nid LONG, seq STRING, n_kmers LONG, cov DOUBLE. ``edges``: src LONG,
so, dst LONG, do with orientations '+' and '-': the sequence of ``src`` read
in orientation ``so`` ends with the k-1 bases with which ``dst`` in ``do``
begins. Every edge has its mirror image (dst, not do) -> (src, not so).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import PACKED_K, flip, packed, reverse_complement
from ..session import cut_lineage

#: From this many nodes on, ids are given by neighbourhood.
MANY_NODES = 1_000_000
#: Bases of the stretches by which neighbours find together.
MINIMIZER = 11
NODES = "nid long, seq string, n_kmers long, cov double"
EDGES = "src long, so string, dst long, do string"


def nodes_of(counts: DataFrame) -> DataFrame:
    """One node for each counted k-mer; the ids are fixed by writing the table.

    Many k-mers are put where their neighbours are first, so that ids of one
    partition make up long stretches of paths.
    """
    ids = lambda df: cut_lineage(df.select(F.monotonically_increasing_id().alias("nid"), "seq", "n_kmers", "cov"))
    nodes = ids(counts.select(F.col("kmer").alias("seq"), F.lit(1).cast("long").alias("n_kmers"), F.col("n").cast("double").alias("cov")))
    return ids(by_neighbourhood(nodes)) if nodes.count() > MANY_NODES else nodes


def minimizers(kmers: pa.Array) -> np.ndarray:
    """The least hash of a k-mer's stretches of MINIMIZER bases, either strand's: neighbouring k-mers mostly share it."""
    lengths = pa.compute.binary_length(kmers).to_numpy(zero_copy_only=False)
    out = np.zeros(len(lengths), np.uint64)
    for k in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == k)
        text = "".join(kmers.take(pa.array(rows)).to_pylist()).encode()
        codes = (np.frombuffer(text, np.uint8) >> np.uint8(1) & np.uint8(3)).astype(np.uint64).reshape(-1, k)
        m = min(MINIMIZER, k)
        forward, backward = np.zeros((len(rows), k - m + 1), np.uint64), np.zeros((len(rows), k - m + 1), np.uint64)
        for i in range(m):
            part = codes[:, i : i + k - m + 1]
            forward |= part << np.uint64(2 * (m - 1 - i))
            backward |= (part ^ np.uint64(2)) << np.uint64(2 * i)
        with np.errstate(over="ignore"):
            word = np.minimum(forward, backward) * np.uint64(0x9E3779B97F4A7C15)
            out[rows] = (word ^ (word >> np.uint64(29))).min(axis=1) if k else 0
    return out


def by_neighbourhood(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Nodes of single k-mers, moved to a partition that they share with most of their neighbours."""
    n = partitions or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                mixed = minimizers(batch.column("seq")) * np.uint64(0xD1342543DE82EF95)
            home = ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "home"])

    placed = nodes.select("seq", "n_kmers", "cov").mapInArrow(run, "seq string, n_kmers long, cov double, home int")
    return placed.repartitionById(n, F.col("home")).drop("home")


def oriented_view(nodes: DataFrame) -> DataFrame:
    """Every node in both orientations with the sequence as read."""
    both = F.array(F.struct(F.lit("+").alias("orient"), F.col("seq").alias("read")), F.struct(F.lit("-").alias("orient"), reverse_complement("seq").alias("read")))
    return nodes.select("nid", F.inline(both))


def overlap_edges(nodes: DataFrame, k: int) -> DataFrame:
    """All edges by an equi-join of the last and the first k-1 bases of oriented nodes.

    A k-1-mer is followed by at most four bases and preceded by at most four,
    so no join key has more than sixteen pairs. Up to 31 bases the key is one
    LONG; only the ends of a node are ever reversed.
    """
    key = packed if k - 1 <= PACKED_K else (lambda c: c)
    first, last = F.left("seq", F.lit(k - 1)), F.right("seq", F.lit(k - 1))
    ends = lambda forward, backward: F.inline(F.array(F.struct((F.col("nid") * 2).alias("end"), key(forward).alias("overlap")), F.struct((F.col("nid") * 2 + 1).alias("end"), key(reverse_complement(backward)).alias("overlap"))))
    left = nodes.select(ends(last, first)).withColumnRenamed("end", "u")
    right = nodes.select(ends(first, last)).withColumnRenamed("end", "v")
    sign = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    return left.join(right, "overlap").select(F.shiftright("u", 1).alias("src"), sign("u").alias("so"), F.shiftright("v", 1).alias("dst"), sign("v").alias("do"))


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), flip("do").alias("so"), F.col("src").alias("dst"), flip("so").alias("do"))


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def paired(edges: DataFrame) -> DataFrame:
    """Each edge once, and only if its mirror image is there too; a hairpin is its own."""
    distinct = edges.distinct()
    return distinct.join(mirrored(distinct), ["src", "so", "dst", "do"], "left_semi")


def consecutive(ordered: DataFrame, name: str = "number") -> DataFrame:
    """Rows of an ordered table with consecutive numbers from 0.

    The numbers come from the range sort's partitions and their sizes, so no
    task sees all rows; the sorted rows are written down, as both passes must
    see the same partitions.
    """
    at = F.spark_partition_id()
    placed = cut_lineage(ordered.withColumn("_p", at).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(at.cast("long"), 33)))
    first, rows = 0, []
    for p, n in sorted((r._p, r.n) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        rows.append((p, first))
        first += n
    offsets = ordered.sparkSession.createDataFrame(rows, "_p int, _first long")  # one row a partition
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_first") + F.col("_i")).drop("_p", "_i", "_first")


def renumbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with ids from 0 in the order of sequences, every node in its lesser orientation: the same however it was built."""
    least = F.least("seq", reverse_complement("seq"))
    turned = nodes.select(F.col("nid").alias("was"), (F.col("seq") != least).alias("turned"), least.alias("seq"), "n_kmers", "cov")
    new = cut_lineage(consecutive(turned.orderBy("seq", "was"), "nid"))

    def end(df: DataFrame, node: str, sign: str) -> DataFrame:
        names = new.select(F.col("was").alias(node), F.col("nid").alias("_n"), F.col("turned").alias("_t"))
        return df.join(names, node).withColumn(node, F.col("_n")).withColumn(sign, F.when(F.col("_t"), flip(sign)).otherwise(F.col(sign))).drop("_n", "_t")

    return new.select("nid", "seq", "n_kmers", "cov"), end(end(edges, "src", "so"), "dst", "do").select("src", "so", "dst", "do")


def lookup(nodes: DataFrame, kmers: DataFrame) -> DataFrame:
    """The node, orientation and coverage of given k-mers, in whichever orientation they are given."""
    view = oriented_view(nodes).join(nodes.select("nid", "cov"), "nid")
    return kmers.join(view, kmers["kmer"] == view["read"]).select("kmer", "nid", "orient", "cov")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nid, out_plus and out_minus: edges that leave the node in each orientation. Edges into (v, o) are those out of
    (v, not o), so out_minus is also the number of edges into the node read forwards."""
    out = edges.groupBy(F.col("src").alias("nid")).agg(F.count_if(F.col("so") == "+").alias("out_plus"), F.count_if(F.col("so") == "-").alias("out_minus"))
    return nodes.select("nid").join(out, "nid", "left").select("nid", F.coalesce("out_plus", F.lit(0)).alias("out_plus"), F.coalesce("out_minus", F.lit(0)).alias("out_minus"))


def ambiguous(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Junctions: nodes that more than one edge to other nodes leaves on one side at least."""
    return degrees(nodes, without_self_loops(edges)).filter("out_plus > 1 or out_minus > 1").select("nid")


def externals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with edges on one side only, and the orientation in which they are left."""
    one_sided = degrees(nodes, edges).filter("(out_plus = 0) <> (out_minus = 0)")
    return one_sided.select("nid", F.when(F.col("out_plus") > 0, "+").otherwise("-").alias("orient"), F.greatest("out_plus", "out_minus").alias("exits"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).filter("out_plus = 0 and out_minus = 0").select("nid")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges)
    return d.agg(F.count("*").alias("kmers"), F.count_if((F.col("out_plus") == 0) & (F.col("out_minus") == 0)).alias("alone"), F.coalesce(F.sum(F.col("out_plus") + F.col("out_minus")), F.lit(0)).alias("edge_refs"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes in ``gone`` (nid)."""
    left = nodes.join(gone.select("nid"), "nid", "left_anti")
    edges = edges.join(gone.select(F.col("nid").alias("src")), "src", "left_anti").join(gone.select(F.col("nid").alias("dst")), "dst", "left_anti")
    return left, edges.select("src", "so", "dst", "do")


def without_weak(nodes: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    return without_nodes(nodes, edges, nodes.filter(F.col("cov") < least).select("nid"))


#: Links between nodes that one task labels in memory; more are labelled by rounds over the cluster.
LOCAL_LINKS = 2_000_000


def _label_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least id that each linked node is connected with: lesser labels go along links, and labels to their own labels, until none changes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nid, at = np.unique(np.concatenate((table.column("a").to_numpy(), table.column("b").to_numpy())), return_inverse=True)
    a, b = at[: table.num_rows], at[table.num_rows :]
    label = np.arange(len(nid))
    while True:
        before = label.copy()
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    for first in range(0, len(nid), 100_000):
        part = slice(first, first + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(nid[part]), pa.array(nid[label[part]])], names=["nid", "root"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nid and component, the least id that is connected with it.

    Alternating large and small stars: every node links its greater
    neighbours, then its lesser ones, to the least of all, until only stars
    are left. Minima are aggregated and joined, no neighbourhood is gathered;
    each round is written down.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    links = cut_lineage(links)
    if links.count() <= LOCAL_LINKS:
        roots = links.repartition(1).mapInArrow(_label_batch, "nid long, root long")
        return nodes.select("nid").join(roots, "nid", "left").select("nid", F.coalesce("root", "nid").alias("component"))

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = state(links)
    while True:
        both = links.union(links.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        links = cut_lineage(both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct())
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = links.join(least, "a").select(F.inline(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b")))))
        links = cut_lineage(links.filter(a != b).distinct())
        now = state(links)
        if now == last:
            break
        last = now
    return nodes.select("nid").join(links.select(a.alias("nid"), b.alias("root")), "nid", "left").select("nid", F.coalesce("root", "nid").alias("component"))


def neighbourhood_means(nodes: DataFrame, edges: DataFrame, around: DataFrame) -> DataFrame:
    """For rows (nid, but) the unweighted mean coverage of the distinct neighbours of nid on both sides except ``but``."""
    near = edges.select(F.col("src").alias("nid"), F.col("dst").alias("near")).distinct()
    cov = nodes.select(F.col("nid").alias("near"), F.col("cov").alias("near_cov"))
    return around.join(near, "nid").filter(F.col("near") != F.col("but")).join(cov, "near").groupBy("nid", "but").agg(F.avg("near_cov").alias("mean"))
