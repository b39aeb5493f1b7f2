"""Correction of the graph: dead ends, bulges, weak connectors.

Every step judges all candidates against the unchanged graph and removes a
batch of them, so each step is a handful of equi-joins; steps repeat until
nothing changes. Candidates have an order, by sequence: one whose verdict
could change with the removal of an earlier one waits for the next round, so
what goes is what would go one by one in this order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..plans.options import CorrectionOptions, bulge_kmers, connector_kmers, dead_end_bases, short_path_limit
from ..session import cut_lineage
from .compact import contract_and_tell
from .graph import degrees, externals, isolated, neighbourhood_means, paired, without_nodes, without_self_loops

#: Alternative paths: how far their length may differ.
LENGTH_SLACK, LENGTH_SHARE = 3, 0.10


def dead_ends(nodes: DataFrame, edges: DataFrame, k: int, options: CorrectionOptions, alone: DataFrame | None = None) -> DataFrame:
    """nid of every node that ends nowhere and is too short, or short and far less covered than its surroundings.

    Isolated nodes below the limit go, if they are among ``alone`` (nid; None: all). A dead end that leads into a junction
    goes below the limit, unless it is longer than every other short dead end
    of that junction, which go instead; up to the covered limit it goes if the
    junction's other neighbours average more than the ratio times its
    coverage. A dead end that fans out is its own junction.
    """
    limit = short_path_limit(dead_end_bases(options.dead_end_bases, options.dead_end_k_multiple, k), k)
    covered = max(limit, short_path_limit(dead_end_bases(options.dead_end_bases, options.dead_end_covered_k_multiple, k), k))
    size = nodes.select("nid", "n_kmers", "cov")
    lone = isolated(nodes, edges)
    lone = (lone if alone is None else lone.join(alone, "nid", "left_semi")).join(size, "nid").filter(F.col("n_kmers") < limit).select("nid")
    tips = cut_lineage(externals(nodes, edges).join(size, "nid").filter(F.col("n_kmers") < covered))
    lead = edges.select(F.col("src").alias("nid"), F.col("so").alias("orient"), F.col("dst").alias("junction"), F.col("do").alias("jo"))

    fans = tips.filter("exits > 1")
    fan_short = fans.filter(F.col("n_kmers") < limit).select("nid")
    fan_mean = neighbourhood_means(nodes, edges, fans.select("nid", F.lit(-1).cast("long").alias("but"))).select("nid", "mean")
    fan_weak = fans.join(fan_mean, "nid").filter((F.col("n_kmers") >= limit) & (F.col("mean") > options.dead_end_ratio * F.col("cov"))).select("nid")

    single = tips.filter("exits = 1").join(lead, ["nid", "orient"])
    short = cut_lineage(single.filter(F.col("n_kmers") < limit))
    rivals = short.select("junction", "jo", F.col("nid").alias("rival"), F.col("n_kmers").alias("rival_kmers"))
    against = short.join(rivals, ["junction", "jo"]).filter(F.col("nid") != F.col("rival"))
    longest = against.groupBy("nid").agg(F.max("rival_kmers").alias("rival_kmers"))
    judged = short.join(longest, "nid", "left").withColumn("wins", F.coalesce(F.col("n_kmers") > F.col("rival_kmers"), F.lit(False)))
    losers = judged.filter("not wins").select("nid")
    mean = neighbourhood_means(nodes, edges, single.filter(F.col("n_kmers") >= limit).select(F.col("junction").alias("nid"), F.col("nid").alias("but")))
    weak = single.filter(F.col("n_kmers") >= limit).join(mean.select(F.col("nid").alias("junction"), F.col("but").alias("nid"), "mean"), ["junction", "nid"]).filter(F.col("mean") > options.dead_end_ratio * F.col("cov")).select("nid")
    return lone.union(fan_short).union(fan_weak).union(losers).union(weak).distinct()


def _inner(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Oriented nodes with one way in and one way out between two others: entrance, node, exit. Each appears in both directions."""
    d = degrees(nodes, edges).filter("out_plus = 1 and out_minus = 1").select("nid")
    out = edges.select(F.col("src").alias("nid"), F.col("so").alias("orient"), F.col("dst").alias("x"), F.col("do").alias("xo"))
    into = edges.select(F.col("src").alias("e"), F.col("so").alias("eo"), F.col("dst").alias("nid"), F.col("do").alias("orient"))
    return into.join(d, "nid", "left_semi").join(out, ["nid", "orient"]).filter("e <> nid and x <> nid and e <> x")


def _sides(df: DataFrame) -> DataFrame:
    """nid, key and the two ends of each row, as the oriented node that is left there: the same whatever the row's direction."""
    back = F.when(F.col("xo") == "+", "-").otherwise("+")
    return df.select("nid", "key", F.inline(F.array(F.struct(F.col("e").alias("at"), F.col("eo").alias("ao")), F.struct(F.col("x").alias("at"), back.alias("ao")))))


def bulge_verdicts(nodes: DataFrame, edges: DataFrame, k: int, options: CorrectionOptions) -> DataFrame:
    """Every detour that has an alternative: nid, key (its lesser sequence), e, eo, x, xo, c_cov, the best alternative's
    a_cov, a_kmers and nodes, and whether the detour is to go.

    A detour is a contracted path from a node with several ways on to one with
    several ways in. An alternative avoids the detour and its entrance, visits
    no node twice and is of about the detour's length. The best covered one
    counts, then the closest in length, then the least by sequence. Partial
    paths are followed in rounds over all detours at once; of each detour the
    shortest ``alternatives_tried`` are followed on. The detour goes if its
    coverage is less than ``pop_ratio`` of the alternative's (as 32-bit
    floats), or if it looks like an error and the alternative does not.
    """
    info = nodes.select("nid", "n_kmers", "cov", F.least("seq", reverse_complement("seq")).alias("key"))
    forks = edges.groupBy("src", "so").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("src").alias("e"), F.col("so").alias("eo"))
    joins = edges.groupBy("dst", "do").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("dst").alias("x"), F.col("do").alias("xo"))
    inner = _inner(nodes, edges).filter("e < x").join(info, "nid").filter(F.col("n_kmers") <= bulge_kmers(k))
    candidates = cut_lineage(inner.join(forks, ["e", "eo"], "left_semi").join(joins, ["x", "xo"], "left_semi").select("nid", "key", "e", "eo", "x", "xo", F.col("n_kmers").alias("c_kmers"), F.col("cov").alias("c_cov")))
    way = edges.join(nodes.select(F.col("nid").alias("dst"), "n_kmers", "cov", "seq"), "dst").select(F.col("src").alias("at"), F.col("so").alias("ao"), F.col("dst").alias("to"), F.col("do").alias("to_o"), "n_kmers", "cov", F.when(F.col("do") == "+", F.col("seq")).otherwise(reverse_complement("seq")).alias("read"))
    slack = F.greatest(F.lit(LENGTH_SLACK), F.ceil(F.col("c_kmers") * LENGTH_SHARE))
    told = ["nid", "c_kmers", "e", "x", "xo"]
    front = candidates.select(*told, F.col("e").alias("at"), F.col("eo").alias("ao"), F.lit(0).cast("long").alias("len"), F.lit(0.0).alias("mass"), F.array().cast("array<bigint>").alias("seen"), F.lit("").alias("sign"))
    reached = None
    tried = options.alternatives_tried
    place = F.row_number().over(Window.partitionBy("nid").orderBy("len", "sign", "seen"))
    number = 0
    while not front.isEmpty():
        number += 1
        on = front.join(way, ["at", "ao"]).filter((F.col("to") != F.col("nid")) & (F.col("to") != F.col("e")) & ~((F.col("to") == F.col("x")) & (F.col("to_o") == F.col("xo"))) & ~F.array_contains("seen", F.col("to")))
        on = on.filter(F.col("len") + F.col("n_kmers") <= F.col("c_kmers") + slack)
        on = on.select(*told, F.col("to").alias("at"), F.col("to_o").alias("ao"), (F.col("len") + F.col("n_kmers")).alias("len"), (F.col("mass") + F.col("cov") * F.col("n_kmers")).alias("mass"), F.concat("seen", F.array("to")).alias("seen"), F.concat("sign", "read").alias("sign"), F.lit(number).alias("round"))
        reached = on if reached is None else reached.unionByName(on)
        if tried is not None:  # a path beyond these stays beyond them, as what follows is longer than what it follows
            reached = reached.withColumn("place", place).filter(F.col("place") <= tried).drop("place")
        reached = cut_lineage(reached)
        front = reached.filter(F.col("round") == number)
    if reached is None:
        reached = front.withColumn("round", F.lit(0))
    ends = edges.select(F.col("src").alias("at"), F.col("so").alias("ao"), F.col("dst").alias("x"), F.col("do").alias("xo"))
    arrived = reached.filter(F.col("len") >= F.col("c_kmers") - slack).join(ends, ["at", "ao", "x", "xo"], "left_semi")
    arrived = arrived.select("nid", F.struct((-F.try_divide("mass", "len")).alias("order"), F.abs(F.col("len") - F.col("c_kmers")).alias("away"), "sign", F.col("len").alias("a_kmers"), "seen").alias("b"))
    best = candidates.join(arrived.groupBy("nid").agg(F.min("b").alias("b")), "nid").select("nid", "key", "e", "eo", "x", "xo", "c_cov", (-F.col("b.order")).alias("a_cov"), "b.a_kmers", F.col("b.seen").alias("nodes"))
    weaker = F.col("c_cov").cast("float") < F.lit(options.pop_ratio).cast("float") * F.col("a_cov").cast("float")
    ceiling = options.coverage.ceiling
    if ceiling is not None:
        weaker = weaker | ((F.round("c_cov") < ceiling) & (F.round("a_cov") >= ceiling))
    return best.withColumn("goes", weaker)


def bulges(nodes: DataFrame, edges: DataFrame, k: int, options: CorrectionOptions) -> DataFrame:
    """nid of every detour that goes by `bulge_verdicts`, without those that must wait.

    A detour waits if a lesser one that goes is part of its alternative, or if
    the lesser ones that go leave its exit or entrance only one way: its shape
    will be another then.
    """
    gone = cut_lineage(bulge_verdicts(nodes, edges, k, options).filter("goes"))
    earlier = gone.select(F.col("nid").alias("part"), F.col("key").alias("part_key"))
    broken = gone.select("nid", "key", F.explode("nodes").alias("part")).join(earlier, "part").filter("part_key < key").select("nid")
    ways = edges.groupBy(F.col("src").alias("at"), F.col("so").alias("ao")).agg(F.count("*").alias("ways"))
    order = Window.partitionBy("at", "ao").orderBy("key", "nid")
    closed = _sides(gone).join(ways, ["at", "ao"]).withColumn("before", F.row_number().over(order) - 1).filter("ways - before < 2").select("nid")
    return gone.select("nid").join(broken.union(closed).distinct(), "nid", "left_anti")


def continuations(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """mass and kmers of the path from every oriented node of ``starts`` (at, ao) along its only way on, until there is none
    or several; a path that never ends has no row.

    By pointer doubling: every node's pointer is replaced by its pointer's, so
    a path of n nodes takes log n rounds.
    """
    own = nodes.select("nid", (F.col("cov") * F.col("n_kmers")).alias("mass"), F.col("n_kmers").alias("kmers"))
    code = lambda n, o: F.col(n) * 2 + (F.col(o) == "-").cast("long")
    only = edges.groupBy(code("src", "so").alias("key")).agg(F.count("*").alias("n"), F.first(code("dst", "do")).alias("ptr")).filter("n = 1").select("key", "ptr")
    state = own.select(F.explode(F.array(F.col("nid") * 2, F.col("nid") * 2 + 1)).alias("key"), "mass", "kmers").join(only, "key", "left")
    state = cut_lineage(state.select("key", F.col("ptr").isNull().alias("done"), F.coalesce("ptr", "key").alias("ptr"), "mass", "kmers"))
    for _ in range(math.ceil(math.log2(max(state.count(), 2))) + 1):
        if state.filter("not done").isEmpty():
            break
        far = state.select(F.col("key").alias("ptr"), F.col("ptr").alias("far"), F.col("done").alias("far_done"), F.col("mass").alias("more"), F.col("kmers").alias("more_kmers"))
        moved = state.filter("not done").join(far, "ptr").select("key", F.col("far_done").alias("done"), F.col("far").alias("ptr"), (F.col("mass") + F.col("more")).alias("mass"), (F.col("kmers") + F.col("more_kmers")).alias("kmers"))
        state = cut_lineage(state.filter("done").unionByName(moved))
    return starts.withColumn("key", code("at", "ao")).join(state.filter("done").select("key", "mass", "kmers"), "key").drop("key")


def connector_verdicts(nodes: DataFrame, edges: DataFrame, k: int, options: CorrectionOptions) -> DataFrame:
    """Every link whose entrance has other ways out and whose exit has other ways in: nid, key, e, eo, x, xo, cov, left_mean,
    right_mean and whether it is to go.

    A competing branch counts with its mean coverage, weighted by k-mers,
    along its only continuation; the branches of a side are averaged. A link
    with a branch that runs in a circle is left out. It goes if the one or the
    other mean (or both, with ``connector_both``) exceeds ``connector_ratio``
    times its own coverage.
    """
    inner = _inner(nodes, edges).join(nodes.select("nid", "n_kmers", "cov", F.least("seq", reverse_complement("seq")).alias("key")), "nid").filter(F.col("n_kmers") <= connector_kmers(k))
    onward = edges.select(F.col("src").alias("x"), F.col("so").alias("xo")).distinct()
    inner = cut_lineage(inner.join(onward, ["x", "xo"], "left_semi"))
    out = edges.select(F.col("src").alias("e"), F.col("so").alias("eo"), F.col("dst").alias("at"), F.col("do").alias("ao"))
    into = edges.select(F.col("dst").alias("x"), F.col("do").alias("xo"), F.col("src").alias("at"), F.when(F.col("so") == "+", "-").otherwise("+").alias("ao"))
    sides = [inner.join(side, keys).filter(F.col("at") != F.col("nid")).select("nid", "orient", F.lit(name).alias("side"), "at", "ao") for side, keys, name in ((out, ["e", "eo"], "left"), (into, ["x", "xo"], "right"))]
    branches = cut_lineage(sides[0].unionByName(sides[1]))
    means = continuations(nodes, edges, branches.select("at", "ao").distinct()).select("at", "ao", (F.col("mass") / F.col("kmers")).alias("mean"))
    met = branches.join(means, ["at", "ao"], "left").groupBy("nid", "orient").agg(
        F.bool_or(F.col("mean").isNull()).alias("circular"), *(F.avg(F.when(F.col("side") == s, F.col("mean"))).alias(f"{s}_mean") for s in ("left", "right"))
    )
    judged = inner.join(met.filter("not circular and left_mean is not null and right_mean is not null"), ["nid", "orient"])
    limit = options.connector_ratio * F.col("cov")
    over = (F.col("left_mean") > limit, F.col("right_mean") > limit)
    return judged.select("nid", "key", "e", "eo", "x", "xo", "cov", "left_mean", "right_mean", (over[0] & over[1] if options.connector_both else over[0] | over[1]).alias("goes"))


def connectors(nodes: DataFrame, edges: DataFrame, k: int, options: CorrectionOptions) -> DataFrame:
    """nid of every link that goes by `connector_verdicts`; one that shares an end with a lesser one that goes waits, as its
    branches will be others then."""
    gone = cut_lineage(connector_verdicts(nodes, edges, k, options).filter("goes"))
    order = Window.partitionBy("at", "ao").orderBy("key", "nid")
    late = _sides(gone).dropDuplicates(["nid", "at", "ao"]).withColumn("before", F.row_number().over(order) - 1).filter("before > 0").select("nid")
    return gone.select("nid").distinct().join(late.distinct(), "nid", "left_anti")


def _remove(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    gone = cut_lineage(gone)
    n = gone.count()
    if n:
        nodes, edges = without_nodes(nodes, edges, gone)
        nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    return nodes, edges, n


def correct(nodes: DataFrame, edges: DataFrame, k: int, options: CorrectionOptions) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The corrected graph and how many nodes each step removed.

    First paths are contracted and dead ends removed until nothing changes,
    then bulges and connectors too. Every round but the last removes or merges
    nodes, so this ends. A node that is isolated from the start stays; a path
    that is cut off by the removal of dead ends goes if it is short.
    """
    removed = {"dead ends": 0, "bulges": 0, "connectors": 0}
    edges = cut_lineage(paired(without_self_loops(edges)))

    def settle(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        nodes, edges, _ = contract_and_tell(nodes, edges, k)
        edges = without_self_loops(edges)
        made = None
        while options.remove_dead_ends:
            made = nodes.select("nid").limit(0) if made is None else made
            nodes, edges, n = _remove(nodes, edges, dead_ends(nodes, edges, k, options, made))
            removed["dead ends"] += n
            if not n:
                break
            nodes, edges, made = contract_and_tell(nodes, edges, k)
            edges = without_self_loops(edges)
        return nodes, edges

    nodes, edges = settle(nodes, edges)
    while True:
        changed = 0
        for name, wanted, find in (("bulges", options.remove_bulges, bulges), ("connectors", options.remove_connectors, connectors)):
            if wanted:
                nodes, edges, n = _remove(nodes, edges, find(nodes, edges, k, options))
                removed[name] += n
                changed += n
                if n:  # what a removal leaves unbranched is one path to the next step
                    nodes, edges, _ = contract_and_tell(nodes, edges, k)
                    edges = without_self_loops(edges)
        if not changed:
            return nodes, edges, removed
        nodes, edges = settle(nodes, edges)
