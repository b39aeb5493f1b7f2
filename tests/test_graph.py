import pytest
from pyspark.sql import functions as F

from brute import canonical, counts, genome, rc, shotgun, unitigs
from helixframe.operators import compact, correct, graph
from helixframe.operators.compact import collapse, contract, rank_paths, spell_walks
from helixframe.plans.assemble import FloorMemory, assemble, aun
from helixframe.plans.options import AssemblyOptions, CorrectionOptions, CoverageReference, GraphOutputError, InputError, PreprocessingError, SpellingError

K = 7


def build(spark, kmers: dict[str, int]):
    nodes = graph.nodes_of(spark.createDataFrame(sorted(kmers.items()), "kmer string, n long"))
    return nodes, graph.overlap_edges(nodes, len(next(iter(kmers))))


def kmers_of(*sequences: str, k: int = K, n: int = 10) -> dict[str, int]:
    return {m: n for s in sequences for m in {canonical(s[i : i + k]) for i in range(len(s) - k + 1)}}


def test_edges_and_mirrors(spark):
    nodes, edges = build(spark, kmers_of(genome(60, 1)))
    pairs = {tuple(r) for r in edges.collect()}
    flip = {"+": "-", "-": "+"}
    assert pairs and all((d, flip[do], s, flip[so]) in pairs for s, so, d, do in pairs)
    assert {tuple(r) for r in graph.paired(edges.union(edges)).collect()} == pairs
    broken = edges.limit(1)
    assert graph.paired(broken.filter("src <> dst")).count() == 0 or broken.filter("src = dst").count()


def test_unitigs_match_brute_force(spark):
    middle, ends = genome(25, 2), [genome(20, s) for s in (3, 4, 5)]
    kmers = kmers_of(ends[0] + middle + ends[1] + middle + ends[2])
    nodes, edges = build(spark, kmers)
    merged, links, changed = contract(nodes, graph.without_self_loops(edges), K)
    got = {canonical(r.seq) for r in merged.collect()}
    assert changed and got == unitigs(set(kmers), K)
    again, _, changed = contract(merged, graph.without_self_loops(links), K)
    assert not changed and {canonical(r.seq) for r in again.collect()} == got
    assert merged.agg(F.sum("n_kmers")).first()[0] == len(kmers)
    parts = graph.components(merged, links)
    assert parts.select("component").distinct().count() == 1


def test_neighbours_share_a_partition(spark, monkeypatch):
    k, text = 21, genome(3000, 77)
    kmers = kmers_of(text, k=k)
    plain = {canonical(r.seq) for r in contract(*build(spark, kmers), k)[0].collect()}
    monkeypatch.setattr(graph, "MANY_NODES", 0)
    monkeypatch.setattr(compact, "rank_paths", lambda keys, links, local=0: rank_paths(keys, links, 0))
    nodes, edges = build(spark, kmers)
    assert nodes.count() == len(kmers) == nodes.select("nid").distinct().count()
    at = F.shiftright("src", 33) == F.shiftright("dst", 33)
    assert edges.filter(at).count() > 0.6 * edges.count() and nodes.select(F.shiftright("nid", 33)).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged, _, _ = contract(nodes, graph.without_self_loops(edges), k)
    assert {canonical(r.seq) for r in merged.collect()} == plain == {canonical(text)}


@pytest.mark.parametrize("local", [graph.LOCAL_LINKS, 0])
def test_components(spark, monkeypatch, local):
    import random

    monkeypatch.setattr(graph, "LOCAL_LINKS", local)
    r = random.Random(6)
    pairs = [(a, a + 1) for a in range(100, 160)] + [(200, b) for b in range(201, 230)] + [tuple(r.sample(range(300, 340), 2)) for _ in range(25)] + [(7, 7)]
    ids = sorted({x for p in pairs for x in p} | {1, 2})
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame([(a, "+", b, "+") for a, b in pairs] + [(b, "-", a, "-") for a, b in pairs], graph.EDGES)
    nodes = plain_nodes(spark, [(i, "A", 1, 1.0) for i in ids])
    assert {r.nid: r.component for r in graph.components(nodes, edges).collect()} == root


def test_cycle_spells_the_overlap_again(spark):
    ring = genome(40, 8)
    kmers = kmers_of(ring + ring[: K - 1])
    nodes, edges = build(spark, kmers)
    rows = collapse(nodes, graph.paired(edges), K).collect()
    assert len(rows) == 1 and rows[0].kind == "cycle" and rows[0].len == len(kmers) + K - 1
    seq = rows[0].seq
    assert seq[: K - 1] == seq[-(K - 1) :] and (seq[:20] in ring * 3 or rc(seq[:20]) in ring * 3)


@pytest.mark.parametrize("local", [compact.LOCAL_KEYS, 0])
def test_ranking(spark, local):
    keys = spark.range(0, 300).withColumnRenamed("id", "key")
    links = keys.filter("key < 99 or key between 100 and 162 or key = 163").select(F.col("key").alias("u"), F.when(F.col("key") == 163, 100).otherwise(F.col("key") + 1).alias("v"))
    rows = {r.key: r for r in rank_paths(keys, links, local).collect()}
    assert all(rows[i].head == 0 and rows[i].rank == i and not rows[i].cyclic for i in range(100))
    assert all(rows[i].head == 100 and rows[i].rank == i - 100 and rows[i].cyclic for i in range(100, 164))
    assert rows[250].head == 250 and len(rows) == 300


def test_ranking_over_id_partitions(spark, monkeypatch):
    monkeypatch.setattr(compact, "ID_PARTITION_SHIFT", 4)  # pieces of sixteen keys, as if ids came from many partitions
    n = 200
    order = [(37 * i) % n for i in range(n)]  # a path through all keys that leaves its partition at every step
    pairs = list(zip(order, order[1:])) + [(a, a + 1) for a in range(300, 399)] + [(a, a + 1) for a in range(500, 577)] + [(577, 500), (640, 641), (641, 640)]
    keys = spark.range(0, 700).withColumnRenamed("id", "key")
    links = spark.createDataFrame(pairs, "u long, v long")
    rows = {r.key: r for r in rank_paths(keys, links, 0).collect()}
    assert len(rows) == 700 and all(rows[k].head == order[0] and rows[k].rank == i and not rows[k].cyclic for i, k in enumerate(order))
    assert all(rows[300 + i].head == 300 and rows[300 + i].rank == i for i in range(100))
    assert all(rows[500 + i].head == 500 and rows[500 + i].rank == i and rows[500 + i].cyclic for i in range(78))
    assert rows[641].head == 640 and rows[641].rank == 1 and rows[641].cyclic and rows[450].head == 450


def plain_nodes(spark, rows):
    return spark.createDataFrame(rows, graph.NODES)


def both_ways(spark, pairs):
    flip = {"+": "-", "-": "+"}
    return spark.createDataFrame(sorted({e for s, so, d, do in pairs for e in ((s, so, d, do), (d, flip[do], s, flip[so]))}), graph.EDGES)


def test_dead_ends(spark):
    long, cov = 500, 30.0
    nodes = plain_nodes(spark, [(1, "A", long, cov), (2, "C", long, cov), (3, "G", 10, cov), (4, "T", 20, cov), (5, "AA", 30, cov), (6, "CC", long, cov), (7, "GG", 120, 3.0), (8, "TT", long, cov)])
    edges = both_ways(spark, [(1, "+", 2, "+"), (3, "+", 2, "+"), (4, "+", 2, "+"), (2, "+", 6, "+"), (7, "+", 8, "+"), (6, "+", 8, "+")])
    gone = {r.nid for r in correct.dead_ends(nodes, edges, 21, CorrectionOptions()).collect()}
    # 3 loses to the longer dead end 4; 5 stands alone and is short; 7 is beyond the limit but far less covered
    assert gone == {3, 5, 7}


def test_bulge_and_coverage_rules(spark):
    def run(c, a, options=CorrectionOptions()):
        nodes = plain_nodes(spark, [(1, "A", 300, 30.0), (2, "C", 300, 30.0), (3, "G", 21, c), (4, "T", 21, a)])
        edges = both_ways(spark, [(1, "+", 3, "+"), (3, "+", 2, "+"), (1, "+", 4, "-"), (4, "-", 2, "+")])
        return {r.nid for r in correct.bulges(nodes, edges, 21, options).collect()}

    assert run(2.0, 30.0) == {3} and run(30.0, 2.0) == {4}
    assert run(3.0, 30.0) == set() and run(20.0, 30.0) == set()
    assert run(4.0, 30.0, CorrectionOptions(coverage=CoverageReference(20, 2, 0.25))) == {3}


@pytest.mark.parametrize("hops", [4, 7])
def test_bulge_with_a_long_alternative(spark, hops):
    chain = list(range(4, 4 + hops))
    nodes = plain_nodes(spark, [(1, "A", 300, 30.0), (2, "C", 300, 30.0), (3, "G", 21, 2.0)] + [(i, "T", 21 // hops, 30.0) for i in chain])
    walk = [1, *chain, 2]
    edges = both_ways(spark, [(1, "+", 3, "+"), (3, "+", 2, "+")] + [(a, "+", b, "+") for a, b in zip(walk, walk[1:])])
    assert {r.nid for r in correct.bulges(nodes, edges, 21, CorrectionOptions()).collect()} == {3}


def test_connectors(spark):
    def run(c, **options):
        nodes = plain_nodes(spark, [(1, "A", 300, 30.0), (2, "C", 300, 30.0), (3, "G", 30, c), (4, "T", 300, 30.0), (5, "AA", 300, 5.0), (6, "CC", 300, 30.0)])
        edges = both_ways(spark, [(1, "+", 3, "+"), (3, "+", 2, "+"), (1, "+", 4, "+"), (5, "+", 2, "+"), (2, "+", 6, "+")])
        return {r.nid for r in correct.connectors(nodes, edges, 21, CorrectionOptions(**options)).collect()}

    assert run(3.0) == {3} and run(8.0) == set() and run(3.0, connector_both=True) == set() and run(1.0, connector_both=True) == {3}


def test_connector_flanks_follow_the_only_way_on(spark):
    def run(extra, flank=8.0):
        # 1 -3-> 2, beside it 1 -> 4 and 5 -> 2; 4 alone is weak, but goes on to 7 (and 8) without a choice
        nodes = plain_nodes(spark, [(1, "A", 300, 30.0), (2, "C", 300, 30.0), (3, "G", 30, 3.0), (4, "T", 100, flank), (5, "AA", 300, 5.0), (6, "CC", 300, 30.0), (7, "GG", 300, 30.0), (8, "TT", 300, 30.0), (9, "ACA", 300, 30.0)])
        edges = both_ways(spark, [(1, "+", 3, "+"), (3, "+", 2, "+"), (1, "+", 4, "+"), (5, "+", 2, "+"), (2, "+", 6, "+"), (4, "+", 7, "-"), *extra])
        table = {r.nid: r for r in correct.connector_verdicts(nodes, edges, 21, CorrectionOptions()).collect()}
        return table, {r.nid for r in correct.connectors(nodes, edges, 21, CorrectionOptions()).collect()}

    table, gone = run([(9, "+", 7, "-")])  # 7 has two ways in, which does not stop the walk
    assert gone == {3} and abs(table[3].left_mean - (100 * 8 + 300 * 30) / 400) < 1e-9 and table[3].right_mean == 5.0
    table, gone = run([(7, "-", 8, "+"), (7, "-", 9, "+")])  # the walk ends before the fork
    assert abs(table[3].left_mean - (100 * 8 + 300 * 30) / 400) < 1e-9
    table, gone = run([(7, "-", 8, "+"), (8, "+", 7, "-")])  # a circle: given up
    assert 3 not in table and gone == set()


def test_detours_wait_for_lesser_ones(spark):
    """Three ways from 1 to 60: 10 is judged by 20 alone (4 k-mers against 1), 20 by 40 (7 against 4)."""

    def run(x, y):
        nodes = plain_nodes(spark, [(1, "CCC", 20, 20.0), (10, x, 1, 1.0), (20, y, 4, 3.0), (40, "GGA", 7, 9.0), (60, "CAC", 20, 20.0)])
        edges = both_ways(spark, [e for m in (10, 20, 40) for e in ((1, "+", m, "+"), (m, "+", 60, "+"))])
        options = CorrectionOptions(pop_ratio=0.5)
        gone, here = [], (nodes, edges)
        while True:
            now = sorted(r.nid for r in correct.bulges(*here, 31, options).collect())
            if not now:
                return gone
            gone.append(now)
            here = graph.without_nodes(*here, spark.createDataFrame([(n,) for n in now], "nid long"))

    assert run("AAA", "ACA") == [[10, 20]]  # the lesser sequence is judged while its alternative stands
    assert run("ACA", "AAA") == [[20]]  # with the alternative gone first, nothing is left to judge it by


def test_alternatives_tried(spark):
    # seven short spurs before the alternative: a search that goes on from few partial paths does not get there
    nodes = plain_nodes(spark, [(1, "A", 300, 30.0), (2, "C", 300, 30.0), (3, "G", 10, 1.0), (4, "TA", 5, 30.0), (5, "TC", 5, 30.0)] + [(10 + i, "G" + "ACT"[i % 3] * (i + 1), 1, 30.0) for i in range(7)])
    edges = both_ways(spark, [(1, "+", 3, "+"), (3, "+", 2, "+"), (1, "+", 4, "+"), (4, "+", 5, "+"), (5, "+", 2, "+")] + [(1, "+", 10 + i, "+") for i in range(7)])
    run = lambda n: {r.nid for r in correct.bulges(nodes, edges, 21, CorrectionOptions(alternatives_tried=n)).collect()}
    assert run(8) == set() and run(9) == {3} == run(None) == run(131)


def test_only_what_was_cut_off_counts_as_isolated(spark):
    options = CorrectionOptions(remove_bulges=False, remove_connectors=False)
    nodes = plain_nodes(spark, [(1, "ACGTTGCA", 30, 9.0)])
    left, _, removed = correct.correct(nodes, both_ways(spark, [(1, "+", 1, "+")]), 21, options)
    assert [r.nid for r in left.collect()] == [1] and removed["dead ends"] == 0
    assert [r.nid for r in correct.dead_ends(nodes, spark.createDataFrame([], graph.EDGES), 21, options).collect()] == [1]


def test_spelling(spark):
    text = genome(40, 11)
    walk = [canonical(text[i : i + K]) for i in range(len(text) - K + 1)]
    df = spark.createDataFrame([(1, walk), (2, walk[:1])], "walk_id int, kmers array<string>")
    got = {r.walk_id: r.seq for r in spell_walks(df, K).collect()}
    assert canonical(got[1]) == canonical(text) and got[2] == walk[0]
    for bad, why in (([], "empty"), (["ACG"], "length"), ([walk[0], "TTTTTTT"], "not a walk")):
        with pytest.raises(Exception, match=why):
            spell_walks(spark.createDataFrame([(1, bad)], "walk_id int, kmers array<string>"), K).collect()


def test_weak_nodes_and_totals(spark):
    nodes, edges = build(spark, {**kmers_of(genome(30, 12)), "AAAAAAA": 1})
    assert graph.without_weak(nodes, edges, 5)[0].count() == nodes.count() - 1
    total = graph.totals(nodes, edges).first()
    assert total.kmers == nodes.count() and total.edge_refs == edges.count()
    assert {r.kmer for r in graph.lookup(nodes, spark.createDataFrame([("TTTTTTT",), ("CCCCCCC",)], "kmer string")).collect()} == {"TTTTTTT"}


def test_floor_memory():
    m = FloorMemory(25)
    m.saw(11, True)
    assert m.ceiling == 25
    m.saw(0, False)
    m.saw(0, True)
    assert m.ceiling == 11
    m.saw(0, True)  # the choice before stays the last one
    assert m.ceiling == 0


def test_assembly(spark):
    text = genome(700, 21)
    df = spark.createDataFrame(shotgun(text, 260, 80, 22, 0.2), "read_id long, seq string, qual string")
    done = assemble(df, AssemblyOptions(k=21, min_count=3, min_contig_length=200))
    rows = done.long_contigs().collect()
    assert len(rows) == 1 and (rows[0].seq in text or rc(rows[0].seq) in text) and rows[0].len > 0.95 * 700
    assert done.completed_ks == [21] and len(done) == 1 and not done.is_empty()
    assert abs(aun(done.contigs, 200) - rows[0].len) < 1e-9
    empty = df.limit(0)
    with pytest.raises(InputError):
        assemble(empty, AssemblyOptions(k=21))
    with pytest.raises(PreprocessingError):
        assemble(df, AssemblyOptions(k=81))


def test_a_ladder_gives_one_exact_contig(spark):
    text = genome(2000, 61)
    quality = "".join(chr(33 + (35 if j % 7 == 0 else 70)) for j in range(150))
    rows = [(2 * i + copy, text[5 * i : 5 * i + 150], quality) for i in range(371) for copy in (0, 1)]
    steps = []
    done = assemble(spark.createDataFrame(rows, "read_id long, seq string, qual string"), AssemblyOptions(ks=(21, 31), min_contig_length=200), counted=steps.append)
    rows = done.long_contigs().collect()
    assert done.completed_ks == [21, 31] and done.stopped_at is None and [s.k for s in steps] == [21, 31]
    assert len(rows) == 1 and (rows[0].seq in text or rc(rows[0].seq) in text) and rows[0].len >= 0.99 * 2000


def test_an_unresolved_first_k_still_gives_its_graph(spark):
    text = genome(160, 51)
    df = spark.createDataFrame([(i, text[80 * (i % 2) :][:80], None) for i in range(4)], "read_id long, seq string, qual string")
    seen, steps = [], []
    done = assemble(df, AssemblyOptions(k=21), lambda nodes, edges: seen.append(nodes.count()), counted=steps.append)
    assert steps[0].unresolved and steps[0].min_count == 2 and seen and done.completed_ks == [21]

    def broken(nodes, edges):
        raise OSError("disk full")

    with pytest.raises(GraphOutputError, match="disk full"):
        assemble(df, AssemblyOptions(k=21, min_count=2), broken)
    with pytest.raises(SpellingError):
        spell_walks(df, 1)


def test_counts_survive_brute_force():
    assert sum(counts([(1, "ACGTT", None)], 3).values()) == 3 and compact.CHUNK > 1
