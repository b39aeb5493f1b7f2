import random

import numpy as np
import pytest

from helixframe.llm.splitting import cut_positions, oversized, split_walks

SCHEMA = "k int, contig_id long, sample string, serialized_contigs array<struct<counts:int,abs_ind:array<long>,innerdir:string>>, written_at timestamp, extra string"


def greedy(sizes, most):
    """Cuts one after another: the farthest node boundary that fits, else the limit."""
    bounds = np.cumsum([0, *[s for s in sizes if s]]).tolist()
    cuts, at = [0], 0
    while at < bounds[-1]:
        reach = [b for b in bounds if at < b <= at + most]
        at = reach[-1] if reach else at + most
        cuts.append(at)
    return cuts


def test_cuts_match_greedy():
    r = random.Random(3)
    walks = [[r.choice([0, 1, 2, 5, 9, 10, 11, 30, 95]) for _ in range(r.randrange(0, 40))] for _ in range(200)]
    walks = [w for w in walks if sum(w)]
    most = np.array([r.choice([1, 2, 10, 17, 100]) for _ in walks])
    offsets = np.cumsum([0, *map(len, walks)])
    walk, pos, _ = cut_positions(np.array([s for w in walks for s in w]), offsets, most)
    for i, w in enumerate(walks):
        assert pos[walk == i].tolist() == greedy(w, most[i])


def test_cuts_with_an_overlap_match_greedy():
    r = random.Random(4)
    walks = [[r.choice([1, 2, 5, 9, 10, 11, 30, 95]) for _ in range(r.randrange(1, 40))] for _ in range(200)]
    most = np.array([r.choice([2, 10, 17, 100]) for _ in walks])
    again = np.array([r.randrange(m) for m in most])
    offsets = np.cumsum([0, *map(len, walks)])
    walk, pos, _ = cut_positions(np.array([s for w in walks for s in w]), offsets, most, again)
    for i, w in enumerate(walks):
        bounds, cuts, here = np.cumsum([0, *w]).tolist(), [0], 0
        while here < bounds[-1]:
            budget = most[i] - (again[i] if here else 0)
            reach = [b for b in bounds if here < b <= here + budget]
            here = reach[-1] if reach else here + budget
            cuts.append(here)
        assert pos[walk == i].tolist() == cuts


def test_pieces_share_the_overlap(spark):
    walk = [list(range(a, a + n)) for a, n in ((0, 3), (3, 40), (43, 7), (50, 8), (58, 26))]
    df = rows(spark, [(5, 1, walk, at(2)), (5, 2, [[1, 2]], at(1))])
    for overlap in (None, 0, 4, 9, 19):
        mine = sorted(split_walks(df, 20, with_kmers=True, overlap=overlap).filter("contig_id = 1").collect(), key=lambda p: p.piece_no)
        shared = max((overlap or 0) - 4, 0)
        assert all(p.bases <= 20 and p.kmers == list(range(p.from_kmer, p.to_kmer)) for p in mine) and mine[0].from_kmer == 0 and mine[-1].to_kmer == 84
        assert all(b.from_kmer == max(a.to_kmer - shared, 0) and b.to_kmer > a.to_kmer for a, b in zip(mine, mine[1:]))
    with pytest.raises(ValueError):
        split_walks(df, 20, overlap=20)


def rows(spark, data):
    return spark.createDataFrame([(k, i, "s", None if w is None else [(1, a, "x") for a in w], t, "e") for k, i, w, t in data], SCHEMA)


def at(day):
    import datetime

    return None if day is None else datetime.datetime(2031, 1, day)


def test_pieces_restore_the_walk(spark):
    r = random.Random(5)
    walk = [[r.randrange(-(1 << 62), 1 << 62) for _ in range(n)] for n in (3, 0, 40, 7, 8, 1, 25)]
    walk[1] = None
    df = rows(spark, [(5, 1, walk, at(2)), (5, 1, walk, at(2)), (5, 1, [[9] * 500], at(1)), (5, 2, [[1, 2], [3]], at(1)), (5, 3, None, at(1)), (5, 4, [], at(1)), (5, 5, [None, []], at(1)), (None, 6, [[4, 5]], None), (50, 7, [[1, 2, 3]], at(1))])
    pieces = sorted(split_walks(df, 20, with_kmers=True).collect(), key=lambda p: (p.contig_id, p.piece_no))
    mine = [p for p in pieces if p.contig_id == 1]
    assert [h for p in mine for h in p.kmers] == [h for node in walk for h in node or []]
    assert all(p.bases <= 20 and p.bases == len(p.kmers) + 4 for p in mine)
    assert all(a.to_kmer == b.from_kmer for a, b in zip(mine, mine[1:])) and mine[-1].ends == "end"
    assert {p.ends for p in mine} == {"border", "inside", "end"} and all(p.inside for p in mine)
    assert [(p.contig_id, p.n_pieces) for p in pieces if p.contig_id in (2, 6)] == [(2, 1), (6, 1)]
    assert not [p for p in pieces if p.contig_id in (3, 4, 5)]
    assert [len(p.kmers) for p in pieces if p.contig_id == 7] == [1, 1, 1]  # k above the limit: one k-mer a piece
    assert {(r.contig_id, r.cut) for r in oversized(df, 20).collect()} == {(1, "inside"), (7, "inside")}


def test_borders_suffice(spark):
    df = rows(spark, [(5, 1, [[1] * 10, [2] * 10, [3] * 10], at(1)), (5, 2, [[1] * 16], at(1)), (5, 3, [[1] * 17], at(1)), (None, None, [[1] * 40], at(1))])
    assert {(r.contig_id, r.cut) for r in oversized(df, 20).collect()} == {(1, "border"), (3, "inside"), (None, "inside")}


def test_empty_and_long(spark):
    assert split_walks(rows(spark, [])).count() == 0
    df = rows(spark, [(31, 1, [[i] for i in range(20_000)], at(1))])
    got = sorted(split_walks(df).collect(), key=lambda p: p.piece_no)
    assert len(got) == -(-20_000 // 970) and all(p.bases == 1000 for p in got[:-1])
    with pytest.raises(ValueError):
        split_walks(df, 0)
