from collections import Counter

import numpy as np
import pytest

from helixframe.llm.heavy import VoteSketch, heavy_items, vote_sketch, Entries

SCHEMA = "entry_id long, hnc long, count long, item string, extra int"


def test_bounds_hold_after_merging():
    r = np.random.default_rng(1)
    items = r.zipf(1.3, 60_000) % 5000 - 2500
    weights = r.integers(0, 9, len(items))
    truth = Counter()
    for i, w in zip(items.tolist(), weights.tolist()):
        truth[i] += w
    whole = VoteSketch(4, 256)
    for part in np.array_split(np.arange(len(items)), 7):
        piece = VoteSketch(4, 256)
        for some in np.array_split(part, 3):
            piece.add(items[some], weights[some])
        for row in range(4):
            cell = np.arange(256)
            whole.merge(row, cell, piece.total[row], piece.item[row], piece.surplus[row])
    keys = np.array(list(truth))
    low, high = whole.bounds(keys)
    sums = np.array([truth[k] for k in keys.tolist()])
    assert (low <= sums).all() and (sums <= high).all() and whole.total[0].sum() == sums.sum()


def frame(spark, rows):
    return spark.createDataFrame([(e, h, c, "x", 1) for e, h, c in rows], SCHEMA).repartition(5)


def test_exact_result(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(h), int(c)) for i, (h, c) in enumerate(zip(r.zipf(1.4, 20_000) % 3000, r.integers(0, 20, 20_000)))]
    rows += rows[:4000]
    truth = Counter()
    for e, h, c in dict.fromkeys(rows):
        truth[h] += c
    whole = sum(truth.values())
    for share, width in ((0.005, 2048), (0.01, 8), (0.2, 2048)):  # a tiny sketch is full of doubtful cells
        got = {x.item: x for x in heavy_items(frame(spark, rows), share, width=width).collect()}
        assert {i: x.weight for i, x in got.items()} == {i: n for i, n in truth.items() if n >= share * whole}
        assert all(x.low <= x.weight <= x.high for x in got.values())


def test_hot_item_nulls_ties(spark):
    rows = [(i, 7, 1) for i in range(3000)] + [(3000 + i, i + 100, None) for i in range(50)] + [(4000, None, 3000), (4001, 8, 500), (4002, 9, 500), (4001, 8, 500)] + [(None, 10, 400)] * 2 + [(5000, 11, -5), (5001, 12, 0)]
    got = {x.item: x.weight for x in heavy_items(frame(spark, rows), 0.05).collect()}
    assert got == {7: 3000, 8: 500, 9: 500, 10: 800}
    sketch, whole = vote_sketch(frame(spark, rows))
    assert whole == 3000 + 3000 + 1000 + 800


def test_empty(spark):
    assert heavy_items(frame(spark, [])).count() == 0
    assert heavy_items(frame(spark, [(1, 5, 0), (2, None, None)])).count() == 0
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            heavy_items(frame(spark, []), bad)
    renamed = frame(spark, [(1, 5, 3)]).withColumnRenamed("hnc", "word").drop("item").withColumnRenamed("word", "item")
    assert heavy_items(renamed, entries=Entries(item="item")).first().item == 5
