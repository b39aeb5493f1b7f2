import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import frequency, versions
from helixframe.llm.frequency import dictionary_of, marked_terms, packed, packed_terms, term_frequencies, unpacked, unpacked_terms

BLOCKS = "block_id long, sample string, canonical_hashes array<long>, counts array<long>, loaded_at timestamp, value string, term_id int"
RUNS = "sample string, used_min_count int, run_at timestamp, value string"


def day(n):
    return None if n is None else datetime.datetime(2031, 1, n)


def blocks(spark, rows):
    return spark.createDataFrame([(b, s, h, c, day(t), "x", 0) for b, s, h, c, t in rows], BLOCKS).repartition(4)


def runs(spark, rows):
    return spark.createDataFrame([(s, m, day(t), "x") for s, m, t in rows], RUNS)


ROWS = [
    (1, "a", [5, 5, None, -3, 9], [1, 2, 7, 4], 1),
    (1, "a", [5, 5, None, -3, 9], [1, 2, 7, 4], 1),
    (1, "a", [5, 100], [50, 50], None),
    (2, "a", [5, -3], None, 3),
    (2, "a", [5, -3], [9, 9], 2),
    (3, "b", [5, 8], [None, 6], 1),
    (4, "b", None, None, 1),
    (5, None, [8], [1, 2, 3], 1),
    (None, "a", [9], [2], 1),
]


def test_frequencies(spark):
    got = {r.value: (r.occurrences, r.records, r.libraries) for r in term_frequencies(blocks(spark, ROWS)).collect()}
    assert got == {5: (3, 3, 2), -3: (4, 2, 1), 9: (2, 2, 1), 8: (7, 2, 2)}


def test_marks(spark):
    cut = runs(spark, [("a", 5, 2), ("a", 1, 1), ("a", 0, None), ("b", 7, 1), ("b", 7, 1), (None, None, 3)])
    got = {(r.canonical_hash, r.mark) for r in marked_terms(blocks(spark, ROWS), cut, 0.4).collect()}
    # six blocks: 5 stands in three; 8 is kept by the library without cutoff
    assert got == {(5, "rare"), (-3, "rare"), (9, "rare"), (5, "common")}


def test_hot_value_and_ids(spark):
    rows = [(i, f"l{i % 40}", [7, i], [1, 1], 1) for i in range(5000)]
    terms = term_frequencies(blocks(spark, rows), ranges=3)
    assert terms.count() == terms.select("term_id").distinct().count() == 5000
    assert terms.filter("value = 7").first()[2:5] == (5001, 5000, 40)
    ordered = terms.withColumn("range", F.shiftright("term_id", 40)).groupBy("range").agg(F.array_sort(F.collect_list(F.struct("value", "term_id"))).alias("t")).collect()
    assert all([x.term_id & ((1 << 40) - 1) for x in r.t] == list(range(len(r.t))) for r in ordered)


@pytest.mark.parametrize("rows", [[], [(1, "a", [], [], 1)], [(1, None, None, None, None)]])
def test_empty(spark, rows):
    assert term_frequencies(blocks(spark, rows)).count() == 0
    assert marked_terms(blocks(spark, rows), runs(spark, [])).count() == 0


def test_long_block(spark):
    rows = [(1, "a", list(range(150_000)), [1] * 150_000, 1)]
    assert term_frequencies(blocks(spark, rows)).agg(F.sum("occurrences"), F.count("*")).first() == (150_000, 150_000)


def test_packing():
    for values in ([], [0], [255], [256, 1], [1 << 40, 3]):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values
    values = np.unique(np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 999))
    assert (unpacked_terms(packed_terms(values)) == values).all()
    ends = np.array([-(1 << 63), -1, 0, (1 << 63) - 1])
    assert (unpacked_terms(packed_terms(ends)) == ends).all()


def test_a_dictionary_is_written_and_used_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_BROADCAST", 0)
    r = random.Random(3)
    old = [(i, f"l{i % 7}", [r.randrange(-3000, 3000) for _ in range(30)], [2] * 30, 1) for i in range(100)]
    new = [(i, "m", [r.randrange(-9000, 9000) for _ in range(30)], [1] * 30, 1) for i in range(100)]
    terms = term_frequencies(blocks(spark, old), ranges=5)
    dictionary_of(terms, 5).write.parquet(str(tmp_path / "d"))
    before = {x.value: x.term_id for x in terms.collect()}
    assert before == {x.value: x.term_id for x in term_frequencies(blocks(spark, old * 2), ranges=5).collect()}  # whatever the partitions
    after = {x.value: x for x in term_frequencies(blocks(spark, new), dictionary=spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert set(after) == {v for row in new for v in row[2]} and len({x.term_id for x in after.values()}) == len(after)
    assert all(after[v].term_id == t for v, t in before.items() if v in after) and not {x.term_id for v, x in after.items() if v not in before} & set(before.values())
    want = Counter(v for row in new for v in row[2])
    assert {v: x.occurrences for v, x in after.items()} == dict(want)


def test_a_range_folds(spark, monkeypatch):
    now = frequency.Range(3)
    monkeypatch.setattr(frequency, "FOLD", 50)
    want = Counter()
    r = np.random.default_rng(2)
    for i in range(9):
        values, records = np.unique(r.integers(0, 60, 40), return_counts=True)
        want.update(dict(zip(values.tolist(), (records * 2).tolist())))
        now.take({"kind": frequency.ENTRIES, "terms": packed_terms(values), "owner": packed(np.zeros(len(values), np.int64)), "occurrences": packed(records * 2), "records": packed(records), "libraries": np.array([i % 2, 30]).tobytes()})
    rows = now.terms().to_pylist()
    assert {x["value"]: x["occurrences"] for x in rows} == dict(want) and [x["term_id"] & 0xFFFF for x in rows] == list(range(len(rows)))
    assert all(x["term_id"] >> 40 == 3 and x["records"] * 2 == x["occurrences"] and x["libraries"] in (1, 2) and x["kept_by"] <= x["libraries"] for x in rows)
