from collections import Counter

import pyarrow as pa
import pytest

from helixframe.llm.sampling import BottomK, fixed_size_sample

SCHEMA = "entry_id long, sample string, threshold long, counts array<int>, _g int"


def frame(spark, ids, parts=5):
    return spark.createDataFrame([(i, "s", None, [1, None] if i else None, 3) for i in ids], SCHEMA).repartition(parts)


def test_distinct_and_repeatable(spark):
    ids = [i % 3000 for i in range(9000)] + [0] * 5000 + [None] * 50
    one = sorted(r.entry_id for r in fixed_size_sample(frame(spark, ids), 256, seed=4).collect())
    two = sorted(r.entry_id for r in fixed_size_sample(frame(spark, ids, 2), 256, seed=4).collect())
    other = sorted(r.entry_id for r in fixed_size_sample(frame(spark, ids), 256, seed=5).collect())
    assert len(set(one)) == 256 and one == two and one != other


def test_uniform_whatever_the_deliveries():
    pieces = [pa.table({"entry_id": list(range(0, 25)) + [1] * 400}), pa.table({"entry_id": list(range(15, 40)) + [1] * 30})]
    drawn = Counter()
    for seed in range(600):
        heap = BottomK(10, seed)
        for piece in pieces:
            heap.add(piece, "entry_id")
        drawn.update(heap.table.column("entry_id").to_pylist())
    assert sum(drawn.values()) == 6000 and all(100 < drawn[i] < 200 for i in range(40))


def test_small_and_empty(spark):
    assert sorted(r.entry_id for r in fixed_size_sample(frame(spark, [3, 1, 1])).collect()) == [1, 3]
    assert fixed_size_sample(frame(spark, [])).count() == 0 and fixed_size_sample(frame(spark, [1]), 0).count() == 0
    assert fixed_size_sample(frame(spark, [None])).count() == 0
    assert fixed_size_sample(frame(spark, [1]), columns=["entry_id", "counts"]).columns == ["entry_id", "counts"]
    with pytest.raises(ValueError):
        fixed_size_sample(frame(spark, [1]), -1)


def test_no_task_reads_all_heaps(spark):
    df = fixed_size_sample(frame(spark, list(range(5000)), 7), 16)
    assert df.count() == 16
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") - plan.count("ReusedExchange") >= 3 and "Coalesce" not in plan  # repartition of the frame, to the mergers, to one
