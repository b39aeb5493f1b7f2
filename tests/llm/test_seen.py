import random

import numpy as np

from helixframe.functions import filters
from helixframe.llm.seen import BloomChain, build_chains, saved_filter_answers, seen_before, wrong_answers

SIGHTS = "sight_id long, canonical_hash long, key string, kind int"
INDEX = "block_id long, canonical_hashes array<long>, route int"


def test_chain_grows_within_its_bound():
    r = np.random.default_rng(4)
    chain = BloomChain(0.01, first=1000)
    keys = r.integers(-(1 << 62), 1 << 62, 60_000)
    for part in np.array_split(keys, 37):
        chain.add(part[~chain.holds(part)])
    assert chain.holds(keys).all() and len(chain.layers) >= 5
    fresh = r.integers(-(1 << 62), 1 << 62, 200_000)
    assert chain.holds(fresh).mean() < 1.5 * chain.bound + 1e-3 and chain.bound < 0.01
    errors = [layer.error for layer in chain.layers]
    assert all(b < a for a, b in zip(errors, errors[1:])) and all(layer.fill < 0.6 for layer in chain.layers)
    assert not BloomChain().holds(keys[:3]).any() and BloomChain().bound == 0


def brute(sights, index):
    known = {k for b in index for k in b or [] if k is not None}
    first = {}
    for s, k in sights:
        if k is not None and s is not None:
            first[k] = min(first.get(k, s), s)
    return {s for s, k in sights if k is not None and s is not None and (k in known or first[k] < s)}


def run(spark, sights, index, **options):
    left = spark.createDataFrame([(s, k, "x", 0) for s, k in sights], SIGHTS).repartition(6)
    right = spark.createDataFrame([(i, b, 0) for i, b in enumerate(index)], INDEX).repartition(3)
    rows = [r.sight_id for r in seen_before(left, right, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows), left, right


def test_exact_even_with_a_bad_filter(spark):
    r = random.Random(6)
    sights = [(i, r.choice([None, 42, 42, r.randrange(300), r.randrange(-(1 << 60), 1 << 60)])) for i in range(6000)]
    sights += r.sample(sights, 500) + [(None, 42), (-5, 1)]
    index = [[r.randrange(200) for _ in range(20)] + [None] for _ in range(10)] + [None, []]
    got, left, right = run(spark, sights, index)
    assert got == brute(sights, index)
    got, left, right = run(spark, sights, index, error=0.9, first=64, chains=2)
    assert got == brute(sights, index)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        row = wrong_answers(left, right, error=0.9, first=64, chains=2, rows=100).first()
        assert {r.sight_id for r in seen_before(left, right, error=0.9, first=64, chains=2, rows=100).collect()} == got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert row.wrong > 0 and 0 < row.rate <= 1 and row.questions >= row.wrong
    row = wrong_answers(left, right).first()
    assert row.rate <= row.promised and row.bound <= row.promised


def test_hot_key_and_empty(spark):
    sights = [(i, 9) for i in range(20_000)]
    assert run(spark, sights, [])[0] == set(range(1, 20_000))
    assert run(spark, [], [[1]])[0] == set() and run(spark, [(1, None), (None, 3)], [[3]])[0] == set()
    assert run(spark, [(1, 3), (1, 3)], [])[0] == set()
    left = spark.createDataFrame([(1, 3, "x", 0), (2, 3, "x", 0)], SIGHTS)
    assert [r.sight_id for r in seen_before(left).collect()] == [2]
    assert wrong_answers(left.limit(0)).first().questions == 0


def test_chains_are_saved_loaded_and_grown(spark, tmp_path):
    r = random.Random(8)
    key = lambda: r.randrange(-(1 << 60), 1 << 60)
    old, more = [key() for _ in range(9000)], [key() for _ in range(3000)]
    index = lambda keys: spark.createDataFrame([(i, keys[i : i + 50] + [None], 0) for i in range(0, len(keys), 50)], INDEX).repartition(3)
    sights = [(i, r.choice([r.choice(old), r.choice(more), key()])) for i in range(5000)]
    left = spark.createDataFrame([(s, k, "x", 0) for s, k in sights], SIGHTS).repartition(5)
    build_chains(index(old), first=500, chains=3).write.parquet(str(tmp_path / "chains"))
    build_chains(index(more), first=500, saved=spark.read.parquet(str(tmp_path / "chains"))).write.parquet(str(tmp_path / "grown"))
    saved = spark.read.parquet(str(tmp_path / "grown"))
    assert saved.select("route").distinct().count() == 3 and saved.agg({"layer": "max"}).first()[0] >= 2
    want = brute(sights, [old, more])
    both = index(old + more)
    assert {x.sight_id for x in seen_before(left, both, saved=saved).collect()} == want == {x.sight_id for x in seen_before(left, both, first=500, chains=3).collect()}
    unchecked = {x.sight_id for x in seen_before(left, saved=saved).collect()}
    assert want <= unchecked and len(unchecked - want) <= 5  # nothing to look up in: wrong at the promised rate
    assert {x.sight_id for x in seen_before(left, index(old), saved=spark.read.parquet(str(tmp_path / "chains"))).collect()} == brute(sights, [old])


def test_history_and_chains_are_made_once(spark):
    left = spark.createDataFrame([(i, i % 70, "x", 0) for i in range(500)], SIGHTS)
    right = spark.createDataFrame([(i, list(range(i, i + 30)), 0) for i in range(20)], INDEX)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = seen_before(left, right)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "ReusedExchange" in plan and plan.count("_build") <= 1 and plan.count("run(") == plan.count("MapInArrow run(")
    assert plan.count("Scan ExistingRDD") <= 2  # history and sightings, each once


def test_saved_filters(spark):
    keys = np.array([(i * 7919 + 5) * 1_000_003 for i in range(40)], np.int64)
    full = np.zeros(20, np.int64)
    filters.add(full, keys)
    rows = [("a", keys[:30].tolist() + [None]), ("b", keys[:10].tolist()), (None, keys[:5].tolist()), ("d", None)]
    indexed = spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(rows)], "block_id long, sample string, canonical_hashes array<long>")
    import datetime

    day = lambda n: datetime.datetime(2030, 1, n)
    bits = spark.createDataFrame([(1, "a", full.tolist(), day(2)), (1, "a", full.tolist(), day(2)), (2, "a", [0] * 20, day(1)), (3, "b", [0] * 20, day(1)), (4, None, [], day(1)), (5, "d", None, None)], "bloom_id long, sample string, buffer array<long>, saved_at timestamp")
    asked = [(i, s, k) for s in ("a", "b", None, "d", "e") for i, k in enumerate(keys.tolist() + [None, 17])]
    sightings = spark.createDataFrame(asked + asked[:9], "sight_id long, sample string, canonical_hash long")
    got = {r.sample: (r["keys"], r.held, r.yes, r.wrong, r.missed) for r in saved_filter_answers(sightings, indexed, bits).collect()}
    yes = int(filters.holds(full, np.array([17], np.int64))[0])
    assert got == {"a": (41, 30, 40 + yes, 10 + yes, 0), "b": (41, 10, 0, 0, 10), "": (41, 5, 0, 0, 5), "d": (41, 0, 0, 0, 0), "e": (41, 0, 0, 0, 0)}
    assert saved_filter_answers(sightings.limit(0), indexed.limit(0), bits.limit(0)).count() == 0
