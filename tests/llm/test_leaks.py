import random

import numpy as np
import pytest

from helixframe.llm.leaks import Shingles, leak_report, leaked, minhashes, permuted
from helixframe.llm.text import Words

DOCS, ITEMS = "doc_id long, text string, item_id string, passage int", "item_id long, text string, answer string, doc_id int"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n)]


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, None, 1) for i, t in items], ITEMS)


def test_sliding_minimum():
    v = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 200, 201):
        assert minhashes(v, width).tolist() == [min(v[i : i + width]) for i in range(200 - width + 1)]


def test_passages(spark):
    item = words(40, 1)
    other = words(15, 2)
    twelve = item[7:19]
    docs = [
        (1, " ".join(words(3000, 3) + twelve + words(500, 4))),
        (2, " ".join(words(20, 5) + item[7:18] + words(20, 6))),  # eleven words
        (3, "\n".join(w.upper() for w in twelve)),
        (4, "&quot;" + ", &nbsp;".join(w[:1] + "­" + w[1:] + "​" for w in twelve) + "&hellip;"),
        (5, " ".join(item[7:13] + ["zzz"] + item[13:19])),
        (6, None), (7, ""), (8, " ".join(other + item)), (8, " ".join(other + item)),
        (None, " ".join(item)), (9, " ".join(twelve[:6])), (10, " ".join(twelve[6:])),
    ]
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item)), (4, " ".join(words(11, 9))), (5, None), (6, ""), (None, " ".join(other))]
    d, i = frames(spark, docs, items)
    want = {(doc, it) for doc in (1, 3, 4, 8, None) for it in (1, 3)} | {(8, 2), (8, None)}
    rows = [tuple(r) for r in leaked(d, i).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {tuple(r) for r in leaked(d, i, stride=1, permutations=1).collect()} == want  # the exact way
    assert {tuple(r) for r in leaked(d, i, filter_bits=6).collect()} == want  # a filter that sorts out nothing
    report = {r.item_id: r.documents for r in leak_report(d, i).collect() if r.item_id}
    assert report == {1: 5, 2: 1, 3: 5, 4: 0, 5: 0, 6: 0}


def test_random_against_brute_force(spark):
    r = random.Random(11)
    vocabulary = words(6, 12)  # few words, so that shingles repeat
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 80)))) for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 30)))) for i in range(20)] + [(99, docs[5][1][:120])]
    d, i = frames(spark, docs, items)
    for least in (6, 12):
        grams = lambda t: {tuple(t.split()[j : j + least]) for j in range(len(t.split()) - least + 1)}  # noqa: B023, E731
        want = {(a, b) for a, t in docs for b, u in items if grams(t) & grams(u)}
        assert {tuple(x) for x in leaked(d, i, least, 3, stride=1, permutations=1).collect()} == want
        assert {tuple(x) for x in leaked(d, i, least, 3).collect()} == want


def test_recall_against_brute_force(spark):
    """Every passage lies in one document, in a place of its own; few permutations miss what they must, many miss nothing."""
    r = random.Random(5)
    items = [(i, words(60, 1000 + i)) for i in range(60)]
    docs = []
    for i, text in items:
        for j in range(10):
            at = r.randrange(49)
            docs.append((100 * i + j, " ".join(words(r.randrange(0, 90), 5000 + 100 * i + j) + text[at : at + 12] + words(r.randrange(0, 90), 90_000 + 100 * i + j))))
    d, i = frames(spark, docs, [(n, " ".join(t)) for n, t in items])
    want = {(n, n // 100) for n, _ in docs}
    found = lambda p: {tuple(x) for x in leaked(d, i, permutations=p).collect()}
    one, four, all_ = found(1), found(4), found(16)
    assert one <= four <= all_ == want
    for got, p in ((one, 1), (four, 4)):
        assert abs(len(got) / len(want) - (1 - (7 / 15) ** p)) < 0.1


def test_documents_are_read_once(spark):
    d, i = frames(spark, [(n, " ".join(words(50, n))) for n in range(40)], [(n, " ".join(words(50, 20 + n))) for n in range(30)])
    df = leaked(d, i)
    assert {tuple(r) for r in df.collect()} == {(20 + n, n) for n in range(20)}
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("passage#" in line and "Scan" in line for line in plan.split("\n")) == 1


def test_windows_cover_every_passage():
    for stride, counts in ((8, (0, 7, 8, 9, 15, 16, 23, 60)), (1, (0, 8, 30)), (3, (8, 20)), (20, (8, 27, 70))):
        texts = [" ".join(words(n + 4, 70 + n)) if n else "" for n in counts]
        held = Words(texts)
        parts = Shingles(held, 5, 8, stride)
        for n, size in enumerate(counts):
            own = parts.first_word[held.text[parts.first_word] == n] - (np.flatnonzero(held.text == n)[0] if size else 0) if len(parts.first_word) else np.zeros(0, int)
            assert sorted(own.tolist()) == (list(range(0, size - 7, stride)) if size >= 8 else [])
        for p in range(3):
            h = permuted(held.shingles(5), p)
            want = [min(h[w : w + min(left, 8 + stride - 1)]) for w, left in zip(parts.first_word.tolist(), parts.left.tolist())]
            assert parts.signature(p).tolist() == want


def test_empty(spark):
    d, i = frames(spark, [], [])
    assert leaked(d, i).count() == 0
    d, i = frames(spark, [(1, "a " * 30)], [(1, "a " * 30)])
    assert leaked(d, i).count() == 1
    with pytest.raises(ValueError):
        leaked(d, i, 3, 5)
