import random

import numpy as np

from helixframe.functions import nthash

SEED = dict(zip("ACGT", nthash.SEEDS))
OTHER = dict(zip("ACGT", "TGCA"))


def turned(word: int, by: int) -> int:
    """Bit by bit: every part of the word is a ring of its own."""
    for _ in range(by):
        bits, at = 0, 0
        for width in nthash.WIDTHS:
            ring = [(word >> (at + i)) & 1 for i in range(width)]
            for i, bit in enumerate(ring):
                bits |= bit << (at + (i + 1) % width)
            at += width
        word = bits
    return word


def slow(kmer: str) -> tuple[int, int]:
    forward = backward = 0
    for i, base in enumerate(kmer):
        forward ^= turned(SEED[base], len(kmer) - 1 - i)
        backward ^= turned(SEED[OTHER[base]], i)
    return forward, backward


def test_windows():
    r = random.Random(1)
    assert sum(nthash.WIDTHS) == 64
    for k in (3, 4, 5, 21, 31, 32, 77, 255):
        text = "".join(r.choice("ACGT") for _ in range(k + 4))
        forward, backward = nthash.hashes(np.array(["ACGT".index(b) for b in text], np.uint8), k)
        want = [slow(text[i : i + k]) for i in range(5)]
        assert [(int(f), int(b)) for f, b in zip(forward, backward)] == want
        other = "".join(OTHER[b] for b in reversed(text))
        mirrored = nthash.hashes(np.array(["ACGT".index(b) for b in other], np.uint8), k)
        assert [(int(b), int(f)) for f, b in zip(*mirrored)][::-1] == want
    assert not len(nthash.hashes(np.zeros(2, np.uint8), 3)[0])


def test_expression(spark):
    rows = ["ACGTTGCAT", "acgttgcat", "ATGCAACGT", "ACN", "", None, "TTTTTTTTT"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = {r.i: r.h for r in df.select("i", nthash.sequence_hashes("s").alias("h")).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for i, s in enumerate(rows):
        if not s or "N" in s:
            assert got[i].canonical is None
        else:
            f, b = slow(s.upper())
            assert (got[i].canonical, got[i].other, got[i].reverse) == (signed(min(f, b)), signed(max(f, b)), b < f)
    assert got[0].canonical == got[2].canonical and got[0].reverse != got[2].reverse
