"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import random
from collections import Counter

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s[::-1].translate(COMPLEMENT)


def canonical(s: str) -> str:
    return min(s, rc(s))


def windows(seq: str, qual: str | None, k: int, floor: int):
    seq = seq.upper()
    rated = qual is not None and len(qual) == len(seq)
    for i in range(len(seq) - k + 1):
        if all(seq[j] in "ACGT" and (not rated or ord(qual[j]) - 33 >= floor) for j in range(i, i + k)):
            yield i, seq[i : i + k]


def counts(reads, k: int, floor: int = 0) -> Counter:
    return Counter(canonical(w) for _, s, q in reads if s for _, w in windows(s, q, k, floor))


def genome(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def shotgun(text: str, n: int, length: int, seed: int, errors: float = 0.0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        p = r.randrange(len(text) - length + 1)
        s = list(text[p : p + length])
        if r.random() < errors:
            j = r.randrange(length)
            s[j] = r.choice([b for b in "ACGT" if b != s[j]])
        s = "".join(s)
        out.append((i, rc(s) if r.random() < 0.5 else s, "F" * length))
    return out


def unitigs(kmers: set[str], k: int) -> set[str]:
    """Maximal unbranched paths of canonical k-mers, each in its lesser orientation; cycles by a rotation-free key."""
    both = kmers | {rc(x) for x in kmers}
    following = {x: [x[1:] + b for b in "ACGT" if x[1:] + b in both and canonical(x[1:] + b) != canonical(x)] for x in both}
    before = {x: [b + x[:-1] for b in "ACGT" if b + x[:-1] in both and canonical(b + x[:-1]) != canonical(x)] for x in both}
    out, seen = set(), set()
    for x in sorted(both):
        if len(before[x]) == 1 and len(following[before[x][0]]) == 1:
            continue
        path, y = x, x
        nodes = [canonical(x)]
        while len(following[y]) == 1 and len(before[following[y][0]]) == 1:
            y = following[y][0]
            path += y[-1]
            nodes.append(canonical(y))
        out.add(canonical(path))
        seen.update(nodes)
    return out
