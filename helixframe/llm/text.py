"""Code points of many texts as arrays, their classes, and words."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import numpy as np

from .arrays import mix

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the Unicode property White_Space, as inclusive ranges.
WHITE_SPACE = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Soft hyphen, zero-width space, zero-width no-break space: invisible inside a word.
INVISIBLE = "\u00ad\u200b\ufeff"


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for low, high in WHITE_SPACE:
        classes[low : high + 1] = SPACE
    return classes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def plain(text: str) -> str:
    """Character references read as their characters, invisible characters dropped, lower case."""
    if "&" in text:
        text = html.unescape(text)
    for c in INVISIBLE:
        if c in text:
            text = text.replace(c, "")
    return text.lower()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Words:
    """The words (maximal runs of letters and digits) of many texts, with a 64-bit hash of each."""

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(texts)
        codes = code_points(self.joined)
        inside = code_classes()[codes]
        inside = (inside == LETTER) | (inside == NUMBER)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(bounds, self.start, "right")
        length = self.end - self.start
        if not len(length):
            self.hash = np.zeros(0, np.uint64)
            return
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            chars = (codes[inside].astype(np.uint64) + np.uint64(1)) * powers(0x9E3779B97F4A7C15, int(length.max()))[place]
            self.hash = mix(np.add.reduceat(chars, first))

    def __len__(self) -> int:
        return len(self.start)

    def phrase(self, first: int, n: int) -> str:
        return " ".join(self.joined[self.start[i] : self.end[i]] for i in range(first, first + n))

    def shingles(self, n: int) -> np.ndarray:
        """A hash of each n consecutive words, across texts too; empty if there are fewer words."""
        count = len(self) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(count, np.uint64)
        with np.errstate(over="ignore"):
            for i, factor in enumerate(powers(0xD1342543DE82EF95, n)):
                total += self.hash[i : i + count] * factor
        return mix(total, n)


def in_chunks(texts: list[str | None], most: int = 1_000_000):
    """Ranges of consecutive texts of about ``most`` characters; a longer text is alone in its range."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
