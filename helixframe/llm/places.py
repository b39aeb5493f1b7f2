"""Where in many texts a pattern can match at all, found over arrays of code points.

A regular expression that is tried at every character spends nearly all its
time on places where it cannot match. The classes of all code points of a
batch are looked up at once; runs of digits, chains of them, codes and words
follow from these, and each pattern is tried where they allow it. The places
are a superset of the matches, so the matches are those of a plain scan.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .text import code_points

#: Digits a phone or identity number has at least, and characters of a code.
LEAST_DIGITS, LEAST_CODE, LEAST_CODE_DIGITS = 7, 8, 6
#: Digits of a house number at most, and words before one that its address can begin with.
MOST_HOUSE, WORDS_BACK = 4, 7
MARGIN = 8


@lru_cache(maxsize=4)
def _tables(title: str, inner: str) -> dict[str, np.ndarray]:
    """Class tables over all code points; ``title`` and ``inner`` are character classes."""
    everything = [chr(c) for c in range(0x110000)]
    table = lambda test: np.fromiter(map(test, everything), bool, 0x110000)
    space, digit = table(str.isspace), table(str.isdecimal)
    space[0x1C:0x20] = True
    in_class = re.compile(f"[{title}]").match
    starts = np.zeros(0x110000, bool)
    starts[:0x3000] = [in_class(c) is not None for c in everything[:0x3000]]
    starts[0xFFFD] = in_class("�") is not None
    within = re.compile(inner).match
    wide = np.fromiter((within(c) is not None for c in everything), bool, 0x110000)
    return {"space": space, "digit": digit, "title": starts, "inner": wide}


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


class Places:
    """For each of ``texts``, by index: ``numbers`` and ``codes`` (start, end), ``houses`` (start, end, how far back an address may
    begin, whether one may follow, whether one may lie before it), ``names`` (starts)."""

    def __init__(self, texts: list[str], title: str, inner: str):
        joined = "\n".join(texts)
        codes = np.concatenate((np.full(MARGIN, 10, np.uint32), code_points(joined), np.full(MARGIN, 10, np.uint32)))
        t = _tables(title, inner)
        self.bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts]))) + MARGIN
        digit, space, begins = t["digit"][codes], t["space"][codes], t["title"][codes]
        start, end = _runs(digit)
        self.numbers = self._split(*self._chains(codes, start, end))
        self.codes = self._split(*self._code_runs(codes, digit))
        self.houses = self._split(*self._house_numbers(codes, start, end, space, begins))
        self.names = self._split(self._name_starts(codes, begins, t["inner"][codes]))

    def _split(self, first: np.ndarray, *more: np.ndarray) -> list[list[tuple]]:
        """Rows by text, positions counted from its beginning."""
        text = np.searchsorted(self.bounds, first, "right") - 1
        offset = self.bounds[text]
        rows = list(zip(*((c - offset if c.dtype != bool else c).tolist() for c in (first, *more))))
        cuts = np.searchsorted(text, np.arange(len(self.bounds)))
        return [rows[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    @staticmethod
    def _chains(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digits joined by a blank, dot, hyphen, slash or bracket, if there are enough of them."""
        if not len(start):
            return start, end
        gap, one, two = start[1:] - end[:-1], codes[end[:-1]], codes[end[:-1] + 1]
        joined = (gap == 1) & np.isin(one, [ord(c) for c in " .-/)"])
        joined |= (gap == 2) & (((one == ord(")")) & (two == ord(" "))) | ((one == ord(" ")) & (two == ord("("))))
        lead = np.flatnonzero(np.concatenate(([True], ~joined)))
        digits = np.add.reduceat(end - start, lead)
        last = np.concatenate((lead[1:], [len(start)])) - 1
        enough = digits >= LEAST_DIGITS
        return start[lead[enough]], end[last[enough]]

    @staticmethod
    def _code_runs(codes: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upper = (codes >= 65) & (codes <= 90)
        start, end = _runs(upper | digit | (codes == 45))
        digits, letters = np.concatenate(([0], np.cumsum(digit))), np.concatenate(([0], np.cumsum(upper)))
        good = (end - start >= LEAST_CODE) & (digits[end] - digits[start] >= LEAST_CODE_DIGITS) & (letters[end] > letters[start])
        return start[good], end[good]

    @staticmethod
    def _house_numbers(codes: np.ndarray, start: np.ndarray, end: np.ndarray, space: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        short = end - start <= MOST_HOUSE
        start, end = start[short], end[short]
        before, after, next_ = codes[start - 1], codes[end], codes[end + 1]
        letter = ((after | 32) >= 97) & ((after | 32) <= 122)
        follows = (after == 32) | (after == 44) | (letter & (next_ == 32))
        leads = (before == 32) | (before == 46)  # a blank, or the dot of an abbreviation
        blanks = np.flatnonzero(space)
        at = np.searchsorted(blanks, start - 1)
        back = blanks[np.maximum(at - WORDS_BACK, 0)] + 1 if len(blanks) else np.zeros(len(start), np.int64)
        titles = np.concatenate(([0], np.cumsum(begins)))
        leads &= titles[start] > titles[back]
        good = follows | leads
        return start[good], end[good], back[good], follows[good], leads[good]

    @staticmethod
    def _name_starts(codes: np.ndarray, begins: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Beginnings of words in title case that something like a second one follows."""
        low = (codes >= 97) & (codes <= 122) | (codes >= 0xE0) & (codes <= 0xFF)
        wide = inner.copy()
        wide[:-1] |= (codes[:-1] == 63) & low[1:]
        wide[1:] |= ((codes[:-1] == 0xC3) | (codes[:-1] == 0xC2)) & (codes[1:] >= 0x80) & (codes[1:] <= 0xBF)
        start = np.flatnonzero(begins & ~np.concatenate(([False], inner[:-1])))
        _, ends = _runs(wide | begins)
        end = ends[np.minimum(np.searchsorted(ends, start, "right"), len(ends) - 1)] if len(ends) else start
        gap = codes[np.minimum(end, len(codes) - 1)]
        good = (gap == 32) | (gap == 0xA0) | (gap == 46) | (gap == 44)
        following = begins[np.minimum(end + 1, len(codes) - 1)] | begins[np.minimum(end + 2, len(codes) - 1)]
        return start[good & following]
