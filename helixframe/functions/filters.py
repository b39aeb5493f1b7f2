"""The word-blocked Bloom filter that libraries are saved with, over numpy arrays."""

from __future__ import annotations

import numpy as np

# Fixed values of the saved layout: multiplier and shift of the mixer, and the bit offsets that make up a key's five bits.
MULTIPLIER, SHIFT = 0x85D059AA333121CF, 31
FINGERPRINT_SHIFTS = (0, 6, 12, 18, 24)
BITS_PER_KEY, EXPECTED_KEYS = 12, 1 << 27
#: Filled beyond this share of bits, a filter's answers are no longer to be relied on.
WARN_OCCUPANCY = 0.25


def default_words(keys: int = EXPECTED_KEYS) -> int:
    return max(1, round(keys * BITS_PER_KEY / 64))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint64)
    out = np.zeros(len(keys), np.uint64)
    for shift in FINGERPRINT_SHIFTS:
        out |= np.uint64(1) << ((keys >> np.uint64(shift)) & np.uint64(63))
    return out


def location(keys: np.ndarray, words: int) -> np.ndarray:
    """The word of each key: the mixed key, scaled to the range by the high half of a 128-bit product."""
    keys = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (keys ^ (keys >> np.uint64(SHIFT))) * np.uint64(MULTIPLIER)
    low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)
    n = np.uint64(words)  # below 2**32, so neither product overflows
    return ((high * n + ((low * n) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def holds(buffer: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = fingerprint(keys)
    return (buffer.view(np.uint64)[location(keys, len(buffer))] & bits) == bits


def add(buffer: np.ndarray, keys: np.ndarray) -> None:
    np.bitwise_or.at(buffer.view(np.uint64), location(keys, len(buffer)), fingerprint(keys))


def occupancy(buffer: np.ndarray) -> tuple[int, int]:
    """Set bits and all bits."""
    return int(np.bitwise_count(buffer.view(np.uint64)).sum()), len(buffer) * 64
