"""The 64-bit rolling hash that saved tables carry, over all windows of many bases at once.

A base's seed is rotated by its distance from the window's end; a rotation
turns each of six parts of the word by itself. Windows are put together by
doubling, so k bases take log k vector steps instead of a roll from window to
window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The seeds of A, C, G, T and the widths of the parts, lowest bits first.
SEEDS = (0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456)
WIDTHS = (19, 13, 11, 9, 7, 5)


def _parts() -> list[tuple[int, np.uint64]]:
    """Width and mask of each part."""
    at, out = 0, []
    for width in WIDTHS:
        out.append((width, np.uint64(((1 << width) - 1) << at)))
        at += width
    return out


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    """Each part turned left by so many bits."""
    out = np.zeros_like(x)
    for width, mask in _parts():
        n = by % width
        part = x & mask
        out |= ((part << np.uint64(n)) & mask) | ((part >> np.uint64(width - n)) & mask) if n else part
    return out


def hashes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse-complement hash of every window of k bases, given as 0 to 3 for A, C, G, T."""
    seeds = np.array(SEEDS, np.uint64)
    if len(codes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    f, b, span = seeds[codes], seeds[3 - codes], 1
    forward = backward = None
    done = 0
    rest = k
    while rest:
        if rest & 1:
            if forward is None:
                forward, backward = f, b
            else:
                n = len(f) - done
                forward, backward = rotated(forward[:n], span) ^ f[done : done + n], backward[:n] ^ rotated(b[done : done + n], done)
            done += span
        rest >>= 1
        if rest:
            f, b = rotated(f[:-span], span) ^ f[span:], b[:-span] ^ rotated(b[span:], span)
            span *= 2
    return forward, backward


_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(b"ACGTacgt", np.uint8)] = np.tile(np.arange(4, dtype=np.uint8), 2)


def _of_sequences(seqs: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(seqs), 2), np.int64)
    known = np.zeros(len(seqs), bool)
    lengths = seqs.str.len().fillna(0).astype(int).to_numpy()
    for k in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == k)
        text = "".join(seqs.iloc[rows]).encode("ascii", "replace")
        codes = _CODES[np.frombuffer(text, np.uint8)]
        clean = (codes.reshape(-1, k) < 4).all(axis=1)
        forward, backward = hashes(np.where(codes < 4, codes, 0), k)
        first = np.arange(len(rows)) * k
        out[rows, 0], out[rows, 1] = forward[first].view(np.int64), backward[first].view(np.int64)
        known[rows] = clean
    return pd.DataFrame({"forward": pd.Series(out[:, 0]).where(known, None).astype("Int64"), "backward": pd.Series(out[:, 1]).where(known, None).astype("Int64")})


def sequence_hashes(seq: Column | str) -> Column:
    """canonical (the lesser of both strands' hashes without sign), other, and whether the canonical one is the reverse
    complement's, of whole sequences; nulls for null or empty ones and those with anything but bases."""
    # the return type decides that one Arrow batch at a time is handed over
    both = F.pandas_udf(_of_sequences, "struct<forward: bigint, backward: bigint>")(F.col(seq) if isinstance(seq, str) else seq)
    flipped = both["backward"].bitwiseXOR(F.lit(-(1 << 63))) < both["forward"].bitwiseXOR(F.lit(-(1 << 63)))
    return F.struct(F.when(flipped, both["backward"]).otherwise(both["forward"]).alias("canonical"), F.when(flipped, both["forward"]).otherwise(both["backward"]).alias("other"), flipped.alias("reverse"))
