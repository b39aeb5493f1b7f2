"""k-mer windows: usable runs, quality floors, canonical form, strictest clean floor.

A window is a stretch of k usable bases; a base is usable under a floor if it
is A, C, G or T in either case and its quality reaches the floor (reads
without qualities always do). Windows are cut from Arrow batches with numpy:
all of a batch at once, for any k, so no row is exploded before it is masked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = "read_id long, start int, kmer string, forward boolean, grp int"

_CODES = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b] = _CODES[_b + 32] = _i
_LETTERS = np.frombuffer(b"ACGTN", np.uint8)


def check_k(k: int) -> None:
    if k % 2 == 0 or not 3 <= k <= 255:
        raise ValueError(f"k must be odd and between 3 and 255, not {k}")


class Batch:
    """The bases of a batch of reads on one axis."""

    def __init__(self, seq: pa.Array, qual: pa.Array):
        present = seq.is_valid().to_numpy(zero_copy_only=False)
        text = seq.fill_null("")
        lengths = pa.compute.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.lengths, self.present = lengths, present
        self.codes = _CODES[_bytes(text)]
        q = qual.fill_null("")
        q_lengths = pa.compute.binary_length(q).to_numpy(zero_copy_only=False)
        rated = (q_lengths == lengths) & qual.is_valid().to_numpy(zero_copy_only=False)
        self.quality = np.full(len(self.codes), 255, np.uint8)
        inside = np.repeat(rated, lengths)
        self.quality[inside] = np.maximum(_bytes(q)[np.repeat(rated, q_lengths)].astype(np.int16) - 33, 0)
        self.read = np.repeat(np.arange(len(lengths)), lengths)

    def usable(self, floor: int) -> np.ndarray:
        return (self.codes < 4) & (self.quality >= floor)

    def starts(self, k: int, floor: int) -> np.ndarray:
        """Where windows of k usable bases of one read begin."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        bad = np.concatenate(([0], np.cumsum(~self.usable(floor))))
        return np.flatnonzero((bad[k:] == bad[:-k]) & (self.read[k - 1 :] == self.read[:n]))

    def groups(self, starts: np.ndarray, k: int, floors: list[int]) -> np.ndarray:
        """Index of the strictest floor that each window clears."""
        group = np.zeros(len(starts), np.int32)
        for i, floor in enumerate(floors[1:], 1):
            bad = np.concatenate(([0], np.cumsum(~self.usable(floor))))
            group[bad[starts + k] == bad[starts]] = i
        return group

    def packed(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Every position's k bases as a word, forwards and as reverse complement, by doubling."""
        c = (self.codes & 3).astype(np.uint64)
        forward, backward, done = None, None, 0
        f, b, span = c, np.uint64(3) - c, 1
        rest = k
        while rest:
            if rest & 1:
                if forward is None:
                    forward, backward = f, b
                else:
                    n = len(f) - done
                    head = forward[:n]
                    forward = (head << np.uint64(2 * span)) | f[done : done + n]
                    backward = backward[:n] | (b[done : done + n] << np.uint64(2 * done))
                done += span
            rest >>= 1
            if rest:
                f, b = (f[:-span] << np.uint64(2 * span)) | f[span:], b[:-span] | (b[span:] << np.uint64(2 * span))
                span *= 2
        return forward, backward

    def strings(self, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows as (n, k) letters, and whether the forward strand is the canonical one."""
        if not len(starts):
            return np.zeros((0, k), np.uint8), np.zeros(0, bool)
        letters = np.lib.stride_tricks.sliding_window_view(self.codes, k)[starts]
        reverse = 3 - letters[:, ::-1]
        differs = letters != reverse
        at = differs.argmax(axis=1)
        rows = np.arange(len(starts))
        forward = letters[rows, at] <= reverse[rows, at]
        return _LETTERS[np.where(forward[:, None], letters, reverse)], forward


def _bytes(text: pa.Array) -> np.ndarray:
    """The characters of a string column without nulls; each must be one byte."""
    _, offsets, data = text.buffers()
    if data is None or len(text) == 0:
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def as_strings(letters: np.ndarray) -> pa.Array:
    n, k = letters.shape
    offsets = np.arange(n + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def kmer_windows(reads: DataFrame, k: int, floors: list[int] | None = None) -> DataFrame:
    """read_id, start (from 0), canonical kmer, whether it is the forward strand, and grp, the index of the strictest
    of the ascending ``floors`` that the window clears. Windows that do not clear the first floor are left out."""
    check_k(k)
    floors = _floors(floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                batch = Batch(part.column("seq"), part.column("qual"))
                starts = batch.starts(k, floors[0])
                letters, forward = batch.strings(starts, k)
                owner = batch.read[starts]
                columns = [part.column("read_id").take(pa.array(owner)), pa.array((starts - batch.offsets[owner]).astype(np.int32)), as_strings(letters), pa.array(forward), pa.array(batch.groups(starts, k, floors))]
                yield pa.RecordBatch.from_arrays(columns, names=["read_id", "start", "kmer", "forward", "grp"])

    return _one_byte(reads).mapInArrow(run, WINDOWS)


def _floors(floors: list[int] | None) -> list[int]:
    floors = list(floors or [0])
    if floors != sorted(set(floors)) or len(floors) > 3:
        raise ValueError("floors must ascend, and there are at most three")
    return floors


def _one_byte(reads: DataFrame) -> DataFrame:
    """Reads whose characters are one byte each; any other character is no base."""
    clean = lambda c: F.regexp_replace(c, "[^\\x00-\\x7f]", "N" if c == "seq" else "!").alias(c)
    return reads.select("read_id", clean("seq"), clean("qual"))


def masked(seq: Column | str, qual: Column | str, floor: int) -> Column:
    """The sequence in upper case with unusable bases as N, as an expression."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    qual = F.col(qual) if isinstance(qual, str) else qual
    bases = F.regexp_replace(F.upper(seq), "[^ACGT]", "N")
    if floor <= 0:
        return bases
    kept = F.zip_with(F.split(bases, ""), F.split(qual, ""), lambda b, q: F.when(F.ascii(q) - 33 >= floor, b).otherwise("N"))
    return F.when(F.length(qual) == F.length(seq), F.array_join(kept, "")).otherwise(bases)


def masked_reads(reads: DataFrame, floors: list[int]) -> DataFrame:
    """One row for each read and floor: the read as that floor leaves it."""
    rows = F.array(*(F.struct(F.lit(f).alias("floor"), masked("seq", "qual", f).alias("seq")) for f in _floors(floors)))
    return reads.select("read_id", F.inline(rows))


def usable_runs(reads: DataFrame, k: int, floor: int = 0) -> DataFrame:
    """The maximal stretches of usable bases that hold a window of length k."""
    runs = F.regexp_extract_all(masked("seq", "qual", floor), F.lit("[ACGT]+"), F.lit(0))
    return reads.select("read_id", F.posexplode(F.filter(runs, lambda r: F.length(r) >= k)).alias("run_no", "run"))


def window_groups(reads: DataFrame, k: int, floors: list[int] | None = None) -> DataFrame:
    """grp, windows and reads: how many windows of `kmer_windows` have each group, and in how many reads. Every batch is summed
    where it is read."""
    check_k(k)
    floors = _floors(floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                part = whole.slice(at, 5000)
                batch = Batch(part.column("seq"), part.column("qual"))
                starts = batch.starts(k, floors[0])
                group, owner = batch.groups(starts, k, floors), batch.read[starts]
                rows = [(g, int((group == g).sum()), len(np.unique(owner[group == g]))) for g in np.unique(group).tolist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["grp", "windows", "reads"])

    parts = _one_byte(reads).mapInArrow(run, "grp int, windows long, reads long")
    return parts.groupBy("grp").agg(F.sum("windows").alias("windows"), F.sum("reads").alias("reads"))


def floor_presence(groups: DataFrame, floors: list[int]) -> DataFrame:
    """For each floor whether any window (rows with a column grp) clears it."""
    most = groups.agg(F.max("grp").alias("m"))
    rows = F.array(*(F.struct(F.lit(f).alias("floor"), (F.coalesce(F.col("m"), F.lit(-1)) >= i).alias("has_kmers")) for i, f in enumerate(floors)))
    return most.select(F.inline(rows))
