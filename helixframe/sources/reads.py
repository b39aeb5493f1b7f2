"""Read records: validation, delivery, statistics, alphabet, and the replayable store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import Batch, _floors, _one_byte, masked

PEEKED_READS = 5000
MOST_QUALITY = 64


def delivered_once(records: DataFrame) -> DataFrame:
    """read_id, sample, seq and qual of each read once, however often it was delivered."""
    return records.groupBy("read_id").agg(F.max(F.struct("sample", "seq", "qual")).alias("r")).select("read_id", "r.*")


def validated(reads: DataFrame, mode: str = "fail") -> DataFrame:
    """Reads whose quality has the length of their sequence or is missing.

    ``fail`` raises on the first other read, ``unrate`` drops its quality, ``drop`` drops it.
    """
    broken = F.col("qual").isNotNull() & (F.length("qual") != F.length("seq"))
    if mode == "drop":
        return reads.filter(~F.coalesce(broken, F.lit(False)))
    if mode == "unrate":
        return reads.withColumn("qual", F.when(~broken, F.col("qual")))
    if mode == "fail":
        return reads.withColumn("seq", F.when(broken, F.raise_error(F.concat(F.lit("quality and sequence differ in length in read "), F.col("read_id")))).otherwise(F.col("seq")))
    raise ValueError(f"unknown mode {mode}")


def statistics(reads: DataFrame) -> DataFrame:
    size = F.length("seq")
    return reads.agg(F.count("seq").alias("reads"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bases"), F.coalesce(F.max(size), F.lit(0)).alias("longest"))


def quality_alphabet(reads: DataFrame, peeked: int = PEEKED_READS) -> DataFrame:
    """The distinct qualities of usable bases in the first reads by read_id; none if one of these reads has no quality."""
    first = reads.filter("seq is not null").orderBy("read_id").limit(peeked)
    unrated = first.agg(F.count_if(F.col("qual").isNull()).alias("unrated"))
    pairs = F.arrays_zip(F.split(F.upper("seq"), "").alias("b"), F.split("qual", "").alias("q"))
    letters = first.filter("length(seq) = length(qual)").select(F.inline(pairs)).toDF("b", "q").filter("b in ('A','C','G','T')")
    quality = F.greatest(F.ascii("q") - 33, F.lit(0))
    return letters.select(quality.alias("quality")).distinct().filter(F.col("quality") < MOST_QUALITY).join(F.broadcast(unrated.filter("unrated = 0").select(F.lit(True).alias("rated"))), F.lit(True), "left_semi")


UNUSABLE = 3


def _packed(floors: list[int], bits: int):
    """Reads to ``bits`` bits a base: the code, and with four the class above it, the strictest floor that the base clears."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            batch = Batch(part.column("seq"), part.column("qual"))
            value = (batch.codes & 3).astype(np.uint8)
            if bits == 4:
                grade = np.full(len(value), UNUSABLE, np.uint8)
                for i, floor in enumerate(floors):
                    grade[batch.usable(floor)] = i
                value |= grade << 2
            per = 8 // bits
            sizes = -(-batch.lengths // per)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            place = np.arange(len(value)) - batch.offsets[batch.read]
            data = np.zeros(int(ends[-1]), np.uint8)
            for slot in range(per):
                mine = place % per == slot
                data[ends[batch.read[mine]] + place[mine] // per] |= value[mine] << (slot * bits)
            bases = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            present = pa.array(batch.present)
            yield pa.RecordBatch.from_arrays([part.column("read_id"), pa.compute.if_else(present, bases, None), pa.compute.if_else(present, pa.array(batch.lengths.astype(np.int32)), None)], names=["read_id", "bases", "size"])

    return run


def _unpacked(floors: list[int], bits: int):
    """The reads as far as the floors tell them apart: unusable bases are N, qualities those of the floors; without classes none."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    marks = np.array([33 + f for f in floors] + [33] * (UNUSABLE + 1 - len(floors)), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            present = part.column("size").is_valid()
            lengths = part.column("size").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bases = part.column("bases").fill_null(b"")
            starts = np.frombuffer(bases.buffers()[1], np.int32)[bases.offset : bases.offset + len(bases)].astype(np.int64)
            data = np.frombuffer(bases.buffers()[2] or b"", np.uint8)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            read = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(int(ends[-1])) - ends[read]
            per = 8 // bits
            value = data[starts[read] + place // per] >> (place % per * bits).astype(np.uint8) if len(read) else np.zeros(0, np.uint8)
            text = letters[value & 3]
            offsets = pa.py_buffer(ends.astype(np.int32))
            quality = pa.nulls(len(lengths), pa.string())
            if bits == 4:
                grade = value >> 2 & 3
                text = np.where(grade == UNUSABLE, np.uint8(ord("N")), text)
                quality = pa.compute.if_else(present, pa.Array.from_buffers(pa.string(), len(lengths), [None, offsets, pa.py_buffer(marks[grade])]), None)
            seq = pa.Array.from_buffers(pa.string(), len(lengths), [None, offsets, pa.py_buffer(np.ascontiguousarray(text))])
            yield pa.RecordBatch.from_arrays([part.column("read_id"), pa.compute.if_else(present, seq, None), quality], names=["read_id", "seq", "qual"])

    return run


class ReadStore:
    """Reads for every pass of a run, packed and cached once; later passes replay them without the input.

    A base takes four bits: its code and the strictest of the ``floors`` it
    clears, which is all that counting at these floors asks for. ``two_bit``
    keeps bases only, in two bits, and refuses reads with anything else.
    """

    def __init__(self, reads: DataFrame, floors: list[int], two_bit: bool = False):
        self.floors = _floors(floors)
        if two_bit and self.floors != [0]:
            raise ValueError("two-bit storage has no qualities, so its only floor is 0")
        if two_bit:
            dirty = F.upper("seq").rlike("[^ACGT]")
            reads = reads.select("read_id", F.when(dirty, F.raise_error(F.lit("two-bit storage takes A, C, G and T only"))).otherwise(F.upper("seq")).alias("seq"), F.lit(None).cast("string").alias("qual"))
        kind = reads.schema["read_id"].dataType.simpleString()
        bits = 2 if two_bit else 4
        self._packed = _one_byte(reads).mapInArrow(_packed(self.floors, bits), f"read_id {kind}, bases binary, size int").persist(StorageLevel.MEMORY_AND_DISK)
        self._reads = self._packed.mapInArrow(_unpacked(self.floors, bits), f"read_id {kind}, seq string, qual string")

    def reads(self) -> DataFrame:
        return self._reads

    def masked(self, floor: int) -> DataFrame:
        if floor not in self.floors:
            raise KeyError(f"floor {floor} is not stored")
        return self._reads.select("read_id", masked("seq", "qual", floor).alias("seq"))

    def class_of_floor(self, floor: int) -> int:
        return self.floors.index(floor)

    def statistics(self) -> DataFrame:
        return self._packed.agg(F.count("size").alias("reads"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bases"), F.coalesce(F.max("size"), F.lit(0)).alias("longest"))

    def close(self) -> None:
        self._packed.unpersist()

