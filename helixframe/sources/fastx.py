"""FASTA and FASTQ files: sniffing, codecs, streamed decoding, sample sheets.

Each file is one row of a small table of paths; a task streams its file and
emits Arrow batches, so no file is ever held in memory as a whole.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 8192
RECORDS = "file_no int, path string, record_no long, seq string, qual string"
# How compressed files begin.
GZIP, XZ, ZSTD, BZIP2 = b"\x1f\x8b", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd", b"BZh"


class FormatError(ValueError):
    pass


def opened(raw: BinaryIO) -> BinaryIO:
    """The stream behind whichever codec its first bytes name."""
    buffered = io.BufferedReader(raw, 1 << 20)
    magic = buffered.peek(6)[:6]
    if magic.startswith(GZIP):
        return gzip.GzipFile(fileobj=buffered)
    if magic.startswith(XZ):
        return lzma.LZMAFile(buffered)
    if magic.startswith(BZIP2):
        return bz2.BZ2File(buffered)
    if magic.startswith(ZSTD):
        return io.BufferedReader(pa.CompressedInputStream(pa.PythonFile(buffered, "r"), "zstd"))
    return buffered


def parse(stream: BinaryIO) -> Iterator[tuple[str, str | None]]:
    """seq and qual of each record; an empty stream has none. FASTA if it begins with '>', FASTQ with '@'."""
    lines = (line.rstrip(b"\r\n") for line in stream)
    head = next((line for line in lines if line), None)
    if head is None:
        return
    if head.startswith(b">"):
        parts: list[bytes] = []
        for line in lines:
            if line.startswith(b">"):
                yield b"".join(parts).decode("latin-1"), None
                parts = []
            else:
                parts.append(line)
        yield b"".join(parts).decode("latin-1"), None
    elif head.startswith(b"@"):
        while head is not None:
            if not head.startswith(b"@"):
                raise FormatError("a record does not begin with '@'")
            seq, plus, qual = next(lines, None), next(lines, None), next(lines, None)
            if seq is None or plus is None or qual is None:
                raise FormatError("the last record is cut")
            if not plus.startswith(b"+"):
                raise FormatError("the third line of a record does not begin with '+'")
            if len(seq) != len(qual):
                raise FormatError("quality and sequence differ in length")
            yield seq.decode("latin-1"), qual.decode("latin-1")
            head = next((line for line in lines if line), None)
    else:
        raise FormatError("neither FASTA nor FASTQ")


def _open_path(path: str) -> BinaryIO:
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_stream(inner, compression=None)
    return open(path, "rb", buffering=0)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_no", "path", "record_no", "seq", "qual"]
    for batch in batches:
        for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            record = 0
            try:
                with _open_path(path) as raw, opened(raw) as stream:
                    for seq, qual in parse(stream):
                        rows.append((number, path, record, seq, qual))
                        record += 1
                        if len(rows) == BATCH:
                            yield _batch(rows, names)
                            rows = []
            except (OSError, EOFError, ValueError, lzma.LZMAError, pa.ArrowException) as problem:
                raise RuntimeError(f"{path}, record {record + 1}: {problem}") from problem
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_fastx(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the files in order of (file_no, record_no). No path is an error; so is a broken file, with its
    path and record; an empty file has no records."""
    if not paths:
        raise ValueError("no input files")
    table = spark.createDataFrame(list(enumerate(paths)), "file_no int, path string").repartitionById(len(paths), F.col("file_no"))  # one file a task
    return table.mapInArrow(_decode, RECORDS)


def reads_of(records: DataFrame) -> DataFrame:
    """Records as reads; the id keeps the order of files and records."""
    return records.select((F.shiftleft(F.col("file_no").cast("long"), 40) + F.col("record_no")).alias("read_id"), "seq", "qual")


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """sample, pos and path of a sheet of lines "name file ..." separated by white space; a line without a file raises."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("f")).filter("f[0] <> ''")
    checked = F.when(F.size("f") < 2, F.raise_error(F.concat(F.lit("no file behind sample "), F.col("f")[0]))).otherwise(F.slice("f", 2, F.size("f") - 1))
    return lines.select(F.col("f")[0].alias("sample"), F.posexplode(checked).alias("pos", "path"))
