"""How often every distinct value occurs, in how many records, and which are too rare or too common.

Method: values are encoded by a global integer dictionary, occurrences and
record presence are accumulated in count arrays over the identifiers, and the
arrays are summed by identifier range. A range is a part of the values' hash
space. Every task sends one packed message for each of its batches to each
range; the range gives its values identifiers, encodes what arrives by them
and adds it to its count arrays. An identifier is ``range * 2**40`` plus the
value's rank within the range, so it depends on the values and the number of
ranges alone. A dictionary that was written down keeps its identifiers, and
new values are appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import flat_lists, ints, mix, rechunk
from .versions import by_deliveries

#: Cutoff of a library that has none: nothing lies below it.
NO_CUTOFF = 0
#: Entries that a range takes in before it adds them up.
FOLD = 2_000_000
KNOWN, ENTRIES = 0, 1
MESSAGES = "range int, kind int, terms binary, owner binary, occurrences binary, records binary, libraries binary"
TERMS = "term_id long, value long, occurrences long, records long, libraries long, kept_by long"
_MESSAGES = pa.schema([("range", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("terms", "owner", "occurrences", "records", "libraries"))])


def current(df: DataFrame, key: str, when: str, *columns: str) -> DataFrame:
    """Of each key the row with the latest ``when`` (nulls oldest, ties by the greatest content)."""
    row = F.struct(F.col(when).alias("_when"), *columns)
    return df.select(F.col(key), row.alias("_row")).groupBy(key).agg(F.max("_row").alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def current_blocks(blocks: DataFrame) -> DataFrame:
    """Of each block its newest version. Only blocks delivered more than once are shuffled, found by their ids alone."""
    columns = ("sample", "canonical_hashes", "counts")
    once, more = by_deliveries(blocks.select("block_id", "loaded_at", *columns), "block_id")
    return once.select("block_id", *columns).unionByName(current(more, "block_id", "loaded_at", *columns))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes each that hold all of them, behind that number of bytes."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or int(values.max(initial=0)) < 1 << 8 * s)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def packed_terms(values: np.ndarray) -> bytes:
    """Ascending values as differences, first bytes first: these are nearly all 0, and shrink with the shuffle's compression."""
    steps = np.diff(np.concatenate((np.zeros(1, np.uint64), values.view(np.uint64) ^ np.uint64(1 << 63))))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_terms(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    with np.errstate(over="ignore"):
        return (np.cumsum(steps, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _accumulate(key: np.ndarray, second: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in ascending order and the sum of each value over them."""
    order = np.lexsort((second, key))
    key, second = key[order], second[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (second[1:] != second[:-1]))))
    return (key[first], second[first], *(np.add.reduceat(v[order], first) for v in values))


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(values.view(np.uint64), 3) % np.uint64(ranges)).astype(np.int64)


def _messages(ranges: int):
    """Blocks to one message for each batch and range: for each value and library its occurrences, and the blocks holding it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rechunk(batches, 4000):
            offsets, lengths, flat = flat_lists(table.column("hashes").combine_chunks())
            c_offsets, c_lengths, c_flat = flat_lists(table.column("counts").combine_chunks())
            row = np.repeat(np.arange(table.num_rows), lengths)
            at = np.arange(len(flat)) - offsets[row]
            counted = at < c_lengths[row]
            counts = np.zeros(len(flat), np.int64)
            counts[counted] = ints(c_flat)[(c_offsets[row] + at)[counted]]
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            value, row, counts = ints(flat)[known], row[known], counts[known]
            if not len(value):
                continue
            value, row, counts = _accumulate(value, row, counts)
            names, library = np.unique(ints(table.column("library").combine_chunks()), return_inverse=True)
            cutoff = np.zeros(len(names), np.int64)
            cutoff[library] = ints(table.column("cutoff").combine_chunks())
            value, library, counts, records = _accumulate(value, library[row], counts, np.ones(len(row), np.int64))
            to = _range_of(value, ranges)
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(ranges + 1))
            rows = []
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                mine = order[bounds[r] : bounds[r + 1]]
                there, owner = np.unique(library[mine], return_inverse=True)
                rows.append((r, ENTRIES, packed_terms(value[mine]), packed(owner), packed(counts[mine]), packed(records[mine]), np.concatenate((names[there], cutoff[there])).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MESSAGES)], schema=_MESSAGES)

    return run


def _known(ranges: int):
    """A written dictionary to one message for each batch and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rechunk(batches, 500_000):
            value, term = ints(table.column("value").combine_chunks()), ints(table.column("term_id").combine_chunks())
            order = np.lexsort((value, _range_of(value, ranges)))
            value, term = value[order], term[order]
            to = _range_of(value, ranges)
            for r in np.unique(to).tolist():
                mine = to == r
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((r, KNOWN, packed_terms(value[mine]), None, packed(term[mine] & ((1 << 40) - 1)), None, None), _MESSAGES)], schema=_MESSAGES)

    return run


class Range:
    """Dictionary and count arrays of one range; memory grows with its distinct values and their libraries, not with what arrives."""

    def __init__(self, number: int):
        self.number = number
        self.values, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ascending values and their codes
        self.ranks = np.zeros(0, np.int64)  # by code; -1 for values that no written dictionary holds
        self.libraries: dict[int, int] = {}
        self.cutoffs: list[int] = []
        self.sums = (np.zeros(0, np.int64),) * 4  # code, library, occurrences, records
        self.waiting: list[tuple] = []
        self.entries = 0

    def encode(self, values: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
        """The codes of values; new ones are appended to the dictionary, with the ranks given or none yet."""
        at = np.searchsorted(self.values, values)
        new = np.ones(len(values), bool)
        inside = at < len(self.values)
        new[inside] = self.values[at[inside]] != values[inside]
        fresh, first = np.unique(values[new], return_index=True)
        if len(fresh):
            place = np.searchsorted(self.values, fresh)
            self.codes = np.insert(self.codes, place, len(self.ranks) + np.arange(len(fresh)))
            self.values = np.insert(self.values, place, fresh)
            self.ranks = np.concatenate((self.ranks, ranks[new][first] if ranks is not None else np.full(len(fresh), -1)))
        return self.codes[np.searchsorted(self.values, values)]

    def take(self, row: dict) -> None:
        values = unpacked_terms(row["terms"])
        if row["kind"] == KNOWN:
            self.encode(values, unpacked(row["occurrences"]))
            return
        names, cutoffs = np.frombuffer(row["libraries"], np.int64).reshape(2, -1)
        for name, cutoff in zip(names.tolist(), cutoffs.tolist()):
            if name not in self.libraries:
                self.libraries[name] = len(self.cutoffs)
                self.cutoffs.append(cutoff)
        own = np.array([self.libraries[n] for n in names.tolist()], np.int64)
        self.waiting.append((values, own[unpacked(row["owner"])], unpacked(row["occurrences"]), unpacked(row["records"])))
        self.entries += len(values)
        if self.entries >= FOLD:
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        values, *rest = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.entries = [], 0
        self.sums = _accumulate(*(np.concatenate(c) for c in zip(self.sums, (self.encode(values), *rest))))

    def terms(self) -> pa.RecordBatch:
        """One row for each value that occurs; new values are ranked behind the written ones, in ascending order."""
        self.fold()
        unranked = self.codes[self.ranks[self.codes] < 0]
        self.ranks[unranked] = self.ranks.max(initial=-1) + 1 + np.arange(len(unranked))
        code, library, occurrences, records = self.sums
        n = len(self.ranks)
        arrays = [np.zeros(n, np.int64) for _ in range(4)]
        for total, part in zip(arrays, (occurrences, records, np.ones(len(code), np.int64), occurrences >= np.array(self.cutoffs, np.int64)[library])):
            np.add.at(total, code, part)
        held = arrays[2][self.codes] > 0
        codes = self.codes[held]
        columns = [(self.number << 40) + self.ranks[codes], self.values[held], *(a[codes] for a in arrays)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term_id", "value", "occurrences", "records", "libraries", "kept_by"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages sorted by range, a dictionary's first."""
    now: Range | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["range"] != now.number:
                if now is not None:
                    yield now.terms()
                now = Range(row["range"])
            now.take(row)
    if now is not None:
        yield now.terms()


def term_frequencies(blocks: DataFrame, libraries: DataFrame | None = None, ranges: int | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """term_id, value, occurrences, records, libraries and kept_by of every distinct value.

    ``blocks`` are rows of indexed_kmers, of which the latest loaded_at of each
    block_id holds; ``records`` counts the blocks with the value, ``kept_by``
    the libraries in which its occurrences reach the library's cutoff, the
    used_min_count of its latest row in ``libraries`` (none or null: every
    occurrence, even a sum of 0, reaches it).

    A ``dictionary`` (`dictionary_of` an earlier result) keeps the identifiers
    of its values and the number of ranges. A range's dictionary and sums lie
    in one task's memory; ``ranges`` (the shuffle partitions, if not given)
    must suit the number of distinct values.

    Null elements are no values; a null or missing count is 0, counts beyond
    the hashes are ignored, a negative one counts as 0; a value standing twice
    in a block adds up and makes one record. A null block_id is one block, a
    null sample one library. Equal loaded_at: the greatest content holds.
    Further columns are ignored. Values are combined by library within every
    task before they are shuffled, so a value in a third of all blocks costs
    one entry a batch.
    """
    spark = blocks.sparkSession
    if dictionary is not None:
        ranges = dictionary.agg(F.max("ranges")).first()[0] or ranges
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = current_blocks(blocks)
    if libraries is None:
        held = held.withColumn("cutoff", F.lit(NO_CUTOFF).cast("long"))
    else:
        cutoffs = current(libraries, "sample", "run_at", "used_min_count").select(F.col("sample").alias("_s"), F.col("used_min_count").cast("long").alias("_c"))
        held = held.join(cutoffs, F.col("sample").eqNullSafe(F.col("_s")), "left").withColumn("cutoff", F.coalesce("_c", F.lit(NO_CUTOFF).cast("long")))
    counts = F.transform(F.col("counts").cast("array<long>"), lambda c: F.greatest(c, F.lit(0).cast("long")))
    flat = held.select(F.col("canonical_hashes").alias("hashes"), counts.alias("counts"), F.xxhash64("sample").alias("library"), "cutoff")
    messages = flat.mapInArrow(_messages(ranges), MESSAGES)
    if dictionary is not None:
        messages = messages.unionByName(dictionary.select("value", "term_id").mapInArrow(_known(ranges), MESSAGES))
    by_range = messages.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "kind")
    return by_range.mapInArrow(_ranges, TERMS)


def dictionary_of(terms: DataFrame, ranges: int | None = None) -> DataFrame:
    """term_id and value of `term_frequencies`, with the number of ranges they were made with; to be written and used again."""
    ranges = ranges or int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return terms.select("term_id", "value", F.lit(ranges).alias("ranges"))


def marked_terms(blocks: DataFrame, libraries: DataFrame, common_share: float = 0.2) -> DataFrame:
    """canonical_hash and mark: ``rare`` if no library keeps the value, ``common`` if more than ``common_share`` of all blocks hold it.

    A value can carry both marks and then has two rows. Blocks without any
    value count as blocks too.
    """
    named, nameless = blocks.agg(F.countDistinct("block_id"), F.max(F.col("block_id").isNull().cast("int"))).first()
    most = common_share * (named + (nameless or 0))
    terms = term_frequencies(blocks, libraries)
    marks = F.filter(F.array(F.when(F.col("kept_by") == 0, "rare"), F.when(F.col("records") > F.lit(most), "common")), lambda m: m.isNotNull())
    return terms.select(F.col("value").alias("canonical_hash"), F.explode(marks).alias("mark"))
