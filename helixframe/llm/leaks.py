"""Evaluation texts leaking into training text.

A document leaks an item if it holds at least ``least`` (12) consecutive words
of the item's text. Method: size-partitioned MinHash containment search with
exact verification. A passage of an item is a set of 8 five-word shingles; the
signature of a whole document could not show it among thousands. So every text
of whatever length is partitioned into overlapping windows of bounded size, in
one of which each passage lies as a whole: with windows that begin every 8
shingles and hold 15, a contained passage is 8/15 of the window at least. Under each
permutation its MinHash is that window's with this probability, so 16
permutations miss one passage in 200,000; with windows of the passage's own
size (``stride`` 1) one permutation misses none. Windows and passages that
share a MinHash are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix
from .text import Words, in_chunks, plain

#: log2 of the bits of the filter that all workers hold: 8 MB, whatever the number of items.
FILTER_BITS = 26
STRIDE, PERMUTATIONS = 8, 16
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def minhashes(shingles: np.ndarray, width: int) -> np.ndarray:
    """The minimum over each ``width`` consecutive shingles, in a logarithmic number of vector steps."""
    count = len(shingles) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    least, span = shingles, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:count], least[width - span : width - span + count])


def permuted(shingles: np.ndarray, number: int) -> np.ndarray:
    """The hashes under one of the permutations: an exclusive or and an odd factor."""
    salt, factor = (int(x) for x in mix(np.array([2 * number, 2 * number + 1], np.uint64), 99))
    with np.errstate(over="ignore"):
        return (shingles ^ np.uint64(salt)) * np.uint64(factor | 1)


class Shingles:
    """The shingles of many texts, each text's at the beginning of blocks of ``stride``, with empty places behind them."""

    def __init__(self, words: Words, size: int, width: int, stride: int):
        held = words.shingles(size)
        inside = np.flatnonzero(words.text[: len(held)] == words.text[size - 1 :]) if len(held) else np.zeros(0, np.int64)
        text = words.text[inside]
        self.width, self.stride = width, stride
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate((first, [len(text)]))) if len(text) else np.zeros(0, np.int64)
        blocks = -(-counts // stride) + -(-width // stride)
        offset = (np.cumsum(blocks) - blocks) * stride
        place = np.repeat(offset, counts) + np.arange(len(text)) - np.repeat(first, counts)
        self.hashes = np.full(int(blocks.sum()) * stride, NONE, np.uint64)
        self.filled = np.zeros(len(self.hashes), bool)
        self.hashes[place], self.filled[place] = held[inside], True
        # windows: one for every stride of a text's shingles that a passage may begin in
        windows = np.where(counts >= width, (counts - width) // stride + 1, 0)
        number = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = np.repeat(offset, windows) + number * stride
        self.first_word = inside[np.repeat(first, windows) + number * stride] if len(number) else np.zeros(0, np.int64)
        self.left = np.repeat(counts, windows) - number * stride  # shingles of the text from here on

    def signature(self, number: int) -> np.ndarray:
        """The MinHash of every window under one permutation: of ``width + stride - 1`` shingles, fewer at a text's end."""
        h = np.where(self.filled, permuted(self.hashes, number), NONE)
        reach = self.width + self.stride - 1
        if self.stride > 1 and reach < 2 * self.stride:
            blocks = h.reshape(-1, self.stride)
            at = self.start // self.stride
            return np.minimum(blocks.min(axis=1)[at], blocks[:, : reach - self.stride].min(axis=1)[at + 1])
        return minhashes(np.concatenate((h, np.full(reach, NONE, np.uint64))), reach)[self.start]


def item_passages(items: DataFrame, least: int = 12, shingle: int = 5, permutations: int = PERMUTATIONS) -> DataFrame:
    """value, words and item_id: of every item each MinHash that one of its passages has, and the stretch of words over which it holds."""
    width = least - shingle + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [plain(t or "") for t in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts):
                words = Words(texts[a:b])
                parts = Shingles(words, shingle, width, 1)
                for number in range(permutations):
                    value, first = parts.signature(number), parts.first_word
                    owner = words.text[first]
                    begins = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))) if len(value) else np.zeros(0, np.int64)
                    ends = np.concatenate((begins[1:], [len(value)])) - 1 if len(begins) else begins
                    stretches = [words.phrase(int(first[i]), int(first[j] - first[i]) + least) for i, j in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(value[begins].view(np.int64)), pa.array(stretches, pa.string()), batch.column(0).take(pa.array(owner[begins] + a)).cast(pa.int64())], names=["value", "words", "item_id"])

    return items.select("item_id", "text").mapInArrow(run, "value long, words string, item_id long").distinct()


def _filter(spark: SparkSession, passages: DataFrame, bits: int):
    """A broadcast bitmap of the top ``bits`` bits of all values; its size does not depend on how many there are."""
    place = F.shiftrightunsigned("value", 64 - bits)
    words = passages.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(value, {64 - bits}) & 63 as int))")).alias("set")).toArrow()
    bitmap = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return spark.sparkContext.broadcast(bitmap)


def _search(sent, bits: int, least: int, shingle: int, stride: int, permutations: int):
    """The windows of every text that have a MinHash that passages may have."""
    width = least - shingle + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value.view(np.uint64)
        for batch in batches:
            texts = [plain(t) if t else "" for t in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts):
                words = Words(texts[a:b])
                parts = Shingles(words, shingle, width, stride)
                if not len(parts.start):
                    continue
                met, values = [], []
                for number in range(permutations):
                    value = parts.signature(number)
                    top = value >> np.uint64(64 - bits)
                    hit = np.flatnonzero((bitmap[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1))
                    met.append(hit)
                    values.append(value[hit])
                window, value = np.concatenate(met), np.concatenate(values)
                if len(window):
                    held = np.minimum(parts.left[window], width + stride - 1) + shingle - 1
                    phrases = {}
                    out = [phrases.get(w) or phrases.setdefault(w, words.phrase(int(parts.first_word[w]), int(n))) for w, n in zip(window.tolist(), held.tolist())]
                    docs = batch.column(0).take(pa.array(words.text[parts.first_word[window]] + a))
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), docs.cast(pa.int64()), pa.array(out, pa.string())], names=["value", "doc_id", "phrase"])

    return run


def _verified(least: int):
    """Candidates whose window holds ``least`` consecutive words, and so all their shingles, of the passages' stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known = [], {}
            for i, pair in enumerate(zip(batch.column("phrase").to_pylist(), batch.column("words").to_pylist())):
                if pair not in known:
                    phrase, words = f" {pair[0]} ", pair[1].split(" ")
                    known[pair] = any(f" {' '.join(words[j : j + least])} " in phrase for j in range(len(words) - least + 1))
                if known[pair]:
                    keep.append(i)
            yield batch.select(["doc_id", "item_id"]).take(pa.array(keep, pa.int64()))

    return run


def leaked(documents: DataFrame, items: DataFrame, least: int = 12, shingle: int = 5, stride: int = STRIDE, permutations: int = PERMUTATIONS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id and item_id of every document that holds ``least`` consecutive words of an item.

    Words are maximal runs of letters and digits, compared in lower case, after
    character references are read as their characters and soft hyphens and
    zero-width spaces are dropped. Documents are read once, however many items
    there are: a filter of fixed size sorts out nearly all windows where they
    are read, the others meet the items by an equi-join on their MinHash.

    A passage is missed with probability (1 - p / (p + stride - 1)) to the
    power of ``permutations``, p being its shingles: 5e-6 by default. ``stride``
    1 with one permutation is the exact way, at the cost of a window a word.

    Null and empty texts, and items of fewer than ``least`` words, match
    nothing. Repeated rows give one pair; items of equal text are all
    reported. Rows with null ids are compared like others. Texts are searched
    whole. Further columns are ignored.
    """
    if not 0 < shingle <= least:
        raise ValueError("a passage must hold at least one shingle")
    if stride < 1 or permutations < 1 or not 6 <= filter_bits <= 30:
        raise ValueError("stride and permutations must be positive, filter_bits between 6 and 30")
    held = item_passages(items, least, shingle, permutations)
    sent = _filter(documents.sparkSession, held, filter_bits)
    windows = documents.select("doc_id", "text").mapInArrow(_search(sent, filter_bits, least, shingle, stride, permutations), "value long, doc_id long, phrase string")
    met = windows.join(held, "value").select("doc_id", "item_id", "phrase", "words")
    return met.mapInArrow(_verified(least), "doc_id long, item_id long").distinct()


def leak_report(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """item_id and the number of documents that leak it, of every item, those that leaked nowhere included."""
    counts = leaked(documents, items, least).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))
