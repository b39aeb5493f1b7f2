"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: texts become arrays of code-point classes; where a token of the
pre-tokeniser starts is decided by a finite automaton, run as an associative
scan over transition functions instead of a regular expression; the resulting
slices are looked up in a cache, and unknown ones are merged pair by pair.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import LETTER, NUMBER, SPACE, code_classes, code_points, in_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is sent to every worker; larger files are refused.
MOST_VOCABULARY_BYTES = 64 << 20
#: Distinct slices that a worker keeps encoded.
CACHED = 400_000

# Symbols that the automaton reads: letter, number, other, a space before something that is no space, other white space
# before something that is none, white space before white space or the end, an apostrophe that opens a contraction of one
# or of two letters. A text's first symbol comes from a second set, and one symbol changes nothing.
L, N, O, JOINS, LAST_SPACE, MORE_SPACE, SHORT, LONG = range(8)
FIRST, NOTHING, SYMBOLS = 8, 16, 17
# States: a token has just ended; inside letters, numbers, others, white space; after a space that joins what follows;
# two letters or one of a contraction are due.
ENDED, IN_L, IN_N, IN_O, IN_SPACE, JOINED, DUE_2, DUE_1 = range(8)
STATES = 8
#: What may follow an apostrophe in a contraction.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, at symbol * STATES + state."""
    following, starts = np.zeros((SYMBOLS, STATES), np.uint8), np.zeros((SYMBOLS, STATES), bool)
    runs = {L: IN_L, N: IN_N, O: IN_O}
    for state in range(STATES):
        for symbol in range(8):
            if state in (DUE_1, DUE_2):
                result = (DUE_1 if state == DUE_2 else ENDED, False)
            elif symbol in runs:
                result = (runs[symbol], state not in (runs[symbol], JOINED))
            elif symbol in (SHORT, LONG):
                result = (IN_O, False) if state in (IN_O, JOINED) else (DUE_1 if symbol == SHORT else DUE_2, True)
            elif symbol == MORE_SPACE:
                result = (IN_SPACE, state != IN_SPACE)
            else:
                result = (JOINED if symbol == JOINS else ENDED, True)
            following[symbol, state], starts[symbol, state] = result
        following[NOTHING, state] = state
    following[FIRST : FIRST + 8] = following[:8, :1]
    starts[FIRST : FIRST + 8] = starts[:8, :1]
    return following.ravel(), starts.ravel()


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the automaton reads for each code point of non-empty texts, which end before ``ends``."""
    classes = code_classes()[codes]
    last = np.zeros(len(codes), bool)
    last[ends - 1] = True
    space = classes == SPACE
    out = np.full(len(codes), O, np.uint8)
    out[classes == LETTER] = L
    out[classes == NUMBER] = N
    more = space & (np.concatenate((space[1:], [True])) | last)
    out[space] = np.where(more[space], MORE_SPACE, np.where(codes[space] == 0x20, JOINS, LAST_SPACE))
    quotes = np.flatnonzero(codes == ord("'"))
    quotes = quotes[~last[quotes]]
    short = np.isin(codes[quotes + 1], [ord(c) for c in ONE_LETTER])
    out[quotes[short]] = SHORT
    quotes = quotes[~short]
    quotes = quotes[(quotes + 2 < len(codes)) & ~last[quotes + 1]]
    pair = codes[quotes + 1].astype(np.int64) << 32 | codes[quotes + 2]
    out[quotes[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS])]] = LONG
    out[np.concatenate(([0], ends[:-1]))] += FIRST
    return out


def token_starts(read: np.ndarray, block: int = 64) -> np.ndarray:
    """Where tokens start. Every block's transition function is composed at once, the functions are scanned by
    doubling, and every block then runs from the state in which it is entered."""
    following, starts = automaton()
    n = -(-len(read) // block)
    grid = np.full(n * block, NOTHING, np.uint8)
    grid[: len(read)] = read
    grid = np.ascontiguousarray(grid.reshape(n, block).T) * np.uint8(STATES)
    function = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    for row in grid:
        function = following[row[:, None] + function]
    step = 1
    while step < n:
        composed = np.take_along_axis(function[step:], function[:-step].astype(np.int64), 1)
        function = np.concatenate((function[:step], composed))
        step *= 2
    state = np.concatenate(([ENDED], function[:-1, ENDED])).astype(np.uint8)
    found = np.empty((block, n), bool)
    for i, row in enumerate(grid):
        at = row + state
        found[i] = starts[at]
        state = following[at]
    return np.flatnonzero(found.T.ravel()[: len(read)])


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the adjacent pair of lowest rank, the leftmost first, is merged until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) <= 24:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # Long slices: a heap of pairs over a linked list. end[i] is 0 once the part at i has gone.
    size = len(piece)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < size and (r := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= size or end[end[i]] != stop:
            continue
        middle, end[i] = end[i], stop
        end[middle] = 0
        if stop < size:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Growing:
    """An array that is appended to in amortised constant time."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1024, kind), 0

    def extend(self, values: list[int]) -> None:
        if self.size + len(values) > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(self.size + len(values) + 1024, self.held.dtype)))
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


class Encoder:
    """Encodes many texts at once; slices seen before cost one lookup."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.sizes: np.ndarray | None = None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.first, self.ids = Growing(np.int64), Growing(np.int64), Growing(np.int32)

    def _code(self, slices: list[str]) -> np.ndarray:
        known = self.known
        codes = [known.get(s, -1) for s in slices]
        out = np.array(codes, np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            for i in missing.tolist():
                s = slices[i]
                code = known.get(s)
                if code is None:
                    code = known[s] = self.lengths.size
                    ids = merged(s.encode("utf-8", "surrogatepass"), self.ranks)
                    self.first.extend([self.ids.size])
                    self.lengths.extend([len(ids)])
                    self.ids.extend(ids)
                out[i] = code
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and all ids; empty texts have none."""
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.zeros(len(texts) + 1, np.int64)
        if not sizes.sum():
            return bounds, np.zeros(0, np.int32)
        if len(self.known) > CACHED:
            self._forget()
        joined = "".join(texts)
        ends = np.cumsum(sizes)
        starts = token_starts(symbols(code_points(joined), np.unique(ends[sizes > 0])))
        cuts = starts.tolist()
        codes = self._code([joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)])])
        count = self.lengths.held[codes]
        run = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(self.first.held[codes] - run[:-1], count) + np.arange(run[-1])
        bounds[1:] = run[np.searchsorted(starts, ends)]
        return bounds, self.ids.held[at]

    def offsets(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where each id begins in the UTF-8 bytes of its text."""
        if self.sizes is None:
            self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for piece, rank in self.ranks.items():
                self.sizes[rank] = len(piece)
        run = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        return (run[:-1] - np.repeat(run[bounds[:-1]], np.diff(bounds))).astype(np.int32)


_ENCODERS: dict[int, Encoder] = {}


def encode_texts(df: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", with_offsets: bool = False) -> DataFrame:
    """doc_id and ids of every row, by the ranks file ``vocabulary`` and without special tokens; ``with_offsets`` also where
    each id begins in the text's UTF-8 bytes.

    Null and empty texts have an empty list, never null; strings that look like
    special tokens are ordinary text. Row for row: repeated rows stay, null ids
    stay, further columns are left out. Texts of any length are encoded whole.
    Only the two columns are read and nothing is shuffled.
    """
    content = Path(vocabulary).read_bytes()
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has {len(content)} bytes; at most {MOST_VOCABULARY_BYTES} are sent to the workers")
    sent = df.sparkSession.sparkContext.broadcast(content)
    key = hash(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = Encoder(parse_ranks(sent.value))
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for a, b in in_chunks(texts):
                bounds, ids = encoder.encode(texts[a:b])
                cuts = pa.array(bounds.astype(np.int32))
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(cuts, pa.array(ids))]
                if with_offsets:
                    columns.append(pa.ListArray.from_arrays(cuts, pa.array(encoder.offsets(bounds, ids))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "ids", "offsets"][: len(columns)])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>" + (", offsets array<int>" if with_offsets else ""))


def decode_ids(df: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The text of every list of ids, and where each id starts in its UTF-8 bytes (null lists: empty text).

    Bytes that are no UTF-8 on their own, as when a list was cut inside a
    character, become U+FFFD.
    """
    sent = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: piece for piece, rank in parse_ranks(sent.value).items()}
        for batch in batches:
            texts, offsets = [], []
            for ids in batch.column(1).to_pylist():
                pieces = [token[i] for i in ids or []]
                texts.append(b"".join(pieces).decode("utf-8", "replace"))
                sizes = [len(p) for p in pieces]
                offsets.append(np.cumsum([0, *sizes])[:-1].tolist() if sizes else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(offsets, pa.list_(pa.int32()))], names=[id_column, "text", "offsets"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, text string, offsets array<int>")
