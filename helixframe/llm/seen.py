"""Has this key been seen before? Scalable Bloom chains with an exact check of their positive answers.

Method: keys are spread over chains by their hash. A chain is a list of Bloom
filters; once the newest one is half full, another with twice the capacity and
half the error rate is added, so the compounded rate of wrong answers stays
below the promised one however long the history grows. The chains of the
history are built once and can be written down, loaded and grown; sightings
then ask them in order of arrival. "No" is final. Of the "yes" answers the
exact check takes those apart that a chain cannot vouch for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters
from .arrays import flat_lists, ints, mix, rechunk

#: Kinds of rows on their way to a chain, and of those that come from it.
LOADED, ASKED = 0, 1
NO, YES, STATE, AGAIN = 0, 1, 2, 3
BEFORE_ALL = np.iinfo(np.int64).min
#: Keys that the first layer of a chain takes.
FIRST = 4096
CHAINS = "route long, layer int, capacity long, error double, keys long, words binary, chains int"
LAYER = "struct<layer: int, capacity: bigint, error: double, keys: bigint, words: binary>"
FLOW = f"route long, sight long, kind int, more array<bigint>, chain {LAYER}"
ANSWERS = "key long, sight long, kind int, more array<bigint>, layers int, keys long, bound double"


class Layer:
    def __init__(self, capacity: int, error: float, seed: int):
        self.capacity, self.error, self.seed = capacity, error, seed
        self.probes = max(1, math.ceil(-math.log2(error)))
        self.bits = max(64, math.ceil(capacity * self.probes / math.log(2)))
        self.words = np.zeros((self.bits + 63) // 64, np.uint64)
        self.set_bits = 0

    @property
    def fill(self) -> float:
        return self.set_bits / self.bits

    def _places(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        one, two = mix(keys, self.seed), mix(keys, self.seed + 1) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(self.probes):
                place = (one + np.uint64(i) * two) % np.uint64(self.bits)
                yield (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        maybe = np.ones(len(keys), bool)
        for word, bit in self._places(keys):
            maybe &= (self.words[word] & bit) != 0
        return maybe

    def add(self, keys: np.ndarray) -> None:
        for word, bit in self._places(keys):
            np.bitwise_or.at(self.words, word, bit)
        self.set_bits = int(np.bitwise_count(self.words).sum())


class BloomChain:
    """Growing set of int64 keys without the keys; ``error`` bounds the rate of wrong positive answers for good."""

    def __init__(self, error: float = 0.001, first: int = 1 << 16, growth: int = 2, tightening: float = 0.5, fill: float = 0.5):
        self.error, self.first, self.growth, self.tightening, self.full = error, first, growth, tightening, fill
        self.layers: list[Layer] = []
        self.keys = 0

    def _grow(self) -> None:
        i = len(self.layers)
        self.layers.append(Layer(self.first * self.growth**i, self.error * (1 - self.tightening) * self.tightening**i, 2 * i))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        maybe = np.zeros(len(keys), bool)
        unsigned = keys.view(np.uint64)
        for layer in self.layers:
            rest = np.flatnonzero(~maybe)
            if not len(rest):
                break
            maybe[rest] = layer.holds(unsigned[rest])
        return maybe

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that the chain does not hold; a layer takes what brings it to its fill threshold."""
        unsigned, done = keys.view(np.uint64), 0
        while done < len(keys):
            if not self.layers or self.layers[-1].fill >= self.full:
                self._grow()
            layer = self.layers[-1]
            # keys until the threshold, each setting ``probes`` bits of which a share is set already
            room = math.ceil(math.log((1 - layer.fill) / (1 - self.full)) * layer.bits / layer.probes)
            part = unsigned[done : done + max(room, 1)]
            layer.add(part)
            done += len(part)
        self.keys += len(keys)

    @property
    def bound(self) -> float:
        """Chance that a key never added is answered with yes, from the layers' fill."""
        right = 1.0
        for layer in self.layers:
            right *= 1 - layer.fill**layer.probes
        return 1 - right

    def rows(self) -> list[tuple]:
        """layer, capacity, error, keys of the whole chain and words of every layer; `loaded` makes a chain of them again."""
        return [(i, layer.capacity, layer.error, self.keys, layer.words.tobytes()) for i, layer in enumerate(self.layers)]

    def load(self, layer: int, capacity: int, error: float, keys: int, words: bytes) -> None:
        """Put a written layer in place; layers may come in any order."""
        while len(self.layers) <= layer:
            self.layers.append(Layer(64, 0.5, 0))
        self.layers[layer] = Layer(capacity, error, 2 * layer)
        self.layers[layer].words[:] = np.frombuffer(words, np.uint64)
        self.layers[layer].set_bits = int(np.bitwise_count(self.layers[layer].words).sum())
        self.keys = keys


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of the given columns, the others null."""
    given = {c: v if isinstance(v, pa.Array) else pa.array(v, schema.field(c).type) for c, v in columns.items()}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


_LAYER = pa.struct([("layer", pa.int32()), ("capacity", pa.int64()), ("error", pa.float64()), ("keys", pa.int64()), ("words", pa.binary())])
_FLOW = pa.schema([("route", pa.int64()), ("sight", pa.int64()), ("kind", pa.int32()), ("more", pa.list_(pa.int64())), ("chain", _LAYER)])
_CHAINS = pa.schema([("route", pa.int64()), ("layer", pa.int32()), ("capacity", pa.int64()), ("error", pa.float64()), ("keys", pa.int64()), ("words", pa.binary()), ("chains", pa.int32())])
_ANSWERS = pa.schema([("key", pa.int64()), ("sight", pa.int64()), ("kind", pa.int32()), ("more", pa.list_(pa.int64())), ("layers", pa.int32()), ("keys", pa.int64()), ("bound", pa.float64())])


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in rechunk(batches, 4000):
        _, _, flat = flat_lists(table.column("keys").combine_chunks())
        keys = np.unique(ints(flat.drop_null()))
        yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["route"])


def _history(indexed: DataFrame, chains: int) -> DataFrame:
    """The history's keys (route) by chain. Its filter keeps one from being added on the way to a join, which would make it another exchange."""
    keys = indexed.select(F.col("canonical_hashes").alias("keys")).mapInArrow(_distinct_keys, "route long")
    return keys.filter("route is not null").repartition(chains, "route")


def _sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch asks once for each of its keys, with the first sighting; the later ones, which repeat it for certain, go along (more)."""
    for table in rechunk(batches, 200_000):
        key, sight = ints(table.column("key").combine_chunks()), ints(table.column("sight").combine_chunks())
        order = np.lexsort((sight, key))
        key, sight = key[order], sight[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (sight[1:] != sight[:-1])))  # without repeated deliveries
        key, sight = key[once], sight[once]
        leads = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(leads)
        sizes = np.diff(np.concatenate((first, [len(key)]))) - 1
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sight[~leads]), mask=pa.array(sizes == 0))
        yield _batch(_FLOW, len(first), route=key[first], sight=sight[first], kind=np.full(len(first), ASKED), more=more)


def _taken(chain: BloomChain, layers: pa.ChunkedArray) -> None:
    for row in layers.drop_null().to_pylist():
        chain.load(**row)


def _build(error: float, first: int, chains: int):
    """Keys, and layers of an older chain before them, to the layers of a chain; they go by one of the chain's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, route = BloomChain(error, first), None
        for table in rechunk(batches, 100_000):
            if "chain" in table.column_names:
                written = pa.compute.is_valid(table.column("chain"))
                _taken(chain, table.column("chain"))
                route = ints(table.column("route").combine_chunks())[0] if route is None else route
                table = table.filter(pa.compute.invert(written))
            keys = np.unique(ints(table.column("route").combine_chunks()))
            if len(keys):
                route = keys[0] if route is None else route
                chain.add(keys[~chain.holds(keys)])
        if chain.layers:
            layer, capacity, errors, keys, words = zip(*chain.rows())
            n = len(layer)
            yield _batch(_CHAINS, n, route=[int(route)] * n, layer=layer, capacity=capacity, error=errors, keys=keys, words=words, chains=[chains] * n)

    return run


def _layers(saved: DataFrame) -> DataFrame:
    return saved.select("route", F.struct("layer", "capacity", "error", "keys", "words").alias("chain"))


def chain_count(df: DataFrame) -> int:
    """As many chains as shuffle partitions: what a chain takes is a fraction of what its partition holds."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def build_chains(indexed: DataFrame, error: float = 0.001, first: int = FIRST, chains: int | None = None, saved: DataFrame | None = None) -> DataFrame:
    """The layers of the chains that hold all of ``indexed.canonical_hashes``, and what ``saved`` chains held before.

    The table can be written and read again; `seen_before` takes it as
    ``saved``. Every chain's rows carry one of its keys (route), by which they
    find the sightings they are asked by, and the number of chains. Null
    elements are no keys, an empty history has no rows.
    """
    if saved is not None:
        chains = saved.agg(F.max("chains")).first()[0] or chains
    chains = chains or chain_count(indexed)
    keys = _history(indexed, chains)
    if saved is not None:
        keys = keys.select("route", F.lit(None).cast(LAYER).alias("chain")).unionByName(_layers(saved)).repartition(chains, "route").sortWithinPartitions(F.col("chain").isNull())
    return keys.mapInArrow(_build(error, first, chains), CHAINS)


def _ask(error: float, first: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = BloomChain(error, first), None
        for table in rechunk(batches, rows):
            kind = ints(table.column("kind").combine_chunks())
            if (kind == LOADED).any():
                _taken(chain, table.column("chain"))
            table = table.filter(pa.array(kind == ASKED))
            if not table.num_rows:
                continue
            key, sight = ints(table.column("route").combine_chunks()), ints(table.column("sight").combine_chunks())
            same = np.concatenate(([last == (key[0], sight[0])], (key[1:] == key[:-1]) & (sight[1:] == sight[:-1])))
            last = (key[-1], sight[-1])
            known = chain.holds(key)
            # rows come in order of arrival, so within a batch a key's first row is its first sighting
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            maybe = known | (np.arange(len(key)) > at[back])
            maybe[0] |= same[0]
            told = np.where(maybe, YES, NO).astype(np.int32)
            # a delivery of the sighting before it is no sighting; what it brings along still is
            yield _batch(_ANSWERS, len(key), key=key, sight=np.where(told == YES, sight, BEFORE_ALL), kind=np.where(same, AGAIN, told), more=table.column("more").combine_chunks())
            chain.add(key[at][~known[at]])
        yield _batch(_ANSWERS, 1, kind=[STATE], layers=[len(chain.layers)], keys=[chain.keys], bound=[chain.bound])

    return run


def _answers(sightings: DataFrame, indexed: DataFrame | None, saved: DataFrame | None, error: float, first: int, chains: int | None, rows: int) -> tuple[DataFrame, int]:
    """What the chains answer: YES with key and sighting or NO with the key, either with the sightings that go along, and one STATE of each chain."""
    if saved is not None:
        chains = saved.agg(F.max("chains")).first()[0] or chains
    chains = chains or chain_count(sightings)
    flow = sightings.select(F.col("canonical_hash").alias("key"), F.col("sight_id").alias("sight")).filter("key is not null and sight is not null").mapInArrow(_sightings, FLOW)
    if saved is None and indexed is not None:
        saved = build_chains(indexed, error, first, chains)
    if saved is not None:
        loaded = _layers(saved).select("route", F.lit(int(BEFORE_ALL)).alias("sight"), F.lit(LOADED).alias("kind"), F.lit(None).cast("array<bigint>").alias("more"), "chain")
        flow = flow.unionByName(loaded)
    flow = flow.repartition(chains, "route").sortWithinPartitions(F.col("kind") != LOADED, "sight", "route")
    return flow.mapInArrow(_ask(error, first, rows), ANSWERS), chains


def _checked(answers: DataFrame, indexed: DataFrame | None, chains: int, vouched: bool) -> DataFrame:
    """key, sight, kind, more and right of every answer; only a YES can be right.

    A chain forgets nothing, so behind a NO every later sighting of the key
    repeats it; so does every one behind the key's first YES. Only that first
    YES of a key without a NO must stand in the history. Answers and history
    are both split by key into as many parts, so they meet in place.
    """
    told = answers.filter(F.col("kind") != STATE).select("key", "sight", "kind", "more")
    told = told.withColumn("began", F.min("sight").over(Window.partitionBy("key")))
    yes = F.col("kind") == YES
    repeats = F.col("sight") > F.col("began")
    if indexed is None:
        return told.select("key", "sight", "kind", "more", (yes & (repeats | F.lit(vouched))).alias("right"))
    history = _history(indexed, chains).withColumnRenamed("route", "key").groupBy("key").agg(F.lit(True).alias("known"))
    return told.join(history, "key", "left").select("key", "sight", "kind", "more", (yes & (repeats | F.coalesce("known", F.lit(False)))).alias("right"))


def seen_before(sightings: DataFrame, indexed: DataFrame | None = None, error: float = 0.001, first: int = FIRST, chains: int | None = None, rows: int = 50_000, saved: DataFrame | None = None) -> DataFrame:
    """sight_id of every sighting whose key stands in ``indexed`` or in a sighting with a smaller sight_id.

    The chains are built from ``indexed.canonical_hashes``, or taken from
    ``saved`` (`build_chains`), and asked by the sightings in order of
    sight_id, whose keys they learn. "No" is always right and ends there. A
    "yes" is right if the key had a "no" or another "yes" before; the others
    are looked up in ``indexed``. With ``saved`` and no ``indexed`` there is
    nothing to look up in, and these are wrong at most at the promised rate.

    Before it is shuffled, a batch of sightings is put together to one
    question for each of its keys, so a key that makes up a third of all
    sightings asks once a batch. A chain answers about ``rows`` questions at a
    time, before it learns their keys.

    A repeated sight_id is the same sighting and appears once; null keys and
    null sight_ids are never seen and not returned; null elements of the index
    are no keys. Empty tables give no rows; further columns are ignored.
    """
    answers, n = _answers(sightings, indexed, saved, error, first, chains, rows)
    checked = _checked(answers, indexed, n, saved is not None).filter("right or more is not null")
    own = F.when(F.col("right"), F.array("sight")).otherwise(F.array().cast("array<bigint>"))
    return checked.select(F.explode(F.concat(own, F.coalesce("more", F.array().cast("array<bigint>")))).alias("sight_id")).distinct()


def wrong_answers(sightings: DataFrame, indexed: DataFrame | None = None, error: float = 0.001, first: int = FIRST, chains: int | None = None, rows: int = 50_000, saved: DataFrame | None = None) -> DataFrame:
    """One row on the chains' answers: questions, wrong (positive answers that the exact check refutes), negatives,
    rate (wrong / questions about unseen keys), bound (highest compounded bound of a chain, from its fill), layers and keys."""
    answers, n = _answers(sightings, indexed, saved, error, first, chains, rows)
    one = F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    told = _checked(answers, indexed, n, saved is not None).filter(F.col("kind") == YES).select(one.alias("questions"), (~F.col("right")).cast("long").alias("wrong"), none.alias("negatives"), F.lit(0).alias("layers"), none.alias("keys"), F.lit(0.0).alias("bound"))
    no = F.col("kind") == NO
    rest = answers.filter(F.col("kind").isin(NO, STATE)).select(F.when(no, one).otherwise(none).alias("questions"), none.alias("wrong"), F.when(no, one).otherwise(none).alias("negatives"), F.coalesce("layers", F.lit(0)).alias("layers"), F.coalesce("keys", none).alias("keys"), F.coalesce("bound", F.lit(0.0)).alias("bound"))
    summed = told.unionByName(rest).agg(*(F.coalesce(F.sum(c), none).alias(c) for c in ("questions", "wrong", "negatives", "keys")), *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("layers", "bound")))
    unseen = F.col("wrong") + F.col("negatives")
    return summed.select("questions", "wrong", "negatives", F.when(unseen > 0, F.try_divide("wrong", unseen)).otherwise(F.lit(0.0)).alias("rate"), F.col("bound").cast("double").alias("bound"), F.lit(error).alias("promised"), F.col("layers").cast("int").alias("layers"), "keys")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word of its library's filter that each key asks, and the bits that must be set there."""
    for table in rechunk(batches, 50_000):
        keys, words = ints(table.column("key").combine_chunks()).view(np.uint64), ints(table.column("words").combine_chunks())
        word = np.full(len(keys), -1, np.int64)
        for n in np.unique(words[words > 0]).tolist():
            word[words == n] = filters.location(keys[words == n], n)
        yield pa.RecordBatch.from_arrays([table.column("library").combine_chunks(), table.column("key").combine_chunks(), table.column("held").combine_chunks(), pa.array(word), pa.array(filters.fingerprint(keys).view(np.int64))], names=["library", "key", "held", "word_no", "bits"])


def saved_filter_answers(sightings: DataFrame, indexed: DataFrame, bloom_bits: DataFrame) -> DataFrame:
    """sample, keys, held, yes, wrong and missed: what every library's saved filter answers to the distinct keys sighted in
    it, against the hashes its blocks hold.

    ``held`` counts the keys that stand in the library's blocks, ``wrong`` those answered yes that do
    not (false positives), ``missed`` those that do but are answered no, which happens
    where a buffer was zeroed or cut. Of several saved filters of a library
    the latest holds (nulls oldest, ties by the greatest buffer). A null or
    empty buffer, and a library without a filter, answer no to everything;
    null words are 0. Null samples are one library, null keys no keys.

    A key's bits lie in one word, so keys and words meet by an equi-join on
    library and word, and no filter is sent anywhere as a whole.
    """
    row = F.max(F.struct("saved_at", "buffer")).alias("r")
    kept = bloom_bits.groupBy(F.coalesce("sample", F.lit("")).alias("library")).agg(row).select("library", F.col("r.buffer").alias("buffer"))
    of = lambda df: F.coalesce(df["sample"], F.lit("")).alias("library")
    asked = sightings.select(of(sightings), F.col("canonical_hash").alias("key")).filter("key is not null").distinct()
    held = indexed.select(of(indexed), F.explode("canonical_hashes").alias("key")).filter("key is not null").distinct().withColumn("held", F.lit(True))
    questions = asked.join(held, ["library", "key"], "left").join(kept.select("library", F.coalesce(F.size("buffer"), F.lit(0)).alias("words")), "library", "left")
    questions = questions.select("library", "key", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))
    placed = questions.mapInArrow(_places, "library string, key long, held boolean, word_no long, bits long")
    words = kept.select("library", F.posexplode("buffer").alias("word_no", "word")).select("library", F.col("word_no").cast("long").alias("word_no"), F.coalesce("word", F.lit(0)).alias("word"))
    told = placed.join(words, ["library", "word_no"], "left").withColumn("yes", F.coalesce(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)))
    count = lambda c: F.count_if(c)
    return told.groupBy(F.col("library").alias("sample")).agg(F.count("*").alias("keys"), count(F.col("held")).alias("held"), count(F.col("yes")).alias("yes"), count(F.col("yes") & ~F.col("held")).alias("wrong"), count(F.col("held") & ~F.col("yes")).alias("missed"))
