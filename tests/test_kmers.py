import pytest
from pyspark.sql import functions as F

from brute import canonical, counts, genome, rc, windows
from helixframe.functions import dna
from helixframe.operators import counting, kmers
from helixframe.plans import catalog
from helixframe.sources import reads as source

READS = [
    (1, "ACGTACGGTNACGTTTGACCA", "I" * 21),
    (2, "acgtacggtcaacgtttgacc", "#" * 5 + "I" * 10 + "+" * 6),
    (3, "ACG", "III"),
    (4, "", ""),
    (5, None, None),
    (6, "TTTTTTTTTTTTTTTTTTTTTTTTT", None),
    (7, "GGGTCAAACGTGGGTCAAACGTé", "II"),
]
SCHEMA = "read_id long, seq string, qual string"


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(READS, SCHEMA).repartition(3)


@pytest.mark.parametrize("k,floor", [(3, 0), (5, 10), (5, 30), (11, 0)])
def test_windows(reads, k, floor):
    got = sorted((r.read_id, r.start, r.kmer, r.forward) for r in kmers.kmer_windows(reads, k, [floor]).collect())
    want = sorted((i, at, canonical(w), canonical(w) == w) for i, s, q in READS if s for at, w in windows(s, q, k, floor))
    assert got == want


def test_groups(reads):
    floors = [0, 10, 30]
    got = {(r.read_id, r.start): r.grp for r in kmers.kmer_windows(reads, 5, floors).collect()}
    for level, floor in enumerate(floors):
        clean = {(i, at) for i, s, q in READS if s for at, _ in windows(s, q, 5, floor)}
        assert {p for p, g in got.items() if g >= level} == clean


@pytest.mark.parametrize("k", [3, 7, 21, 31, 33, 35, 61, 63, 93])
def test_counts(spark, k):
    rows = [(i, "ACGGTCAATGCCATTGACCGTAAGCTNACGGTCAATGCCATTGACCGTAAGCTAAC" * 2, None) for i in range(3)] + READS
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert {r.kmer: r.n for r in counting.count_kmers(df, k).collect()} == dict(counts(rows, k))


def test_floor_counts_and_cutoff(reads):
    table = counting.count_kmers(reads, 5, [0, 10, 30])
    for i, floor in enumerate([0, 10, 30]):
        assert {r.kmer: r[f"n_f{i}"] for r in table.collect() if r[f"n_f{i}"]} == dict(counts(READS, 5, floor))
    assert min(r.n for r in counting.at_least(table, 2).collect()) == 2
    assert {r.kmer for r in counting.gated_counts(table).collect()} == {m for m, n in counts(READS, 5).items() if n > 1}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert counting.count_kmers(empty, 21).count() == 0
    assert counting.dense(counting.histogram(counting.count_kmers(empty, 21))).sum() == 0
    assert kmers.kmer_windows(empty, 5).count() == 0


@pytest.mark.parametrize("k", [2, 4, 1, 257])
def test_bad_k(reads, k):
    with pytest.raises(ValueError):
        counting.count_kmers(reads, k)


def test_bad_floors(reads):
    for floors in ([5, 5], [3, 1], [0, 1, 2, 3]):
        with pytest.raises(ValueError):
            kmers.kmer_windows(reads, 5, floors)


def test_histogram_saturates(spark):
    h = counting.histogram(spark.createDataFrame([("A", 3), ("C", 3), ("G", 9000), ("T", 8000), ("N", 0)], "kmer string, n long"))
    assert {r["count"]: r["distinct"] for r in h.collect()} == {3: 2, 8000: 2}


def test_carry(spark):
    table = spark.createDataFrame([("AAC", 7), ("AAG", 1)], "kmer string, n long")
    contigs = spark.createDataFrame([("AAGT",)], "seq string")
    got = {r.kmer: (r.n, r.is_new) for r in counting.carry(table, contigs, 3, 4).collect()}
    assert got == {"AAC": (7, False), "AAG": (4, False), "ACT": (4, True)}


def test_sample_is_hash_threshold(spark):
    table = spark.range(20000).select(F.col("id").cast("string").alias("kmer"), F.lit(2).cast("long").alias("n"))
    threshold = counting.sample_threshold(20000, most=6000)
    n = counting.sampled(table, threshold).count()
    assert counting.sample_fraction(threshold) == 0.25 and abs(n - 5000) < 300
    assert counting.sample_threshold(10, most=6000) == 1 << 64


def test_scalar_functions(spark):
    row = spark.createDataFrame([("aCgTN", "ACCTG")], "s string, w string").select(
        dna.reverse_complement("w").alias("rc"), dna.canonical("w").alias("c"), dna.prefix("w", 5).alias("p"), dna.suffix("w", 5).alias("q"),
        dna.packed("w").alias("word"), dna.unpacked(dna.packed("w"), 5).alias("back"), dna.packed_base(dna.packed("w"), 3, 5).alias("t"),
        dna.endpoint_byte("w").alias("ends"), dna.encode_base(F.lit("g")).alias("g"), dna.encode_base(F.lit("N")).alias("n"), dna.decode_base(F.lit(2)).alias("two"),
        dna.complement_code(F.lit(0)).alias("comp"), dna.phred(F.lit("I")).alias("forty"), dna.phred(F.lit(" ")).alias("zero"), dna.is_base(F.lit("n")).alias("base"),
    ).first()
    assert (row.rc, row.c, row.p, row.q, row.back, row.t, row.g, row.n, row.two, row.comp, row.forty, row.zero, row.base) == ("CAGGT", "ACCTG", "ACCT", "CCTG", "ACCTG", 2, 3, None, "T", 2, 40, 0, False)
    assert row.word == int("".join(str("ACTG".index(b)) for b in "ACCTG"), 4) and row.ends == 0 * 4 + 3
    assert [dna.packed_bits(k) for k in (31, 33, 65, 255)] == [64, 128, 256, 512]


def test_read_records(spark):
    rows = [(1, "s", "ACGT", "IIII"), (1, "s", "ACGT", "IIII"), (2, "s", "ACGT", "II"), (3, "s", "AC", None)]
    df = source.delivered_once(spark.createDataFrame(rows, "read_id long, sample string, seq string, qual string"))
    assert df.count() == 3
    assert source.validated(df, "drop").count() == 2
    assert source.validated(df, "unrate").filter("qual is null").count() == 2
    with pytest.raises(Exception, match="differ in length in read 2"):
        source.validated(df).collect()
    stats = source.statistics(df).first()
    assert (stats.reads, stats.bases, stats.longest) == (3, 10, 4)
    assert source.quality_alphabet(df).count() == 0
    rated = source.validated(df, "unrate").filter("qual is not null")
    assert [r[0] for r in source.quality_alphabet(rated).collect()] == [40]


def test_store(spark, reads):
    clean = reads.filter("seq is not null and read_id in (2, 6)")
    store = source.ReadStore(clean, [0, 20])
    assert store.class_of_floor(20) == 1
    assert {r.read_id: r.seq for r in store.masked(20).collect()}[2] == "N" * 5 + "CGGTCAACGT" + "N" * 6
    with pytest.raises(KeyError):
        store.masked(7)
    store.close()
    with pytest.raises(ValueError):
        source.ReadStore(clean, [0, 20], two_bit=True)
    with pytest.raises(Exception, match="A, C, G and T only"):
        source.ReadStore(reads.filter("read_id = 1"), [0], two_bit=True).reads().collect()


def test_a_packed_store_counts_alike(spark, reads):
    rows = READS + [(100 + i, "ACGGTCAATGCCATTGACCG"[: i % 21], ("5I+#" * 5)[: i % 21] if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for floors in ([0], [0, 10, 30], [20]):
        store = source.ReadStore(df, floors)
        for k in (3, 11):
            table = lambda d: {tuple(r) for r in counting.count_kmers(d, k, floors).collect()}  # noqa: B023, E731
            assert table(store.reads()) == table(df)
        assert {(r.read_id, len(r.seq) if r.seq is not None else None) for r in store.reads().collect()} == {(i, len(s) if s is not None else None) for i, s, _ in rows}
        assert tuple(store.statistics().first()) == tuple(source.statistics(df).first())
        store.close()
    clean = df.filter("read_id >= 100 or read_id = 6")
    two = source.ReadStore(clean, [0], two_bit=True)
    assert {(r.read_id, r.seq, r.qual) for r in two.reads().collect()} == {(r.read_id, r.seq, None) for r in clean.collect()}
    two.close()
    empty = source.ReadStore(df.limit(0), [0, 20])
    assert empty.reads().count() == 0 and tuple(empty.statistics().first()) == (0, 0, 0)


def test_every_window_of_the_contigs(spark, tmp_path):
    text, old, k = genome(70, 41), genome(60, 42), catalog.K
    dirty = text[:30].lower() + "N" + text[30:]
    rows = [(1, old, 1), (1, dirty, 2), (2, text[5:40], 1), (3, None, 1), (4, text[:9], 1)]
    contigs = spark.createDataFrame([(k, i, seq, 1.0, None, t) for i, seq, t in rows], "k int, contig_id long, seq string, cov double, serialized_contigs array<struct<counts: int>>, written_at int")
    contigs.write.parquet(f"{tmp_path}/contigs.parquet")
    want = {(i, p, w) for i, seq in ((1, dirty), (2, text[5:40])) for p, w in windows(seq, None, k, 0)}
    assert len(want) > 40
    got = catalog.QUERIES["b_window_functions"](spark, str(tmp_path)).collect()
    code = {b: n for n, b in enumerate("ACTG")}
    assert sorted((r.contig_id, r.start, r.unpacked) for r in got) == sorted(want)
    for r in got:
        s = r.unpacked
        assert (r.rc, r.canonical, r.prefix, r.suffix) == (rc(s), canonical(s), s[:-1], s[1:])
        assert (r.packed, r.ends, r.fifth) == (sum(code[b] << 2 * (k - 1 - i) for i, b in enumerate(s)), code[s[0]] * 4 + code[s[-1]], code[s[4]])
    assert {r.contig_id for r in got if r.start > 0} == {1, 2}
