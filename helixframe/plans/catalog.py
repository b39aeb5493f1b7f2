"""Registered queries of the core operators and the SQL they are checked against.

Reads come from read_records, each once; a quality of another length than its
sequence counts as missing. The number in a name is the operator's in the
inventory of the blueprint.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import compact, correct, counting, graph, kmers, spectrum
from ..sources import reads as read_source
from ..sources import sinks
from . import assemble, libraries, mixture, options, selection
from . import spectrum as estimator

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K, FLOORS, MIN_COUNT = 21, [0, 11, 25], 3
VALLEY, PEAK = 4, 12


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables as a query."""

    def register(f):
        QUERIES[name] = lambda spark, folder: f(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in tables))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def reads_of(records: DataFrame) -> DataFrame:
    return read_source.validated(read_source.delivered_once(records), "unrate")


_MASK = "array_to_string(list_transform(generate_series(1, length(seq)), lambda i: CASE WHEN upper(seq[i]) IN ('A','C','G','T') AND (qual IS NULL OR ascii(qual[i]) - 33 >= {floor}) THEN upper(seq[i]) ELSE 'N' END), '')"
_READS = "reads AS (SELECT DISTINCT read_id, sample, seq, CASE WHEN length(qual) = length(seq) THEN qual END AS qual FROM read_records)"
_MASKED = f"{_READS}, masked AS (SELECT read_id, seq, {', '.join(f'{_MASK.format(floor=f)} AS m{i}' for i, f in enumerate(FLOORS))} FROM reads)"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_WINDOWS = f"""{_MASKED}, cut AS (SELECT read_id, i - 1 AS start, substr(m0, i, {K}) AS w, substr(m1, i, {K}) AS w1, substr(m2, i, {K}) AS w2
  FROM (SELECT *, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM masked) WHERE strpos(substr(m0, i, {K}), 'N') = 0),
windows AS (SELECT read_id, start, least(w, {_RC.format('w')}) AS kmer, w <= {_RC.format('w')} AS forward, CASE WHEN strpos(w2, 'N') = 0 THEN 2 WHEN strpos(w1, 'N') = 0 THEN 1 ELSE 0 END AS grp FROM cut)"""
_COUNTS = f"""{_WINDOWS}, counts AS (SELECT kmer, count(*) AS n, count(*) AS n_f0, count(*) FILTER (WHERE grp >= 1) AS n_f1, count(*) FILTER (WHERE grp >= 2) AS n_f2 FROM windows GROUP BY kmer)"""
_SPECTRUM = f"{_COUNTS}, spectrum AS (SELECT CAST(least(n, 8000) AS INTEGER) AS count, count(*) AS distinct_kmers FROM counts GROUP BY 1)"
_FILLED = f"{_SPECTRUM}, filled AS (SELECT b.count, coalesce(distinct_kmers, 0) AS distinct_kmers FROM (SELECT unnest(generate_series(1, 8000)) AS count) b LEFT JOIN spectrum USING (count))"
_NODES = f"{_COUNTS}, nodes AS (SELECT kmer, n FROM counts WHERE n >= {MIN_COUNT}), view AS (SELECT kmer, '+' AS o, kmer AS s FROM nodes UNION ALL SELECT kmer, '-', {_RC.format('kmer')} FROM nodes)"
_EDGES = f"{_NODES}, edges AS (SELECT a.kmer AS src, a.o AS so, b.kmer AS dst, b.o AS dor FROM view a JOIN view b ON right(a.s, {K - 1}) = left(b.s, {K - 1}))"
_DEGREES = f"{_EDGES}, degrees AS (SELECT kmer, count(so) FILTER (WHERE so = '+') AS out_plus, count(so) FILTER (WHERE so = '-') AS out_minus FROM nodes LEFT JOIN edges ON src = kmer GROUP BY kmer)"


# A: sources and sinks


@query("a7_validation", "read_records", sql="""
WITH r AS (SELECT DISTINCT read_id, seq, qual FROM read_records)
SELECT CASE WHEN qual IS NULL THEN 'unrated' WHEN length(qual) <> length(seq) THEN 'broken' ELSE 'rated' END AS kind, count(*) AS reads, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bases FROM r GROUP BY 1""")
def a7_validation(records: DataFrame) -> DataFrame:
    once = read_source.delivered_once(records)
    kind = F.when(F.col("qual").isNull(), "unrated").when(F.length("qual") != F.length("seq"), "broken").otherwise("rated")
    return once.groupBy(kind.alias("kind")).agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))


@query("a12_read_stats", "read_records", sql=f"WITH {_READS} SELECT count(seq) AS reads, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bases, CAST(coalesce(max(length(seq)), 0) AS INTEGER) AS longest FROM reads")
def a12_read_stats(records: DataFrame) -> DataFrame:
    return read_source.statistics(reads_of(records))


@query("a12_library_stats", "read_records", sql=f"WITH {_READS} SELECT sample, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(max(length(seq)) AS INTEGER) AS longest FROM reads GROUP BY 1")
def a12_library_stats(records: DataFrame) -> DataFrame:
    return reads_of(records).groupBy("sample").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.max(F.length("seq")).alias("longest"))


@query("a13_quality_alphabet", "read_records", sql=f"""WITH {_READS}, first AS (SELECT * FROM reads WHERE qual IS NOT NULL ORDER BY read_id LIMIT 5000),
pairs AS (SELECT upper(seq[i]) AS b, greatest(ascii(qual[i]) - 33, 0) AS quality FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM first))
SELECT DISTINCT CAST(quality AS INTEGER) AS quality FROM pairs WHERE b IN ('A','C','G','T') AND quality < 64""")
def a13_quality_alphabet(records: DataFrame) -> DataFrame:
    return read_source.quality_alphabet(reads_of(records).filter("qual is not null"))


@query("a13_alphabet_rule", "read_records", sql=f"""WITH {_READS}, first AS (SELECT * FROM reads WHERE seq IS NOT NULL ORDER BY read_id LIMIT 5000),
pairs AS (SELECT upper(seq[i]) AS b, greatest(ascii(qual[i]) - 33, 0) AS quality FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM first WHERE qual IS NOT NULL))
SELECT (SELECT count(*) FILTER (WHERE qual IS NULL) FROM first) > 0 AS unrated, CASE WHEN (SELECT count(*) FILTER (WHERE qual IS NULL) FROM first) > 0 THEN 0 ELSE count(DISTINCT quality) FILTER (WHERE b IN ('A','C','G','T') AND quality < 64) END AS qualities FROM pairs""")
def a13_alphabet_rule(records: DataFrame) -> DataFrame:
    """Over all reads: one without qualities among the first leaves no alphabet."""
    reads = reads_of(records)
    first = reads.filter("seq is not null").orderBy("read_id").limit(read_source.PEEKED_READS)
    return first.agg((F.count_if(F.col("qual").isNull()) > 0).alias("unrated")).crossJoin(read_source.quality_alphabet(reads).agg(F.count("*").alias("qualities")))


_CONTIGS = "contigs_now AS (SELECT k, contig_id, upper(seq) AS seq, cov, serialized_contigs FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY written_at DESC) AS rn FROM contigs) WHERE rn = 1)"


def contigs_now(contigs: DataFrame) -> DataFrame:
    """The current version of each contig, its sequence in upper case."""
    row = F.max(F.struct("written_at", "k", F.upper("seq").alias("seq"), "cov", "serialized_contigs"))
    return contigs.groupBy("contig_id").agg(row.alias("r")).select("contig_id", "r.k", "r.seq", "r.cov", "r.serialized_contigs")


@query("a14_fasta", "contigs", sql=f"""WITH {_CONTIGS}, long AS (SELECT seq, row_number() OVER (ORDER BY length(seq) DESC, seq) - 1 AS number FROM contigs_now WHERE length(seq) >= 500)
SELECT number, '>' || number || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM long""")
def a14_fasta(contigs: DataFrame) -> DataFrame:
    return sinks.fasta_records(contigs_now(contigs), 500)


@query("a16_gfa_links", "read_records", sql=f"""WITH {_EDGES}, linked AS (SELECT src, so, dst, dor FROM edges WHERE src <> dst),
flipped AS (SELECT dst AS src, CASE dor WHEN '+' THEN '-' ELSE '+' END AS so, src AS dst, CASE so WHEN '+' THEN '-' ELSE '+' END AS dor FROM linked)
SELECT DISTINCT least('L' || chr(9) || b.src || chr(9) || b.so || chr(9) || b.dst || chr(9) || b.dor, 'L' || chr(9) || b.dst || chr(9) || CASE b.dor WHEN '+' THEN '-' ELSE '+' END || chr(9) || b.src || chr(9) || CASE b.so WHEN '+' THEN '-' ELSE '+' END) || chr(9) || '{K - 1}M' AS value FROM linked b""")
def a16_gfa_links(records: DataFrame) -> DataFrame:
    _, edges = _named_graph(records)
    line = lambda a, ao, b, bo: F.concat_ws("\t", F.lit("L"), a, ao, b, bo)
    edges = edges.filter("src <> dst")
    value = F.least(line("src", "so", "dst", "dor"), line(F.col("dst"), dna.flip("dor"), F.col("src"), dna.flip("so")))
    return edges.select(F.concat(value, F.lit(f"\t{K - 1}M")).alias("value")).distinct()


_ONE = "e AS (SELECT DISTINCT src, so, dst, dor FROM edges WHERE src <> dst), one AS (SELECT src, so FROM e GROUP BY 1, 2 HAVING count(*) = 1)"
_SPELLED = """spelled AS (SELECT head, ho, string_agg(CASE WHEN rank = 0 THEN v.s ELSE right(v.s, 1) END, '' ORDER BY rank) AS seq, count(*) AS n_kmers, CAST(sum(n.n) AS BIGINT) AS mass
  FROM walk w JOIN view v ON v.kmer = w.kmer AND v.o = w.o JOIN nodes n ON n.kmer = w.kmer GROUP BY head, ho)"""
_UNITIGS = f"""WITH RECURSIVE {_EDGES}, {_ONE},
simple AS (SELECT src, so, dst, dor FROM e SEMI JOIN one USING (src, so) WHERE EXISTS (SELECT 1 FROM one o WHERE o.src = e.dst AND o.so <> e.dor)),
walk AS (SELECT kmer AS head, o AS ho, kmer, o, 0 AS rank FROM view v WHERE NOT EXISTS (SELECT 1 FROM simple s WHERE s.dst = v.kmer AND s.dor = v.o)
  UNION ALL SELECT head, ho, s.dst, s.dor, rank + 1 FROM walk w JOIN simple s ON s.src = w.kmer AND s.so = w.o),
{_SPELLED}, unitigs AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS id, * FROM (SELECT DISTINCT least(seq, {_RC.format('seq')}) AS seq, n_kmers, mass FROM spelled)),
ends AS (SELECT id, '+' AS o, seq AS s FROM unitigs UNION ALL SELECT id, '-', {_RC.format('seq')} FROM unitigs),
links AS (SELECT a.id AS src, a.o AS so, b.id AS dst, b.o AS dor FROM ends a JOIN ends b ON right(a.s, {K - 1}) = left(b.s, {K - 1})
  WHERE least(right(a.s, {K}), {_RC.format(f'right(a.s, {K})')}) <> least(left(b.s, {K}), {_RC.format(f'left(b.s, {K})')}))"""


def _contracted(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = _nodes(records)
    nodes, edges, _ = compact.contract(nodes, graph.without_self_loops(graph.overlap_edges(nodes, K)), K)
    return nodes, edges


@query("a16_gfa_lines", "read_records", sql=f"""{_UNITIGS}
SELECT CAST(0 AS INTEGER) AS part, 'H' || chr(9) || 'VN:Z:1.1' AS value
UNION ALL SELECT 1, 'S' || chr(9) || id || chr(9) || seq || chr(9) || 'LN:i:' || length(seq) || chr(9) || 'KC:i:' || mass FROM unitigs
UNION ALL SELECT DISTINCT 2, CASE WHEN (src, so, dst, dor) <= (dst, f_dor, src, f_so) THEN 'L' || chr(9) || src || chr(9) || so || chr(9) || dst || chr(9) || dor ELSE 'L' || chr(9) || dst || chr(9) || f_dor || chr(9) || src || chr(9) || f_so END || chr(9) || '{K - 1}M'
  FROM (SELECT *, CASE so WHEN '+' THEN '-' ELSE '+' END AS f_so, CASE dor WHEN '+' THEN '-' ELSE '+' END AS f_dor FROM links)""")
def a16_gfa_lines(records: DataFrame) -> DataFrame:
    return sinks.gfa_lines(*graph.renumbered(*_contracted(records)), K)


@query("a16_gfa2_lines", "read_records", sql=f"""{_UNITIGS}
SELECT CAST(0 AS INTEGER) AS part, 'H' || chr(9) || 'VN:Z:2.0' AS value
UNION ALL SELECT 1, 'S' || chr(9) || id || chr(9) || length(seq) || chr(9) || seq FROM unitigs
UNION ALL SELECT DISTINCT 2, 'E' || chr(9) || '*' || chr(9) || src || so || chr(9) || dst || dor || chr(9) ||
  CASE WHEN so = '+' THEN (sl - {K - 1}) || chr(9) || sl || '$' ELSE '0' || chr(9) || {K - 1} END || chr(9) || CASE WHEN dor = '-' THEN (dl - {K - 1}) || chr(9) || dl || '$' ELSE '0' || chr(9) || {K - 1} END || chr(9) || '*'
  FROM (SELECT l.*, length(a.seq) AS sl, length(b.seq) AS dl FROM (SELECT CASE WHEN keep THEN src ELSE dst END AS src, CASE WHEN keep THEN so ELSE f_dor END AS so, CASE WHEN keep THEN dst ELSE src END AS dst, CASE WHEN keep THEN dor ELSE f_so END AS dor
    FROM (SELECT *, (src, so, dst, dor) <= (dst, f_dor, src, f_so) AS keep FROM (SELECT *, CASE so WHEN '+' THEN '-' ELSE '+' END AS f_so, CASE dor WHEN '+' THEN '-' ELSE '+' END AS f_dor FROM links))) l
    JOIN unitigs a ON a.id = l.src JOIN unitigs b ON b.id = l.dst)""")
def a16_gfa2_lines(records: DataFrame) -> DataFrame:
    return sinks.gfa2_lines(*graph.renumbered(*_contracted(records)), K)


@query("a16_dot_lines", "read_records", sql=f"""{_UNITIGS}
SELECT CAST(0 AS INTEGER) AS part, 'digraph {{' AS value UNION ALL SELECT 3, '}}'
UNION ALL SELECT 1, '  ' || id || ' [label="' || id || ': ' || length(seq) || ' bases, ' || n_kmers || ' k-mers seen ' || mass || ' times"]' FROM unitigs
UNION ALL SELECT 2, '  ' || src || ' -> ' || dst || ' [label="' || so || dor || '"]' FROM (SELECT DISTINCT * FROM links)""")
def a16_dot_lines(records: DataFrame) -> DataFrame:
    return sinks.dot_lines(*graph.renumbered(*_contracted(records)))


@query("a18_spectrum_rows", "read_records", sql=f"WITH {_FILLED} SELECT count, distinct_kmers AS \"distinct\" FROM filled WHERE count <= (SELECT max(count) FROM spectrum)")
def a18_spectrum_rows(records: DataFrame) -> DataFrame:
    return sinks.spectrum_rows(_spectrum(records))


# B: scalar functions


_CONTIG_WINDOWS = f"""contig_windows AS (SELECT contig_id, CAST(i - 1 AS INTEGER) AS start, substr(seq, i, {K}) AS s FROM (SELECT *, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM contigs_now) WHERE regexp_matches(substr(seq, i, {K}), '^[ACGT]{{{K}}}$'))"""


def _contig_windows(contigs: DataFrame) -> DataFrame:
    """contig_id, start and s: every window of K bases of the current contigs, as it is read there."""
    reads = contigs_now(contigs).select(F.col("contig_id").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))
    windows = kmers.kmer_windows(reads, K)
    return windows.select(F.col("read_id").alias("contig_id"), "start", F.when(F.col("forward"), F.col("kmer")).otherwise(dna.reverse_complement("kmer")).alias("s"))


@query("b_window_functions", "contigs", sql=f"""WITH {_CONTIGS}, {_CONTIG_WINDOWS}
SELECT contig_id, start, {_RC.format('s')} AS rc, least(s, {_RC.format('s')}) AS canonical, left(s, {K - 1}) AS prefix, right(s, {K - 1}) AS suffix,
  CAST((strpos('ACTG', left(s, 1)) - 1) * 4 + strpos('ACTG', right(s, 1)) - 1 AS INTEGER) AS ends,
  CAST(list_sum(list_transform(generate_series(1, {K}), lambda i: CAST(strpos('ACTG', s[i]) - 1 AS BIGINT) << (2 * ({K} - i)))) AS BIGINT) AS packed, s AS unpacked,
  CAST(strpos('ACTG', s[5]) - 1 AS INTEGER) AS fifth FROM contig_windows""")
def b_window_functions(contigs: DataFrame) -> DataFrame:
    word = dna.packed("s")
    return _contig_windows(contigs).select("contig_id", "start", dna.reverse_complement("s").alias("rc"), dna.canonical("s").alias("canonical"), dna.prefix("s", K).alias("prefix"), dna.suffix("s", K).alias("suffix"), dna.endpoint_byte("s").cast("int").alias("ends"), word.alias("packed"), dna.unpacked(word, K).alias("unpacked"), dna.packed_base(word, 4, K).cast("int").alias("fifth"))


@query("b7_base_qualities", "read_records", sql=f"""WITH {_READS}, pairs AS (SELECT upper(seq[i]) AS b, greatest(ascii(qual[i]) - 33, 0) AS quality FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM reads WHERE qual IS NOT NULL))
SELECT b AS base, CAST(quality AS INTEGER) AS quality, count(*) AS bases FROM pairs GROUP BY 1, 2""")
def b7_base_qualities(records: DataFrame) -> DataFrame:
    rated = reads_of(records).filter("qual is not null and length(seq) > 0")
    pairs = rated.select(F.inline(F.arrays_zip(F.split(F.upper("seq"), ""), F.split("qual", "")))).toDF("base", "q")
    return pairs.groupBy("base", dna.phred("q").alias("quality")).agg(F.count("*").alias("bases"))


# C: windows, floors, filters


@query("c1_windows", "read_records", sql=f"WITH {_WINDOWS} SELECT read_id, CAST(start AS INTEGER) AS start, kmer, forward, CAST(grp AS INTEGER) AS grp FROM windows")
def c1_windows(records: DataFrame) -> DataFrame:
    return kmers.kmer_windows(reads_of(records), K, FLOORS)


@query("c1_runs", "read_records", sql=f"WITH {_MASKED}, runs AS (SELECT read_id, list_filter(regexp_extract_all(m0, '[ACGT]+'), lambda r: length(r) >= {K}) AS r FROM masked) SELECT read_id, CAST(i - 1 AS INTEGER) AS run_no, r[i] AS run FROM (SELECT *, unnest(generate_series(1, len(r))) AS i FROM runs)")
def c1_runs(records: DataFrame) -> DataFrame:
    return kmers.usable_runs(reads_of(records), K)


@query("c2_masked_reads", "read_records", sql=f"WITH {_MASKED} " + " UNION ALL ".join(f"SELECT read_id, {f} AS floor, m{i} AS seq FROM masked" for i, f in enumerate(FLOORS)))
def c2_masked_reads(records: DataFrame) -> DataFrame:
    return kmers.masked_reads(reads_of(records), FLOORS)


@query("c5_window_groups", "read_records", sql=f"WITH {_WINDOWS} SELECT CAST(grp AS INTEGER) AS grp, count(*) AS windows, count(DISTINCT read_id) AS reads FROM windows GROUP BY 1")
def c5_window_groups(records: DataFrame) -> DataFrame:
    return kmers.window_groups(reads_of(records), K, FLOORS)


@query("c8_floor_presence", "read_records", sql=f"WITH {_WINDOWS}, m AS (SELECT coalesce(max(grp), -1) AS m FROM windows) " + " UNION ALL ".join(f"SELECT {f} AS floor, m >= {i} AS has_kmers FROM m" for i, f in enumerate(FLOORS)))
def c8_floor_presence(records: DataFrame) -> DataFrame:
    return kmers.floor_presence(kmers.window_groups(reads_of(records), K, FLOORS), FLOORS)


@query("c9_floor_ladder", "read_records", sql=f"""WITH {_READS}, first AS (SELECT * FROM reads WHERE qual IS NOT NULL ORDER BY read_id LIMIT 5000),
pairs AS (SELECT upper(seq[i]) AS b, greatest(ascii(qual[i]) - 33, 0) AS quality FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM first)),
alphabet AS (SELECT DISTINCT quality FROM pairs WHERE b IN ('A','C','G','T') AND quality < 64),
facts AS (SELECT count(*) AS n, min(quality) AS lowest, coalesce(min(quality) FILTER (WHERE quality >= 20), 20) AS strict FROM alphabet),
more AS (SELECT *, (SELECT max(quality) FROM alphabet WHERE quality > 10 AND quality <= strict - 5) AS loose FROM facts),
ladder AS (SELECT CASE WHEN n <= 1 OR lowest >= strict THEN [0] WHEN loose IS NOT NULL AND lowest < loose THEN [0, loose, strict] ELSE [0, strict] END AS f FROM more)
SELECT CAST(i - 1 AS INTEGER) AS position, CAST(f[i] AS INTEGER) AS floor FROM (SELECT f, unnest(generate_series(1, len(f))) AS i FROM ladder)""")
def c9_floor_ladder(records: DataFrame) -> DataFrame:
    alphabet = [r[0] for r in read_source.quality_alphabet(reads_of(records).filter("qual is not null")).collect()]
    return records.sparkSession.createDataFrame([(i, f) for i, f in enumerate(selection.effective_floors(alphabet))], "position int, floor int")


@query("c11_at_least", "read_records", sql=f"WITH {_COUNTS} SELECT kmer, n FROM counts WHERE n >= {MIN_COUNT}")
def c11_at_least(records: DataFrame) -> DataFrame:
    return counting.at_least(_counts(records), MIN_COUNT).select("kmer", "n")


@query("c12_without_weak_nodes", "read_records", sql=f"WITH {_EDGES} SELECT src, so, dst, dor FROM edges WHERE src IN (SELECT kmer FROM nodes WHERE n >= 6) AND dst IN (SELECT kmer FROM nodes WHERE n >= 6)")
def c12_without_weak_nodes(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    _, edges = graph.without_weak(nodes, graph.overlap_edges(nodes, K), 6)
    return _named(nodes, edges)


@query("c13_long_contigs", "contigs", sql=f"WITH {_CONTIGS} SELECT contig_id, CAST(length(seq) AS INTEGER) AS len FROM contigs_now WHERE length(seq) >= 500")
def c13_long_contigs(contigs: DataFrame) -> DataFrame:
    return contigs_now(contigs).select("contig_id", F.length("seq").alias("len")).filter("len >= 500")


# D: aggregations


def _counts(records: DataFrame) -> DataFrame:
    return counting.count_kmers(reads_of(records), K, FLOORS)


def _spectrum(records: DataFrame) -> DataFrame:
    return counting.histogram(_counts(records))


@query("d1_kmer_counts", "read_records", sql=f"WITH {_COUNTS} SELECT kmer, n FROM counts")
def d1_kmer_counts(records: DataFrame) -> DataFrame:
    return counting.count_kmers(reads_of(records), K).select("kmer", "n")


@query("d1_long_kmer_counts", "read_records", sql=f"""WITH {_MASKED}, cut AS (SELECT substr(m0, i, 41) AS w FROM (SELECT *, unnest(generate_series(1, length(seq) - 40)) AS i FROM masked) WHERE strpos(substr(m0, i, 41), 'N') = 0)
SELECT least(w, {_RC.format('w')}) AS kmer, count(*) AS n FROM cut GROUP BY 1""")
def d1_long_kmer_counts(records: DataFrame) -> DataFrame:
    return counting.count_kmers(reads_of(records), 41).select("kmer", "n")


@query("d2_gated_counts", "read_records", sql=f"WITH {_COUNTS} SELECT kmer, n FROM counts WHERE n >= 2")
def d2_gated_counts(records: DataFrame) -> DataFrame:
    return counting.gated_counts(_counts(records)).select("kmer", "n")


@query("d3_filter_occupancy", "bloom_bits", sql="""
WITH b AS (SELECT DISTINCT bloom_id, buffer FROM bloom_bits)
SELECT bloom_id, CAST(coalesce(list_sum(list_transform(buffer, lambda w: bit_count(w))), 0) AS BIGINT) AS set_bits, CAST(coalesce(len(buffer), 0) * 64 AS BIGINT) AS all_bits,
  coalesce(list_sum(list_transform(buffer, lambda w: bit_count(w))), 0) * 4 > coalesce(len(buffer), 0) * 64 AS warn FROM b""")
def d3_filter_occupancy(filters: DataFrame) -> DataFrame:
    once = filters.groupBy("bloom_id").agg(F.max("buffer").alias("buffer"))
    return counting.occupancy(once).select("bloom_id", "set_bits", "all_bits", "warn")


@query("d4_floor_counts", "read_records", sql=f"WITH {_COUNTS} SELECT kmer, n_f0, n_f1, n_f2 FROM counts")
def d4_floor_counts(records: DataFrame) -> DataFrame:
    return _counts(records).select("kmer", "n_f0", "n_f1", "n_f2")


@query("d5_d8_sample_check", "read_records", sql=f"""WITH {_COUNTS}, size AS (SELECT count(*) AS n FROM counts),
halvings AS (SELECT min(h) AS h FROM size, (SELECT unnest(generate_series(0, 12)) AS h) WHERE (n >> h) <= 20000 OR h = 12)
SELECT n AS "table", 1.0 / (1 << h) AS fraction, true AS unbiased FROM size, halvings""")
def d5_d8_sample_check(records: DataFrame) -> DataFrame:
    """The hash sample against its table; which k-mers it holds depends on a hash the reference SQL has no counterpart of."""
    counts = _counts(records)
    return counting.sample_check(counts, counting.sample_threshold(counts.count(), most=20_000)).select("table", "fraction", "unbiased")


@query("d9_spectrum", "read_records", sql=f"WITH {_SPECTRUM} SELECT count, distinct_kmers AS \"distinct\" FROM spectrum")
def d9_spectrum(records: DataFrame) -> DataFrame:
    return _spectrum(records)


@query("d9_floor_spectra", "read_records", sql=f"WITH {_COUNTS} " + " UNION ALL ".join(f"SELECT {f} AS floor, CAST(least(n_f{i}, 8000) AS INTEGER) AS count, count(*) AS \"distinct\" FROM counts WHERE n_f{i} > 0 GROUP BY 2" for i, f in enumerate(FLOORS)))
def d9_floor_spectra(records: DataFrame) -> DataFrame:
    return counting.floor_histograms(_counts(records), FLOORS)


@query("d10_occurrence_median", "read_records", sql=f"WITH {_SPECTRUM} SELECT min(count) AS median FROM (SELECT count, sum(count * distinct_kmers) OVER (ORDER BY count) AS upto, sum(count * distinct_kmers) OVER () AS whole FROM spectrum) WHERE upto * 2 >= whole")
def d10_occurrence_median(records: DataFrame) -> DataFrame:
    return spectrum.occurrence_median(_spectrum(records))


@query("d11_d13_tail_sums", "read_records", sql=f"WITH {_SPECTRUM} SELECT CAST(sum(distinct_kmers) FILTER (WHERE count >= {VALLEY}) AS BIGINT) AS distinct_above, round(sum(count * distinct_kmers) FILTER (WHERE count >= {VALLEY}) / sum(count * distinct_kmers)::DOUBLE, 9) AS instance_share FROM spectrum")
def d11_d13_tail_sums(records: DataFrame) -> DataFrame:
    return spectrum.tail_sums(_spectrum(records), VALLEY).withColumn("instance_share", F.round("instance_share", 9))


@query("d12_mirrored_area", "read_records", sql=f"WITH {_SPECTRUM} SELECT round(coalesce(sum(distinct_kmers) FILTER (WHERE count BETWEEN {VALLEY} AND {2 * PEAK - VALLEY}), 0) / (sum(distinct_kmers) FILTER (WHERE count >= 2))::DOUBLE, 9) AS area FROM spectrum")
def d12_mirrored_area(records: DataFrame) -> DataFrame:
    return spectrum.mirrored_area(_spectrum(records), VALLEY, PEAK).select(F.round("area", 9).alias("area"))


@query("d14_loss_guard", "read_records", sql=f"""WITH {_FILLED}, o AS (SELECT count, coalesce(sum(distinct_kmers) OVER (ORDER BY count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost, sum(distinct_kmers) OVER () AS whole FROM filled WHERE count >= {VALLEY} AND count < 8000)
SELECT CAST(greatest(coalesce(max(count), 2), 2) AS INTEGER) AS guard FROM o WHERE count <= {PEAK} AND lost <= whole * 0.01""")
def d14_loss_guard(records: DataFrame) -> DataFrame:
    return spectrum.loss_guard(_spectrum(records), VALLEY, PEAK).select(F.col("guard").cast("int").alias("guard"))


@query("d16_lobe_dispersion", "read_records", sql=f"""WITH {_SPECTRUM}, m AS (SELECT sum(distinct_kmers)::DOUBLE AS n, sum(count * distinct_kmers)::DOUBLE AS s, sum(count * count * distinct_kmers)::DOUBLE AS q FROM spectrum WHERE count >= {VALLEY} AND count < {2 * PEAK})
SELECT round((q / n - (s / n) * (s / n)) / (s / n), 6) AS dispersion FROM m""")
def d16_lobe_dispersion(records: DataFrame) -> DataFrame:
    return spectrum.dispersion(_spectrum(records), VALLEY, PEAK).select(F.round("dispersion", 6).alias("dispersion"))


@query("d17_aun", "contigs", sql=f"WITH {_CONTIGS} SELECT k, round(sum(length(seq)::DOUBLE * length(seq)) / sum(length(seq)), 6) AS aun FROM contigs_now WHERE length(seq) >= 100 GROUP BY k")
def d17_aun(contigs: DataFrame) -> DataFrame:
    size = F.length("seq")
    return contigs_now(contigs).filter(size >= 100).groupBy("k").agg(F.round(F.sum(size.cast("double") * size) / F.sum(size), 6).alias("aun"))


@query("d18_path_coverage", "contigs", sql=f"""WITH {_CONTIGS}, n AS (SELECT contig_id, unnest(serialized_contigs) AS node FROM contigs_now)
SELECT contig_id, round(sum(node.counts::DOUBLE * len(node.abs_ind)) / sum(len(node.abs_ind)), 6) AS coverage, CAST(sum(len(node.abs_ind)) AS BIGINT) AS kmers FROM n WHERE len(node.abs_ind) > 0 AND node.counts IS NOT NULL GROUP BY 1""")
def d18_path_coverage(contigs: DataFrame) -> DataFrame:
    node = contigs_now(contigs).select("contig_id", F.inline("serialized_contigs")).filter("size(abs_ind) > 0 and counts is not null")
    n = F.size("abs_ind")
    return node.groupBy("contig_id").agg(F.round(F.sum(F.col("counts").cast("double") * n) / F.sum(n), 6).alias("coverage"), F.sum(n).alias("kmers"))


@query("d20_neighbour_means", "read_records", sql=f"""WITH {_EDGES}, near AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)
SELECT src AS kmer, round(avg(n), 6) AS mean FROM near JOIN nodes ON kmer = dst GROUP BY src""")
def d20_neighbour_means(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    edges = graph.overlap_edges(nodes, K)
    means = graph.neighbourhood_means(nodes, edges, nodes.select("nid", F.col("nid").alias("but")))
    return means.join(nodes, "nid").select(F.col("seq").alias("kmer"), F.round("mean", 6).alias("mean"))


_CARRIED = f"""carried AS (SELECT DISTINCT least(w, {_RC.format('w')}) AS kmer FROM (SELECT substr(s, i, {K}) AS w FROM (SELECT s, unnest(generate_series(1, length(s) - {K - 1})) AS i FROM (SELECT regexp_replace(seq, '[^ACGT]', 'N', 'g') AS s FROM contigs_now))) WHERE strpos(w, 'N') = 0)"""


@query("d24_carry", "read_records", "contigs", sql=f"""WITH {_COUNTS}, {_CONTIGS}, {_CARRIED}
SELECT coalesce(c.kmer, r.kmer) AS kmer, greatest(coalesce(n, 0), CASE WHEN r.kmer IS NOT NULL THEN 5 ELSE 0 END) AS n, n IS NULL AS is_new FROM counts c FULL JOIN carried r ON c.kmer = r.kmer""")
def d24_carry(records: DataFrame, contigs: DataFrame) -> DataFrame:
    return counting.carry(_counts(records), contigs_now(contigs).select("seq"), K, 5)


@query("d25_components", "read_records", sql=f"""{_UNITIGS}, reach AS (SELECT id AS a, id AS b FROM unitigs UNION SELECT r.a, l.dst FROM reach r JOIN links l ON l.src = r.b),
labels AS (SELECT b AS id, min(a) AS component FROM reach GROUP BY b), sizes AS (SELECT component, sum(n_kmers) AS n FROM labels JOIN unitigs USING (id) GROUP BY component)
SELECT count(*) AS components, count(*) FILTER (WHERE n = 1) AS alone, CAST(max(n) AS BIGINT) AS largest FROM sizes""")
def d25_components(records: DataFrame) -> DataFrame:
    """Contracted first, so that components are found over paths and not over k-mers."""
    nodes, edges = _contracted(records)
    labels = graph.components(nodes, edges).join(nodes, "nid").groupBy("component").agg(F.sum("n_kmers").alias("n"))
    return labels.agg(F.count("*").alias("components"), F.count_if(F.col("n") == 1).alias("alone"), F.max("n").alias("largest"))


@query("d26_graph_totals", "read_records", sql=f"WITH {_DEGREES} SELECT count(*) AS kmers, count(*) FILTER (WHERE out_plus = 0 AND out_minus = 0) AS alone, CAST(sum(out_plus + out_minus) AS BIGINT) AS edge_refs FROM degrees")
def d26_graph_totals(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    return graph.totals(nodes, graph.overlap_edges(nodes, K))


@query("d27_run_totals", "contigs", sql=f"WITH {_CONTIGS} SELECT k, count(*) AS contigs, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bases FROM contigs_now GROUP BY k")
def d27_run_totals(contigs: DataFrame) -> DataFrame:
    return contigs_now(contigs).groupBy("k").agg(F.count("*").alias("contigs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))


# E to G: spectrum, fit, selection


@query("e1_smoothed", "read_records", sql=f"""WITH {_FILLED} SELECT CAST(count AS INTEGER) AS count, CAST(floor(sum(distinct_kmers) OVER w / count(*) OVER w) AS BIGINT) AS smooth FROM filled WHERE count < 8000 WINDOW w AS (ORDER BY count ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def e1_smoothed(records: DataFrame) -> DataFrame:
    return spectrum.smoothed(_spectrum(records))


@query("e3_highest_bin", "read_records", sql=f"WITH {_SPECTRUM} SELECT count AS peak FROM spectrum WHERE count >= {VALLEY} AND count < 8000 ORDER BY distinct_kmers DESC, count LIMIT 1")
def e3_highest_bin(records: DataFrame) -> DataFrame:
    return spectrum.highest_bin(_spectrum(records), VALLEY)


@query("e4_lowest_bin", "read_records", sql=f"WITH {_FILLED} SELECT CAST(count AS INTEGER) AS valley FROM filled WHERE count BETWEEN 2 AND {PEAK} ORDER BY distinct_kmers, count LIMIT 1")
def e4_lowest_bin(records: DataFrame) -> DataFrame:
    return spectrum.lowest_bin(_spectrum(records), 2, PEAK)


@query("e7_local_valleys", "read_records", sql=f"WITH {_FILLED} SELECT CAST(count AS INTEGER) AS count, distinct_kmers AS \"distinct\" FROM (SELECT *, lag(distinct_kmers) OVER (ORDER BY count) AS b, lead(distinct_kmers) OVER (ORDER BY count) AS a FROM filled) WHERE count >= 2 AND count < 7999 AND distinct_kmers < a AND distinct_kmers < b")
def e7_local_valleys(records: DataFrame) -> DataFrame:
    return spectrum.local_valleys(_spectrum(records))


@query("e9_pair_sums", "read_records", sql=f"WITH {_FILLED} SELECT CAST(count AS INTEGER) AS count, pair FROM (SELECT count, distinct_kmers + lead(distinct_kmers) OVER (ORDER BY count) AS pair FROM filled) WHERE pair > 0")
def e9_pair_sums(records: DataFrame) -> DataFrame:
    return spectrum.pair_sums(_spectrum(records))


_RUNS = "runs AS (SELECT sample, k, used_min_count, genomic_peak, histovec FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY run_at DESC) AS rn FROM preprocessed_k) WHERE rn = 1)"
_PAIRS = f"""{_RUNS}, names AS (SELECT sample, unnest(generate_series(1, 8000)) AS c FROM runs),
given AS (SELECT sample, c, coalesce(histovec[c], 0)::BIGINT AS n FROM (SELECT sample, histovec, unnest(generate_series(1, len(histovec))) AS c FROM runs) WHERE c <= 8000),
bins AS (SELECT x.sample, x.c, coalesce(n, 0) AS n FROM names x LEFT JOIN given g ON g.sample = x.sample AND g.c = x.c),
occupied AS (SELECT sample, c, n, min(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lead(n, 1) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(n, 3) OVER w AS n3
  FROM bins WHERE c BETWEEN 2 AND 7999 AND n > 0 WINDOW w AS (PARTITION BY sample ORDER BY c)),
seeds AS (SELECT sample, min(c) AS seed FROM occupied WHERE (before IS NULL OR n < before) AND n1 >= n AND n2 >= n AND n3 >= n GROUP BY sample),
raw_peaks AS (SELECT sample, c AS rp FROM (SELECT b.sample, c, row_number() OVER (PARTITION BY b.sample ORDER BY n DESC, c) AS rn FROM bins b JOIN seeds s ON s.sample = b.sample AND c BETWEEN seed AND 7999 WHERE n > 0) WHERE rn = 1),
raw AS (SELECT sample, c AS rv, rp FROM (SELECT b.sample, c, rp, row_number() OVER (PARTITION BY b.sample ORDER BY n, c) AS rn FROM bins b JOIN raw_peaks p ON p.sample = b.sample AND c BETWEEN 2 AND rp) WHERE rn = 1 AND c < rp),
smooth AS (SELECT sample, c, n, CAST(floor(sum(n) OVER w / count(*) OVER w) AS BIGINT) AS s FROM bins WHERE c < 8000 WINDOW w AS (PARTITION BY sample ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
fine_valleys AS (SELECT sample, c AS sv FROM (SELECT b.sample, c, row_number() OVER (PARTITION BY b.sample ORDER BY s, abs(c - rv), c) AS rn FROM smooth b JOIN raw r ON r.sample = b.sample AND c BETWEEN 2 AND rp) WHERE rn = 1),
fine_peaks AS (SELECT sample, c AS sp FROM (SELECT b.sample, c, row_number() OVER (PARTITION BY b.sample ORDER BY s DESC, abs(c - rp), c) AS rn FROM smooth b JOIN raw r ON r.sample = b.sample JOIN fine_valleys v ON v.sample = b.sample
  WHERE n > 0 AND c >= greatest(rv, sv + 1) AND c <= 13 * rp // 10) WHERE rn = 1),
primary_pairs AS (SELECT sample, 0 AS rank, CASE WHEN low OR sp IS NULL THEN rv ELSE sv END AS valley, CASE WHEN low OR sp IS NULL THEN rp ELSE sp END AS peak
  FROM (SELECT r.*, rp < 15 AND rv < 15 AND rp - rv < 10 AS low, sv, sp FROM raw r LEFT JOIN fine_valleys v ON v.sample = r.sample LEFT JOIN fine_peaks p ON p.sample = r.sample)),
local_valleys AS (SELECT sample, min(c) AS lv FROM (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM bins WINDOW w AS (PARTITION BY sample ORDER BY c)) WHERE c BETWEEN 2 AND 7998 AND n < a AND n < b GROUP BY sample),
local_peaks AS (SELECT sample, lv, c AS lp FROM (SELECT b.sample, lv, c, row_number() OVER (PARTITION BY b.sample ORDER BY n DESC, c) AS rn FROM bins b JOIN local_valleys v ON v.sample = b.sample AND c > lv AND c <= 7999) WHERE rn = 1),
tails AS (SELECT l.sample, lv, lp, sum(n) FILTER (WHERE c IN (lp, lp + 1)) AS t1, sum(n) FILTER (WHERE c IN (lp + 1, lp + 2)) AS t2, sum(n) FILTER (WHERE c IN (lp + 2, lp + 3)) AS t3 FROM local_peaks l JOIN bins b ON b.sample = l.sample GROUP BY ALL),
pairs AS (SELECT * FROM primary_pairs UNION ALL SELECT sample, 1, lv, lp FROM tails WHERE lp + 3 <= 7999 AND t1 > t2 AND t2 > t3),
facts AS (SELECT p.sample, rank, valley, peak, sum(n) FILTER (WHERE c BETWEEN valley AND 2 * peak - valley) / nullif(sum(n) FILTER (WHERE c >= 2), 0)::DOUBLE AS area,
  sum(c * n) FILTER (WHERE c >= valley) / nullif(sum(c * n), 0)::DOUBLE AS above, max(n) FILTER (WHERE c = peak) AS high, max(n) FILTER (WHERE c = valley) AS low, sum(n) FILTER (WHERE c BETWEEN valley AND 7999) AS lobe
  FROM pairs p JOIN bins b ON b.sample = p.sample GROUP BY ALL),
accepted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY rank) AS rn FROM facts WHERE valley >= 2 AND peak > valley AND 2 * peak - valley <= 7999 AND area >= 0.05 AND above >= 0.20 AND high >= 1.75 * greatest(low, 1)) WHERE rn = 1),
measured AS (SELECT a.sample, max(m) AS guard FROM (SELECT a.sample, b.c AS m, valley, peak, lobe, sum(n) OVER (PARTITION BY a.sample ORDER BY b.c) - n AS lost FROM accepted a JOIN bins b ON b.sample = a.sample AND b.c BETWEEN valley AND peak) a WHERE lost <= floor(lobe * 0.01) GROUP BY a.sample),
poisson AS (SELECT sample, max(m) AS guard FROM (SELECT sample, x + 1 AS m, sum(exp(x * ln(peak) - peak - lgamma(x + 1))) OVER (PARTITION BY sample ORDER BY x) AS below FROM (SELECT sample, peak, unnest(generate_series(0, peak - 1)) AS x FROM accepted)) WHERE below <= 0.01 GROUP BY sample)"""


@query("e11_library_estimates", "preprocessed_k", sql=f"""WITH {_PAIRS},
medians AS (SELECT sample, min(c) AS median FROM (SELECT sample, c, sum(c * n) OVER (PARTITION BY sample ORDER BY c) AS upto, sum(c * n) OVER (PARTITION BY sample) AS whole FROM bins) WHERE whole > 0 AND 2 * upto >= whole GROUP BY sample)
SELECT r.sample, r.k, CAST(a.valley AS INTEGER) AS valley, CAST(coalesce(a.peak, median) AS INTEGER) AS peak, CASE WHEN a.sample IS NOT NULL THEN 'Fitted' WHEN median IS NOT NULL THEN 'Fallback' ELSE 'Unknown' END AS peak_source, a.sample IS NOT NULL AS resolved,
  CAST(CASE WHEN a.sample IS NULL THEN 2 ELSE greatest(2, least(valley, greatest(2, least(coalesce(m.guard, 2), coalesce(p.guard, 2))))) END AS INTEGER) AS min_count
FROM runs r LEFT JOIN accepted a ON a.sample = r.sample LEFT JOIN measured m ON m.sample = r.sample LEFT JOIN poisson p ON p.sample = r.sample LEFT JOIN medians d ON d.sample = r.sample""")
def e11_library_estimates(preprocessed: DataFrame) -> DataFrame:
    return libraries.library_estimates(preprocessed)


@query("e13_library_medians", "preprocessed_k", sql="""
WITH runs AS (SELECT sample, histovec FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY run_at DESC) AS rn FROM preprocessed_k) WHERE rn = 1),
bins AS (SELECT sample, i AS count, coalesce(histovec[i], 0)::BIGINT AS n FROM (SELECT *, unnest(generate_series(1, len(histovec))) AS i FROM runs)),
mass AS (SELECT sample, count, sum(count * n) OVER (PARTITION BY sample ORDER BY count) AS upto, sum(count * n) OVER (PARTITION BY sample) AS whole FROM bins)
SELECT sample, CAST(min(count) AS INTEGER) AS median FROM mass WHERE whole > 0 AND upto * 2 >= whole GROUP BY sample""")
def e13_library_medians(preprocessed: DataFrame) -> DataFrame:
    bins = libraries.latest_runs(preprocessed).select("sample", F.posexplode("histovec").alias("i", "n")).filter("n > 0")
    mass = ((F.col("i") + 1).cast("long") * F.col("n")).alias("mass")
    by_library = Window.partitionBy("sample")
    running = bins.select("sample", "i", mass).select("sample", "i", F.sum("mass").over(by_library.orderBy("i")).alias("upto"), F.sum("mass").over(by_library).alias("whole"))
    return running.filter("upto * 2 >= whole").groupBy("sample").agg((F.min("i") + 1).alias("median"))


_DENSITY = "exp(lgamma(c + {mean} / 5.0) - lgamma(c + 1) - lgamma({mean} / 5.0) - {mean} / 5.0 * ln(6.0) + c * ln(5.0 / 6.0))"


@query("e14_e15_library_cutoffs", "preprocessed_k", sql=f"""WITH {_RUNS}, sized AS (SELECT sample, genomic_peak AS peak, coalesce(used_min_count, 2) AS given, genomic_peak + 5.0 AS mean, least(6 * genomic_peak, 7999) AS last,
  list_sum(list_transform(list_slice(histovec, 1, least(6 * genomic_peak, 7999)), lambda x: coalesce(x, 0)))::DOUBLE AS seen FROM runs WHERE genomic_peak >= 2),
grid AS (SELECT *, unnest(generate_series(0, last)) AS c FROM sized WHERE seen > 0),
dense AS (SELECT *, {_DENSITY.format(mean='mean')} AS single, CASE WHEN c = 1 THEN 0.85 WHEN c > 1 THEN 0.15 * (pow(c - 1, -2.0) - pow(c, -2.0)) END AS error FROM grid),
scaled AS (SELECT *, sum(single) FILTER (WHERE c >= 1) OVER w AS single_mass, sum(error) FILTER (WHERE c >= 1) OVER w AS error_mass FROM dense WINDOW w AS (PARTITION BY sample)),
heights AS (SELECT *, seen * 0.19 * single / single_mass AS sh, seen * 0.8 * error / error_mass AS eh, seen * 0.19 / single_mass * sum(single) OVER (PARTITION BY sample ORDER BY c) AS lost FROM scaled),
marks AS (SELECT sample, given, least(CAST(floor(mean + 0.5) AS BIGINT), last) AS ceiling, max(sh) FILTER (WHERE c = peak) AS mode_height FROM heights GROUP BY sample, given, mean, last),
cuts AS (SELECT h.sample, m.given, greatest(min(c) FILTER (WHERE c BETWEEN 1 AND ceiling - 1 AND lost > 1), 2) AS hole, greatest(coalesce(max(c) FILTER (WHERE c >= 1 AND eh >= mode_height), 0) + 1, 2) AS floor,
  greatest(min(c) FILTER (WHERE c BETWEEN 1 AND ceiling - 1 AND sh > eh), 2) AS crossover, min(c) FILTER (WHERE c BETWEEN 1 AND ceiling - 1 AND lost > 1) IS NULL AS no_hole, min(c) FILTER (WHERE c BETWEEN 1 AND ceiling - 1 AND sh > eh) IS NULL AS no_cross
  FROM heights h JOIN marks m ON m.sample = h.sample GROUP BY h.sample, m.given)
SELECT sample, CAST(CASE WHEN no_hole THEN NULL ELSE hole END AS INTEGER) AS hole_cutoff, CAST(floor AS INTEGER) AS error_floor, CAST(CASE WHEN no_cross THEN NULL ELSE crossover END AS INTEGER) AS crossover,
  CAST(greatest(CASE WHEN no_hole THEN given ELSE least(given, hole) END, floor) AS INTEGER) AS guarded FROM cuts""")
def e14_e15_library_cutoffs(preprocessed: DataFrame) -> DataFrame:
    """The cutoffs of one model at every library's peak: 80 % errors with a power-law tail, 19 % single copies of dispersion 6, 1 % repeats."""
    return libraries.library_cutoffs(preprocessed)


@query("f1_mixture_fit", "read_records")
def f1_mixture_fit(records: DataFrame) -> DataFrame:
    """Every converged fit of the reads' spectrum with its verdict; no row if no valley and peak separate."""
    h = counting.dense(_spectrum(records))
    found = estimator.estimate(h)
    rows = []
    if found.resolved:
        best, tried = mixture.fit_spectrum(h, found.valley, found.peak, found.dispersion, spark=records.sparkSession)
        rows = [(*f.configuration.name, *(float(w) for w in f.weights), float(f.mean), f.mode, float(f.dispersion), f.bic, f.deviance, why or None, f is best) for f, why in tried]
    return records.sparkSession.createDataFrame(rows, "error_model string, genome_model string, w_error double, w_single double, w_repeat double, mean double, mode int, dispersion double, bic double, deviance double, rejection string, chosen boolean")


@query("g9_choice", "read_records")
def g9_choice(records: DataFrame) -> DataFrame:
    counts = _counts(records)
    choice = selection.choose(counting.floor_spectra(counts, FLOORS), fitter=mixture.fitter(records.sparkSession))
    return records.sparkSession.createDataFrame([(choice.floor, choice.min_count, choice.peak, choice.source, choice.unresolved)], "floor int, min_count int, peak int, source string, unresolved boolean")


@query("g10_floor_totals", "read_records", sql=f"""WITH {_COUNTS}, """ + " UNION ALL ".join(["""spectra AS (SELECT 0 AS floor, n_f0 AS n FROM counts""", "SELECT 11, n_f1 FROM counts", "SELECT 25, n_f2 FROM counts)"]) + """
SELECT CAST(floor AS INTEGER) AS floor, count(*) AS kmers, CAST(sum(n) AS BIGINT) AS windows FROM spectra WHERE n > 0 GROUP BY floor""")
def g10_floor_totals(records: DataFrame) -> DataFrame:
    """What every floor leaves; `selection.floor_report` fits each of these spectra."""
    return counting.floor_totals(_counts(records), FLOORS)


# H: graph


def _nodes(records: DataFrame) -> DataFrame:
    return graph.nodes_of(counting.at_least(_counts(records), MIN_COUNT))


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by k-mers instead of ids."""
    a, b = nodes.select(F.col("nid").alias("src"), F.col("seq").alias("s")), nodes.select(F.col("nid").alias("dst"), F.col("seq").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), "so", F.col("d").alias("dst"), F.col("do").alias("dor"))


def _named_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = _nodes(records)
    return nodes, _named(nodes, graph.overlap_edges(nodes, K))


@query("h1_oriented_view", "read_records", sql=f"WITH {_NODES} SELECT kmer, o AS orient, s AS read FROM view")
def h1_oriented_view(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    return graph.oriented_view(nodes).join(nodes.select("nid", F.col("seq").alias("kmer")), "nid").select("kmer", "orient", "read")


@query("h3_edges", "read_records", sql=f"WITH {_EDGES} SELECT src, so, dst, dor FROM edges")
def h3_edges(records: DataFrame) -> DataFrame:
    return _named_graph(records)[1]


@query("h4_window_lookup", "read_records", "contigs", sql=f"""WITH {_NODES}, {_CONTIGS}, {_CONTIG_WINDOWS}, q AS (SELECT DISTINCT s AS kmer FROM contig_windows)
SELECT q.kmer, v.o AS orient, CAST(n.n AS DOUBLE) AS cov FROM q JOIN view v ON v.s = q.kmer JOIN nodes n ON n.kmer = v.kmer""")
def h4_window_lookup(records: DataFrame, contigs: DataFrame) -> DataFrame:
    return graph.lookup(_nodes(records), _contig_windows(contigs).select(F.col("s").alias("kmer")).distinct()).select("kmer", "orient", "cov")


@query("h6_h7_paired_edges", "read_records", sql=f"""WITH {_EDGES}, e AS (SELECT DISTINCT src, so, dst, dor FROM edges WHERE src <> dst)
SELECT a.* FROM e a SEMI JOIN e b ON b.src = a.dst AND b.dst = a.src AND b.so <> a.dor AND b.dor <> a.so""")
def h6_h7_paired_edges(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    return _named(nodes, graph.paired(graph.without_self_loops(graph.overlap_edges(nodes, K))))


@query("h5_degrees", "read_records", sql=f"WITH {_DEGREES} SELECT kmer, out_plus, out_minus FROM degrees")
def h5_degrees(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    return graph.degrees(nodes, graph.overlap_edges(nodes, K)).join(nodes, "nid").select(F.col("seq").alias("kmer"), "out_plus", "out_minus")


@query("h9_externals", "read_records", sql=f"WITH {_DEGREES} SELECT kmer, CASE WHEN out_plus > 0 THEN '+' ELSE '-' END AS orient, greatest(out_plus, out_minus) AS exits FROM degrees WHERE (out_plus = 0) <> (out_minus = 0)")
def h9_externals(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    return graph.externals(nodes, graph.overlap_edges(nodes, K)).join(nodes, "nid").select(F.col("seq").alias("kmer"), "orient", "exits")


@query("h8_unitigs", "read_records", sql=f"{_UNITIGS} SELECT seq, n_kmers, round(mass / n_kmers::DOUBLE, 6) AS cov FROM unitigs")
def h8_unitigs(records: DataFrame) -> DataFrame:
    return _contracted(records)[0].select(F.least("seq", dna.reverse_complement("seq")).alias("seq"), "n_kmers", F.round("cov", 6).alias("cov"))


@query("h8_simple_edges", "read_records", sql=f"""WITH {_EDGES}, e AS (SELECT * FROM edges WHERE src <> dst),
one AS (SELECT src, so FROM e GROUP BY 1, 2 HAVING count(*) = 1)
SELECT src, so, dst, dor FROM e SEMI JOIN one USING (src, so) WHERE EXISTS (SELECT 1 FROM one o WHERE o.src = e.dst AND o.so <> e.dor)""")
def h8_simple_edges(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    links = compact.simple_edges(graph.without_self_loops(graph.overlap_edges(nodes, K)))
    sign = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    return _named(nodes, links.select(F.shiftright("u", 1).alias("src"), sign("u").alias("so"), F.shiftright("v", 1).alias("dst"), sign("v").alias("do")))


# Planted cases: the middle 300 bases of every current contig, if no 21-mer of theirs stands in another of these, at
# coverage 20; and of coverage 1 a substitution, a branch of 30 other bases, and a link from each second contig to the next.
_CORES = f"""{_CONTIGS}, cores AS (SELECT contig_id, substr(seq, length(seq) // 2 - 149, 300) AS c FROM contigs_now WHERE regexp_matches(seq, '^[ACGT]{{300,}}$')),
core_kmers AS (SELECT contig_id, least(w, {_RC.format('w')}) AS m FROM (SELECT contig_id, substr(c, i, {K}) AS w FROM (SELECT *, unnest(generate_series(1, {301 - K})) AS i FROM cores))),
planted AS (SELECT contig_id, c, row_number() OVER (ORDER BY contig_id) AS place FROM cores WHERE contig_id NOT IN (SELECT contig_id FROM core_kmers JOIN (SELECT m FROM core_kmers GROUP BY m HAVING count(*) > 1) USING (m)))"""


def _cores(contigs: DataFrame) -> DataFrame:
    """contig_id and c of the planted cases."""
    seq = contigs_now(contigs).filter(F.col("seq").rlike("^[ACGT]{300,}$"))
    cores = seq.select("contig_id", F.expr("substr(seq, div(length(seq), 2) - 149, 300)").alias("c"))
    found = kmers.kmer_windows(cores.select(F.col("contig_id").alias("read_id"), F.col("c").alias("seq"), F.lit(None).cast("string").alias("qual")), K)
    shared = found.groupBy("kmer").agg(F.count("*").alias("n"), F.collect_set("read_id").alias("ids")).filter("n > 1").select(F.explode("ids").alias("contig_id"))
    return cores.join(shared.distinct(), "contig_id", "left_anti")


def _planted(cores: DataFrame, weak: DataFrame, firm: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Contracted graph of the cores at coverage 20, the sequences ``weak`` (s) at 1 and ``firm`` ones at 10."""
    both = cores.select(F.lit(20).cast("long").alias("read_id"), F.col("c").alias("seq")).union(weak.select(F.lit(1).cast("long"), "s"))
    both = (both if firm is None else both.union(firm.select(F.lit(10).cast("long"), "s"))).withColumn("qual", F.lit(None).cast("string"))
    counts = kmers.kmer_windows(both, K).groupBy("kmer").agg(F.sum("read_id").alias("n"))
    nodes = graph.nodes_of(counts)
    nodes, edges, _ = compact.contract(nodes, graph.without_self_loops(graph.overlap_edges(nodes, K)), K)
    return nodes, graph.without_self_loops(edges)


def _named_nodes(nids: DataFrame, nodes: DataFrame) -> DataFrame:
    return nids.join(nodes, "nid").select(F.least("seq", dna.reverse_complement("seq")).alias("seq"), "n_kmers", "cov")


@query("h10_dead_ends", "contigs", sql=f"""WITH {_CORES}, tips AS (SELECT substr(c, 181, 20) || translate(substr(c, 201, 30), 'ACGT', 'CATG') AS s FROM planted)
SELECT least(s, {_RC.format('s')}) AS seq, CAST(30 AS BIGINT) AS n_kmers, 1.0::DOUBLE AS cov FROM tips""")
def h10_dead_ends(contigs: DataFrame) -> DataFrame:
    cores = _cores(contigs)
    nodes, edges = _planted(cores, cores.select(F.concat(F.substring("c", 181, 20), F.translate(F.substring("c", 201, 30), "ACGT", "CATG")).alias("s")))
    return _named_nodes(correct.dead_ends(nodes, edges, K, options.CorrectionOptions()), nodes)


@query("h17_bulges", "contigs", sql=f"""WITH {_CORES}, detours AS (SELECT substr(c, 130, 20) || translate(substr(c, 150, 1), 'ACGT', 'CATG') || substr(c, 151, 20) AS s FROM planted)
SELECT least(s, {_RC.format('s')}) AS seq, CAST({K} AS BIGINT) AS n_kmers, 1.0::DOUBLE AS cov FROM detours""")
def h17_bulges(contigs: DataFrame) -> DataFrame:
    cores = _cores(contigs)
    nodes, edges = _planted(cores, cores.select(F.concat(F.substring("c", 130, 20), F.translate(F.substring("c", 150, 1), "ACGT", "CATG"), F.substring("c", 151, 20)).alias("s")))
    return _named_nodes(correct.bulges(nodes, edges, K, options.CorrectionOptions()), nodes)


@query("h21_connectors", "contigs", sql=f"""WITH {_CORES}, joined AS (SELECT substr(a.c, 131, 20) || substr(b.c, 151, 20) AS s FROM planted a JOIN planted b ON b.place = a.place + 1 AND a.place % 2 = 1
  WHERE substr(a.c, 151, 1) <> substr(b.c, 151, 1) AND substr(a.c, 150, 1) <> substr(b.c, 150, 1))
SELECT least(s, {_RC.format('s')}) AS seq, CAST(20 AS BIGINT) AS n_kmers, 1.0::DOUBLE AS cov FROM joined""")
def h21_connectors(contigs: DataFrame) -> DataFrame:
    cores = graph.consecutive(_cores(contigs).orderBy("contig_id"), "place")
    pair = cores.select((F.col("place") - 1).alias("place"), F.col("c").alias("d"))
    joined = cores.filter("place % 2 = 0").join(pair, "place").filter("substr(c, 151, 1) <> substr(d, 151, 1) and substr(c, 150, 1) <> substr(d, 150, 1)")
    links = joined.select(F.concat(F.substring("c", 131, 20), F.substring("d", 151, 20)).alias("s"))
    onward = cores.select(F.concat(F.substring("c", 210, 20), F.translate(F.substring("c", 230, 1), "ACGT", "CATG"), F.substring("c", 231, 20)).alias("s"))  # a link must lead to where it goes on
    nodes, edges = _planted(cores, links, onward)
    return _named_nodes(correct.connectors(nodes, edges, K, options.CorrectionOptions()), nodes)


@query("h23_junctions", "read_records", sql=f"""WITH {_EDGES}, d AS (SELECT src, so, count(*) AS n FROM edges WHERE src <> dst GROUP BY 1, 2) SELECT DISTINCT src AS kmer FROM d WHERE n > 1""")
def h23_junctions(records: DataFrame) -> DataFrame:
    nodes = _nodes(records)
    return graph.ambiguous(nodes, graph.overlap_edges(nodes, K)).join(nodes, "nid").select(F.col("seq").alias("kmer"))


@query("h24_contigs", "read_records", sql=f"""WITH RECURSIVE {_EDGES}, {_ONE.split(', one AS')[0]},
junctions AS (SELECT DISTINCT src AS kmer FROM (SELECT src, so FROM e GROUP BY 1, 2 HAVING count(*) > 1)),
simple AS (SELECT * FROM e WHERE src NOT IN (SELECT kmer FROM junctions) AND dst NOT IN (SELECT kmer FROM junctions)),
walk AS (SELECT kmer AS head, o AS ho, kmer, o, 0 AS rank FROM view v WHERE kmer NOT IN (SELECT kmer FROM junctions) AND NOT EXISTS (SELECT 1 FROM simple s WHERE s.dst = v.kmer AND s.dor = v.o)
  UNION ALL SELECT head, ho, s.dst, s.dor, rank + 1 FROM walk w JOIN simple s ON s.src = w.kmer AND s.so = w.o),
{_SPELLED}
SELECT seq, CAST(length(seq) AS INTEGER) AS len, round(mass / n_kmers::DOUBLE, 6) AS cov, 'path' AS kind FROM (SELECT DISTINCT least(seq, {_RC.format('seq')}) AS seq, n_kmers, mass FROM spelled)
UNION ALL SELECT kmer, {K}, n::DOUBLE, 'junction' FROM nodes WHERE kmer IN (SELECT kmer FROM junctions)""")
def h24_contigs(records: DataFrame) -> DataFrame:
    """Contigs of the uncorrected graph."""
    nodes = _nodes(records)
    return compact.collapse(nodes, graph.paired(graph.overlap_edges(nodes, K)), K).withColumn("cov", F.round("cov", 6))


@query("h27_spelled_reads", "read_records", sql=f"WITH {_READS} SELECT read_id, upper(seq) AS seq FROM reads WHERE regexp_matches(upper(seq), '^[ACGT]{{{K + 1},}}$')")
def h27_spelled_reads(records: DataFrame) -> DataFrame:
    """Clean reads taken apart into canonical k-mers and spelled again; a walk reads as well backwards, so its direction is taken from the read."""
    clean = reads_of(records).filter(F.upper("seq").rlike(f"^[ACGT]{{{K + 1},}}$"))
    parts = F.transform(F.sequence(F.lit(1), F.length("seq") - (K - 1)), lambda i: dna.canonical(F.substring(F.upper("seq"), i, F.lit(K))))
    spelled = compact.spell_walks(clean.select(F.col("read_id").alias("walk_id"), parts.alias("kmers")), K)
    return spelled.withColumnRenamed("walk_id", "read_id")


# J: runs


@query("j3_default_ladders", "read_records", sql="""WITH n AS (SELECT DISTINCT CAST(length(seq) AS INTEGER) AS longest FROM read_records WHERE seq IS NOT NULL UNION SELECT unnest(generate_series(20, 301, 5))::INTEGER),
steps AS (SELECT longest, least(longest - 10, 255) AS ceiling, list_filter(list_concat([21, 31, 41, 55, 71], generate_series(91, 255, 20)), lambda k: k <= least(longest - 10, 255)) AS below FROM n),
ks AS (SELECT longest, ceiling, CASE WHEN len(below) = 0 THEN [21] ELSE below END AS ks, CASE WHEN ceiling % 2 = 0 THEN ceiling - 1 ELSE ceiling END AS top FROM steps)
SELECT longest, CAST(CASE WHEN top > ks[len(ks)] AND (top - ks[len(ks)] >= 8 OR top = 255) THEN list_append(ks, top) ELSE ks END AS INTEGER[]) AS ks FROM ks""")
def j3_default_ladders(records: DataFrame) -> DataFrame:
    """The ladder for every length that a read has, and some more."""
    spark = records.sparkSession
    lengths = records.filter("seq is not null").select(F.length("seq").alias("longest")).union(spark.range(20, 302, 5).select(F.col("id").cast("int"))).distinct()

    def run(batches):
        for batch in batches:
            longest = batch.column(0)
            yield pa.RecordBatch.from_arrays([longest, pa.array([options.default_ladder(n) for n in longest.to_pylist()], pa.list_(pa.int32()))], names=["longest", "ks"])

    return lengths.mapInArrow(run, "longest int, ks array<int>")


@query("j14_assembled", "read_records")
def j14_assembled(records: DataFrame) -> DataFrame:
    """All reads assembled at one k with chosen floor and cutoff, and corrected."""
    result = assemble.assemble(reads_of(records).select("read_id", "seq", "qual"), options.AssemblyOptions(k=K))
    return result.contigs


@query("j12_ladder", "contigs", sql=f"WITH {_CORES} SELECT least(c, {_RC.format('c')}) AS seq, CAST(300 AS INTEGER) AS len FROM planted")
def j12_ladder(contigs: DataFrame) -> DataFrame:
    """A ladder of two ks over reads of the planted cases: from every fifth base 100 bases of both strands, an error in every
    eighth read. Each case must come out as one contig."""
    at = F.explode(F.sequence(F.lit(0), F.lit(40))).alias("at")
    cut = _cores(contigs).select("contig_id", "c", at).select("contig_id", "at", F.expr("substr(c, 5 * at + 1, 100)").alias("s"))
    wrong = F.concat(F.left("s", F.lit(50)), F.translate(F.substring("s", 51, 1), "ACGT", "CATG"), F.right("s", F.lit(49)))
    strands = F.array(F.struct(F.lit(0).alias("strand"), F.when(F.col("at") % 8 == 3, wrong).otherwise(F.col("s")).alias("seq")), F.struct(F.lit(1).alias("strand"), dna.reverse_complement("s").alias("seq")))
    reads = cut.select("contig_id", "at", F.inline(strands)).select((F.col("contig_id") * 100 + F.col("at") * 2 + F.col("strand")).alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))
    return assemble.assemble(reads, options.AssemblyOptions(ks=(21, 31), min_count=2)).contigs.select("seq", "len")
