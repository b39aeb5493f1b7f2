"""The pN_ queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from . import frequency, heavy, leaks, pii, sampling, seen, splitting, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables as a query."""

    def register(f):
        QUERIES[name] = lambda spark, folder: f(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in tables))
        if sql:
            ORACLES[name] = sql
        return f

    return register


_CURRENT_WALKS = """
current AS (SELECT contig_id, k, sample, list_transform(serialized_contigs, lambda n: coalesce(len(n.abs_ind), 0)) AS sizes
  FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY written_at DESC NULLS LAST) AS rn FROM contigs) WHERE rn = 1)"""


@query("p1_found", "contigs", sql=f"""WITH {_CURRENT_WALKS}
SELECT contig_id, CASE WHEN list_max(sizes) + k - 1 > 1000 THEN 'inside' ELSE 'border' END AS cut
FROM current WHERE coalesce(list_sum(sizes), 0) > 0 AND list_sum(sizes) + k - 1 > 1000""")
def p1_found(contigs: DataFrame) -> DataFrame:
    return splitting.oversized(contigs)


_NEXT = "coalesce(list_max(list_filter(bounds, lambda x: x > {at} AND x <= {at} + most)), least({at} + most, total))"


@query("p1_pieces", "contigs", sql=f"""WITH RECURSIVE newest AS (SELECT contig_id, k, sample, serialized_contigs AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY written_at DESC NULLS LAST) AS rn FROM contigs) WHERE rn = 1),
flat AS (SELECT contig_id, k, sample, flatten(list_transform(nodes, lambda n: coalesce(n.abs_ind, []))) AS hashes, greatest(1000 - (coalesce(k, 1) - 1), 1) AS most FROM newest),
steps AS (SELECT contig_id, i, sum(coalesce(len(nodes[i].abs_ind), 0)) OVER (PARTITION BY contig_id ORDER BY i) AS bound FROM (SELECT contig_id, nodes, unnest(generate_series(1, len(nodes))) AS i FROM newest)),
walks AS (SELECT f.*, len(hashes) AS total, list_prepend(0, b.bounds) AS bounds FROM flat f JOIN (SELECT contig_id, list(CAST(bound AS BIGINT) ORDER BY i) AS bounds FROM steps GROUP BY contig_id) b ON b.contig_id = f.contig_id WHERE len(hashes) > 0),
cuts AS (SELECT contig_id, 0 AS no, CAST(0 AS BIGINT) AS a, {_NEXT.format(at='0')} AS b FROM walks
  UNION ALL SELECT c.contig_id, no + 1, c.b, {_NEXT.format(at='c.b')} FROM cuts c JOIN walks w ON w.contig_id = c.contig_id WHERE c.b < total),
ended AS (SELECT c.*, CASE WHEN b = total THEN 'end' WHEN list_contains(bounds, b) THEN 'border' ELSE 'inside' END AS ends FROM cuts c JOIN walks w ON w.contig_id = c.contig_id)
SELECT c.contig_id, k, sample, CAST(no AS INTEGER) AS piece_no, CAST(count(*) OVER (PARTITION BY c.contig_id) AS INTEGER) AS n_pieces, a AS from_kmer, CAST(b AS BIGINT) AS to_kmer,
  CAST(len(list_filter(bounds, lambda x: x <= a)) - 1 AS INTEGER) AS first_node, CAST(len(list_filter(bounds, lambda x: x < b)) - 1 AS INTEGER) AS last_node, CAST(b - a + coalesce(k, 1) - 1 AS BIGINT) AS bases, ends,
  bool_or(ends = 'inside') OVER (PARTITION BY c.contig_id) AS inside, list_slice(hashes, a + 1, b) AS kmers FROM ended c JOIN walks w ON w.contig_id = c.contig_id""")
def p1_pieces(contigs: DataFrame) -> DataFrame:
    return splitting.split_walks(contigs, with_kmers=True)


@query("p2_found", "kmer_info", sql="""
WITH e AS (SELECT DISTINCT entry_id, hnc, coalesce(count, 0) AS c FROM kmer_info)
SELECT hnc FROM e WHERE hnc IS NOT NULL GROUP BY hnc HAVING sum(c) >= 0.005 * (SELECT sum(c) FROM e)""")
def p2_found(kmer_info: DataFrame) -> DataFrame:
    return heavy.heavy_items(kmer_info).select(F.col("item").alias("hnc"))


@query("p2_sums", "kmer_info", sql="""
WITH e AS (SELECT DISTINCT entry_id, hnc, coalesce(count, 0) AS c FROM kmer_info)
SELECT hnc, CAST(sum(c) AS BIGINT) AS summed_count, true AS within_bounds FROM e WHERE hnc IS NOT NULL
GROUP BY hnc HAVING sum(c) >= 0.005 * (SELECT sum(c) FROM e)""")
def p2_sums(kmer_info: DataFrame) -> DataFrame:
    items = heavy.heavy_items(kmer_info)
    return items.select(F.col("item").alias("hnc"), F.col("weight").alias("summed_count"), F.col("weight").between(F.col("low"), F.col("high")).alias("within_bounds"))


_TERMS = """
blocks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC NULLS LAST, counts DESC) AS rn FROM indexed_kmers) WHERE rn = 1),
cutoffs AS (SELECT sample, used_min_count FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY run_at DESC NULLS LAST, used_min_count DESC) AS rn FROM preprocessed_k) WHERE rn = 1),
entries AS (SELECT block_id, sample, unnest(canonical_hashes) AS canonical_hash, unnest(list_resize(coalesce(counts, []), len(canonical_hashes))) AS n FROM blocks),
in_library AS (SELECT canonical_hash, sample, sum(coalesce(n, 0)) AS occurrences, count(DISTINCT block_id) AS blocks FROM entries WHERE canonical_hash IS NOT NULL GROUP BY ALL),
terms AS (SELECT canonical_hash, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(blocks) AS BIGINT) AS blocks, count(*) AS libraries,
  count(*) FILTER (WHERE used_min_count IS NULL OR occurrences >= used_min_count) AS kept_by
  FROM in_library LEFT JOIN cutoffs USING (sample) GROUP BY 1)"""


@query("p3_found", "indexed_kmers", "preprocessed_k", sql=f"""WITH {_TERMS}
SELECT canonical_hash, 'rare' AS mark FROM terms WHERE kept_by = 0
UNION ALL SELECT canonical_hash, 'common' FROM terms WHERE blocks > 0.2 * (SELECT count(DISTINCT block_id) FROM indexed_kmers)""")
def p3_found(indexed_kmers: DataFrame, preprocessed_k: DataFrame) -> DataFrame:
    return frequency.marked_terms(indexed_kmers, preprocessed_k)


@query("p3_frequencies", "indexed_kmers", "preprocessed_k", sql=f"WITH {_TERMS} SELECT canonical_hash, occurrences, blocks, libraries FROM terms")
def p3_frequencies(indexed_kmers: DataFrame, preprocessed_k: DataFrame) -> DataFrame:
    terms = frequency.term_frequencies(indexed_kmers, preprocessed_k)
    return terms.select(F.col("value").alias("canonical_hash"), "occurrences", F.col("records").alias("blocks"), "libraries")


@query("p4_found", "kmer_sightings", "indexed_kmers", sql="""
WITH known AS (SELECT DISTINCT unnest(canonical_hashes) AS canonical_hash FROM indexed_kmers),
first AS (SELECT canonical_hash, min(sight_id) AS since FROM kmer_sightings GROUP BY 1)
SELECT DISTINCT sight_id FROM kmer_sightings s JOIN first USING (canonical_hash)
WHERE s.sight_id > since OR canonical_hash IN (SELECT canonical_hash FROM known WHERE canonical_hash IS NOT NULL)""")
def p4_found(kmer_sightings: DataFrame, indexed_kmers: DataFrame) -> DataFrame:
    return seen.seen_before(kmer_sightings, indexed_kmers)


@query("p4_wrong_answers", "kmer_sightings", "indexed_kmers")
def p4_wrong_answers(kmer_sightings: DataFrame, indexed_kmers: DataFrame) -> DataFrame:
    return seen.wrong_answers(kmer_sightings, indexed_kmers)


_MIXED = f"((CAST(xor(key, key >> {filters.SHIFT}) AS UHUGEINT) * {filters.MULTIPLIER}) % 18446744073709551616)"
_BITS = " | ".join(f"(1::UBIGINT << ((key >> {shift}) & 63))" for shift in filters.FINGERPRINT_SHIFTS)


@query("p4_filters", "kmer_sightings", "indexed_kmers", "bloom_bits", sql=f"""
WITH kept AS (SELECT coalesce(sample, '') AS library, buffer FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(sample, '') ORDER BY saved_at DESC NULLS LAST, buffer DESC NULLS LAST) AS rn FROM bloom_bits) WHERE rn = 1),
asked AS (SELECT DISTINCT coalesce(sample, '') AS library, canonical_hash AS hash FROM kmer_sightings WHERE canonical_hash IS NOT NULL),
held AS (SELECT DISTINCT coalesce(sample, '') AS library, unnest(canonical_hashes) AS hash FROM indexed_kmers),
questions AS (SELECT a.library, CAST(CASE WHEN a.hash < 0 THEN a.hash::HUGEINT + 18446744073709551616 ELSE a.hash END AS UBIGINT) AS key, h.hash IS NOT NULL AS held, buffer
  FROM asked a LEFT JOIN held h ON h.library = a.library AND h.hash = a.hash LEFT JOIN kept k ON k.library = a.library),
placed AS (SELECT library, held, {_BITS} AS bits, coalesce(buffer[CAST(CAST({_MIXED} AS HUGEINT) * len(buffer) // 18446744073709551616 AS BIGINT) + 1], 0)::HUGEINT AS word FROM questions),
told AS (SELECT library, held, (CAST(CASE WHEN word < 0 THEN word + 18446744073709551616 ELSE word END AS UBIGINT) & bits) = bits AS yes FROM placed)
SELECT library AS sample, count(*) AS keys, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE yes) AS yes, count(*) FILTER (WHERE yes AND NOT held) AS wrong, count(*) FILTER (WHERE held AND NOT yes) AS missed FROM told GROUP BY 1""")
def p4_filters(kmer_sightings: DataFrame, indexed_kmers: DataFrame, bloom_bits: DataFrame) -> DataFrame:
    return seen.saved_filter_answers(kmer_sightings, indexed_kmers, bloom_bits)


@query("p5_sample", "spectrum_sketch")
def p5_sample(spectrum_sketch: DataFrame) -> DataFrame:
    return sampling.fixed_size_sample(spectrum_sketch, 256, columns=["entry_id", "sample", "canonical_hash", "threshold", "counts"])


@query("p6_ids", "documents")
def p6_ids(documents: DataFrame) -> DataFrame:
    return tokens.encode_texts(documents)


@query("p7_found", "documents", "eval_items")
def p7_found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks.leaked(documents, eval_items)


@query("p7_items", "documents", "eval_items")
def p7_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks.leak_report(documents, eval_items)


@query("p8_found", "documents", "person_names")
def p8_found(documents: DataFrame, person_names: DataFrame) -> DataFrame:
    return pii.find_pii(documents, person_names).select("doc_id", "pii_type", "pii_text").distinct()


@query("p8_redacted", "documents", "person_names")
def p8_redacted(documents: DataFrame, person_names: DataFrame) -> DataFrame:
    return pii.redact(documents, person_names)
