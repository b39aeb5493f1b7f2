"""Counting k-mers of reads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import kmer_windows


def reads_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """read_records files as they appear in a folder."""
    schema = "read_id long, sample string, seq string, qual string, loaded_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_within(reads: DataFrame, delay: str = "7 days") -> DataFrame:
    """Reads once; ids are remembered as long as a repetition may come."""
    return reads.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["read_id"])


def running_counts(reads: DataFrame, k: int, floor: int = 0) -> DataFrame:
    """Counts of canonical k-mers so far, for output mode update or complete."""
    return kmer_windows(reads, k, [floor]).groupBy("kmer").agg(F.count("*").alias("n"))


def arrivals(reads: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Reads and bases of each library by time of loading; late ones count while the watermark waits for them."""
    timed = reads.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window), "sample")
    return timed.agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases")).select(F.col("window.start").alias("since"), "sample", "reads", "bases")


def to_memory(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Run what is available now into a table in memory, for tests."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
