"""Newest versions of rows, without shuffling those that have no other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys delivered more than once that are sent to all tasks; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def by_deliveries(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose LONG ``key`` stands once, and the others, told apart by the keys alone; nulls are one key."""
    keyed = df.withColumn("_null", F.col(key).isNull()).withColumn("_key", F.coalesce(key, F.lit(0).cast("long")))
    several = keyed.groupBy("_null", "_key").agg(F.count("*").alias("n")).filter("n > 1").select("_null", "_key")
    several = F.broadcast(several) if several.count() <= MOST_BROADCAST else several
    once, more = (keyed.join(several, ["_null", "_key"], how).select(*df.columns) for how in ("left_anti", "left_semi"))
    return once, more
