"""Keyed access to records: by name or alias, by ordinal, by part, and lists of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(records: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, which an index rejects."""
    return records.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def fetch(records: DataFrame, key: str, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records whose key, or else whose alias (alias, key), a list (key, line_no) names, with the place in the list."""
    asked = wanted.select(F.col("key").alias("asked"), "line_no")
    primary = asked.join(records.select(F.col(key).alias("asked")).distinct(), "asked", "left_semi").withColumn("key", F.col("asked"))
    others = asked.join(records.select(F.col(key).alias("asked")).distinct(), "asked", "left_anti").join(aliases.select(F.col("alias").alias("asked"), "key"), "asked")
    found = primary.unionByName(others).select(F.col("key").alias(key), "asked", "line_no")
    return records.join(found, key)


def listed(records: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    return records.join(wanted.select(F.col("key").alias(key)).distinct(), key, "left_semi")


def numbered(records: DataFrame, key: str, ranges: int = 200) -> DataFrame:
    """Records with the ordinal of their key, from 0, in byte order.

    A few keys, chosen by a hash, cut the keys into ranges; each range is numbered by itself, and the sizes of the ranges
    before it are added.
    """
    cuts = sorted(r[0] for r in records.select(key).orderBy(F.xxhash64(key)).limit(ranges).collect())
    borders = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    ranged = records.withColumn("__range", F.size(F.filter(borders, lambda b: b <= F.col(key))))
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(key)))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    # A row for every range.
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(before), "__range").withColumn("ordinal", F.col("__before") + F.col("__at") - 1).drop("__range", "__at", "__before")


def parts(records: DataFrame, seq: str, start: str, end: str) -> DataFrame:
    """Records with `part`, the residues from start to end (1-based, inclusive); an end of 0 is the last one."""
    last = F.when(F.col(end) == 0, F.length(seq)).otherwise(F.least(F.col(end), F.length(seq)))
    return records.withColumn("part", F.substring(F.col(seq), F.col(start), F.greatest(F.lit(0), last - F.col(start) + 1)))
