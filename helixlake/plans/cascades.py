"""Queries of the gapped search. Dynamic programming is beyond SQL here: tests compare it with all paths, one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators import cascade
from helixlake.plans import catalog
from helixlake.sources import tables

#: Locations of the models' Viterbi and Forward bits, as 40,000 windows of random residues have them.
LOCATIONS = {"stem": (4.68, 6.46), "loop": (4.16, 5.16), "tail": (5.03, 7.59)}
MODELS = [m | {"viterbi_mu": LOCATIONS[m["name"]][0], "forward_mu": LOCATIONS[m["name"]][1]} for m in catalog.MODELS]
#: P-values that a window must reach at each stage: the first is a diagonal's, the others are a whole window's.
THRESHOLDS = {"f1": 0.02, "f2": 0.25, "f3": 0.2, "f3b": 0.2}
REPORT, INCLUDE = 500_000.0, 50_000.0


def gapped_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all models on both strands through the ungapped, Viterbi, Forward and bias filters."""
    found = cascade.search(tables.sequences(spark, d), MODELS, THRESHOLDS, report=REPORT, include=INCLUDE)
    return found.select("seq_id", "strand", "model", "lo", "hi", F.round("score", 5).alias("score"), F.round("evalue", 5).alias("evalue"), F.col("included").cast("int").alias("included"))


def filter_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Windows and residues that pass each stage of the search, by model and strand."""
    return cascade.survivors(cascade.filtered(tables.sequences(spark, d), MODELS, THRESHOLDS), MODELS)


QUERIES = {f.__name__: f for f in (gapped_search, filter_survivors)}
ORACLE_SQL: dict[str, str] = {}
