"""The corpus pipeline: five stages that each call one operator on all that the stage before it kept.

Stages but the last return the columns of documents. Empty tables pass through; null texts are rejected by the
first stage, since no language can be told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import langid, minhash, packing, pii, suffixes
from helixlake.llm._shared import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this mean probability of its best language a text is in none that was learned.
LEAST_SCORE = 0.35
#: SQL can express neither the network of the first stage nor the packing of the last one.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told keep their rows; a missing label is filled in."""
    net = langid.fit(docs.filter(~langid.held_out()))
    told = langid.predict(docs, net).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays. Of an id with several texts each goes by itself."""
    dropped = minhash.components(docs).filter("not kept").select("doc_id", "digest").distinct()
    return docs.withColumn("digest", F.unhex(F.md5("text"))).join(dropped, ["doc_id", "digest"], "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand more than once are cut out of the texts."""
    return _documents(suffixes.deduplicated(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kinds in brackets."""
    return _documents(pii.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        # Stages read their documents several times; what the stage before kept is written, not computed anew.
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
