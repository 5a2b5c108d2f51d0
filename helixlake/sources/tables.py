"""Sequences, hits, scores and alignments derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residues_of(text: Column) -> Column:
    """IUPAC residues of a text: letters, upper-cased, others dropped, T as U, X as N and I as A."""
    known = "ACGUTRYMKSWHBVDNXI"
    return F.translate(F.upper(F.regexp_replace(text, f"[^{known}{known.lower()}]+", "")), "TXI", "UNA")


def sequences(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """seq_id, seq, len of every document; if so wanted, residues are taken from many texts together."""
    if together:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
        return with_residues(docs, "seq", "seq").withColumn("len", F.length("seq"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), residues_of(F.col("text")).alias("seq"))
    return docs.withColumn("len", F.length("seq"))


#: The residue that a byte of a text stands for, 0 for none.
_RESIDUE = np.zeros(256, np.uint8)
for _c in "ACGUTRYMKSWHBVDNXI":
    _RESIDUE[[ord(_c), ord(_c.lower())]] = ord({"T": "U", "X": "N", "I": "A"}.get(_c, _c))


def _kept(text: pa.Array) -> pa.Array:
    """`residues_of` texts, as arrays of bytes."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    symbols = _RESIDUE[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    held = symbols > 0
    upto = np.concatenate([[0], np.cumsum(held, dtype=np.int32)])[offsets - offsets[0]].astype(np.int32)
    found = pa.StringArray.from_buffers(len(text), pa.py_buffer(upto), pa.py_buffer(symbols[held]))
    return pc.if_else(text.is_valid(), found, pa.scalar(None, pa.string())) if text.null_count else found


def with_residues(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Rows with the residues of a text in its place, worked out a few megabytes of texts at a time."""
    told = ", ".join(f"`{name if c == text else c}` {kind}" for c, kind in docs.dtypes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place = 0, batch.schema.get_field_index(text)
            while at < batch.num_rows:
                column = batch.column(place)
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 22), "right")) - 1)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([_kept(x) if k == place else x for k, x in enumerate(part.columns)], names=[name if c == text else c for c in batch.schema.names])
                at = to

    return docs.mapInArrow(found, told)


SEQS_SQL = """seqs AS (SELECT doc_id AS seq_id, translate(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),
  '[^ACGUTRYMKSWHBVDNXI]', '', 'g'), 'TXI', 'UNA') AS seq FROM documents)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits for the overlap operators: a supplier is a sequence, a line an interval with a score."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("seq_id"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        (F.col("l_partkey") + 1).alias("lo"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_orderkey").alias("hit_id"),
        F.col("l_linenumber").alias("sub_id"),
    )


HITS_SQL = """hits AS (SELECT l_suppkey AS seq_id, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
  l_partkey + 1 AS lo, l_partkey + l_quantity::BIGINT AS hi, l_extendedprice AS score, l_orderkey AS hit_id, l_linenumber AS sub_id FROM lineitem)"""


def alignments(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """aln_id, seq_id, row: all residues of the documents of a language and source are an alignment's rows, from its first
    column on. Where a row ends before the longest one of its alignment, the rest of it is gaps, which are not spelled out. If so wanted, residues are taken from many texts together."""
    docs = table(spark, sf_dir, "documents")
    if together:
        return with_residues(docs.select(F.concat_ws("/", "lang", "source").alias("aln_id"), F.col("doc_id").alias("seq_id"), F.col("text").alias("row")), "row", "row")
    return docs.select(F.concat_ws("/", "lang", "source").alias("aln_id"), F.col("doc_id").alias("seq_id"), residues_of(F.col("text")).alias("row"))


ALN_SQL = """aln AS (SELECT concat_ws('/', lang, source) AS aln_id, doc_id AS seq_id, coalesce(translate(regexp_replace(upper(
  regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGUTRYMKSWHBVDNXI]', '', 'g'), 'TXI', 'UNA'), '') AS row FROM documents)"""
