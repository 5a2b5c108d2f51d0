"""Entropy weighting: how many sequences an alignment counts for, so that its columns carry as many bits as are wanted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions import priors
from helixlake.operators import columns

UNIFORM = 0.25
#: Count vectors that are looked at together.
CHUNK = 16_384


def column_counts(aln: DataFrame) -> DataFrame:
    """(aln_id, apos, counts) of the canonical residues of each consensus column, in the order ACGU."""
    return columns.canonical_columns(aln).select("aln_id", "apos", F.transform("acgu", lambda n: n.cast("double")).alias("counts"))


def effective_numbers(counts: DataFrame, shapes: DataFrame, mixture: priors.Mixture, bits: float, *, rounds: int = 3, parts: int = 16) -> DataFrame:
    """(aln_id, nseq, neff): the number of sequences at which the mean relative entropy of an alignment's columns is `bits`.

    counts has (aln_id, apos, counts), shapes (aln_id, nseq). Entropy grows with the number, so that each round looks at `parts`
    numbers, and keeps the stretch between the last one with too few bits and the next. A task holds the different counts of one alignment's columns. All sequences where even they have too few bits; neff is the lower end of a stretch of nseq / parts ** rounds.
    """
    # Columns with equal counts are one, with their number.
    of = counts.groupBy("aln_id", "counts").agg(F.count("*").alias("columns")).join(F.broadcast(shapes.select("aln_id", "nseq")), "aln_id")
    kind = counts.schema["aln_id"].dataType.simpleString()

    def weighed(key: tuple, rows: pa.Table) -> pa.Table:
        n, times, nseq = rows["counts"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), rows["columns"].to_numpy(), rows["nseq"][0].as_py()
        low, width = 0.0, float(nseq)

        def bits_at(x: float) -> float:
            total = 0.0
            for first in range(0, len(n), CHUNK):
                p = priors.posteriors(n[first : first + CHUNK] * x / nseq, mixture)
                total += ((p * np.log2(p / UNIFORM)).sum(1) * times[first : first + CHUNK]).sum()
            return total / times.sum()

        for _ in range(rounds if width else 0):
            # The numbers with too few bits are the first ones.
            few = sum(bits_at(low + width * k / parts) <= bits for k in range(1, parts + 1))
            low, width = low + few * (width / parts), width / parts if few < parts else 0.0
        return pa.table({"aln_id": pa.array([key[0].as_py()], key[0].type), "nseq": pa.array([nseq], pa.int64()), "neff": pa.array([low], pa.float64())})

    return of.groupBy("aln_id").applyInArrow(weighed, f"aln_id {kind}, nseq long, neff double")
