"""Queries with mixture priors: posteriors of consensus columns, and entropy weighting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import priors
from helixlake.operators import columns, weighting
from helixlake.plans.alignments import _CONSENSUS
from helixlake.sources import tables

#: Columns that favour one residue, pairs of like residues, or none.
MIXTURE = [
    (0.1, [6.0, 0.3, 0.3, 0.3]), (0.1, [0.3, 6.0, 0.3, 0.3]), (0.1, [0.3, 0.3, 6.0, 0.3]), (0.1, [0.3, 0.3, 0.3, 6.0]),
    (0.15, [2.0, 0.4, 2.0, 0.4]), (0.15, [0.4, 2.0, 0.4, 2.0]), (0.3, [4.0, 4.0, 4.0, 4.0]),
]
#: Mean bits of a column that alignments are weighted down to.
BITS = 0.2


def column_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """The mean posterior probabilities of the four residues in every consensus column."""
    counts = weighting.column_counts(tables.alignments(spark, d))
    # Equal counts have one posterior, which is worked out once.
    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = priors.posteriors(batch["counts"].flatten().to_numpy().reshape(-1, 4), MIXTURE)
                offsets = pa.array(np.arange(0, 4 * len(found) + 1, 4), pa.int32())
                yield pa.RecordBatch.from_arrays([batch["counts"], pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["counts", "posterior"])

    once = counts.select("counts").distinct().mapInArrow(posteriors, "counts array<double>, posterior array<double>")
    found = counts.join(once, "counts")
    return found.select("aln_id", "apos", *(F.round(F.get("posterior", F.lit(i)), 6).alias(f"p_{r.lower()}") for i, r in enumerate("ACGU")))


def entropy_weights(spark: SparkSession, d: str) -> DataFrame:
    """The effective number of sequences of every alignment."""
    aln = tables.alignments(spark, d)
    found = weighting.effective_numbers(weighting.column_counts(aln), columns.shapes(aln).select("aln_id", "nseq"), MIXTURE, BITS)
    return found.select("aln_id", "nseq", F.round("neff", 6).alias("neff"))


QUERIES = {f.__name__: f for f in (column_posteriors, entropy_weights)}

_VECTORS = _CONSENSUS + ", v AS (SELECT aln_id, apos, " + ", ".join(f"coalesce(sum(n) FILTER (residue = '{r}'), 0)::DOUBLE AS n{i}" for i, r in enumerate("ACGU")) + " FROM counts SEMI JOIN cons USING (aln_id, apos) WHERE residue IN ('A', 'C', 'G', 'U') GROUP BY ALL)"


def _posterior_sql(of: str, keep: str) -> str:
    """Posteriors p0 to p3 of a table's counts n0 to n3, component by component."""
    logs = ", ".join(f"ln({q}e0) + lgamma({sum(a)}e0) - lgamma(n0 + n1 + n2 + n3 + {sum(a)}e0)" + "".join(f" + lgamma(n{i} + {x}e0) - lgamma({x}e0)" for i, x in enumerate(a)) + f" AS l{k}" for k, (q, a) in enumerate(MIXTURE))
    top = "greatest(" + ", ".join(f"l{k}" for k in range(len(MIXTURE))) + ")"
    weights = ", ".join(f"exp(l{k} - {top}) AS w{k}" for k in range(len(MIXTURE)))
    total = "(" + " + ".join(f"w{k}" for k in range(len(MIXTURE))) + ")"
    means = ", ".join("(" + " + ".join(f"w{k} * (n{i} + {a[i]}e0) / (n0 + n1 + n2 + n3 + {sum(a)}e0)" for k, (_, a) in enumerate(MIXTURE)) + f") / {total} AS p{i}" for i in range(4))
    return f"SELECT {keep}, {means} FROM (SELECT *, {weights} FROM (SELECT *, {logs} FROM {of}))"


_TRIED = "SELECT s.aln_id, nseq, low, width, k, apos, " + ", ".join(f"n{i} * (low + width * k / 16) / nseq AS n{i}" for i in range(4)) + " FROM {} s JOIN v USING (aln_id), (SELECT unnest(range(1, 17)) AS k)"
_ROUND = "SELECT aln_id, nseq, low + count(*) FILTER (bits <= " + str(BITS) + "e0) * width / 16 AS low, CASE WHEN count(*) FILTER (bits <= " + str(BITS) + "e0) < 16 THEN width / 16 ELSE 0 END AS width FROM (SELECT aln_id, nseq, low, width, k, avg({}) AS bits FROM ({}) GROUP BY ALL) GROUP BY aln_id, nseq, low, width"


def _rounds_sql() -> str:
    bits = " + ".join(f"p{i} * log2(p{i} / 0.25e0)" for i in range(4))
    parts = ["a0 AS (SELECT aln_id, nseq, 0e0 AS low, nseq::DOUBLE AS width FROM shape)"]
    for k in range(3):
        parts.append(f"t{k} AS ({_TRIED.format(f'a{k}')})")
        parts.append(f"a{k + 1} AS ({_ROUND.format(bits, _posterior_sql(f't{k}', 'aln_id, nseq, low, width, k'))})")
    return ", ".join(parts)


ORACLE_SQL = {
    "column_posteriors": f"{_VECTORS} SELECT aln_id, apos, round(p0, 6) AS p_a, round(p1, 6) AS p_c, round(p2, 6) AS p_g, round(p3, 6) AS p_u FROM ({_posterior_sql('v', 'aln_id, apos')})",
    "entropy_weights": f"{_VECTORS}, {_rounds_sql()} SELECT aln_id, nseq, round(low, 6) AS neff FROM a3",
}
