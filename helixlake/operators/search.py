"""Ungapped search of sequences by models: tiles, diagonals, P-values, E-values, overlaps, report and inclusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions import stats
from helixlake.operators import intervals

HITS = "seq_id long, model string, strand string, lo long, hi long, score int"
#: Starts of a tile of a sequence: what a task scores at one time.
STEP = 100_000


def emissions(models: list[dict], match: int = 2, mismatch: int = -1) -> dict[str, np.ndarray]:
    """Of each model (name, consensus) the score of each of the four residues and of others at each position."""
    found = {}
    for m in models:
        table = np.full((len(m["consensus"]), 256), mismatch, np.int16)
        for k, x in enumerate(m["consensus"]):
            table[k, ord(x)] = match
        found[m["name"]] = table
    return found


def best_segments(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each start the largest sum of a stretch of the diagonal on which it lies, over all of the model's positions."""
    n = len(codes) - len(table) + 1
    running, best = np.zeros(n, np.int16), np.zeros(n, np.int16)
    for k, scores in enumerate(table):
        running += scores[codes[k : k + n]]
        np.maximum(running, 0, out=running)
        np.maximum(best, running, out=best)
    return best


def diagonals(seqs: DataFrame, models: list[dict], at_least: int, strands: tuple[str, ...] = ("+", "-"), step: int = STEP) -> DataFrame:
    """Places of sequences (seq_id, seq) where a model's best ungapped segment on a diagonal scores enough.

    A task cuts tiles of `step` starts out of each sequence that it holds, with what the model needs after them.
    """
    forward = emissions(models)
    # A reverse strand is read backwards with the complement's scores, so that no sequence is turned around.
    turn = np.arange(256)
    for x, y in zip(b"ACGU", b"UGCA", strict=True):
        turn[x] = y
    tables = {"+": forward, "-": {name: np.ascontiguousarray(t[::-1][:, turn]) for name, t in forward.items()}}
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"seq_id": [], "model": [], "strand": [], "lo": [], "hi": [], "score": []}
            for seq_id, seq in zip(batch.column("seq_id").to_pylist(), batch.column("seq"), strict=True):
                codes = np.frombuffer(seq.as_py().encode(), np.uint8)
                for strand in strands:
                    for name, table in tables[strand].items():
                        for start in range(0, len(codes) - len(table) + 1, step):
                            best = best_segments(codes[start : start + step + len(table) - 1], table)
                            at = np.flatnonzero(best >= at_least)
                            lo = at + start + 1
                            for c, v in zip(out, ([seq_id] * len(at), [name] * len(at), [strand] * len(at), lo.tolist(), (lo + len(table) - 1).tolist(), best[at].tolist()), strict=True):
                                out[c] += v
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return seqs.filter("len > 0").select("seq_id", "seq").mapInArrow(scan, HITS)


def search(seqs: DataFrame, models: list[dict], *, mode: str = "default", strands: tuple[str, ...] = ("+", "-"), report: float = 10.0, include: float = 0.01) -> DataFrame:
    """Hits of models (name, consensus, mu, lambda) in sequences (seq_id, seq, len), with P-value, E-value and `included`.

    Z, the search space, is the residues of the strands searched. Its size picks the first filter's threshold, and with
    it the least score that a window must reach; survivors are valued, cut at the E-value to report, and of overlapping
    hits of one model only the best stay. A table without residues has no hits.
    """
    z = len(strands) * (seqs.agg(F.sum("len")).first()[0] or 0)
    f1 = seqs.sparkSession.range(1).select(stats.filter_thresholds(F.lit(z / 1e6), F.lit(mode))["f1"]).first()[0]
    # The least score whose P-value passes for any model; the exact filter follows.
    least = min(m["mu"] - np.log(-np.log1p(-min(f1, 1 - 1e-12))) / m["lambda"] for m in models)
    cut = max(min(m["mu"] - np.log(report / max(z, 1)) / m["lambda"] for m in models) - 1, least)
    found = diagonals(seqs, models, max(1, int(np.floor(cut))), strands)
    table = F.broadcast(seqs.sparkSession.createDataFrame(pd.DataFrame([{"model": m["name"], "mu": m["mu"], "lambda": m["lambda"]} for m in models])))
    p = -F.expm1(-F.exp(-F.col("lambda") * (F.col("score") - F.col("mu"))))
    valued = found.join(table, "model").withColumn("pvalue", p).filter(F.col("pvalue") <= f1).withColumn("evalue", F.col("pvalue") * float(z))
    reported = valued.filter(F.col("evalue") <= report)
    order = [F.desc("score"), F.asc("lo"), F.asc("hi")]
    kept = intervals.remove_overlaps(reported, ["seq_id", "strand", "model"], order, ["lo", "hi", "score", "pvalue", "evalue"])
    return kept.withColumn("included", F.col("evalue") <= include)
