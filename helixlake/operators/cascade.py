"""Gapped filters behind the ungapped one: Viterbi, Forward and the composition bias, over many windows at one time.

A profile has match, insert and delete states for each position of a consensus; it is entered and left at any position. Windows
are what surrounds a good ungapped diagonal. Scores are in bits over the background. Each stage sees what the one before let through.

A task reads whole sequences and cuts tiles of them itself, so that a sequence is held once however long it is, and works on CHUNK
windows at one time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators import intervals
from helixlake.operators.search import STEP, best_segments, emissions

#: Windows that are scored at one time.
CHUNK = 4_096
STAGES = ("f1", "f2", "f3", "f3b")
WINDOWS = "seq_id long, model string, strand string, lo long, hi long, ungapped int, viterbi double, forward double, bias double, stage string"


@dataclass(frozen=True)
class Gaps:
    """Probabilities of opening and of lengthening a gap."""

    opened: float = 0.02
    longer: float = 0.4


@dataclass(frozen=True)
class Bias:
    """A null model of two states: how often the second is entered and kept, and its odds of each residue over the background."""

    enter: float = 0.001
    stay: float = 0.99
    odds: dict = field(default_factory=lambda: {"A": 1.6, "C": 0.4, "G": 0.7, "U": 1.3})


def viterbi(codes: np.ndarray, match: np.ndarray, gaps: Gaps = Gaps()) -> np.ndarray:
    """The best path's bits in each window (a row of byte codes); match has the bits of every code at every position.

    A path enters any position with equal odds, goes on by matches, inserts (no bits) and deletes, and ends at any match.
    """
    n, length = codes.shape
    k = len(match)
    go, to, on, back = np.log2([1 - 2 * gaps.opened, gaps.opened, gaps.longer, 1 - gaps.longer])
    enter = -np.log2(k)
    none = np.full((n, 1), -np.inf)
    m = np.full((n, k), -np.inf)
    i, d, best = m.copy(), m.copy(), np.full(n, -np.inf)
    slope = np.arange(k) * on
    for at in range(length):
        before = np.maximum(np.maximum(m + go, i + back), d + back)
        i = np.maximum(m + to, i + on)
        m = match.T[codes[:, at]] + np.maximum(enter, np.hstack([none, before[:, :-1]]))
        # Deletes follow any match to the left in the same row: the best of match less its way so far.
        way = np.maximum.accumulate(m - slope, 1) + slope
        d = np.hstack([none, way[:, :-1] + to])
        np.maximum(best, m.max(1), out=best)
    return best


def forward(codes: np.ndarray, match: np.ndarray, gaps: Gaps = Gaps()) -> np.ndarray:
    """Bits of all paths together, each window's sums scaled at each place."""
    n, length = codes.shape
    k = len(match)
    odds = np.exp2(match)
    go, to, on, back = 1 - 2 * gaps.opened, gaps.opened, gaps.longer, 1 - gaps.longer
    # A position's windows lie side by side.
    m, i, d = (np.zeros((k, n)) for _ in range(3))
    enter, total, bits = np.full(n, 1 / k), np.zeros(n), np.zeros(n)
    for at in range(length):
        before = m * go + (i + d) * back
        i = m * to + i * on
        m = odds[:, codes[:, at]]
        m[0] *= enter
        m[1:] *= enter + before[:-1]
        d[0] = 0
        for j in range(1, k):
            np.add(m[j - 1] * to, d[j - 1] * on, out=d[j])
        total += m.sum(0)
        scale = np.maximum(m.max(0), total)
        scale[scale == 0] = 1
        for x in (m, i, d, enter, total):
            x /= scale
        bits += np.log2(scale)
    with np.errstate(divide="ignore"):
        return np.log2(total) + bits


def bias_bits(codes: np.ndarray, bias: Bias = Bias()) -> np.ndarray:
    """Bits of each window under the null model of two states over the background; other codes than the four residues have odds 1."""
    odds = np.ones(256)
    for x, v in bias.odds.items():
        odds[ord(x)] = v
    n, length = codes.shape
    plain, biased, bits = np.full(n, 1 - bias.enter), np.full(n, bias.enter), np.zeros(n)
    for at in range(length):
        if at:
            plain, biased = plain * (1 - bias.enter) + biased * (1 - bias.stay), plain * bias.enter + biased * bias.stay
        biased = biased * odds[codes[:, at]]
        scale = plain + biased
        plain, biased, bits = plain / scale, biased / scale, bits + np.log2(scale)
    return bits


def gumbel_tail(score: np.ndarray, mu: float, lam: float) -> np.ndarray:
    return -np.expm1(-np.exp(-lam * (score - mu)))


def exponential_tail(score: np.ndarray, mu: float, lam: float) -> np.ndarray:
    return np.minimum(1.0, np.exp(-lam * (score - mu)))


def _turned() -> np.ndarray:
    turn = np.arange(256)
    for x, y in zip(b"ACGU", b"UGCA", strict=True):
        turn[x] = y
    return turn


def filtered(seqs: DataFrame, models: list[dict], thresholds: dict[str, float], *, strands: tuple[str, ...] = ("+", "-"), gaps: Gaps = Gaps(), bias: Bias = Bias(), step: int = STEP) -> DataFrame:
    """Windows of sequences (seq_id, seq) that pass the first filter, with their scores and the last stage that each passed.

    Models have name, consensus, mu and lambda (of ungapped scores, in their units), and may have viterbi_mu, forward_mu and bits_lambda.
    thresholds are P-values for f1 (ungapped), f2 (Viterbi), f3 (Forward) and f3b (Forward less the bias, where there is any).
    A window is a diagonal with a model's length before and after it, as far as the sequence goes. Null and empty sequences,
    and those shorter than a model, have no windows.
    """
    plain, turn = emissions(models), _turned()
    pad = ord("-")

    def scored(codes: np.ndarray, name: str, strand: str) -> dict[str, np.ndarray]:
        of = next(m for m in models if m["name"] == name)
        lam, match = of.get("bits_lambda", np.log(2)), plain[name].astype(float)
        if strand == "-":
            codes = turn[codes[:, ::-1]]
        n = len(codes)
        out = {"viterbi": np.full(n, np.nan), "forward": np.full(n, np.nan), "bias": np.full(n, np.nan), "stage": np.zeros(n, int)}
        left = np.arange(n)
        out["viterbi"][left] = viterbi(codes, match, gaps)
        left = left[gumbel_tail(out["viterbi"], of.get("viterbi_mu", of["mu"]), lam) <= thresholds["f2"]]
        out["stage"][left] = 1
        if len(left):
            out["forward"][left] = forward(codes[left], match, gaps)
            left = left[exponential_tail(out["forward"][left], of.get("forward_mu", of["mu"]), lam) <= thresholds["f3"]]
            out["stage"][left] = 2
        if len(left):
            out["bias"][left] = np.maximum(0, bias_bits(codes[left], bias))
            less = out["forward"][left] - out["bias"][left]
            left = left[exponential_tail(less, of.get("forward_mu", of["mu"]), lam) <= thresholds["f3b"]]
            out["stage"][left] = 3
        return out

    tables = {"+": plain, "-": {name: np.ascontiguousarray(t[::-1][:, turn]) for name, t in plain.items()}}

    def tile(codes: np.ndarray, start: int, name: str, strand: str) -> Iterator[tuple[np.ndarray, ...]]:
        """Starts, scores and letters of a tile's windows that pass the first filter."""
        of = next(m for m in models if m["name"] == name)
        k = len(of["consensus"])
        best = best_segments(codes[start : start + step + k - 1], tables[strand][name])
        at = np.flatnonzero(gumbel_tail(best.astype(float), of["mu"], of["lambda"]) <= thresholds["f1"])
        for first in range(0, len(at), CHUNK):
            lo = at[first : first + CHUNK] + start
            places = lo[:, None] + np.arange(-k, 2 * k)
            inside = (places >= 0) & (places < len(codes))
            yield lo, best[lo - start], np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], pad)

    def told(name: str, strand: str, waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        k = len(plain[name])
        every = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        for first in range(0, len(every[0]), CHUNK):
            ids, lo, best, windows = (x[first : first + CHUNK] for x in every)
            found, n = scored(windows, name, strand), len(lo)
            columns = [pa.array(ids, pa.int64()), pa.array([name] * n), pa.array([strand] * n), pa.array(lo + 1), pa.array(lo + k), pa.array(best.astype(np.int32))]
            columns += [pa.array(found[c], from_pandas=True) for c in ("viterbi", "forward", "bias")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([STAGES[s] for s in found["stage"]])], ["seq_id", "model", "strand", "lo", "hi", "ungapped", "viterbi", "forward", "bias", "stage"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Windows of many sequences are scored together.
        waiting: dict[tuple[str, str], list[tuple]] = {(name, strand): [] for strand in strands for name in plain}
        sizes = dict.fromkeys(waiting, 0)
        for batch in batches:
            for seq_id, seq in zip(batch.column("seq_id").to_pylist(), batch.column("seq"), strict=True):
                codes = np.frombuffer((seq.as_py() or "").encode("ascii", "replace"), np.uint8)
                for strand in strands:
                    for name, table in tables[strand].items():
                        for start in range(0, len(codes) - len(table) + 1, step):
                            for lo, best, windows in tile(codes, start, name, strand):
                                waiting[name, strand].append((np.full(len(lo), seq_id, object if seq_id is None else np.int64), lo, best, windows))
                                sizes[name, strand] += len(lo)
                                if sizes[name, strand] >= CHUNK:
                                    yield from told(name, strand, waiting[name, strand])
                                    waiting[name, strand], sizes[name, strand] = [], 0
        for (name, strand), rest in waiting.items():
            if rest:
                yield from told(name, strand, rest)

    return seqs.select("seq_id", "seq").filter("seq is not null and seq <> ''").mapInArrow(scan, WINDOWS)


def survivors(windows: DataFrame, models: list[dict], strands: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """(model, strand, stage, n, residues): how many windows passed each stage, and the residues of their diagonals; 0 where none did."""
    passed = windows.select("model", "strand", F.explode(F.slice(F.array(*map(F.lit, STAGES)), F.lit(1), F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int"))).alias("stage"), (F.col("hi") - F.col("lo") + 1).alias("n"))
    counted = passed.groupBy("model", "strand", "stage").agg(F.count("*").alias("n"), F.sum("n").alias("residues"))
    of = windows.sparkSession.createDataFrame([(m["name"], s, x) for m in models for s in strands for x in STAGES], "model string, strand string, stage string")
    return F.broadcast(of).join(counted, ["model", "strand", "stage"], "left").fillna(0, ["n", "residues"])


def search(seqs: DataFrame, models: list[dict], thresholds: dict[str, float], *, strands: tuple[str, ...] = ("+", "-"), report: float = 10.0, include: float = 0.01, gaps: Gaps = Gaps(), bias: Bias = Bias()) -> DataFrame:
    """Hits that pass all filters: diagonals valued by Forward bits less the bias, with their E-value and `included`.

    The search space is the residues of the strands searched. Of overlapping hits of one model on a strand the best stay.
    """
    z = len(strands) * (seqs.agg(F.sum(F.length("seq"))).first()[0] or 0)
    rows = [(m["name"], float(m.get("forward_mu", m["mu"])), float(m.get("bits_lambda", np.log(2)))) for m in models]
    tails = F.broadcast(seqs.sparkSession.createDataFrame(rows, "model string, mu double, lambda double"))
    passed = filtered(seqs, models, thresholds, strands=strands, gaps=gaps, bias=bias).filter(F.col("stage") == STAGES[-1])
    score = F.col("forward") - F.col("bias")
    evalue = F.least(F.lit(1.0), F.exp(-F.col("lambda") * (score - F.col("mu")))) * float(z)
    valued = passed.join(tails, "model").select("seq_id", "model", "strand", "lo", "hi", score.alias("score"), evalue.alias("evalue")).filter(F.col("evalue") <= report)
    kept = intervals.remove_overlaps(valued, ["seq_id", "strand", "model"], [F.desc("score"), F.asc("lo")], ["lo", "hi", "score", "evalue"])
    return kept.withColumn("included", F.col("evalue") <= include)
