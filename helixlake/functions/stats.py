"""Score statistics, as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The factor from natural to binary logarithms, the weight of the third null model, a score for impossible events.
LOG2E, OMEGA, IMPOSSIBLE = 1.44269504, 1.0 / 65536.0, -1e36


def log2_odds(p: Column, null: float = 0.25) -> Column:
    return F.when(p > 0, F.log(p / null) * LOG2E).otherwise(IMPOSSIBLE)


def exponential_survival(x: Column, mu: float, lam: float) -> Column:
    return F.when(x < mu, 1.0).otherwise(F.exp(-lam * (x - mu)))


def gumbel_cdf(x: Column, mu: float, lam: float) -> Column:
    return F.exp(-F.exp(-lam * (x - mu)))


def gumbel_survival(x: Column, mu: float, lam: float) -> Column:
    return -F.expm1(-F.exp(-lam * (x - mu)))


def evalue(score: Column, mu: float, lam: float, z: float, dbsize: float, nrandhits: int) -> Column:
    """Expected hits of at least this score in a database of z residues."""
    return exponential_survival(score, mu, lam) * (z / dbsize * nrandhits)


def score_of_evalue(e: Column, mu: float, lam: float, z: float, dbsize: float, nrandhits: int) -> Column:
    return mu + F.log(e / (z / dbsize * nrandhits)) / -lam


def null1(length: Column) -> Column:
    """Log probability of a length under the geometric null model."""
    return length * F.log(length / (length + 1.0)) + F.log(1.0 / (length + 1.0))


def null3(length: Column, frequencies: list[Column]) -> Column:
    """Bits by which a biased composition lowers a score; never below 0."""
    biased = sum((F.when(f > 0, f * length * F.log2(f / 0.25)).otherwise(0.0) for f in frequencies), F.lit(math.log2(OMEGA)))
    high = F.greatest(F.lit(0.0), biased)
    return high + F.log2(1.0 + F.pow(F.lit(2.0), -F.abs(biased)))


def composition_bias(n: Column, frequencies: list[Column]) -> Column:
    """Bits that n canonical residues of these frequencies carry over uniform ones; 0 for none."""
    return F.greatest(F.lit(0.0), n * sum((F.when(f > 0, f * F.log2(f / 0.25)).otherwise(0.0) for f in frequencies), F.lit(0.0)))


def exponential_cdf(x: Column, mu: float, lam: float) -> Column:
    return F.when(x < mu, 0.0).otherwise(-F.expm1(-lam * (x - mu)))


def exponential_log_survival(x: Column, mu: float, lam: float) -> Column:
    return F.when(x < mu, 0.0).otherwise(-lam * (x - mu))


def gumbel_log_pdf(x: Column, mu: float, lam: float) -> Column:
    y = lam * (x - mu)
    return math.log(lam) - y - F.exp(-y)


def gumbel_pdf(x: Column, mu: float, lam: float) -> Column:
    return F.exp(gumbel_log_pdf(x, mu, lam))


def gumbel_log_cdf(x: Column, mu: float, lam: float) -> Column:
    return -F.exp(-lam * (x - mu))


def gumbel_log_survival(x: Column, mu: float, lam: float) -> Column:
    return F.log(gumbel_survival(x, mu, lam))


def gumbel_inverse_cdf(p: Column, mu: float, lam: float) -> Column:
    return mu - F.log(-F.log(p)) / lam


def gumbel_inverse_survival(p: Column, mu: float, lam: float) -> Column:
    """Where the survival is p; log1p keeps small p exact."""
    return mu - F.log(-F.log1p(-p)) / lam


def scaled_score(p: Column, null: float = 0.25) -> Column:
    """Thousandths of bits as an integer; a fixed low value for impossible events."""
    return F.when(p > 0, F.floor(0.5 + 1000 * F.log2(p / null))).otherwise(-987654321).cast("long")


def probability_of_scaled(score: Column, null: float = 0.25) -> Column:
    return F.when(score == -987654321, 0.0).otherwise(null * F.pow(F.lit(2.0), score / 1000.0))


def log_sum2(a: Column, b: Column) -> Column:
    """log2(2^a + 2^b)."""
    return F.greatest(a, b) + F.log2(1.0 + F.pow(F.lit(2.0), -F.abs(a - b)))


def profile_score_of_evalue(e: Column, z: float, hit_length: int, mu: float, lam: float) -> Column:
    return mu + F.log(e / (z / hit_length)) / -lam


def profile_score_of_pvalue(p: Column, mu: float, lam: float) -> Column:
    return mu + F.log(p) / -lam


def profile_evalue(x: Column, z: float, hit_length: int, mu: float, lam: float) -> Column:
    return exponential_survival(x, mu, lam) * (z / hit_length)


def normalized(v: Column) -> Column:
    """A vector divided by its sum; uniform where that is 0."""
    total = F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    return F.transform(v, lambda x: F.when(total != 0, x / total).otherwise(1.0 / F.size(v)))


def entropy(p: Column) -> Column:
    """Bits of a vector of probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda t, x: t - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def relative_entropy(p: Column, q: Column) -> Column:
    """Bits of p against q; infinite where q has no room for p."""
    each = F.zip_with(p, q, lambda x, y: F.when(x <= 0, 0.0).when(y > 0, x * F.log2(x / y)).otherwise(float("inf")))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x)


#: Least target of the relative entropy of models with and without base pairs, and bits per position.
TARGET_PAIRS, TARGET_NO_PAIRS, SIGMA = 0.59, 0.38, 45.0


def target_relative_entropy(clen: Column, pairs: Column) -> Column:
    spread = (SIGMA - 1.44269504088896341 * F.log(2.0 / (clen * (clen + 1.0)))) / clen
    return F.greatest(spread, F.when(pairs > 0, TARGET_PAIRS).otherwise(TARGET_NO_PAIRS))


def lambda_estimate(length: Column, mean_relative_entropy: Column) -> Column:
    return math.log(2) + 1.44 / (length * mean_relative_entropy)


#: From which search space in Mb on (a millionth less is enough) which P-values pass each filter: F1, F2, F3 to F5.
#: Without F2 the filter is off.
TIERS = [(20000.0, 0.06, 0.02, 0.0002), (2000.0, 0.15, 0.15, 0.0002), (200.0, 0.15, 0.15, 0.0008), (20.0, 0.35, 0.15, 0.003), (2.0, 0.35, None, 0.005), (0.0, 0.35, None, 0.02)]
SLACK, MIDDLE = 1e-6, 0.02


def filter_thresholds(z_mb: Column, mode: Column) -> Column:
    """struct(f1, f2, f3, f4, f5) by search space and mode: "default", "rfam" (strictest tier always), "mid" (one
    threshold from F3 on, F1 and F2 off), "nohmm" or "max" (all off). A filter that is off lets every P-value up to 1 pass, f2 is null then."""
    row = lambda f1, f2, rest: F.struct(F.lit(f1).alias("f1"), F.lit(f2).cast("double").alias("f2"), *(F.lit(rest).alias(x) for x in ("f3", "f4", "f5")))
    by_size = F.when(F.lit(False), row(1.0, None, 1.0))
    for least, f1, f2, rest in TIERS[:-1]:
        by_size = by_size.when(z_mb >= least - SLACK, row(f1, f2, rest))
    by_size = by_size.otherwise(row(*TIERS[-1][1:]))
    return F.when(mode.isin("max", "nohmm"), row(1.0, None, 1.0)).when(mode == "mid", row(1.0, None, MIDDLE)).when(mode == "rfam", row(*TIERS[0][1:])).otherwise(by_size)


def uses_profile_only(never: Column, glocal: Column, always: Column, pairs: Column) -> Column:
    """Whether a model is searched by its profile alone: never wins, then glocal, then always, then no base pairs."""
    return F.when(never | glocal, False).otherwise(always | (pairs == 0))


#: Passes of a search, by index: standard, 5' end, 3' end, both ends, any truncation.
PASSES = {1: "std", 2: "5p", 3: "3p", 4: "5p3p", 5: "any"}


def enforces_first(pass_idx: Column) -> Column:
    return pass_idx.isin(2, 4)


def enforces_last(pass_idx: Column) -> Column:
    return pass_idx.isin(3, 4)


def admits_truncation(pass_idx: Column, mode: Column, start: Column, stop: Column, first: Column, last: Column, spans: Column) -> Column:
    """Whether a hit of a mode (J, L or R) may be reported by a pass: a truncated end must be the sequence's own. spans tells
    whether a joint hit covers the model as a glocal search asks."""
    right = F.when(mode == "J", spans).when(mode == "L", stop == last).when(mode == "R", start == first).otherwise(False)
    return pass_idx.isin(1, 5) | ((start == first) & (stop == last)) | right
