"""Mixture-Dirichlet priors over count vectors, as built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight and parameters of each component: a vector of probabilities is drawn from one of them.
Mixture = list[tuple[float, list[float]]]
#: Terms of Stirling's series beyond which its error is below double precision for arguments of 8 and more.
SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: Column) -> Column:
    """Log of the gamma function of a positive argument: Stirling's series eight places further, taken back by the product between."""
    y = x + 8.0
    back = x
    for k in range(1, 8):
        back = back * (x + float(k))
    series = sum((F.lit(c) / F.pow(y, F.lit(2.0 * k + 1)) for k, c in enumerate(SERIES)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(back)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value bound to a variable, since an expression is evaluated wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def posterior(counts: Column, mixture: Mixture) -> Column:
    """The mean posterior probabilities (array<double>) of a column of counts (array<double>) under a mixture.

    Without counts that is the mixture's mean; null counts have a null posterior. Each component's mean posterior weighs
    as much as the counts make it likely.
    """
    known = lambda q, a: math.log(q) + math.lgamma(sum(a)) - sum(map(math.lgamma, a))
    parts = F.array(*(F.struct(F.lit(float(known(q, a))).alias("known"), F.array(*(F.lit(float(x)) for x in a)).alias("alpha"), F.lit(float(sum(a))).alias("total")) for q, a in mixture))

    def logs(c: Column, n: Column) -> Column:
        likely = lambda m: _sum(F.transform(F.zip_with(c, m["alpha"], lambda x, a: x + a), log_gamma))
        return F.transform(parts, lambda m: m["known"] + likely(m) - bound(n + m["total"], log_gamma))

    def means(c: Column, n: Column, w: Column) -> Column:
        shares = F.zip_with(w, parts, lambda x, m: x / (n + m["total"]))
        # The counts' part of the mean, and the components' own.
        own = lambda i: _sum(F.zip_with(shares, parts, lambda x, m: x * F.get(m["alpha"], i)))
        return bound(_sum(w), lambda s: bound(_sum(shares), lambda t: F.transform(c, lambda x, i: (x * t + own(i)) / s)))

    weights = lambda c, n: bound(logs(c, n), lambda all_: bound(F.array_max(all_), lambda top: F.transform(all_, lambda x: F.exp(x - top))))
    found = bound(counts, lambda c: bound(_sum(c), lambda n: bound(weights(c, n), lambda w: means(c, n, w))))
    return F.when(counts.isNotNull(), found)


def log_gammas(x: np.ndarray) -> np.ndarray:
    """The same as log_gamma, of many numbers."""
    y, back = x + 8.0, x.copy()
    for k in range(1, 8):
        back *= x + k
    square, power = y * y, y.copy()
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) - np.log(back)
    for c in SERIES:
        out += c / power
        power *= square
    return out


def posteriors(counts: np.ndarray, mixture: Mixture) -> np.ndarray:
    """The same as posterior, of many vectors of counts (rows)."""
    n = counts.sum(1)
    # Components share many of their parameters.
    of = {x: log_gammas(counts + x) for x in {float(x) for _, a in mixture for x in a}}
    whole = {t: log_gammas(n + t) for t in {float(sum(a)) for _, a in mixture}}
    known = [math.log(q) + math.lgamma(sum(a)) - sum(map(math.lgamma, a)) for q, a in mixture]
    logs = np.stack([k + sum(of[float(x)][:, i] for i, x in enumerate(a)) - whole[float(sum(a))] for k, (_, a) in zip(known, mixture, strict=True)])
    weights = np.exp(logs - logs.max(0))
    weights /= weights.sum(0)
    return sum(w[:, None] * (counts + np.array(a, float)) / (n + sum(a))[:, None] for w, (_, a) in zip(weights, mixture, strict=True))
