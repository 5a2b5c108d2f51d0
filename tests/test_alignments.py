"""Alignments whose rows spell out gaps, priors and entropy weighting, against literal values and plain sums."""

import math

import pytest
from pyspark.sql import functions as F

from helixlake.functions import priors
from helixlake.operators import columns, weighting

ROWS = [(1, "AC..GU"), (2, "UG..CA"), (3, "---.G-")]
MIXTURE = [(0.6, [3.0, 0.5, 0.5, 0.5]), (0.4, [1.0, 1.0, 1.0, 1.0])]


@pytest.fixture(scope="module")
def aln(spark):
    return spark.createDataFrame([("f", i, r) for i, r in ROWS], "aln_id string, seq_id long, row string")


def test_gaps_are_never_equal(aln):
    found = {(r.s1, r.s2): r.pid for r in columns.identities(aln, every=1).collect()}
    assert found[1, 2] == 0 and found[1, 3] == 1 and found[2, 3] == 0


def test_spans_go_from_first_to_last_residue(spark, aln):
    assert {r.seq_id: (r.first, r.span, r.fragment) for r in columns.fragments(aln).collect()} == {1: (1, 6, False), 2: (1, 6, False), 3: (5, 1, True)}
    edges = spark.createDataFrame([("f", 1, "~~AC-GU~~"), ("f", 2, "---------"), ("f", 3, "")], "aln_id string, seq_id long, row string")
    assert {r.seq_id: r.span for r in columns.fragments(edges).collect()} == {1: 5, 2: 0, 3: 0}


def test_columns_of_gaps_are_no_consensus(spark, aln):
    assert sorted(r.apos for r in columns.consensus_columns(aln).collect()) == [1, 2, 5, 6]
    # Rows that are no fragments hold gaps inside; the ends of a fragment are missing data.
    rows = spark.createDataFrame([("f", 1, "A.CGU"), ("f", 2, "A_CG."), ("f", 3, "ACC--"), ("f", 4, "..C..")], "aln_id string, seq_id long, row string")
    assert sorted(r.apos for r in columns.consensus_columns(rows).collect()) == [1, 3, 4]


def test_dots_and_dashes_are_one_kind_of_gap(aln):
    assert {(r.apos, r.residue): r.n for r in columns.counts(aln).collect() if r.apos in (3, 6)} == {(3, "-"): 3, (6, "U"): 1, (6, "A"): 1, (6, "-"): 1}


def plain_posterior(counts):
    logs = [math.log(q) + math.lgamma(sum(a)) - math.lgamma(sum(a) + sum(counts)) + sum(math.lgamma(c + x) - math.lgamma(x) for c, x in zip(counts, a, strict=True)) for q, a in MIXTURE]
    w = [math.exp(x - max(logs)) for x in logs]
    return [sum(v * (counts[i] + a[i]) / (sum(counts) + sum(a)) for v, (_, a) in zip(w, MIXTURE, strict=True)) / sum(w) for i in range(4)]


def test_log_gamma(spark):
    xs = [1e-6, 0.01, 0.5, 1.0, 2.0, 3.7, 25.0, 1e3, 1e7]
    found = spark.createDataFrame([(x,) for x in xs], "x double").select("x", priors.log_gamma(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11) for r in found)


def test_posteriors(spark):
    rows = [[0.0, 0.0, 0.0, 0.0], [5.0, 0.0, 1.0, 0.0], [0.0, 1e6, 3.0, 2.5], None]
    found = {r.i: r.posterior for r in spark.createDataFrame(list(enumerate(rows)), "i int, c array<double>").select("i", priors.posterior(F.col("c"), MIXTURE).alias("posterior")).collect()}
    assert found[3] is None and all(found[i] == pytest.approx(plain_posterior(rows[i]), rel=1e-9) for i in range(3))


def test_effective_numbers(spark):
    counts = {"a": [[40.0, 0.0, 0.0, 0.0], [0.0, 20.0, 20.0, 0.0]], "b": [[1.0, 1.0, 1.0, 1.0]], "c": [[9.0, 1.0, 0.0, 0.0]]}
    shape = {"a": 40, "b": 4, "c": 10}
    rows = spark.createDataFrame([(k, i, c) for k, v in counts.items() for i, c in enumerate(v)], "aln_id string, apos int, counts array<double>")
    found = weighting.effective_numbers(rows, spark.createDataFrame(list(shape.items()), "aln_id string, nseq long"), MIXTURE, 0.5)

    def bits(name, x):
        each = [plain_posterior([v * x / shape[name] for v in c]) for c in counts[name]]
        return sum(sum(p * math.log2(p / 0.25) for p in row) for row in each) / len(each)

    for r in found.collect():
        step = r.nseq / 16**3
        assert bits(r.aln_id, r.neff) <= 0.5 or r.neff == 0
        assert r.neff == r.nseq or bits(r.aln_id, r.neff + step) > 0.5
    assert {r.aln_id: r.neff == r.nseq for r in found.collect()} == {"a": False, "b": True, "c": False}
