"""Gapped filters against plain recursions and sums over all paths, and the cascade's bookkeeping."""

import itertools
import math

import numpy as np
import pytest

from helixlake.operators import cascade, search

MODELS = [{"name": "a", "consensus": "GGCAU", "mu": 1.0, "lambda": 0.7}, {"name": "b", "consensus": "ACGUUGCA", "mu": 2.0, "lambda": 0.7}]


def codes(text):
    return np.frombuffer(text.encode(), np.uint8)


def paths(seq, match, gaps):
    """The bits of every path: states and places, one by one."""
    k, go, to, on, back = len(match), 1 - 2 * gaps.opened, gaps.opened, gaps.longer, 1 - gaps.longer
    out = []

    def walk(kind, at, pos, bits):
        if kind == "M":
            out.append(bits)
        stay = {"M": (go, to, to), "I": (back, on, 0), "D": (back, 0, on)}[kind]
        for (new, da, dp), p in zip((("M", 1, 1), ("I", 1, 0), ("D", 0, 1)), stay, strict=True):
            a, q = at + da, pos + dp
            if p and a < len(seq) and q < k:
                walk(new, a, q, bits + math.log2(p) + (match[q][seq[a]] if new == "M" else 0))

    for at, pos in itertools.product(range(len(seq)), range(k)):
        walk("M", at, pos, -math.log2(k) + match[pos][seq[at]])
    return out


@pytest.mark.parametrize("text", ["GGCAU", "GGAU", "GGCCAU", "AACAA", "UAU"])
def test_filters_equal_all_paths(text):
    gaps = cascade.Gaps(0.1, 0.3)
    match = search.emissions(MODELS[:1])["a"].astype(float)
    every = paths(codes(text), match, gaps)
    window = np.stack([codes(text)] * 3)
    assert cascade.viterbi(window, match, gaps) == pytest.approx([max(every)] * 3)
    assert cascade.forward(window, match, gaps) == pytest.approx([math.log2(sum(2.0**b for b in every))] * 3)


def test_bias_equals_all_ways():
    bias = cascade.Bias(0.05, 0.8)
    text = "AAUCGN"
    total = 0.0
    for way in itertools.product((0, 1), repeat=len(text)):
        p = (1 - bias.enter, bias.enter)[way[0]]
        for a, b in itertools.pairwise(way):
            p *= ((1 - bias.enter, bias.enter), (1 - bias.stay, bias.stay))[a][b]
        for state, x in zip(way, text, strict=True):
            p *= bias.odds.get(x, 1.0) if state else 1.0
        total += p
    assert cascade.bias_bits(codes(text)[None, :], bias) == pytest.approx([math.log2(total)])


def test_long_windows_do_not_overflow():
    match = search.emissions([{"name": "x", "consensus": "ACGU" * 100}])["x"].astype(float)
    window = np.stack([codes("ACGU" * 300)])
    whole = 400 * 2 - math.log2(400) + 399 * math.log2(0.96)
    assert cascade.viterbi(window, match)[0] == pytest.approx(whole) and whole <= cascade.forward(window, match)[0] < 900


def test_cascade_counts_and_tiles(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACGU"), 400)) + "GGCAU" + "ACGUUGCA" * 3, "GGCAU", "GG", "", None, "AUGCC" * 30]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    thresholds = {"f1": 0.2, "f2": 0.05, "f3": 0.02, "f3b": 0.01}
    key = lambda r: (r.seq_id, r.model, r.strand, r.lo)
    found = {key(r): r for r in cascade.filtered(seqs, MODELS, thresholds).collect()}
    # Tiles make no difference, and a window's scores are those of its own letters.
    tiled = {key(r): r for r in cascade.filtered(seqs, MODELS, thresholds, step=37).collect()}
    assert found == tiled and {r.strand for r in found.values()} == {"+", "-"}
    plain = search.emissions(MODELS)
    turn = str.maketrans("ACGU", "UGCA")
    for (i, model, strand, lo), r in found.items():
        k = len(plain[model])
        text = "".join(texts[i][p] if 0 <= p < len(texts[i]) else "-" for p in range(lo - 1 - k, lo - 1 + 2 * k))
        window = codes(text if strand == "+" else text[::-1].translate(turn))[None, :]
        assert r.viterbi == pytest.approx(cascade.viterbi(window, plain[model].astype(float))[0]) and r.hi == lo + k - 1
        assert (r.forward is None) == (r.stage == "f1") and (r.bias is None) == (r.stage in ("f1", "f2"))
    table = {(r.model, r.strand, r.stage): r.n for r in cascade.survivors(cascade.filtered(seqs, MODELS, thresholds), MODELS).collect()}
    for (model, strand, stage), n in table.items():
        assert n == sum(1 for r in found.values() if r.model == model and r.strand == strand and cascade.STAGES.index(r.stage) >= cascade.STAGES.index(stage))
    assert len(table) == 16
    empty = cascade.survivors(cascade.filtered(seqs.limit(0), MODELS, thresholds), MODELS).collect()
    assert {r.n for r in empty} == {0}


def test_search_keeps_the_best_of_overlapping_hits(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ACGU"), 200)) + "ACGUUGCA" + "".join(rng.choice(list("ACGU"), 200)) for _ in range(6)]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    thresholds = {"f1": 0.3, "f2": 0.3, "f3": 0.2, "f3b": 0.2}
    every = [r for r in cascade.filtered(seqs, MODELS, thresholds).collect() if r.stage == "f3b"]
    z, want = 2 * sum(map(len, texts)), set()
    for group in {(r.seq_id, r.strand, r.model) for r in every}:
        rows = sorted((r for r in every if (r.seq_id, r.strand, r.model) == group), key=lambda r: (-(r.forward - r.bias), r.lo))
        kept = []
        for r in rows:
            mu = next(m["mu"] for m in MODELS if m["name"] == r.model)
            if min(1, math.exp(-math.log(2) * (r.forward - r.bias - mu))) * z <= 500 and all(r.hi < k.lo or k.hi < r.lo for k in kept):
                kept.append(r)
                want.add((*group, r.lo))
    got = {(r.seq_id, r.strand, r.model, r.lo) for r in cascade.search(seqs, MODELS, thresholds, report=500.0).collect()}
    assert got == want and len(got) > 5
