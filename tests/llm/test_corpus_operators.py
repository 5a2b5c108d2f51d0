"""Passage removal, resampling and whitening against plain versions, with nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helixlake.llm import passages, resampling, whitening

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed + i) % 11) for i in range(n))


def plain_passages(rows, length=13):
    """(doc_id, text) -> (doc_id, words, removed, kept words)."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages_found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = passages.with_removed(docs)
    out = []
    for r in found.collect():
        words, n = passages.kept(r.text, r.removed)
        out.append((r.doc_id, n, n - len(words), b" ".join(words).decode()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_passages_equal_brute_force(spark):
    shared, long_word = sentence(3, 40), "x" * 5000
    rows = [
        (5, sentence(1, 30)), (2, sentence(2, 20) + " " + shared), (9, shared + "\t" + sentence(4, 15)), (7, "ä " * 3 + shared.replace(" ", "\n\n")),
        (8, None), (10, ""), (11, "few words"), (12, sentence(3, 12)), (13, sentence(3, 13)), (14, f"{long_word} " * 15), (15, f"{long_word} " * 13 + "end"),
        (16, "same " * 50), (17, "same same " * 20), (None, shared), (None, sentence(8, 25)), (20, sentence(8, 25)), (2, sentence(9, 25)), (21, sentence(9, 25)),
        (22, sentence(10, 30)), (22, sentence(10, 30)), (22, sentence(11, 14)), (23, "　".join(WORDS) + " " + sentence(10, 20)),
    ]
    assert order(passages_found(spark, rows)) == order(plain_passages(rows))


def test_passages_of_many_copies(spark):
    """Copies in every task: settled where they are, or by digest; a long text is one part."""
    rows = [(i, sentence(1, 200) if i % 3 else sentence(i, 60)) for i in range(400)] + [(1000, sentence(5, 30_000))]
    assert order(passages_found(spark, rows)) == order(plain_passages(rows))


def test_passages_edges(spark):
    assert passages.with_removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, sentence(1, 20), "a", 1), (2, sentence(1, 20) + " more", "b", 2)], "doc_id int, text string, removed string, bucket int")
    found = {r.doc_id: r for r in passages.deduplicated(rows).collect()}
    assert found[1].text == sentence(1, 20) and found[2].text == "more" and found[2].bucket == 2
    assert "removed" not in found[1]


def test_sketch_codes():
    at = np.array([0, 3, 254, 255, 600, 5, 1000], np.int64)
    stretch = np.array([0, 0, 0, 0, 0, 1, 1])
    blobs = passages.coded(at, stretch, np.array([0, 5]))
    assert [passages.decoded(b).tolist() for b in blobs] == [[0, 3, 254, 255, 600], [5, 1000]]
    ids, low = np.array([7, 7, 9]), np.array([1, 2, 3], np.uint32)
    for high in ([1, 2, 1 << 60], [5, 1 << 40, (1 << 40) + 3]):
        high = np.array(high, np.uint64)
        for back, sent in zip(passages.unpacked(passages.packed(ids, high, low)), (ids, high, low), strict=True):
            assert back.tolist() == sent.tolist()


def plain_resampling(rows, target, buckets=10_000, least=20, percent=25):
    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    each = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    a, g = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (a + buckets) / ((s[b] + 1.0) * (g + buckets)))) for b in s}
    out = []
    for i, w, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    drawn = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def test_resampling_equals_brute_force(spark):
    rows = [(i, sentence(i % 17, 5 + i % 40)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "?!"), (203, "Ünïcode ÄÖ ñandú 東京 " * 8), (None, sentence(3, 30)), (204, "a" * 3000), (5, sentence(5, 50))]
    target = [sentence(2, 80), None, "", "ALPHA1 beta2"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = resampling.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()]
    assert order(got) == order(plain_resampling(rows, target))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(1 for r in got if r[4]) + 1))


def test_resampling_ties_repeats_and_empty(spark):
    """Of repeated rows each is a document; equal scores are ranked in some order, without gaps."""
    rows = [(1, sentence(1, 30))] * 8
    target = spark.createDataFrame([], "text string")
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id int, text string, bucket string, row int")
    got = resampling.resampled(docs, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and {r.n_features for r in got} == {59}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(empty, target).count() == 0
    only_short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r["rank"] for r in resampling.resampled(only_short, target).collect()} == {None}
    three = resampling.resampled(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), target, longest=3, least=1, percent=100).first()
    assert (three.n_features, three["rank"]) == (6, 1)


def plain_whitening(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return deviation, np.abs(c @ axes / np.sqrt(values)), values / np.trace(c.T @ c / n)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 12)) * np.linspace(0.2, 3, 12) + 2).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(good)]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, n string").repartition(4)
    deviation, wanted, share = plain_whitening(good)
    got = {r.vec_id: r for r in whitening.whitened(frame).collect()}
    assert sorted(got) == list(range(300))
    for i, r in got.items():
        assert int(r.deviation) == deviation[i] and r.n == 300
        assert np.abs(r.whitened) == pytest.approx(wanted[i], abs=1e-6)
        assert r.explained == pytest.approx(share.tolist(), rel=1e-9) and r.identity_error < 1e-9
    signs = np.array([got[i].whitened for i in range(300)])
    assert np.abs(signs.T @ signs / 300 - np.eye(8)).max() < 1e-9


def test_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whitened(frame([])).count() == 0
    assert whitening.whitened(frame([(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0])] * 5)).count() == 0
    # Repeated rows and null ids are rows of their own; a constant dimension has no component.
    got = whitening.whitened(frame([(1, [0.0, 5.0, 1.0]), (1, [0.0, 5.0, 1.0]), (None, [1.0, 5.0, 0.5]), (4, [2.0, 5.0, 7.0])])).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "4", "None"] and {len(r.whitened) for r in got} == {2}
    # Entries far from zero: sums and deviations are exact beyond 64 bits.
    far = whitening.whitened(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [4e9, 2.0])])).collect()
    x = [[(1 << 52) + 100_000, 100_000], [-(1 << 52) + 100_000, 101_024], [4_000_000_000 * 1024 + 100_000, 102_048]]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in far} == {i + 1: sum((3 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}
