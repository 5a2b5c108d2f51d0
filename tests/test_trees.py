"""Guide trees, states and length bands of models with bifurcations against known answers and plain recursions."""

import numpy as np
import pytest

from helixlake.operators import models, trees


def nodes_of(structure, rf=None):
    pairs = trees.consensus(structure, rf)
    return None if pairs is None else list(trees.guide(pairs))


def test_two_helices_split_between_them():
    found = nodes_of("<<__>><_>")
    assert [n[0] for n in found] == ["ROOT", "BIF", "BEGL", "MATP", "MATP", "MATL", "MATL", "END", "BEGR", "MATP", "MATL", "END"]
    assert found[1] == ("BIF", 0, 1, 9) and found[8] == ("BEGR", 1, 7, 9) and found[7] == ("END", 6, 5, 4)


def test_splits_are_as_even_as_they_can_be():
    # Three helices of 3, 3 and 6 positions: 6 and 6 beats 3 and 9; the left part is split again.
    found = nodes_of("<_><_><<__>>")
    assert [(n[0], n[2], n[3]) for n in found if n[0] in ("BIF", "BEGL", "BEGR")] == [("BIF", 1, 12), ("BEGL", 1, 6), ("BIF", 1, 6), ("BEGL", 1, 3), ("BEGR", 4, 6), ("BEGR", 7, 12)]


def test_unpaired_ends_go_left_first():
    assert [n[0] for n in nodes_of(":<_>::")] == ["ROOT", "MATL", "MATR", "MATR", "MATP", "MATL", "END"]


def test_insert_columns_letters_and_broken_brackets():
    assert [n[0] for n in nodes_of("<<..>>", "xx..x.")] == ["ROOT", "MATL", "MATP", "END"]
    assert [n[0] for n in nodes_of("<A_a>")] == ["ROOT", "MATP", "MATL", "MATL", "MATL", "END"]
    assert nodes_of("<<_>") is None and nodes_of(">") is None and [n[0] for n in nodes_of("")] == ["ROOT", "END"]


def test_tables_of_structures(spark):
    rows = spark.createDataFrame([(1, "<_><_>"), (2, None), (3, "<"), (4, "")], "model long, structure string")
    nodes = trees.guide_trees(rows)
    assert {r.model for r in nodes.select("model").distinct().collect()} == {1, 4}
    of = trees.states(nodes.filter("model = 1")).orderBy("v").collect()
    split = next(r for r in of if r.state == "B")
    begins = [r.v for r in of if r.state == "S" and r.node in ("BEGL", "BEGR")]
    assert [split.cfirst, split.cnum] == begins
    above = {r.v: r for r in trees.parents(trees.states(nodes.filter("model = 1"))).collect()}
    assert all(above[v].plast == split.v and above[v].pnum == 1 for v in begins) and above[0].plast == -1
    assert trees.length_bands(nodes.limit(0), trees.transitions(trees.states(nodes.limit(0)))).count() == 0


def plain_densities(of, t, begin, z):
    """P(length) of each state by its definition, length by length."""
    g = np.zeros((len(of), z + 1))
    for v in range(len(of) - 1, -1, -1):
        d = sum(models.EMITS[of[v].state])
        for n in range(z + 1):
            if of[v].state == "E":
                g[v, n] = n == 0
            elif of[v].state == "B":
                g[v, n] = sum(g[of[v].cfirst, k] * g[of[v].cnum, n - k] for k in range(n + 1))
            elif v == 0:
                g[v, n] = sum(begin.get(y, 0) * g[y, n] for y in range(1, len(of)))
            elif n >= d:
                g[v, n] = sum(p * g[of[v].cfirst + k, n - d] for k, p in enumerate(t[v]))
    return g


@pytest.mark.parametrize("structure", ["<_><<__>>:", "::<<___>>", "(<_>,<_><__>)"])
def test_length_bands_equal_the_plain_recursion(spark, structure):
    nodes = trees.guide_trees(spark.createDataFrame([(7, structure)], "model long, structure string"))
    of = trees.states(nodes).orderBy("v").collect()
    steps = trees.transitions(trees.states(nodes))
    t = {r.v: r.t for r in steps.collect()}
    assert all(sum(p) == pytest.approx(1) for p in t.values())
    first = {}
    for r in of:
        first.setdefault(r.nd, r.v)
    begin = {first[r.nd]: r.p for r in models.local_begins(nodes, 0.05).collect()}
    got = {r.v: r for r in trees.length_bands(nodes, steps).collect()}
    g = plain_densities(of, t, begin, 400)
    assert set(got) == {r.v for r in of} and got[0].dmax1 > len(structure) - 1
    for v, r in got.items():
        row = g[v] / max(1.0, g[v].sum())
        for k, beta in ((1, 1e-7), (2, 1e-15)):
            low = next(n for n in range(401) if row[: n + 1].sum() > beta)
            high = next(n for n in range(400, -1, -1) if row[n:].sum() > beta)
            assert (r[f"dmin{k}"], r[f"dmax{k}"]) == (low, high)
