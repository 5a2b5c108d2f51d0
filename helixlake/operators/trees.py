"""Models with bifurcations: guide trees from consensus structures, their states and positions, and length bands of all states.

A structure is a row of a table, and its tree a row for each node; states, parents and positions are windows and joins over nodes.
Only what must follow a structure's nesting, or a model's states from its ends upwards, runs in a task by model: the group
is a model's size, not the data's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.operators import models

NODES = "model long, nd int, node string, parent int, i int, j int"
NODE = [c.split()[0] for c in NODES.split(", ")]
BANDS = "model long, v int, dmin1 int, dmax1 int, dmin2 int, dmax2 int"
#: Symbols of gaps in a reference line: its other columns are consensus columns.
GAPS = ".-_~"


def partners(structure: str) -> list[int] | None:
    """The partner of each position (from 1; 0 for none) by brackets; letters of pseudoknots pair nothing. None if brackets do not match."""
    closes, opened, found = dict(zip(">)]}", "<([{", strict=True)), [], [0] * (len(structure) + 1)
    for at, c in enumerate(structure, 1):
        if c in "<([{":
            opened.append(at)
        elif c in closes:
            if not opened:
                return None
            found[at] = opened.pop()
            found[found[at]] = at
    return None if opened else found


def consensus(structure: str, rf: str | None) -> list[int] | None:
    """Partners among consensus columns only, numbered anew; a pair with an insert column is none."""
    pairs = partners(structure)
    if pairs is None or rf is None:
        return pairs
    number, n = [0] * len(pairs), 0
    for at in range(1, len(pairs)):
        if at <= len(rf) and rf[at - 1] not in GAPS:
            n += 1
            number[at] = n
    return [0, *(number[pairs[at]] for at in range(1, len(pairs)) if number[at])]


def guide(pairs: list[int]) -> Iterator[tuple[str, int, int, int]]:
    """(node, parent, i, j) in preorder: what each node does with the positions i to j.

    Positions without a partner go first at the left, then at the right; then comes a pair of both ends, or else a split
    between two helices into parts of the most equal sizes (of equally good ones the first).
    """
    todo = [(-1, 1, len(pairs) - 1, "ROOT")]
    nd = -1
    while todo:
        parent, i, j, kind = todo.pop()
        nd += 1
        below = (i, j)
        if kind:
            pass
        elif i > j:
            kind = "END"
        elif not pairs[i]:
            kind, below = "MATL", (i + 1, j)
        elif not pairs[j]:
            kind, below = "MATR", (i, j - 1)
        elif pairs[i] == j:
            kind, below = "MATP", (i + 1, j - 1)
        else:
            kind = "BIF"
        yield kind, parent, i, j
        if kind == "BIF":
            splits, k = [], pairs[i] + 1
            while k <= pairs[j]:
                splits.append((abs((k - i) - (j - k + 1)), k))
                while not pairs[k]:
                    k += 1
                k = pairs[k] + 1
            k = min(splits)[1]
            todo += [(nd, k, j, "BEGR"), (nd, i, k - 1, "BEGL")]
        elif kind != "END":
            todo.append((nd, *below, ""))


def guide_trees(structures: DataFrame) -> DataFrame:
    """(model, nd, node, parent, i, j) of every node of structures (model, structure, and rf if columns may be inserts), in preorder.

    i and j are consensus positions. A null structure, and one whose brackets do not match, has no nodes; an empty one has a
    root and an end.
    """
    lines = structures if "rf" in structures.columns else structures.withColumn("rf", F.lit(None).cast("string"))

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for model, structure, rf in zip(batch["model"], batch["structure"], batch["rf"], strict=True):
                pairs = consensus(structure, rf)
                if pairs is not None:
                    found += [(model, nd, *node) for nd, node in enumerate(guide(pairs))]
                # A frame for many models, of bounded size but for a single long one.
                if len(found) > 50_000:
                    yield pd.DataFrame(found, columns=NODE)
                    found = []
            if found:
                yield pd.DataFrame(found, columns=NODE)

    return lines.filter("structure is not null").select("model", "structure", "rf").mapInPandas(built, NODES)


def states(nodes: DataFrame) -> DataFrame:
    """models.states of trees (model, nd, node, parent)."""
    return models.states(nodes)


def edges(of: DataFrame) -> DataFrame:
    """(model, v, k, child) of all connections of states."""
    split = F.col("state") == "B"
    children = F.when(split, F.array("cfirst", "cnum")).when(F.col("cnum") > 0, F.sequence(F.col("cfirst"), F.col("cfirst") + F.col("cnum") - 1))
    return of.select("model", "v", F.posexplode(children).alias("k", "child"))


def parents(of: DataFrame) -> DataFrame:
    """(model, v, plast, pnum): the last of the states that lead to a state, and how many do; -1 and 0 for none."""
    found = edges(of).groupBy("model", F.col("child").alias("v")).agg(F.max("v").alias("plast"), F.count("*").alias("pnum"))
    return of.select("model", "v").join(found, ["model", "v"], "left").select("model", "v", F.coalesce("plast", F.lit(-1)).alias("plast"), F.coalesce("pnum", F.lit(0)).alias("pnum"))


def emit_map(nodes: DataFrame) -> DataFrame:
    """(model, nd, node, lpos, rpos): what each node covers, from the left position that it emits or the one before its own, to the
    right one that it emits or the one after its own."""
    left, right = F.col("node").isin("MATP", "MATL").cast("int"), F.col("node").isin("MATP", "MATR").cast("int")
    lpos, rpos = F.col("i") - 1 + left, F.col("j") + 1 - right
    return nodes.select("model", "nd", "node", lpos.alias("lpos"), rpos.alias("rpos"))


def transitions(of: DataFrame, weight: int = 8) -> DataFrame:
    """(model, v, t): probabilities of a state's connections by order; the first state of a node weighs `weight`, others 1."""
    # A state goes to inserts of its own node first, and then to the next node's states, the first of which is that node's first.
    inserts = F.element_at(F.create_map(*(F.lit(x) for k, v in models.STATES.items() for x in (k, sum(s in ("IL", "IR") for s in v)))), F.col("node"))
    own = F.when(F.col("state") == "IR", 1).otherwise(inserts)
    total = F.col("cnum") + F.when(F.col("cnum") > own, weight - 1).otherwise(0)
    share = F.transform(F.sequence(F.lit(0), F.col("cnum") - 1), lambda k: F.when(k == own, weight).otherwise(1) / total)
    return of.filter("state <> 'B' and cnum > 0").select("model", "v", share.alias("t"))


def densities(kinds: list[str], first: list[int], number: list[int], t: list, begin: np.ndarray, z: int, most: float) -> np.ndarray | None:
    """For each state the probability of every length from 0 to z of what it and those below it emit; None if z is too small."""
    found = np.zeros((len(kinds), z + 1))
    for v in range(len(kinds) - 1, -1, -1):
        g, d = found[v], sum(models.EMITS[kinds[v]])
        if kinds[v] == "E":
            g[0] = 1.0
            continue
        if kinds[v] == "B":
            g[:] = np.convolve(found[first[v]], found[number[v]])[: z + 1]
        elif v:
            again = 0.0
            for k, p in enumerate(t[v]):
                y = first[v] + k
                if y == v:
                    again = p
                else:
                    g[d:] += p * found[y, : z + 1 - d]
            # An insert that leads to itself: all numbers of repeats, twice as many in each step.
            while again and d <= z:
                g[d:] += again * g[:-d].copy()
                again, d = again * again, 2 * d
        else:
            g[:] = begin @ found
        total = g.sum()
        if total <= 0.999 or g[z] > most * np.finfo(float).eps:
            return None
        if total > 1:
            g /= total
    return found


def bounds(found: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest length of each state beyond which either tail has more than beta."""
    low, high = np.cumsum(found, 1) > beta, np.cumsum(found[:, ::-1], 1) > beta
    return low.argmax(1), found.shape[1] - 1 - high.argmax(1)


def length_bands(nodes: DataFrame, t: DataFrame, *, beta1: float = 1e-7, beta2: float = 1e-15, beta_w: float = 1e-7, internal: float = 0.05) -> DataFrame:
    """(model, v, dmin1, dmax1, dmin2, dmax2): for every state of trees the lengths that all but beta1 and beta2 of its mass have.

    t has the transitions (model, v, t). Densities start from four times the consensus length and double until no state's
    tail is cut off; null bands where a thousand times it does not do (as where the local begins do not sum to 1).
    """
    carried = nodes.withColumn("begin", models.begin_share(internal))
    columns = F.element_at(F.create_map(*(F.lit(x) for k in models.STATES for x in (k, models.COLUMNS.get(k, 0)))), F.col("node"))
    of = models.linked(carried, "begin").withColumn("own", F.row_number().over(Window.partitionBy("model", "nd").orderBy("v")) == 1)
    state = F.struct("v", "state", "cfirst", "cnum", F.when(F.col("own"), F.col("begin")).otherwise(0.0).alias("begin"))
    whole = of.groupBy("model").agg(F.array_sort(F.collect_list(state)).alias("of"), F.sum(F.when(F.col("own"), columns).otherwise(0)).alias("clen"))
    # Both sides lie by model already; their size is the number of states, far from what their files let expect, so neither is broadcast.
    steps = t.groupBy("model").agg(F.collect_list(F.struct("v", "t")).alias("steps"))
    rows = whole.join(steps.hint("merge"), "model", "left")
    most = max(beta1, beta2, beta_w)

    def banded(states: list[dict], steps: list[dict], clen: int) -> list[np.ndarray]:
        moves = {x["v"]: x["t"] for x in steps}
        n = max(1, clen)
        z, found = 4 * n, None
        while found is None and z <= 1000 * n:
            found = densities([x["state"] for x in states], [x["cfirst"] for x in states], [x["cnum"] for x in states], [moves.get(x["v"], []) for x in states], np.array([x["begin"] for x in states]), z, most)
            z *= 2
        if found is None:
            return [np.ma.masked_all(len(states), np.int32)] * 4
        return [x.astype(np.int32) for beta in (beta1, beta2) for x in bounds(found, beta)]

    def of_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128).to_pylist()
                bands = [banded(m["of"], m["steps"] or [], m["clen"]) for m in part]
                ids = np.repeat([m["model"] for m in part], [len(m["of"]) for m in part]).astype(np.int64)
                v = np.array([x["v"] for m in part for x in m["of"]], np.int32)
                found = [np.ma.concatenate([b[k] for b in bands]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v), *(pa.array(x.data, mask=np.ma.getmaskarray(x)) for x in found)], names=[c.split()[0] for c in BANDS.split(", ")])

    return rows.select("model", "of", "steps", "clen").mapInArrow(of_models, BANDS)
