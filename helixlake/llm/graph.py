"""Connected components of a graph of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm._shared import HOT_KEYS, HOT_ROWS, discard, joined, saved


class Forest:
    """Union-find over positions 0 to n - 1, for the links inside one task."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that it can reach.

    Every round each id takes the smallest label among its neighbours and then the label of that label, so paths
    halve. Labels are written every round. Ids with very many neighbours, and labels that very many ids share, meet a
    broadcast table of such ids only. An empty table gives an empty one.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"), "n", F.lit(True).alias("changed")))
    total, degree = labels.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(HOT_ROWS, total // HOT_KEYS)
    while True:
        # One look at the labels tells whether any changed, and whether one is shared by so many that it needs care.
        sharing, changed = labels.groupBy("label").agg(F.count("*").alias("k"), F.max("changed").alias("c")).agg(F.max("k"), F.max("c")).first()
        if not changed:
            discard(both)
            return labels.select("id", F.col("label").alias("component"))
        of_b = labels.select(F.col("id").alias("b"), F.col("label").alias("of_b"), "n")
        met = joined(both, of_b, "b", "n", total) if degree > most else both.join(of_b.drop("n"), "b")
        near = met.groupBy(F.col("a").alias("id")).agg(F.min("of_b").alias("near"))
        stepped = labels.join(near, "id").select("id", "n", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        of_to = labels.select(F.col("id").alias("to"), F.col("label").alias("of_to"))
        if crowded := 8 * sharing > most:
            stepped = saved(stepped)
            jumped = joined(stepped, of_to.join(stepped.groupBy("to").agg(F.count("*").alias("k")), "to"), "to", "k", total)
        else:
            jumped = stepped.join(of_to, "to")
        label = F.least("to", "of_to")
        new = saved(jumped.select("id", label.alias("label"), "n", (label < F.col("old")).alias("changed")))
        discard(labels)
        if crowded:
            discard(stepped)
        labels = new
