"""Near-duplicates among embedding vectors by bounds in rotated subspaces.

Unit vectors with cosine of at least t are at a squared distance of at most 2 - 2t. All vectors are turned by one fixed random
rotation. Up to ONE_SPACE vectors meet in tiles: they are dealt into chunks by their ids, packed there into rows of many
vectors, and a tile holds two chunks, so a vector is shipped once a chunk. Of a pair, the squared distance in the
first LOOK coordinates is a lower bound of the whole; a matrix product gives it for many pairs at once, and few pass.

More vectors are split into blocks of a few dimensions; of the squared distance of a pair, at least one block
holds no more than its share by dimensions. So each block is range-joined under its share: a grid over
its first coordinates has cells twice as wide as the range; a vector is at home in one cell and visits those
that its range touches, towards larger cells only, so every pair meets in just one cell. A coordinate of the grid
leaves, by estimate, some two thirds of the pairs, for half as many rows more, and blocks are many: it pays only where pairs by far outweigh rows.
Cells with many vectors are split into tiles of two chunks each, too.

Pairs within the bound are verified in double precision on the whole vectors (where many are, a product in single precision
tells first which are far from the limit), and count only in the first block that has them. Equal vectors are one, which counts as many; tasks
return counts of links and a spanning forest of them, not pairs. So neither copies nor groups of near copies cost rows.

Defined results: a vector that is null, zero, or has null or non-finite components, has no links, and so has
one without an id; vectors of different lengths are never linked; of rows with equal ids one vector
counts (the smallest) and one row is returned; copies are linked with each other like other pairs. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import joined, saved, table
from helixlake.llm.graph import connected_components

BLOCK = 8
#: Coordinates whose squared distance is the bound of a pair.
LOOK = 16
#: Vectors in a chunk of a cell, and their components; a task holds two chunks. Without a grid, chunks of FEW make tiles for all cores, up to SPREAD.
CHUNK, COMPONENTS, FEW, SPREAD = 98_304, 6_291_456, 4_096, 8
#: More vectors than these are gridded.
ONE_SPACE = 4_000_000
#: Pairs of vectors whose bounds are computed at once, and the share of them within the bound that has the rest computed at once, too.
ROWS, COLUMNS, DENSE = 512, 2_048, 1 / 64
#: What single precision may be off in a squared distance of a block.
SLACK = 1e-5
KEYS = ["dim", "block", "cell"]


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, cosine: float, gridded: int) -> list[tuple[int, int, float]]:
    """(first, end, share of the squared distance) of each block of coordinates; all are one block without a grid."""
    n = -(-dim // BLOCK) if gridded else 1
    cuts = [dim * i // n for i in range(n + 1)]
    return [(a, b, (2 - 2 * cosine) * (b - a) / dim) for a, b in zip(cuts, cuts[1:], strict=False)]


def turned(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def narrow(x: np.ndarray) -> np.ndarray:
    """x in single precision if that loses nothing."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if (y == x).all() else x


def _cells(cosine: float, gridded: int, with_vectors: bool):
    """Rows (dim, block, cell, home, id, copies, vec) of every cell where a vector is at home or visits."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].map(len)):
                x = np.stack(part["vec"].to_list()).astype(np.float64)
                ids, copies = part["id"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
                y, raw = turned(x), [v.tobytes() for v in narrow(x)]
                for k, (first, end, share) in enumerate(blocks(dim, cosine, gridded)):
                    m = min(gridded, end - first)
                    reach = math.sqrt(share + SLACK)
                    width, c = 2.001 * reach, y[:, first : first + m]
                    key = lambda z, m=m: ((z + 1024) * (2048 ** np.arange(m - 1, -1, -1))).sum(1) if m <= 5 else ((z + 63) * (128 ** np.arange(m - 1, -1, -1))).sum(1)
                    low, high = np.floor((c - reach) / width).astype(np.int64), np.floor((c + reach) / width).astype(np.int64)
                    home = key(np.floor(c / width).astype(np.int64))
                    for mask in range(2**m):
                        up = np.array([mask >> j & 1 for j in range(m)], bool)
                        cell = key(np.where(up, high, low))
                        at = np.flatnonzero(((high != low) | ~up).all(1) & (cell >= home))
                        if len(at):
                            held = {"copies": copies[at], "vec": [raw[i] for i in at]} if with_vectors else {}
                            yield pd.DataFrame({"dim": dim, "block": k, "cell": cell[at], "home": (cell == home)[at], "id": ids[at]} | held)

    return cells


def joined_labels(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its tree) after the trees of p[i] and q[i] are joined, for all i at once."""
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
        label = parent[label]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, chunks, chunk, ids, copies, vecs) of the vectors of a batch that are of one chunk."""
    for batch in batches:
        dims, chunks, chunk, ids, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "chunks", "chunk", "id", "copies"))
        values = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(dims, dtype=np.int64) - dims
        order = np.lexsort((chunk, dims))
        cuts = np.flatnonzero(np.diff(dims[order]) | np.diff(chunk[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            dim = int(dims[at[0]])
            x = values[starts[at][:, None] + np.arange(dim)]
            held = {"dim": dim, "chunks": int(chunks[at[0]]), "chunk": int(chunk[at[0]]), "ids": ids[at], "copies": copies[at], "vecs": narrow(x).tobytes()}
            types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held.values(), types, strict=True)], list(held))


class _Bound:
    """Places in the product of up to ROWS and COLUMNS rows where it is at most a limit; buffers are kept, since new ones cost as much as the product."""

    def __init__(self) -> None:
        self.product, self.mask = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS + 64, bool)

    def places(self, left: np.ndarray, right: np.ndarray, limit: float) -> np.ndarray:
        n, shape = len(left) * len(right), (len(left), len(right))
        np.less_equal(np.matmul(left, right.T, out=self.product[:n].reshape(shape)), limit, out=self.mask[:n].reshape(shape))
        self.mask[n : n + 64] = False
        # Few are true: 64 are looked at together.
        words = np.flatnonzero(np.packbits(self.mask[: n + -n % 64]).view(np.uint64))
        at = (64 * words[:, None] + np.arange(64)).ravel()
        return at[self.mask[at]]


def _links(cosine: float, gridded: int):
    def links(key: tuple, group: pa.Table) -> pa.Table:
        dim, block, _, i, j = (k.as_py() for k in key)
        sizes = pc.list_value_length(group["ids"]).to_numpy()
        ids, copies = (pc.list_flatten(group[c]).to_numpy() for c in ("ids", "copies"))
        home, chunk = (np.repeat(group[c].to_numpy(), sizes) for c in ("home", "chunk"))
        raw = group["vecs"].to_pylist()
        x = np.concatenate([np.frombuffer(v, np.float32 if len(v) == 4 * dim * n else np.float64).reshape(n, dim) for v, n in zip(raw, sizes, strict=True)])
        del raw, group
        parts = blocks(dim, cosine, gridded)
        first, end, share = parts[block]
        step = max(1, 2_097_152 // dim)
        norm, z = np.empty(len(x)), np.empty((len(x), min(LOOK, end - first)), np.float32)
        axes = rotation(dim)[:, first : first + z.shape[1]]
        for k in range(0, len(x), step):
            v = x[k : k + step].astype(np.float64)
            norm[k : k + step] = np.linalg.norm(v, axis=1)
            z[k : k + step] = (v / norm[k : k + step, None]) @ axes
        square, ones = (z * z).sum(1, keepdims=True), np.ones((len(z), 1), np.float32)
        # One product gives the squared distances in the coordinates that are looked at.
        mine, theirs = np.hstack([-2 * z, square, ones]), np.hstack([z, ones, square])
        counts, label, waiting, waits = np.zeros(len(x), np.int64), np.arange(len(x)), [], 0
        unit = lambda at: (x[at] / norm[at, None]).astype(np.float32)
        fuzz = 1e-6 + 1.2e-7 * dim
        at = [[np.flatnonzero((chunk == c) & (home == h)) for h in (True, False)] for c in (i, j)]
        # Two visitors of a cell do not meet in it.
        sides = [(at[0][0], at[0][0]), (at[0][0], at[0][1])] if i == j else [(at[0][0], np.concatenate(at[1])), (at[0][1], at[1][0])]
        bound = _Bound()
        for left, right in sides:
            of_left, of_right = mine[left], theirs[right]
            for r, c in ((r, c) for r in range(0, len(left), ROWS) for c in range(r if left is right else 0, len(right), COLUMNS)):
                rows, cols = left[r : r + ROWS], right[c : c + COLUMNS]
                near, sure = bound.places(of_left[r : r + ROWS], of_right[c : c + COLUMNS], share + SLACK), None
                if len(near) > DENSE * len(rows) * len(cols):
                    product = (unit(rows) @ unit(cols).T).ravel()
                    near = np.flatnonzero(product >= cosine - fuzz)
                    sure = product[near] >= cosine + fuzz
                for k in range(0, len(near), step):
                    p, q = rows[near[k : k + step] // len(cols)], cols[near[k : k + step] % len(cols)]
                    ok = np.zeros(len(p), bool) if sure is None else sure[k : k + step]
                    if left is right:
                        p, q, ok = p[p < q], q[p < q], ok[p < q]
                    unsure = np.flatnonzero(~ok)
                    a, b = p[unsure], q[unsure]
                    ok[unsure] = np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64)) / (norm[a] * norm[b]) >= cosine
                    p, q = p[ok], q[ok]
                    if len(parts) > 1 and len(p):
                        d = ((x[p] / norm[p, None] - x[q] / norm[q, None]) @ rotation(dim)) ** 2
                        holds = np.stack([d[:, s:e].sum(1) <= w + SLACK / 10 for s, e, w in parts], 1)
                        here = holds.argmax(1) == block
                        p, q = p[here], q[here]
                    np.add.at(counts, p, copies[q])
                    np.add.at(counts, q, copies[p])
                    apart = label[p] != label[q]
                    waiting.append((p[apart], q[apart]))
                    waits += int(apart.sum())
                    if waits > 65_536:
                        label, waiting, waits = joined_labels(label, *map(np.concatenate, zip(*waiting, strict=True))), [], 0
        if waits:
            label = joined_labels(label, *map(np.concatenate, zip(*waiting, strict=True)))
        linked = np.flatnonzero(counts)
        return pa.table({"a": ids[linked], "b": ids[label[linked]], "n": counts[linked]})

    return links


def _tiles(single: DataFrame, cosine: float, gridded: int) -> DataFrame:
    """Rows (dim, block, cell, i, j, chunk, home, ids, copies, vecs) of vectors of chunk i or j of a cell; without a grid all of one length are one cell."""
    held = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(COMPONENTS) / F.col("dim"))))
    chunks, chunk = F.ceil(F.col("count") / held), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    if gridded:
        keys = "dim int, block int, cell long, home boolean, id long"
        sizes = single.mapInPandas(_cells(cosine, gridded, False), keys).groupBy(*KEYS).count()
        large = saved(sizes.select(*KEYS, chunks.cast("int").alias("chunks")).filter("chunks > 1"))
        met = single.mapInPandas(_cells(cosine, gridded, True), f"{keys}, copies long, vec binary").join(large, KEYS, "left")
        met = met.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
        met = met.withColumns({"ids": F.array("id"), "copies": F.array("copies"), "vecs": F.col("vec")})
    else:
        single = single.withColumn("dim", F.size("vec"))
        chunks = F.greatest(chunks, F.least(F.lit(SPREAD), F.ceil(F.col("count") / FEW)))
        large = saved(single.groupBy("dim").count().select("dim", chunks.cast("int").alias("chunks")).filter("chunks > 1"))
        met = single.join(F.broadcast(large), "dim", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
        met = met.mapInArrow(_packed, "dim int, chunks int, chunk int, ids array<long>, copies array<long>, vecs binary")
        met = met.withColumns({"block": F.lit(0), "cell": F.lit(0).cast("long"), "home": F.lit(True)})
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.select(*KEYS, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "home", "ids", "copies", "vecs")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of every vector that is linked with another one."""
    rows = vectors.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = saved(rows.filter(finite & F.exists("vec", lambda x: x != 0)).withColumn("key", F.unhex(F.md5(F.col("vec").cast("string")))))
    classes = saved(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.count("*").alias("copies")))
    gridded = min(8, max(1, math.ceil(math.log2(n / 8_192)))) if (n := classes.count()) > ONE_SPACE else 0
    tiles = _tiles(classes.select("id", "copies", "vec"), cosine, gridded)
    found = saved(tiles.groupBy(*KEYS, "i", "j").applyInArrow(_links(cosine, gridded), "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("a", "b"))
    linked = classes.select("key", "id", "copies").join(counts.join(parts, "id"), "id", "left").filter("copies > 1 or n > 0")
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    of_class = linked.select("key", "copies", n_links.alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return joined(rows.select("id", "key"), saved(of_class), "key", "copies", rows.count()).select("id", "n_links", "component_id")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    linked = near_duplicates(vectors).withColumnRenamed("id", "vec_id")
    every = vectors.select(F.col("vec_id").cast("long")).distinct()
    out = every.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
