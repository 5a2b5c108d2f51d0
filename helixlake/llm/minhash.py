"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles. Its sketch is the k smallest of their hashes. Documents with
equal sets form a class that one of them stands for. Inverted lists of the retained values give candidates:

1. every member of a list with the list's smallest member (a star, so a list of n gives n - 1 pairs);
2. once the verified links of the stars are contracted to components, the pairs of short lists that are
   still in different components;
3. lists that are still long are compared in tiles, by the same estimate and then their full sets; a tile emits the links of a spanning forest.

Only a sketch's rarest values are listed, as many as linked sketches must have one of in common. So a line that
very many documents share makes no list, unless documents consist of little else.

Candidates pass if the Jaccard similarity estimated on the union of both sketches is at least `at_least - margin`
(five standard deviations of the estimate), and are verified on the full sets of both texts. Components of the
links follow by joins. Copies are never expanded into pairs.

Defined results: words are runs of anything but ASCII white space, with A-Z lowered; a text of fewer words than
a shingle is one shingle of them all; a null text or one without words has an empty set and no links; a row
without an id has none; rows with equal ids count as one node. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import discard, joined, lists, release, saved, slices, small_batches, table
from helixlake.llm.graph import Forest, connected_components

WORDS, KEPT = 5, 64
#: Lists of at most so many components give all their pairs of different components.
SHORT = 32
#: Documents in a chunk of a long list; a task holds two chunks.
CHUNK = 1_000
#: Ids up to which a set of them is sent to every executor, at 8 bytes; beyond it they are joined by a shuffle.
SENT = 500_000
#: Words remembered by one task; beyond it they are forgotten and hashed anew.
_REMEMBERED = 250_000
_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_words) > _REMEMBERED:
            _words.clear()
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted distinct 63-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(h))
    acc = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15 + n & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(n):
        acc = (acc ^ h[j : j + len(acc)]) * np.uint64(0xD6E8FEB86659FD93)
        acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xFF51AFD7ED558CCD)
    acc ^= acc >> np.uint64(33)
    return np.unique(acc >> np.uint64(1))


def _sketches(size: int, kept: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in slices(batches):
                sets = [shingles(t, size) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0] + [min(kept, len(s)) for s in sets])
                sketches = lists(np.concatenate([s[:kept] for s in sets]).astype(np.int64), ends)
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array([len(s) for s in sets], pa.int64()), keys, sketches], ["doc_id", "digest", "n", "key", "sketch"])
        finally:
            # The worker lives on for other stages; its words need not.
            _words.clear()
            release()

    return sketch


def _verify(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        try:
            for part in slices(batches, 64):
                ok = []
                for a, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                    if a != last:
                        last, of_last = a, shingles(ta, size)
                    other = shingles(tb, size)
                    inter = len(np.intersect1d(of_last, other, assume_unique=True))
                    ok.append(100 * inter >= percent * (len(of_last) + len(other) - inter))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        finally:
            _words.clear()
            release()

    return verify


def _tile(kept: int, least: float, size: int, percent: int):
    def tile(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Links of a spanning forest: pairs of different components whose sketches overlap enough, each in the first list
        that both stand in, estimated on the union of sketches and verified on full sets unless links found before join them."""
        value, i, j = int(key[0]), int(key[1]), int(key[2])
        group = group.drop_duplicates("id", ignore_index=True)
        ids, part, chunk = group["id"].to_numpy(), group["component"].to_numpy(), group["chunk"].to_numpy()
        long = group["sketch"].map(len).to_numpy()
        sets: dict[int, np.ndarray] = {}

        def full(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingles(group["text"].iat[x], size)
            return sets[x]

        def matrix(lists: list[np.ndarray]) -> np.ndarray:
            """Which of the values that several rows hold each row holds."""
            rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            values, code, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            shared = n > 1
            m = np.zeros((len(lists), int(shared.sum())), np.float32)
            at = shared[code]
            m[rows[at], (np.cumsum(shared) - 1)[code[at]]] = 1
            return m

        sketches = group["sketch"].tolist()
        held, before = matrix(sketches), matrix([x[x < value] for x in group["keys"]])
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        forest, links = Forest(len(ids)), []
        for start in range(0, len(left), 1000):
            x = left[start : start + 1000]
            open_ = part[x][:, None] != part[right][None]
            if i == j:
                open_ &= ids[x][:, None] < ids[right][None]
            if open_.any():
                most = np.minimum(kept, np.maximum(long[x][:, None], long[right][None]))
                hit = open_ & (held[x] @ held[right].T >= least * most) & (before[x] @ before[right].T < 0.5)
                for p, q in zip(*(z.tolist() for z in np.nonzero(hit)), strict=True):
                    p, q = int(x[p]), int(right[q])
                    if forest.find(p) != forest.find(q):
                        union = np.union1d(sketches[p], sketches[q])[:kept]
                        if len(np.intersect1d(np.intersect1d(sketches[p], sketches[q], assume_unique=True), union, assume_unique=True)) < least * len(union):
                            continue
                        inter = len(np.intersect1d(full(p), full(q), assume_unique=True))
                        if 100 * inter >= percent * (len(full(p)) + len(full(q)) - inter):
                            forest.link(p, q)
                            links.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return tile


def links(docs: DataFrame, classes: DataFrame, *, size: int, kept: int, percent: int, margin: float = 0.27) -> DataFrame:
    """All confirmed links that matter to the components of classes (id, n, sketch)."""
    least = percent / 100 - margin
    values = classes.select("id", F.explode("sketch").alias("value"))
    several = saved(values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    held = values.join(several, "value")
    # Linked sketches share so many values that they share one of the rarest ones: of a whole set one of a quarter and
    # one more, of a sample of it one of a half and one more. Values held by one class are the rarest of all. The largest
    # set that a whole one of m can be linked with contains it and has 100 m / percent values; what its sample leaves out
    # of them may all be shared ones, so that many more are listed.
    both_whole = F.floor(F.col("m") * (100 - percent) / 100) + 1
    one_sampled = F.floor(F.col("m") * 100 / percent) - kept + 1
    among = F.when(F.col("m") < kept, F.greatest(both_whole, one_sampled)).otherwise(F.lit(kept // 2 + 1))
    rarest = F.array_sort(F.collect_list(F.struct("df", "value")))
    keys = held.groupBy("id").agg(rarest.alias("r")).join(classes.select("id", F.size("sketch").alias("m")), "id")
    keys = keys.withColumn("take", (among - (F.col("m") - F.size("r"))).cast("int")).filter("take > 0")
    keys = keys.select("id", F.explode(F.slice(F.col("r.value"), F.lit(1), F.col("take"))).alias("value"))
    keys = saved(keys)
    firsts = saved(keys.groupBy("value").agg(F.count("*").alias("members"), F.min("id").alias("first")).filter("members > 1"))
    held = saved(keys.join(firsts, "value"))
    texts = docs.select(F.col("doc_id").alias("id"), "text")

    def some_texts(ids: DataFrame) -> DataFrame:
        ids = saved(ids)
        return saved(texts.join(F.broadcast(ids) if ids.count() <= SENT else ids, "id"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Candidates (a, b) that pass the estimate on the union of sketches, and then the full sets."""
        sa, sb = (classes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        both = pairs.join(sa, "a").join(sb, "b").filter(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, kept)
        likely = saved(both.withColumn("u", union).filter(F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) >= least * F.size("u")).select("a", "b"))
        needed = some_texts(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
        ta, tb = (needed.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        found = saved(likely.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(size, percent), "a long, b long").distinct())
        discard(needed)
        return found

    star = confirmed(held.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    joined = connected_components(star)
    # What is still open: lists that members of different components share.
    by_part = saved(held.select("value", "id").join(joined, "id", "left").select("value", "id", F.coalesce("component", "id").alias("component")))
    parts = by_part.groupBy("value", "component").agg(F.count("*").alias("members")).groupBy("value").agg(F.count("*").alias("parts"), F.sum("members").alias("members")).filter("parts > 1")
    open_lists = saved(by_part.join(parts, "value"))
    short = open_lists.filter(F.col("members") <= SHORT)
    a = short.select("value", F.col("id").alias("a"), F.col("component").alias("ca"))
    b = short.select("value", F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = a.join(b, "value").filter("a < b and ca <> cb").select("a", "b").distinct()
    lengthy = open_lists.filter(F.col("members") > SHORT).select("value", "id", "component", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
    # One row of an id meets its sketch and its text; it is dealt to its lists only then.
    every = saved(lengthy.groupBy("id", "component").agg(F.collect_list(F.struct("value", "chunks")).alias("lists")))
    long_texts = some_texts(every.select("id"))
    each = every.join(classes.select("id", "sketch"), "id").join(long_texts, "id").select("id", "component", "sketch", "text", F.col("lists.value").alias("keys"), F.explode("lists").alias("l"))
    each = each.select("l.value", "l.chunks", "id", "component", "sketch", "keys", "text").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    tiles = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("value", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "component", "sketch", "keys", "text")
    rest = saved(tiles.groupBy("value", "i", "j").applyInPandas(_tile(kept, least, size, percent), "a long, b long"))
    discard(long_texts)
    return star.unionByName(confirmed(pairs)).unionByName(rest)


def components(docs: DataFrame, *, size: int = WORDS, kept: int = KEPT, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, digest) of every row of docs (doc_id, text); the digest is the text's MD5."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    digested = docs.withColumn("digest", F.unhex(F.md5("text")))
    sketched = saved(digested.mapInArrow(_sketches(size, kept), "doc_id long, digest binary, n long, key binary, sketch array<long>"))
    known = sketched.filter("n > 0 and doc_id is not null")
    firsts = saved(known.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("members")))
    classes = known.join(firsts.select("key", F.col("id").alias("doc_id")), ["key", "doc_id"]).groupBy(F.col("doc_id").alias("id"))
    classes = saved(classes.agg(F.max("n").alias("n"), F.max_by("sketch", "n").alias("sketch")))
    parts = connected_components(links(docs, classes, size=size, kept=kept, percent=percent))
    of_class = saved(firsts.join(parts, "id", "left").select("key", F.coalesce("component", "id").alias("component"), "members"))
    out = sketched.select("doc_id", "digest", "n", "key")
    # Very many rows may have the same set, and as many none.
    out = joined(out.filter("n > 0"), of_class, "key", "members", sketched.count(), "left").unionByName(out.filter("n = 0").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "digest")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "digest")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).drop("digest")
