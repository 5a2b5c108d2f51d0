"""Best-fit packing of tokenized documents into sequences of fixed length.

Hierarchical residual packing: every partition packs its own pieces best-fit in order of falling length
and emits the bins that are nearly full. The underfull bins go up a tree as items; each node packs its share of
them best-fit again, emits what became nearly full, and passes all other bins on to the next level, which has
`fan_in` times fewer nodes, but so many that a node has about `node_bins` bins. So no task ever holds many more, however
large the input. The root's remainder is left underfull, or all that is left once a level of many nodes
joins hardly any bins (they are then all too full for each other).

Defined results: a null or empty text is the closing id 0 alone; repeated rows are packed each on its own; a document of more
than `capacity` ids is cut into pieces of `capacity`, the last one may be shorter. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import release, saved, slices, small_batches, table
from helixlake.llm.bpe import byte_of_symbol

CAPACITY = 2048
#: Bins with at most so many free places are emitted at once.
NEARLY_FULL = 4
#: Pieces that are packed locally at one time.
TOGETHER = 50_000
#: Words remembered by one task; beyond it they are forgotten and encoded anew.
REMEMBERED = 250_000
#: Fixed value: how the vocabulary's own file splits normalised text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Characters that str.split() takes for white space and Unicode's White_Space does not.
NOT_WHITE = re.compile("[\x1c-\x1f]").search
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin_id long, in_bin long"


class Words:
    """Ids of the public word vocabulary as little-endian unsigned 32-bit bytes, remembered by word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.split = regex.compile(WORDS).findall
        self.merge = self.tokenizer.model.tokenize
        self.symbol = {b: c for c, b in byte_of_symbol().items()}
        self.known: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, chunk: str) -> bytes:
        """Ids of a normalised chunk without white space, word by word by the vocabulary's own merges."""
        ids = []
        for word in self.split(chunk):
            symbols = word if word.isascii() and word.isprintable() else "".join(map(self.symbol.__getitem__, word.encode()))
            ids += [t.id for t in self.merge(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added) or NOT_WHITE(text):
            return self._raw(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # A capital sigma is lowered without regard to its place in the word.
        chunks = ("".join(map(str.lower, text)) if "Σ" in text else text.lower()).split()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for c in chunks:
                if c not in known:
                    known[c] = self._learn(c)
            return b"".join(map(known.__getitem__, chunks))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit in order of falling length: the bin of each item, and the fill of each bin.

    Open bins are kept by their free places; the bits of one integer tell which of those lists are not
    empty, so that the tightest bin for an item is the lowest set bit at or above its length.
    """
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_set, fills, place = 0, [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = free_set >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = bins_with[free].pop()
            if not bins_with[free]:
                free_set &= ~(1 << free)
        else:
            b, free = len(fills), capacity
            fills.append(0)
        place[i] = b
        fills[b] += n
        if free > n:
            bins_with[free - n].append(b)
            free_set |= 1 << (free - n)
    return place, fills


def _pack_partition(vocabulary: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        # The worker lives on for other stages; the tokenizer and its words need not.
        encoder, rows = Words(vocabulary), []
        try:
            for part in slices(batches):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        end = min(n, start + capacity)
                        rows.append((doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                if len(rows) >= TOGETHER:
                    packed, first = _local(rows, capacity, first)
                    yield packed
                    rows = []
            if rows:
                yield _local(rows, capacity, first)[0]
        finally:
            del encoder
            release()

    return pack


def _local(rows: list[tuple], capacity: int, first: int) -> tuple[pa.RecordBatch, int]:
    place, fills = best_fit([r[3] for r in rows], capacity)
    at, offsets = [0] * len(fills), []
    for b, r in zip(place, rows, strict=True):
        offsets.append(at[b])
        at[b] += r[3]
    columns = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    arrays += [pa.array([first + b for b in place], pa.int64()), pa.array(offsets, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECES.split(", ")]), first + len(fills)


def _merge_node(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin_id", kind="stable")
        place, fills = best_fit(group["fill"].tolist(), capacity)
        members: list[list[int]] = [[] for _ in fills]
        for i, b in enumerate(place):
            members[b].append(i)
        ids, full, held, rows = group["bin_id"].tolist(), group["fill"].tolist(), group["held"].tolist(), []
        for b, items in enumerate(members):
            inside, at = [], 0
            for i in items:
                inside += [{"bin_id": int(x["bin_id"]), "base": int(x["base"]) + at} for x in held[i]]
                at += int(full[i])
            rows.append((int(ids[items[0]]), fills[b], fills[b] >= capacity - NEARLY_FULL, inside))
        return pd.DataFrame(rows, columns=["bin_id", "fill", "done", "held"])

    return merge


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, fan_in: int = 8, node_bins: int = 16_384) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    small_batches(docs.sparkSession)
    pieces = saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack_partition(vocabulary, capacity), PIECES))
    bins = pieces.groupBy("bin_id").agg(F.sum("length").alias("fill"))
    full = F.col("fill") >= capacity - NEARLY_FULL
    level = saved(bins.select("bin_id", "fill", full.alias("done"), F.array(F.struct("bin_id", F.lit(0).cast("long").alias("base"))).alias("held")))
    shape = "bin_id long, fill long, done boolean, held array<struct<bin_id:long,base:long>>"
    finished = level.filter("done")
    count = level.filter("not done").count()
    nodes = max(1, -(-count // node_bins))
    while count > 1:
        # A hash deals the bins to the nodes of a level, so that none has many more than its share.
        node = F.pmod(F.xxhash64("bin_id", F.lit(nodes)), F.lit(nodes)).alias("node")
        level = saved(level.filter("not done").select("bin_id", "fill", "held", node).groupBy("node").applyInPandas(_merge_node(capacity), shape))
        finished = finished.unionByName(level.filter("done"))
        before, count = count, level.filter("not done").count()
        # With one node all have met. Where a round of many nodes joins hardly any, no others would either.
        if nodes == 1 or 100 * count > 99 * before:
            break
        nodes = max(1, -(-nodes // fan_in), -(-count // node_bins))
    finished = finished.unionByName(level.filter("not done"))
    placed = finished.select(F.col("bin_id").alias("sequence_id"), F.explode("held").alias("h")).select("sequence_id", F.col("h.bin_id").alias("bin_id"), F.col("h.base").alias("base"))
    return pieces.join(placed, "bin_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("base") + F.col("in_bin")).alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
