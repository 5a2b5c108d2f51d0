"""Removal of byte strings that stand more than once in a corpus, by a distributed merge sort of suffixes.

Every string of `length` bytes that also starts anywhere else is repeated; all bytes it covers are removed.

* Only some suffixes need sorting. Of the `GRAM`-byte pieces of a window of `length` bytes, the one with the smallest hash is the
  window's anchor. Equal windows have equal anchors at equal places, so windows can be compared by the
  suffixes at their anchors (and the bytes before them). Each anchor owns a run of consecutive windows.
* Anchors whose piece stands nowhere else (counted over all documents) own unique windows and are dropped.
* The suffixes at the others are sorted in every task to runs, one for every bucket of anchor pieces, which are front-coded
  (common prefix with the string before, and the rest) and exchanged. A bucket has about PER_BUCKET suffixes.
* Each bucket merges its runs with a loser tree that carries common prefixes: heads with different common
  prefixes with the last output are ordered without looking at a byte, and equal ones are compared
  only beyond it. The merge gives each suffix's common prefix with the one before it.
* Suffixes that share the anchor's piece form a group; two of them have equal windows at every distance from
  the anchor that their common prefix to the right and common suffix to the left both allow.

Equal contexts are one entry of a run, so a passage in very many documents is one entry a run; equal texts are one text.
An anchor piece that stands in more than LARGEST places would make a group too large for one task; its windows are
counted one by one instead, by 128-bit digests that are summed before they are shuffled.

Defined results: a null or empty text has no bytes; texts shorter than `length` lose nothing; repeated rows are
copies, and lose all bytes if long enough; matches never cross documents. Columns other than the text are kept; only a
column `spans` is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import joined, release, saved, slices, small_batches, table

LENGTH, GRAM = 200, 64
#: Suffixes in a bucket of the exchange, on average, and places of an anchor piece that one task compares.
PER_BUCKET, LARGEST = 30_000, 100_000
#: Suffixes that a task sorts at one time.
RUN = 50_000
ENTRY, ENTRY_SIZE = "<HHB", struct.calcsize("<HHB")
MEMBER, MEMBER_SIZE = "<16sQH", struct.calcsize("<16sQH")


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """63-bit hashes of all GRAM-byte pieces: differences of a running polynomial sum, shifted back and mixed."""
    n = len(data)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up = np.full(n, base, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    down = np.full(n - GRAM + 1, inverse, np.uint64)
    down[0] = 1
    h = (total[GRAM:] - total[: n - GRAM + 1]) * np.multiply.accumulate(down)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(1)


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of every anchor of a text."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    h = gram_hashes(np.frombuffer(data, np.uint8))
    w = length - GRAM + 1
    # Minimum of every w neighbours: a running one within blocks of w, from either side.
    m = -(-len(h) // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(h) - w + 1
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    # The last place of that minimum in each window: the latest occurrence of the value so far, up to the window's end.
    place = np.full(n, -1, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        value = least[s]
        at = np.flatnonzero(h[s : e - 1 + w] == value) + s
        if len(at) == 1:
            place[s:e] = at[0]
        else:
            p = np.arange(s, e)
            place[s:e] = at[np.searchsorted(at, p + w - 1, "right") - 1]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    q = place[first]
    return h[q].astype(np.int64), q, first, last


def _hashed(length: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in slices(batches):
                hs, packed, n = [], [], []
                for text in part.column("text").to_pylist():
                    h, q, first, last = anchors(encoded(text), length)
                    hs.append(h)
                    n.append(len(h))
                    packed.append(q << 16 | (q - first) << 8 | (last - first))
                keys = part.column("tkey").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), keys, pa.array(np.concatenate(packed))], ["hash", "tkey", "packed"])
        finally:
            release()

    return hashed


def contexts(text: bytes, packed: np.ndarray, length: int) -> Iterator[tuple[bytes, bytes, int]]:
    """(bytes from the anchor on, bytes before it in its windows, number of windows) of anchors."""
    for x in packed:
        q, before, more = int(x) >> 16, int(x) >> 8 & 255, int(x) & 255
        yield text[q : q - before + more + length], text[q - before : q], more + 1


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be start at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def _runs(length: int, buckets: int):
    """Sorted, front-coded runs, one for every bucket of pieces: rows (bucket, blob)."""

    def coded(entries: list[tuple[tuple[bytes, bytes, int], bytes]]) -> bytes:
        out, before = [], b""
        for (right, left, n), members in entries:
            same = common(before, right)
            out += [struct.pack(ENTRY, same, len(right) - same, len(left)), right[same:], left, struct.pack("<BI", n, len(members)), members]
            before = right
        return zlib.compress(b"".join(out), 1)

    def run(held: dict) -> pa.RecordBatch:
        by_bucket = defaultdict(list)
        for k, v in held.items():
            by_bucket[zlib.crc32(k[0][:GRAM]) % buckets].append((k, b"".join(v)))
        blobs = [coded(sorted(entries)) for entries in by_bucket.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(by_bucket), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0
        try:
            for part in slices(batches, 256):
                for tkey, text, packed in zip(*(part.column(c).to_pylist() for c in ("tkey", "text", "packed")), strict=True):
                    data = encoded(text)
                    for x, (right, left, count) in zip(packed, contexts(data, packed, length), strict=True):
                        held[right, left, count].append(struct.pack(MEMBER, tkey, (x >> 16) - (x >> 8 & 255), count))
                        n += 1
                        if n == RUN:
                            yield run(held)
                            held, n = defaultdict(list), 0
            if held:
                yield run(held)
        finally:
            del held
            release()

    return runs


def _windows(length: int):
    """The digest and the place of every window of some anchors: rows (window, tkey, start)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            digests, starts, n = [], [], []
            for text, packed in zip(part.column("text").to_pylist(), part.column("packed").to_pylist(), strict=True):
                data, before = encoded(text), len(starts)
                for x in packed:
                    first = (x >> 16) - (x >> 8 & 255)
                    starts += range(first, first + (x & 255) + 1)
                digests += [xxhash.xxh3_128_digest(data[s : s + length]) for s in starts[before:]]
                n.append(len(starts) - before)
            keys = part.column("tkey").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), keys, pa.array(starts, pa.int64())], ["window", "tkey", "start"])

    return windows


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int, bytes]]:
    """(common prefix with the entry before, right, left, windows, members) of a run, in order."""
    data, at, right = zlib.decompress(blob), 0, b""
    while at < len(data):
        same, more, before = struct.unpack_from(ENTRY, data, at)
        at += ENTRY_SIZE
        right = right[:same] + data[at : at + more]
        at += more
        left = data[at : at + before]
        at += before
        n, size = struct.unpack_from("<BI", data, at)
        at += 5
        yield same, right, left, n, data[at : at + size]
        at += size


def merged(runs: list[Iterator]) -> Iterator[tuple[int, tuple]]:
    """(common prefix with the output before, entry) of all runs in order, by a loser tree of common prefixes.

    heads[r] is the head of run r and known[r] its common prefix with the last string that it was compared with
    and lost to, or, for the winner, with the last output.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads; the loser's common prefix with the winner is noted."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        same = common(x[1], y[1], known[a])
        if (x[1][same:], a) <= (y[1][same:], b):
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    winners = list(range(size))
    level = size
    tree = [0] * size + winners
    while level > 1:
        for node in range(level // 2, level):
            tree[node], losers[node] = play(tree[2 * node], tree[2 * node + 1])
        level //= 2
    winner = tree[1] if size > 1 else 0
    while heads[winner] is not None:
        yield known[winner], heads[winner]
        heads[winner] = following = next(runs[winner], None)
        known[winner] = following[0] if following else 0
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated_windows(group: list[tuple], prefixes: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each entry of a group, sorted by its suffix, the runs of its windows (from 0, end exclusive) that stand elsewhere too.

    prefixes[i] is the common prefix of entries i - 1 and i. A window at distance o before the anchor has o bytes
    to its left and length - o bytes from it on.
    """
    found: list[list[tuple[int, int]]] = [[(0, e[3])] if len(e[4]) > MEMBER_SIZE else [] for e in group]

    def note(i: int, low: int, high: int) -> None:
        """Windows of entry i at distances low to high."""
        far = len(group[i][2])
        first, end = max(0, far - high), min(group[i][3], far - low + 1)
        if first < end:
            found[i].append((first, end))

    if len(group) < 2:
        return found
    if len(group) == 2:
        behind = common(group[0][2][::-1], group[1][2][::-1])
        for i in range(2 if prefixes[1] + behind >= length else 0):
            note(i, length - prefixes[1], behind)
        return found
    for o in range(max(len(e[2]) for e in group) + 1):
        # Neighbours with a common prefix of what a window has from the anchor on form a stretch.
        stretch, holders = 0, defaultdict(list)
        for i, (_, _, left, n, _) in enumerate(group):
            if i and prefixes[i] < length - o:
                stretch = i
            if len(left) - n < o <= len(left):
                holders[stretch, left[len(left) - o :]].append(i)
        for several in holders.values():
            if len(several) > 1:
                for i in several:
                    note(i, o, o)
    return found


def _merge(length: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[bytes, list[int]] = defaultdict(list)

        def close(group: list, prefixes: list[int]) -> None:
            group = [(*e[:4], b"".join(e[4])) for e in group]
            for e, spans in zip(group, repeated_windows(group, prefixes, length), strict=True):
                for m in range(0, len(e[4]), MEMBER_SIZE) if spans else ():
                    tkey, first, _ = struct.unpack_from(MEMBER, e[4], m)
                    for a, b in spans:
                        out[tkey] += (first + a, first + b - 1 + length)

        # Of the entries with the last one's suffix (they are neighbours): the place in the group of each left side and number of windows.
        group, prefixes, alike = [], [], {}
        for same, (_, right, left, n, members) in merged([decoded(b) for b in rows["blob"]]):
            if group and same < GRAM:
                close(group, prefixes)
                group, prefixes = [], []
            if not group or group[-1][1] != right:
                alike = {}
            at = alike.setdefault((left, n), len(group))
            if at < len(group):
                # An equal context from another run joins its entry.
                group[at][4].append(members)
            else:
                group.append((same, right, left, n, [members]))
                prefixes.append(same)
        close(group, prefixes)
        return pd.DataFrame({"tkey": list(out), "spans": [np.array(v, np.int64) for v in out.values()]}, dtype=object)

    return merge


def union(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that (start, end, start, end, ...) cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2].tolist(), spans[1::2].tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Add `spans`: array of start, end, start, end, ... (bytes, end exclusive) that repeated strings cover; null if none."""
    if not GRAM < length < GRAM + 192:
        raise ValueError("length must be between 65 and 255")
    small_batches(docs.sparkSession)
    keyed = docs.drop("spans").withColumn("__tkey", F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    texts = keyed.filter(F.octet_length(text) >= length).select(F.col("__tkey").alias("tkey"), F.col(text).alias("text"))
    every = saved(texts.mapInArrow(_hashed(length), "hash long, tkey binary, packed long"))
    total = every.count()
    several = saved(every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").withColumn("large", F.col("n") > LARGEST))
    held = joined(every, several, "hash", "n", total)
    places = lambda large: F.coalesce(F.collect_set(F.when(F.col("large") == large, F.col("packed"))), F.array().cast("array<long>"))
    open_ = held.groupBy("tkey").agg(places(False).alias("packed"), places(True).alias("large"))
    # Copies of a text are summed up before the shuffle.
    single = texts.groupBy("tkey").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    chosen = saved(single.join(open_, "tkey"))
    n = chosen.agg(F.sum(F.size("packed"))).first()[0] or 0
    runs = chosen.select("tkey", "text", "packed").mapInArrow(_runs(length, max(1, n // PER_BUCKET)), "bucket long, blob binary")
    found = saved(runs.groupBy("bucket").applyInPandas(_merge(length), "tkey binary, spans array<long>"))
    whole = chosen.filter("copies > 1").select("tkey", F.array(F.lit(0).cast("long"), F.octet_length("text").cast("long")).alias("spans"))
    several_places = several.filter("large").head(1)
    spans = found.unionByName(whole)
    if several_places:
        windows = saved(chosen.filter(F.size("large") > 0).select("tkey", "text", F.col("large").alias("packed")).mapInArrow(_windows(length), "window binary, tkey binary, start long"))
        counts = saved(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1"))
        again = joined(windows, counts, "window", "n", windows.count())
        spans = spans.unionByName(again.select("tkey", F.array("start", F.col("start") + length).alias("spans")))
    spans = spans.groupBy("tkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = saved(spans.join(chosen.select("tkey", "copies"), "tkey").withColumnRenamed("tkey", "__tkey"))
    return joined(keyed, spans, "__tkey", "copies", total, "left").drop("__tkey")


def _kept(data: bytes, spans) -> tuple[bytes, int, int]:
    if spans is None or not len(spans):
        return data, 0, 0
    out, at, removed = [], 0, union(np.asarray(spans))
    for a, b in removed:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), sum(b - a for a, b in removed), len(removed)


def deduplicated(docs: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with repeated strings cut out of the text; of a code point cut in the middle the rest goes too."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _kept(encoded(t), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    return with_spans(docs, text=text, length=length).withColumn(text, cut(text, "spans")).drop("spans")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            data = encoded(t)
            kept, removed, n = _kept(data, s)
            rows.append((len(data), removed, n, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs).select("doc_id", digest("text", "spans").alias("d")).select("doc_id", "d.*")
