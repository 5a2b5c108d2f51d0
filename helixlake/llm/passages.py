"""Removal of passages of words that an earlier document has: a count-min sketch of all windows, and an exact pass over what it lets through.

A window is `length` consecutive words of one document; words are what ASCII white space leaves. A word is removed where a window
covers it that a document with a smaller id has too; windows are judged on the input.

* Pass 1. Each task sorts the cells of its windows and emits, for every stretch of cells, which were met once and which more often:
  its sketch, whose counters end at 2, since only "repeated or not" is asked. Stretches of all tasks are merged as sorted streams, in
  which a task holds one stretch at a time. The sketch has ROWS rows of about three cells a window (from the bytes of the corpus),
  MOST at most: 2 ** 30 bits a row, so that what is broadcast, a bit a cell, is 256 MB at most.
* Pass 2. Windows whose cells all say "repeated" go on; a window that stands twice cannot be missed. A task sorts those it has
  collected: of equal windows only the smallest document's is open and goes on with a digest of 96 bits, the others are settled where
  they are. Open ones meet in buckets of digests, which hold the windows of PER_BUCKET bytes of text each: a window has one entry a
  task in them, however often it stands; each but the smallest document's is removed.
* Removed windows come back to their documents by id; documents find them again by their digests.

Beyond MOST / 3 windows the sketch lets more windows through that stand once; results stay the same, and the second pass grows with the
windows, linearly.

Defined results: a null or empty text has no words. Texts with fewer words than a window lose nothing. Documents with equal ids
(repeated rows too) do not remove each other's words, and lose those that a smaller id has; documents with a null id keep all words and
take none. An empty table stays empty. Other columns are kept; a column `removed` is replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import release, small_batches, table

LENGTH = 13
#: Rows of the sketch, stretches of a row (so that a task emits as many parts at any size), bytes of text for each cell, and cells
#: of a row at most.
ROWS, STRETCHES, BYTES_A_CELL, MOST = 2, 256, 2, 1 << 30
#: Bytes of texts and windows that a task works on or collects at one time, and the longest word that is hashed in steps.
BYTES, COLLECTED, LONG = 4 << 20, 1 << 20, 64
HEADER, HEADER_SIZE = "<QQ??", struct.calcsize("<QQ??")
#: Bytes of texts for each bucket of open windows.
PER_BUCKET = 8 << 20
#: Odd multipliers of hashes.
STEPS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all bits, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose texts have about `most` bytes; a longer text goes by itself."""
    for batch in batches:
        sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column(text)).to_pylist()], np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end of every word, and the number of each text's first word (and one more, for the end)."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(at[-1] - at[0])
    data = np.zeros(n + 8, np.uint8)
    if n:
        data[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    raw = data[:n]
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    opens, closes = edge[:n].copy(), edge[1:].copy()
    if n:
        opens[1:] |= space[:-1]
        closes[:-1] |= space[1:]
        opens[0] = closes[-1] = True
    starts, ends = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
    return data, starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time; `which` of two independent ones."""
    step = np.uint64(STEPS[which])
    sizes = ends - starts
    eights = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))

    def piece(rows: np.ndarray, k: int) -> np.ndarray:
        left = np.minimum(sizes[rows] - k, 8)
        return eights[starts[rows] + k] & (ALL >> ((8 - left) * 8).astype(np.uint64))

    found = mixed(piece(np.arange(len(starts)), 0) ^ (sizes.astype(np.uint64) + np.uint64(1)) * step)
    for k in range(8, min(int(sizes.max(initial=0)), LONG), 8):
        rows = np.flatnonzero((sizes > k) & (sizes <= LONG))
        found[rows] = mixed(found[rows] * step + piece(rows, k))
    for i in np.flatnonzero(sizes > LONG):
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=which)
    return found


def window_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int, length: int) -> np.ndarray:
    """A hash of every run of `length` words, those across texts included."""
    of = word_hashes(data, starts, ends, which)
    n = max(0, len(of) - length + 1)
    total, step = np.zeros(n, np.uint64), np.uint64(STEPS[1 - which])
    for j in range(length):
        total = total * step + of[j : j + n]
    return mixed(total)


def own(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and the text of each."""
    many = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    start = np.arange(len(text)) + (first[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]))[text]
    return start, text


def cells_of(hashes: np.ndarray, cells: int, row: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch, from one of its halves."""
    half = np.uint64(32)
    return (((hashes & np.uint64(0xFFFFFFFF) if row else hashes >> half) * np.uint64(cells)) >> half).astype(np.uint32)


def coded(at: np.ndarray, stretch: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Sorted places within stretches (which begin at `begin`), each stretch as its steps: a byte a step, and 255 for every 255 beyond."""
    steps = np.diff(at, prepend=0)
    steps[begin] = at[begin]
    more = steps // 255
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = steps % 255
    first = ends[begin] - more[begin] - 1
    return [out[a:b].tobytes() for a, b in zip(first, [*first[1:], len(out)], strict=True)]


def decoded(steps: bytes) -> np.ndarray:
    step = np.frombuffer(steps, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step < 255]


def _sketched(length: int, cells: int):
    """Sketches of tasks: rows (stretch, met, often), the cells of a stretch that were met, and met more than once."""
    size = cells // STRETCHES

    def emitted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        held.clear()
        for row in range(ROWS):
            at = cells_of(hashes, cells, row)
            at.sort()
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            several = np.diff(np.concatenate([new, [len(at)]])) > 1
            for column, some in (("met", at[new]), ("often", at[new[several]])):
                if len(some):
                    stretch, low = (some // np.uint32(size)).astype(np.int64), (some % np.uint32(size)).astype(np.int64)
                    begin = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
                    blobs = pa.array(coded(low, stretch, begin), pa.binary())
                    none = pa.nulls(len(begin), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(stretch[begin] + row * STRETCHES), *((blobs, none) if column == "met" else (none, blobs))], ["stretch", "met", "often"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in by_bytes(batches, "text"):
            data, starts, ends, first = words(part.column("text"))
            at, _ = own(first, length)
            if not len(at):
                continue
            held.append(window_hashes(data, starts, ends, 0, length)[at])
            n += len(at)
            if n >= 4 * COLLECTED:
                yield from emitted(held)
                n = 0
        if n:
            yield from emitted(held)
        release()

    return sketched


def _united(size: int):
    """Of rows (stretch, met, often) sorted by stretch the cells of each stretch that stand twice or more, as bits."""

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(size, bool), np.zeros(size, bool)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["stretch", "bits"])

        for batch in batches:
            for stretch, met, often in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if stretch != now:
                    if now is not None:
                        yield closed()
                    now = stretch
                    once[:] = twice[:] = False
                if met is not None:
                    at = decoded(met)
                    twice[at[once[at]]] = True
                    once[at] = True
                if often is not None:
                    twice[decoded(often)] = True
        if now is not None:
            yield closed()
        release()

    return united


def sketch(docs: DataFrame, size: int, length: int = LENGTH) -> tuple[int, np.ndarray]:
    """Cells of a row, and a bit for each cell of all rows that says whether its windows stand twice or more, for docs (text) of
    about `size` bytes."""
    stretch = min(MOST, size // BYTES_A_CELL) // (8 * STRETCHES) * 8 + 8
    cells = stretch * STRETCHES
    partial = docs.select("text").mapInArrow(_sketched(length, cells), "stretch long, met binary, often binary")
    united = partial.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(_united(stretch), "stretch long, bits binary")
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for r in united.collect():
        at = r["stretch"] * (stretch // 8)
        bits[at : at + stretch // 8] = np.frombuffer(r["bits"], np.uint8)
    return cells, bits


def repeated(hashes: np.ndarray, cells: int, bits: np.ndarray) -> np.ndarray:
    """Whether a window may stand twice or more."""
    found = np.ones(len(hashes), bool)
    for row in range(ROWS):
        at = cells_of(hashes, cells, row).astype(np.uint64) + np.uint64(row * cells)
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def packed(ids: np.ndarray, high: np.ndarray, low: np.ndarray | None) -> bytes:
    """Windows as columns: the documents among them, and for each window its document's place and its digest; with `low`, the
    digests are in order, and their first halves are kept as steps, of six bytes where that will do."""
    docs, place = np.unique(ids, return_inverse=True)
    place = place.astype("<u2" if len(docs) <= 1 << 16 else "<u4")
    steps = high if low is None else np.diff(high, prepend=np.uint64(0))
    wide = low is None or len(steps) < 2 or int(steps[1:].max()) >> 48 > 0
    eights = steps.astype("<u8")
    rest = eights.tobytes() if wide else eights[:1].tobytes() + eights[1:].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return struct.pack(HEADER, len(docs), len(high), low is not None, wide) + docs.astype("<i8").tobytes() + place.tobytes() + rest + (b"" if low is None else low.astype("<u4").tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    many, n, whole, wide = struct.unpack_from(HEADER, blob)
    at = HEADER_SIZE
    docs = np.frombuffer(blob, "<i8", many, at)
    at += 8 * many
    place = np.frombuffer(blob, "<u2" if many <= 1 << 16 else "<u4", n, at)
    at += place.nbytes
    if wide:
        high = np.frombuffer(blob, "<u8", n, at)
        at += 8 * n
    else:
        bytes_ = np.zeros((n, 8), np.uint8)
        bytes_[0] = np.frombuffer(blob, np.uint8, 8, at)
        bytes_[1:, :6] = np.frombuffer(blob, np.uint8, 6 * (n - 1), at + 8).reshape(-1, 6)
        high = bytes_.view("<u8").ravel()
        at += 8 + 6 * (n - 1)
    if not whole:
        return docs[place], high, None
    return docs[place], np.cumsum(high, dtype=np.uint64), np.frombuffer(blob, "<u4", n, at)


def later(ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows by digest and document, and which of them (in that order) are in a document after the first one."""
    order = np.lexsort((ids, low, high))
    h, w, i = high[order], low[order], ids[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    smallest = i[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
    return order, i > smallest


def _candidates(length: int, cells: int, buckets: int, sent):
    """Rows (bucket, blob) of windows: by their digests those that are open, and anywhere those that are settled."""

    def emitted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, high, low = (np.concatenate(c) for c in zip(*held, strict=True))
        order, gone = later(ids, high, low)
        settled = order[gone]
        # Of equal windows of one document the first will do, since documents find theirs by digest.
        ids, high, low = ids[order][~gone], high[order][~gone], low[order][~gone]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        # Digests are in order: a bucket is a stretch of them.
        ids, high, low = ids[new], high[new], low[new]
        bucket = (((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        keys, blobs = bucket[begin].tolist(), [packed(ids[a:b], high[a:b], low[a:b]) for a, b in zip(begin, [*begin[1:], len(ids)], strict=True)]
        if len(settled):
            ids, high, _ = (np.concatenate(c) for c in zip(*held, strict=True))
            pairs = np.unique(np.rec.fromarrays([ids[settled], high[settled]]))
            keys.append(int(pairs.f1[0] % np.uint64(buckets)))
            blobs.append(packed(pairs.f0, pairs.f1, None))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = sent.value, [], 0
        for part in by_bytes(batches, "text"):
            data, starts, ends, first = words(part.column("text"))
            at, text = own(first, length)
            if not len(at):
                continue
            high = window_hashes(data, starts, ends, 0, length)[at]
            found = np.flatnonzero(repeated(high, cells, bits))
            if not len(found):
                continue
            low = (window_hashes(data, starts, ends, 1, length)[at[found]] >> np.uint64(32)).astype(np.uint32)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[text[found]]
            held.append((ids.astype(np.int64), high[found], low))
            n += len(found)
            if n >= COLLECTED:
                yield from emitted(held)
                held, n = [], 0
        if n:
            yield from emitted(held)
        release()

    return candidates


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, blob) sorted by bucket (doc_id, high): the windows of each document that go."""

    def rows(ids: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(high.view("<i8"), pa.int64())], ["doc_id", "high"])

    def closed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            ids, high, low = (np.concatenate(c) for c in zip(*held, strict=True))
            order, gone = later(ids, high, low)
            yield rows(ids[order[gone]], high[order[gone]])

    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if bucket != now:
                yield from closed(held)
                now, held = bucket, []
            ids, high, low = unpacked(blob.as_py())
            if low is None:
                yield rows(ids, high)
            else:
                held.append((ids, high, low))
    yield from closed(held)
    release()


def removable(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, removed): digests of the windows of each document (doc_id long, text) that a smaller id has too."""
    docs = docs.filter("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, bits = sketch(docs, size, length)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    found = docs.select("doc_id", "text").mapInArrow(_candidates(length, cells, max(1, size // PER_BUCKET), sent), "bucket long, blob binary")
    gone = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolved, "doc_id long, high long")
    return gone.groupBy("doc_id").agg(F.collect_list("high").alias("removed"))


def with_removed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with `removed`: digests of the windows whose words go; null if none do."""
    if length < 1:
        raise ValueError("a window has one word at least")
    small_batches(docs.sparkSession)
    docs = docs.drop("removed")
    gone = removable(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), length).withColumnRenamed("doc_id", "__id")
    return docs.withColumn("__id", F.col(doc_id).cast("long")).join(gone, "__id", "left").drop("__id")


def kept(text: str | None, removed: np.ndarray | list[int] | None, length: int = LENGTH) -> tuple[list[bytes], int]:
    """The words that stay, as UTF-8, and the number of all words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    all_words = data.split()
    if removed is None or len(all_words) < length:
        return all_words, len(all_words)
    buffer, starts, ends, _ = words(pa.array([data], pa.large_binary()).view(pa.large_string()))
    hit = np.isin(window_hashes(buffer, starts, ends, 0, length), np.asarray(removed, np.int64).view(np.uint64))
    covered = np.zeros(len(all_words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(hit), 1)
    np.subtract.at(covered, np.flatnonzero(hit) + length, 1)
    stays = np.cumsum(covered)[:-1] == 0
    return list(compress(all_words, stays.tolist())), len(all_words)


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without the words of passages that a document with a smaller id has; texts that lose some have their words joined by one space."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if r is None else b" ".join(kept(t, r, length)[0]).decode("utf-8", "surrogatepass") for t, r in zip(texts, removed, strict=True)], dtype=object)

    return with_removed(docs, doc_id=doc_id, text=text, length=length).withColumn(text, cut(text, "removed")).drop("removed")


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("struct<n_words:long,n_removed:long,kept_sha256:string>")
    def digest(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(texts, removed, strict=True):
            stay, n = kept(t, r)
            rows.append((n, n - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_removed(docs).select("doc_id", digest("text", "removed").alias("d")).select("doc_id", "d.*")
