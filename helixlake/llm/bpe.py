"""Byte-level BPE by dynamic programming over prefixes, and its decoder.

For every prefix of a piece of text there is exactly one token that its BPE encoding can end with. The
encoder walks a piece once: an automaton over the vocabulary follows suffix links to list every token that
ends at a position, and the one token whose predecessor (the stored last token of the shorter prefix) forms
a compatible pair with it is stored. Following the stored tokens back from the end gives the exact ids.

Two tokens are compatible if BPE over their joint bytes gives just these two. This needs no encoding: of
the parts that ever stand at the right edge of the first and the left edge of the second, none may merge
across the border before it is used up within its own token.

Defined results: a null text is an empty one and has no ids; the added token's own string is one id
wherever it stands in a text, as in the library whose files are read; texts may be of any length, since
work and memory are proportional to it; a text that needs a byte the vocabulary lacks is an error. Columns called `ids`
and `decoded` are replaced; no other is touched.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import release, slices, small_batches, table

#: Fixed value: how byte-level BPE vocabularies of this kind split texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The regex module's \s has four control characters that Unicode's White_Space lacks.
SPLIT = SPLIT.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
#: Pieces, and pairs of tokens, remembered by one task; beyond it they are forgotten and encoded anew.
REMEMBERED = 250_000


def byte_of_symbol() -> dict[str, int]:
    """The public map of byte-level vocabularies: printable bytes are themselves, others come from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


RESULT = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_of_symbol()
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes_of = {i: bytes(symbols[c] for c in s) for s, i in vocabulary.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.decodes = self.bytes_of | {i: s.encode() for s, i in self.added.items()}
        self.rank = {(vocabulary[a], vocabulary[b]): n for n, (a, b) in enumerate(merges)}
        self.parts = {vocabulary[a + b]: (vocabulary[a], vocabulary[b], n) for n, (a, b) in enumerate(merges)}
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or i in self.parts:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT).findall
        self.at_added = regex.compile("(" + "|".join(regex.escape(s) for s in self.added) + ")") if self.added else None
        self.right_edge = cache(lambda token: self._edge(token, 1))
        self.left_edge = cache(lambda token: self._edge(token, 0))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.decimal = {i: str(i) for i in self.decodes}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """(part, rank of the merge that uses it up) of every part that stands at an edge of the token."""
        found, until = [(token, float("inf"))], token
        while until in self.parts:
            n = self.parts[until][2]
            until = self.parts[until][side]
            found.append((until, n))
        return found

    def pair(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            rank, left = self.rank.get, self.left_edge(b)
            # Of equal ranks the left one merges first: at its own rank a part of `a` is gone, one of `b` is not.
            known = not any((n := rank((x, y))) is not None and n < x_until and n <= y_until for x, x_until in self.right_edge(a) for y, y_until in left)
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            self.compatible[a, b] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8").decode("latin-1")
        last = [-1] * (len(data) + 1)
        length_of, pair = [0] * (len(data) + 1), self.pair
        for at, (n, token) in self.automaton.iter(data):
            end, before = at + 1, at + 1 - n
            if last[end] < 0 and (before == 0 or last[before] >= 0 and pair(last[before], token)):
                last[end], length_of[end] = token, n
        ids, at = [], len(data)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no tokens for {piece!r}")
            ids.append(last[at])
            at -= length_of[at]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.at_added.split(text) if self.at_added else [text]:
            if part in self.added:
                ids.append(self.added[part])
            else:
                for piece in self.split(part):
                    known = self.pieces.get(piece)
                    if known is None:
                        known = tuple(self.encode_piece(piece))
                        if len(self.pieces) >= REMEMBERED:
                            self.pieces.clear()
                        self.pieces[piece] = known
                    ids += known
        return ids

    def forget(self) -> None:
        self.pieces.clear()
        self.compatible.clear()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.decodes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ids array<int> and decoded string of every row's text. No shuffle; one pass over the texts."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        try:
            for texts in batches:
                ids = [bpe.encode(t or "") for t in texts]
                yield pd.DataFrame({"ids": ids, "decoded": [bpe.decode(i) for i in ids]})
        finally:
            bpe.forget()
            release()

    return docs.withColumn("__bpe", both(F.col(text))).withColumns({"ids": F.col("__bpe.ids"), "decoded": F.col("__bpe.decoded")}).drop("__bpe")


def digests(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add `out`: n_tokens, ids_sha256 and decoded_sha256 of every text, with no ids leaving the worker."""
    small_batches(docs.sparkSession)

    def row(bpe: Bpe, text: str | None) -> dict:
        ids = bpe.encode(text or "")
        decimal = ",".join(map(bpe.decimal.__getitem__, ids))
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(decimal.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(bpe.decode(ids).encode()).hexdigest()}

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(vocabulary)
        try:
            for batch in batches:
                yield pa.array([row(bpe, t) for part in slices([batch]) for t in part.to_pylist()], RESULT)
        finally:
            bpe.forget()
            release()

    return docs.withColumn(out, digest(F.col(text)))


def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "bpe.*")
