"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A text is cut into windows of fixed length; every window's bytes are embedded, filters of several widths run over them, each filter's
maximum over the window goes to a softmax. A text's prediction is the mean of its windows'
probabilities, weighted by their lengths. All windows of all texts are scored, in batches; texts are never shortened.

Training uses a bounded sample: about `per_language` labelled texts of each language (by a hash of their ids, so
the same ones at every run) and at most `windows` windows of each, which the executors cut out of the whole texts; only they
reach the driver. Those bounds are parameters; more than `languages` different labels are an error. Nothing else is sampled.
The trained arrays (a few kilobytes) travel with the task. Windows are scored in buffers of fixed size.

Defined results: `und` with score 0 for a null or empty text and one without any letter; with no labelled text at all every
text is `und`; rows with a null id or language are never learned from; ties go to the language that sorts
first. Repeated rows have equal predictions. Columns that are called `lang_pred` or `score` already are replaced by the
prediction; no other column is touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import release, slices, small_batches, table

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 12, 8
RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
#: Windows that are scored together: their buffers take about 10 MB.
TOGETHER = 128


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows_of(text: str) -> np.ndarray:
    """(n, WINDOW + widest - 1) bytes; windows overlap by the widest filter less one, and are padded with 0."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, more = max(1, -(-len(data) // WINDOW)), max(WIDTHS) - 1
    padded = np.zeros(n * WINDOW + more, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW + more), (WINDOW, 1))


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBEDDING)
    filters: np.ndarray  # (widest * EMBEDDING, all filters); rows beyond a filter's width are 0
    bias: np.ndarray
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray

    def pooled(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The patches, each filter's maximum, and where it stood."""
        e = self.embed[batch]
        n, long, width = e.shape
        deep = max(WIDTHS) * width
        places = long - max(WIDTHS) + 1
        patches = np.lib.stride_tricks.as_strided(e, (n, places, deep), (e.strides[0], e.strides[1], 4))
        hidden = (np.ascontiguousarray(patches).reshape(-1, deep) @ self.filters).reshape(n, places, -1)
        return patches, hidden, hidden.max(1)

    def probabilities(self, top: np.ndarray) -> np.ndarray:
        """Softmax over the languages, from each filter's maximum."""
        logits = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


class Scorer:
    """Scores windows of many texts, TOGETHER at a time, in buffers that are made once."""

    def __init__(self, net: Network) -> None:
        long, deep, total = WINDOW + max(WIDTHS) - 1, max(WIDTHS) * EMBEDDING, len(net.bias)
        self.net, self.n = net, 0
        self.windows = np.zeros((TOGETHER, long), np.uint8)
        self.owner, self.size = np.zeros(TOGETHER, np.int64), np.zeros(TOGETHER)
        self.embedded = np.zeros((TOGETHER, long, EMBEDDING), np.float32)
        self.patches = np.zeros((TOGETHER, WINDOW, deep), np.float32)
        self.hidden = np.zeros((TOGETHER, WINDOW, total), np.float32)
        step = self.embedded.strides
        self.sliding = np.lib.stride_tricks.as_strided(self.embedded, self.patches.shape, (step[0], step[1], step[2]))

    def add(self, text: str, owner: int, sums: np.ndarray) -> None:
        """Put a text's windows in line; full buffers are scored into sums[owner]."""
        windows, at = windows_of(text), 0
        while at < len(windows):
            some = min(TOGETHER - self.n, len(windows) - at)
            to = slice(self.n, self.n + some)
            self.windows[to], self.owner[to] = windows[at : at + some], owner
            self.size[to] = (self.windows[to, :WINDOW] != 0).sum(1)
            self.n, at = self.n + some, at + some
            if self.n == TOGETHER:
                self.flush(sums)

    def flush(self, sums: np.ndarray) -> None:
        n, self.n = self.n, 0
        if n:
            np.take(self.net.embed, self.windows[:n], axis=0, out=self.embedded[:n], mode="clip")
            np.copyto(self.patches[:n], self.sliding[:n])
            np.matmul(self.patches[:n], self.net.filters, out=self.hidden[:n])
            np.add.at(sums, self.owner[:n], self.net.probabilities(self.hidden[:n].max(1)) * self.size[:n, None])


def spread(text: str, windows: int = 4) -> np.ndarray:
    """At most `windows` evenly spaced windows of a whole text."""
    w = windows_of(text)
    return w[np.unique(np.linspace(0, len(w) - 1, windows).astype(int))]


def train(samples: list[np.ndarray], labels: list[str], *, epochs: int = 8, rate: float = 0.004, seed: int = 7) -> Network:
    """Adam on cross-entropy over the windows of each text, classes weighted equally."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = [languages.index(lang) for w, lang in zip(samples, labels, strict=True) for _ in range(len(w))]
    x, y = np.concatenate(samples), np.array(target)
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    total, deep = FILTERS * len(WIDTHS), max(WIDTHS) * EMBEDDING
    mask = np.repeat(np.array([[1.0 if k < w else 0.0 for w in WIDTHS for _ in range(FILTERS)] for k in range(max(WIDTHS))], np.float32), EMBEDDING, 0)
    net = Network(languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), (rng.normal(0, 0.3, (deep, total)) * mask).astype(np.float32), np.zeros(total, np.float32), rng.normal(0, 0.3, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    names = ("embed", "filters", "bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            batch = x[part]
            patches, hidden, top = net.pooled(batch)
            act = np.maximum(top + net.bias, 0)
            logits = act @ net.out + net.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[part][:, None] / len(part)
            back = (p @ net.out.T) * (act > 0)
            at = hidden.argmax(1)
            rows = np.arange(len(part))[:, None]
            chosen = patches[rows, at]  # (batch, filters, deep)
            grad = {"out": act.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "filters": np.einsum("bf,bfd->df", back, chosen) * mask}
            into = (back[:, :, None] * net.filters.T[None]).reshape(len(part), total, max(WIDTHS), EMBEDDING)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], batch[rows[:, :, None], at[:, :, None] + np.arange(max(WIDTHS))], into)
            step += 1
            for k in names:
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.001 * (grad[k] ** 2 - v[k])
                getattr(net, k)[...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def sample(labelled: DataFrame, per_language: int, windows: int, languages: int = 1000) -> list:
    """(lang, doc_id, windows) of about per_language rows of each language with a letter in their text, by a hash of their ids."""
    long = WINDOW + max(WIDTHS) - 1

    @F.pandas_udf("binary")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spread(t, windows).tobytes() if has_letter(t) else None)

    labelled = labelled.filter("text is not null and lang is not null and doc_id is not null")
    counts = labelled.groupBy("lang").count().limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return []
    # One row for each language; the share of its rows that the bound lets in.
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], per_language / r["count"])))
    hashed = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")) / F.lit(2.0**63) + 1) / 2
    chosen = labelled.filter(hashed < F.element_at(share, F.col("lang"))).select("lang", "doc_id", cut("text").alias("w")).filter("w is not null")
    return sorted((r["lang"], r["doc_id"], np.frombuffer(bytes(r["w"]), np.uint8).reshape(-1, long).tobytes()) for r in chosen.collect())


def fit(labelled: DataFrame, *, per_language: int = 500, windows: int = 4, **options) -> Network | None:
    """The network trained on a bounded sample of labelled rows; None if there is none."""
    rows = sample(labelled, per_language, windows)
    long = WINDOW + max(WIDTHS) - 1
    return train([np.frombuffer(w, np.uint8).reshape(-1, long) for _, _, w in rows], [lang for lang, _, _ in rows], **options) if rows else None


def classified(texts: list[str | None], scorer: Scorer | None) -> pa.Array:
    sums = np.zeros((len(texts), len(scorer.net.languages) if scorer else 1))
    known = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if scorer and t and has_letter(t):
            known[i] = True
            scorer.add(t, i, sums)
    if scorer:
        scorer.flush(sums)
    p = sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)
    names = [scorer.net.languages[b] if k else "und" for b, k in zip(p.argmax(1), known, strict=True)] if scorer else ["und"] * len(texts)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(known, p.max(1), 0.0))], fields=list(RESULT))


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score of every whole text; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(net) if net else None
        try:
            for batch in batches:
                parts = [classified(part.to_pylist(), scorer) for part in slices([batch])]
                yield pa.concat_arrays(parts) if parts else pa.array([], RESULT)
                del batch
        finally:
            release()

    return docs.withColumn("__lang", classify(F.col(text))).withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")
