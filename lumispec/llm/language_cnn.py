"""Language identification by a byte convolutional network, trained and applied in numpy.

A window of WINDOW bytes goes through filters of several widths on one-hot bytes (a filter is a table of 256 weights for each of its places),
the largest answer of each filter over the window, a rectifier and a softmax. A text is cut into windows that overlap by the widest filter
less one, so that no n-gram of bytes is missed; its languages' log probabilities are the windows' mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
STRIDE = WINDOW - max(WIDTHS) + 1
#: About so many documents of each language are learnt from, and so many windows of each.
PER_LANGUAGE, WINDOWS = 800, 3
LANGUAGES = 10_000
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the texts (a row each, short texts filled up with zeros) and the number of each text's."""
    padded = [t if len(t) >= WINDOW else t.ljust(WINDOW, b"\0") for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    counts = 1 + -(-(sizes - WINDOW) // STRIDE)
    start = np.cumsum(sizes) - sizes
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(start, counts) + np.minimum(within * STRIDE, np.repeat(sizes - WINDOW, counts))
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(padded), np.uint8), WINDOW)
    return view[begin], counts


class ByteCNN:
    def __init__(self, classes: list[str], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.bias, self.out = np.zeros(n, np.float32), rng.normal(0, n**-0.5, (n, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _answers(self, x: np.ndarray) -> list[np.ndarray]:
        """x: (place, window). For each width (place, window, filter)."""
        out = []
        for table, w in zip(self.tables, WIDTHS, strict=True):
            n = WINDOW - w + 1
            r = table[0][x[:n]]
            for j in range(1, w):
                r += table[j][x[j : n + j]]
            out.append(r)
        return out

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                rows = order[at : at + BATCH]
                x = np.ascontiguousarray(windows[rows].T)
                answers = self._answers(x)
                best = [r.argmax(0) for r in answers]
                top = np.concatenate([np.take_along_axis(r, b[None], 0)[0] for r, b in zip(answers, best, strict=True)], 1) + self.bias
                h = np.maximum(top, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (top > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                f = np.arange(FILTERS)[None, :]
                n = np.arange(len(rows))[:, None]
                for k, (g, b) in enumerate(zip(grads, best, strict=True)):
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(WIDTHS[k]):
                        np.add.at(g[j], (x[b + j, n], f), own)
                grads += [back.sum(0), h.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):  # Adam
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def pairs(self) -> list[tuple[list[tuple[int, np.ndarray]], int]]:
        """For each width, tables by two bytes (or one, at an odd end) with their places: fewer look-ups than one a byte."""
        out = []
        for table, w in zip(self.tables, WIDTHS, strict=True):
            parts = [(j, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            out.append((parts + ([(w - 1, table[w - 1])] if w % 2 else []), w))
        return out

    def log_probabilities(self, windows: np.ndarray, pairs: list) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for at in range(0, len(windows), BATCH):
            x = np.ascontiguousarray(windows[at : at + BATCH].T)
            two = x[:-1].astype(np.uint16) << 8 | x[1:]
            tops = []
            for parts, w in pairs:
                n = WINDOW - w + 1
                r = None
                for j, table in parts:
                    got = table.take((x if len(table) == 256 else two)[j : n + j], 0)
                    r = got if r is None else np.add(r, got, out=r)
                tops.append(r.reshape(n, -1).max(0).reshape(-1, FILTERS))
            z = np.maximum(np.concatenate(tops, 1) + self.bias, 0) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            out[at : at + BATCH] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, texts: list[bytes], pairs: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of the likeliest class of each text, and its probability."""
        windows, counts = windows_of(texts)
        each = self.log_probabilities(windows, pairs or self.pairs())
        mean = np.add.reduceat(each, np.cumsum(counts) - counts) / counts[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best].astype(np.float64)


_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS windows of each text, spread evenly from its beginning to its end."""
    for part in U.slices(batches, "text"):
        langs, windows = [], []
        for lang, text in zip(part.column(0).to_pylist(), U.byte_texts(part), strict=True):
            if has_letter(text):
                last = max(0, len(text) - WINDOW)
                for k in range(WINDOWS if last else 1):
                    langs.append(lang)
                    windows.append(text[last * k // (WINDOWS - 1) :][:WINDOW].ljust(WINDOW, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCNN:
    """Trains on docs (doc_id, text, lang), rows with a null lang or text left out: about per_language documents of each language, chosen by
    xxhash64(doc_id), give windows to the driver. A table of languages up to LANGUAGES is broadcast; rows that share a doc_id are chosen together."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count()
    share = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < per_language / F.col("count")
    few = counts.limit(LANGUAGES + 1).count() <= LANGUAGES
    found = known.join(F.broadcast(counts) if few else counts, "lang").where(share).select("lang", "text").mapInArrow(_training_windows, "lang string, window binary").toArrow()
    found = found.sort_by([("lang", "ascending"), ("window", "ascending")])
    langs = found["lang"].to_pylist()
    model = ByteCNN(sorted(set(langs)) or [UNKNOWN])
    if len(model.classes) > 1:
        number = {c: i for i, c in enumerate(model.classes)}
        windows = np.frombuffer(b"".join(found["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
        model.train(windows, np.array([number[x] for x in langs]))
    return model


def identify(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """docs (text and more columns) with lang_pred and score, its probability; `und` and 0 for a text that is null or has no letter.

    Whole texts are read, however long; repeated rows have equal answers, and of equally likely languages the first by name counts. An empty table
    gives none. Other columns pass through, whatever their names; those named lang_pred or score are replaced. A model that has seen one language or none
    answers with it, or with `und`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.pairs()
        for part in U.slices(batches, "text"):
            texts = U.byte_texts(part)
            some = [i for i, t in enumerate(texts) if has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if some:
                best, p = model.predict([texts[i] for i in some], pairs)
                for i, b in zip(some, best.tolist(), strict=True):
                    lang[i] = model.classes[b]
                score[some] = p
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return U.mapped(docs, run, "lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents: learnt from lang of the rows that aren't held out."""
    docs = U.table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(U.remainder5(F.col("doc_id")) != 0))
    held_out = (U.remainder5(F.col("doc_id")) == 0).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")
