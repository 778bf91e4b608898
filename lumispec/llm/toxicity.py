"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear model sees, besides the text's words, the probabilities of the categories before it.
In training those are out-of-fold predictions, so that a later model learns how far the earlier ones can be trusted. The features are
indicators of words and of their beginnings that are tied to a category beyond chance, scaled by their log-count ratios; each model has the
hinge loss, dual coordinate descent and Platt's calibration. The fit is on the driver, from a bounded sample of labelled rows; every document
is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U
from . import linear
from .quality import bounded_sample

#: Features are 32-bit hashes; those in fewer labelled rows than LEAST are left out.
LEAST = 4
#: Labelled rows that a chain is fitted on at most, those of least xxhash64(doc_id).
SAMPLE = 12_000
#: Bytes of the word beginnings that are features of their own.
PREFIXES = (5, 7)
#: Standard errors of the log odds ratio from which a feature is taken, and distinct strong words that make a labelled document severe.
Z_SCORE, SEVERE_WORDS = 4.0, 3
FOLDS, COST = 4, 1.0


def word_features(texts: list[bytes], kept: U.HashTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature numbers, distinct and in order. A feature is a lower-cased word without marks around it, or its first bytes; its
    number is a 32-bit hash, odd for whole words, or its place among the kept ones."""
    words = U.Words(texts)
    begin, end = words.bare()
    some = np.flatnonzero(end > begin)
    begin, end, doc = begin[some], end[some], words.text[some]
    found = []
    for size in (None, *PREFIXES):
        use = slice(None) if size is None else np.flatnonzero(end - begin >= size)
        h = words.hashes(begin[use], end[use] if size is None else begin[use] + size)
        ids = U.mix64(h + np.uint64(size or 0)) >> np.uint64(32)
        ids = (ids | np.uint64(1) if size is None else ids & ~np.uint64(1)).astype(np.int64)
        if kept is not None:
            ids = kept.find(ids.astype(np.uint64) << np.uint64(32))
        of = doc[use][ids >= 0]
        found.append(of << 32 | ids[ids >= 0])
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in U.slices(batches, "text"):
        doc, ids = word_features(U.byte_texts(part))
        ends = np.searchsorted(doc, np.arange(len(part) + 1))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.uint32).view(np.int32))], names=["label", "features"])


def _strong(rows: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """z scores of the features' log odds ratios between the classes, and the features that go beyond Z_SCORE."""
    df1, df0 = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(rows[i] for i in np.flatnonzero(y == c))]), minlength=size) for c in (1, 0))
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    odds = np.log((df1 + 0.5) / (n1 - df1 + 0.5)) - np.log((df0 + 0.5) / (n0 - df0 + 0.5))
    z = odds / np.sqrt(1 / (df1 + 0.5) + 1 / (n1 - df1 + 0.5) + 1 / (df0 + 0.5) + 1 / (n0 - df0 + 0.5))
    return z, np.abs(z) >= Z_SCORE


class Link:
    """One linear model of the chain, over the kept features and the probabilities of earlier categories."""

    def __init__(self, rows: list[np.ndarray], size: int, earlier: np.ndarray, y: np.ndarray) -> None:
        self.size, self.constant = size, float(y.mean()) if len(y) else 0.0
        self.plain = len(y) == 0 or np.bincount(y, minlength=2).min() < 2 * FOLDS
        self.kept = np.zeros(size, bool)
        if self.plain:
            return
        fold, margins = np.arange(len(y)) % FOLDS, np.zeros(len(y))
        for k in range(FOLDS):
            own = np.flatnonzero(fold == k)
            self._fit([rows[i] for i in np.flatnonzero(fold != k)], earlier[fold != k], y[fold != k])
            margins[own] = self._x([rows[i] for i in own], earlier[own]).dot(self.w)
        self.a, self.b = linear.platt(margins, y)
        self.out_of_fold = linear.sigmoid(self.a * margins + self.b)
        self._fit(rows, earlier, y)

    def _x(self, rows: list[np.ndarray], earlier: np.ndarray) -> linear.Sparse:
        """Kept features, then one for each earlier category and a constant one."""
        more = np.arange(earlier.shape[1] + 1) + self.size
        ids = [r[self.kept[r]] for r in rows]
        return linear.Sparse([np.concatenate([x, more]) for x in ids], [np.concatenate([self.r[x], e, [1.0]]) for x, e in zip(ids, earlier, strict=True)])

    def _fit(self, rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> None:
        self.kept = _strong(rows, y, self.size)[1]
        self.r = linear.log_count_ratio(linear.Sparse([x[self.kept[x]] for x in rows]), y, self.size)
        share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
        self.w = linear.hinge_dual(self._x(rows, earlier), np.where(y > 0, 1.0, -1.0), self.size + earlier.shape[1] + 1, COST / (2 * share))

    def ready(self, used: np.ndarray) -> None:
        """Leaves what scoring needs: the weights of the used features."""
        if not self.plain:
            self.scaled = np.where(self.kept, self.w[: self.size] * self.r, 0)[used].astype(np.float32)
            self.more = self.w[self.size :]
            del self.w, self.r, self.out_of_fold
        del self.kept

    def score(self, doc: np.ndarray, ids: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.full(len(earlier), self.constant)
        return linear.sigmoid(self.a * (np.bincount(doc, self.scaled[ids], len(earlier)) + earlier @ self.more[:-1] + self.more[-1]) + self.b)


class Chain:
    """Models of the categories, in order. rows: ascending feature hashes; targets: 0 or 1 for each category and row."""

    def __init__(self, rows: list[np.ndarray], targets: dict[str, np.ndarray]) -> None:
        hashes, df = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_counts=True)
        hashes = hashes[df >= LEAST]
        flat, sizes = np.concatenate([np.zeros(0, np.int64), *rows]), [len(r) for r in rows]
        at = np.minimum(np.searchsorted(hashes, flat), max(0, len(hashes) - 1))
        known = hashes[at] == flat if len(hashes) else np.zeros(len(flat), bool)
        rows = [x[k] for x, k in zip(np.split(at, np.cumsum(sizes)[:-1]), np.split(known, np.cumsum(sizes)[:-1]), strict=True)] if rows else []
        self.names, self.links = list(targets), []
        earlier = np.zeros((len(rows), 0))
        for name in self.names:
            link = Link(rows, len(hashes), earlier, targets[name])
            self.links.append(link)
            earlier = np.column_stack([earlier, np.full(len(rows), link.constant) if link.plain else link.out_of_fold])
        used = np.flatnonzero(np.logical_or.reduce([x.kept for x in self.links]))
        for link in self.links:
            link.ready(used)
        #: Hashes of the features that count, in ascending order.
        self.kept = hashes[used]

    def score(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """A column for each category."""
        earlier = np.zeros((n, 0))
        for link in self.links:
            earlier = np.column_stack([earlier, link.score(doc, ids, earlier)])
        return earlier


def severe(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """1 for the labelled rows that hold SEVERE_WORDS or more distinct strong words of the label; beginnings of words don't count."""
    hashes, ids = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_inverse=True)
    own = np.split(ids, np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    z, strong = _strong(own, y, len(hashes))
    strong &= (z > 0) & (hashes % 2 == 1)
    return np.array([int(label == 1 and strong[r].sum() >= SEVERE_WORDS) for r, label in zip(own, y, strict=True)], np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Chain:
    """Fits the chain severe, then the label itself, on a bounded sample of docs (doc_id, text) that labels (doc_id, label 0 or 1) covers."""
    found = bounded_sample(docs, labels, label, limit).mapInArrow(_features, "label int, features array<int>").toArrow()
    rows = [np.sort(np.asarray(x.values).view(np.uint32).astype(np.int64)) for x in found["features"]]
    y = found["label"].to_numpy().astype(np.int64)
    chain = Chain(rows, {f"severe_{label}": severe(rows, y) if len(y) else y, label: y})
    del found, rows
    U.give_back()
    return chain


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs (text and more columns) with a probability column for each category of the chain, named p_<category>. Null and empty texts are scored
    as texts without words, equal texts equally, and very long ones over all their words. An empty table gives none. Other columns pass through,
    whatever their names; those of these names are replaced."""
    added = [f"p_{name}" for name in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = U.HashTable(chain.kept.astype(np.uint64) << np.uint64(32))
        for part in U.slices(batches, "text"):
            scores = chain.score(*word_features(U.byte_texts(part), kept), len(part))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in scores.T)], names=[*part.schema.names, *added])

    return U.mapped(docs, run, ", ".join(f"`{x}` double" for x in added))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents: learnt from labels.toxic of the rows whose crc32(doc_id as text) mod 5 is not 0. score is the probability of the
    label, predicted is 1 from 0.5."""
    docs = U.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = U.table(spark, sf_dir, "labels").where(U.remainder5(F.col("doc_id")) != 0)
    scored = score_documents(docs, fit(docs, labels))
    held_out = (U.remainder5(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held_out, F.col("p_severe_toxic").alias("severe_score"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
