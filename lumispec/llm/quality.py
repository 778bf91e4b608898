"""Quality classifier: naive Bayes support vectors on n-gram indicators.

The n-grams are one and two lower-cased words, and one to three word shapes (runs of letters, capitals and digits as one sign each, marks as
they are, and whether the word is the one before again). An indicator is scaled by its log-count ratio between the classes, the vector is
brought to length 1, and a linear model with hinge loss is fitted by dual coordinate descent; margins become probabilities by Platt's method
on out-of-fold margins. The fit is on the driver, from a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U
from . import linear

BITS = 20
#: Labelled rows that a model is fitted on at most, those of least xxhash64(doc_id); and the least number of them that must have an n-gram.
SAMPLE, LEAST = 4000, 4
COST, FOLDS = 1.0, 3

_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+", re.DOTALL), rb"\1")]


def shape(word: bytes) -> bytes:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:12]


class NGrams:
    """Distinct n-gram numbers of texts."""

    def __init__(self) -> None:
        def shapes(words: list[bytes]) -> np.ndarray:
            made = [shape(w) for w in words]
            ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
            return U.mix64(U.hash_spans(b"".join(made), np.append(0, ends[:-1])[: len(made)], ends) + np.uint64(1))

        self.shapes = U.Memo(shapes)

    def of(self, texts: list[bytes], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and n-gram numbers, distinct and in order; of the kept ones alone where kept (a boolean for each) is given."""
        words = U.Words(texts, lower=False)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = words.text
        h = U.hash_spans(words.buffer.translate(U.LOWER), words.begin, words.end)
        s = self.shapes.of(words, words.hashes())
        again = np.zeros(len(words), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        s = s + again.astype(np.uint64)
        found = []
        for grams, longest, salt in ((h, 2, 11), (s, 3, 23)):
            g = U.mix64(grams + np.uint64(salt))
            for n in range(1, longest + 1):
                if n > 1:
                    g = U.mix64(g[:-1] * np.uint64(3) + grams[n - 1 :])
                here = doc[: len(g)]
                ids = (g >> np.uint64(64 - BITS)).astype(np.int64)
                use = doc[n - 1 :] == here
                if kept is not None:
                    use &= kept[ids]
                found.append(here[use] << BITS | ids[use])
        both = np.unique(np.concatenate(found))
        return both >> BITS, both & ((1 << BITS) - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = NGrams()
    for part in U.slices(batches, "text"):
        doc, ids = grams.of(U.byte_texts(part))
        ends = np.searchsorted(doc, np.arange(len(part) + 1))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32))], names=["label", "grams"])


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """label and text of at most `limit` labelled documents of docs (doc_id, text): those of least xxhash64(doc_id). One row counts for each doc_id,
    of labels that of the least label, of docs the least text."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # limit rows at most
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")


class NBSVM:
    """The fitted model: a weight for each kept n-gram and its log-count ratio."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        size = 1 << BITS
        df = np.bincount(np.concatenate(rows), minlength=size) if rows else np.zeros(size, np.int64)
        self.kept = df >= LEAST
        rows = [r[self.kept[r]] for r in rows]
        self.constant = float(y.mean()) if len(y) else 0.5
        self.plain = len(set(y.tolist())) < 2 or np.bincount(y).min() < FOLDS
        if self.plain:  # one class, or next to none of one: there is nothing to learn
            return
        margins, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
        for k in range(FOLDS):
            r, w = self._fit([rows[i] for i in np.flatnonzero(fold != k)], y[fold != k])
            margins[fold == k] = self._vectors([rows[i] for i in np.flatnonzero(fold == k)], r).dot(w)
        self.a, self.b = linear.platt(margins, y)
        r, w = self._fit(rows, y)
        self.scaled, self.square = (w * r).astype(np.float32), (r * r).astype(np.float32)

    @staticmethod
    def _vectors(rows: list[np.ndarray], r: np.ndarray) -> linear.Sparse:
        values = [r[x] for x in rows]
        return linear.Sparse(rows, [v / (np.sqrt((v * v).sum()) or 1.0) for v in values])

    def _fit(self, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = 1 << BITS
        r = linear.log_count_ratio(linear.Sparse(rows), y, size)
        share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
        return r, linear.hinge_dual(self._vectors(rows, r), np.where(y > 0, 1.0, -1.0), size, COST / (2 * share))

    def score(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Probability of class 1 of n texts."""
        if self.plain:
            return np.full(n, self.constant)
        dot, square = (np.bincount(doc, x[ids], n) for x in (self.scaled, self.square))
        return linear.sigmoid(self.a * dot / np.sqrt(np.maximum(square, 1e-12)) + self.b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> NBSVM:
    """Fits on a bounded sample of docs (doc_id, text) that labels (doc_id, label 0 or 1) covers; only feature numbers come to the driver."""
    found = bounded_sample(docs, labels, label, limit).mapInArrow(_features, "label int, grams array<int>").toArrow()
    rows = [np.asarray(x.values) for x in found["grams"]]
    model = NBSVM(rows, found["label"].to_numpy().astype(np.int64))
    del found, rows
    U.give_back()
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: NBSVM) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    grams = NGrams()
    for part in U.slices(batches, "text"):
        yield part, model.score(*grams.of(U.byte_texts(part), model.kept), len(part))


def score_documents(docs: DataFrame, model: NBSVM) -> DataFrame:
    """docs (text and more columns) with score, the probability of class 1. Null and empty texts have the score of no n-grams; equal texts have
    equal scores, and very long ones are read whole. An empty table gives none. Other columns pass through, whatever their names; one named score
    is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _scores(batches, model):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    return U.mapped(docs, run, "score double")


def keep_good(docs: DataFrame, model: NBSVM, least: float) -> DataFrame:
    """The rows of docs (text and more columns, whatever their names) whose score is `least` or more; null and empty texts are judged by the score of
    no n-grams, equal texts alike, very long ones whole. An empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _scores(batches, model):
            yield part.filter(pa.array(score >= least))

    return U.mapped(docs, run)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents: learnt from labels.quality of the rows that aren't held out."""
    docs = U.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = U.table(spark, sf_dir, "labels").where(U.remainder5(F.col("doc_id")) != 0)
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (U.remainder5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
