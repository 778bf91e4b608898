"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0 .. c_{n-1} get the modular prefix array S_i = sum over k < i of (c_k + 1) B^k, for two primes. Any span's hash is
(S_j - S_i) B^-i, so spans of one or several texts are compared in constant time and the longest common extension of two positions is found by
binary search. The fingerprint joins the whole text's hash with a one-permutation MinHash of the hashes of all spans of SPAN code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

PRIMES, BASE = (2**31 - 1, 2**31 - 19), 1_000_003
#: Code points of a span, bins of the sketch and bits kept of each bin's minimum.
SPAN, BINS, BIN_BITS = 16, 64, 12
NONE = np.uint64(2**64 - 1)


class _Powers:
    """B^k and B^-k for each prime, as far as any text has needed."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> _Powers:
        while len(self.up[0]) <= n:
            m = len(self.up[0])
            for tables, bases in ((self.up, [BASE] * 2), (self.down, [pow(BASE, -1, p) for p in PRIMES])):
                for i, p in enumerate(PRIMES):
                    tables[i] = np.concatenate([tables[i], tables[i] * np.uint64(pow(bases[i], m, p)) % np.uint64(p)])
        return self


_POWERS = _Powers()


class PrefixHash:
    """The prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        powers = _POWERS.upto(self.n)
        self.prefix = []
        for i, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * powers.up[i][: self.n] % np.uint64(p), out=s[1:])
            self.prefix.append(s % np.uint64(p))

    def spans(self, starts: np.ndarray | slice, width: int) -> np.ndarray:
        """62-bit hashes of the spans of one width that begin at starts."""
        at = np.arange(self.n + 1)[starts] if isinstance(starts, slice) else starts
        out = np.zeros(len(at), np.uint64)
        for i, p in enumerate(PRIMES):
            s, p64 = self.prefix[i], np.uint64(p)
            out = out << np.uint64(31) | (s[at + width] + p64 - s[at]) * _POWERS.down[i][at] % p64
        return out

    def all_spans(self, width: int) -> np.ndarray:
        """The same for each start, without index arrays."""
        m = self.n - width + 1
        out = None
        for i, p in enumerate(PRIMES):
            s, p64 = self.prefix[i], np.uint64(p)
            h = (s[width:] + p64 - s[:m]) * _POWERS.down[i][:m] % p64
            out = h if out is None else out << np.uint64(31) | h
        return out

    def span(self, i: int, j: int) -> int:
        """The hash of text[i:j]."""
        out = 0
        for k, p in enumerate(PRIMES):
            out = out << 31 | (int(self.prefix[k][j]) - int(self.prefix[k][i])) * int(_POWERS.down[k][i]) % p
        return out

    def joined(self, i: int, other: PrefixHash, j: int) -> int:
        """The hash of text[:i] + other[:j], from the prefix arrays alone."""
        out = 0
        for k, p in enumerate(PRIMES):
            out = out << 31 | (int(self.prefix[k][i]) + int(_POWERS.up[k][i]) * int(other.prefix[k][j])) % p
        return out


def equal_spans(a: PrefixHash, i: int, b: PrefixHash, j: int, width: int) -> bool:
    return a.span(i, i + width) == b.span(j, j + width)


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The most code points in which a from i and b from j agree, by binary search over span equality, below the first power of two that is too many."""
    low, high, step = 0, min(a.n - i, b.n - j), 1
    while step < high and equal_spans(a, i, b, j, step):
        low, step = step, 2 * step
    high = min(high, step)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal_spans(a, i, b, j, mid) else (low, mid - 1)
    return low


def _minima(values: np.ndarray) -> np.ndarray:
    out = np.full(BINS, NONE)
    np.minimum.at(out, (values >> np.uint64(58)).astype(np.intp), values)
    return out


def _hex(whole: int, minima: np.ndarray) -> str:
    kept = np.where(minima == NONE, 0, 1 + minima % np.uint64((1 << BIN_BITS) - 1))
    return f"{whole:016x}" + "".join([f"{x:03x}" for x in kept.tolist()])


class _Doc:
    """What a text's neighbours in the order need of it."""

    def __init__(self, doc_id: int | None, text: str) -> None:
        self.id, self.text = doc_id, text
        self.hashes = PrefixHash(text)
        n = self.hashes.n
        self.values = U.mix64(self.hashes.all_spans(SPAN)) if n >= SPAN else np.zeros(0, np.uint64)
        if 0 < n < SPAN:
            self.print = _hex(self.hashes.span(0, n), _minima(U.mix64(np.array([self.hashes.span(0, n)], np.uint64))))
        else:
            self.print = _hex(self.hashes.span(0, n), _minima(self.values))


def fingerprint(text: str) -> str:
    """The hash of the whole text (16 hex digits), then three digits for each bin; 000: no span fell into it."""
    return _Doc(None, text).print


def likeness(a: str, b: str) -> float:
    """Share of bins on which two fingerprints agree, of those that either fills: an estimate of the spans' Jaccard similarity. Equal fingerprints: 1."""
    if a == b:
        return 1.0
    x, y = ([f[i : i + 3] for i in range(16, len(f), 3)] for f in (a, b))
    filled = sum(p != "000" or q != "000" for p, q in zip(x, y, strict=True))
    return sum(p == q != "000" for p, q in zip(x, y, strict=True)) / filled if filled else 0.0


def _edited(doc: _Doc, after: _Doc) -> tuple[str, str]:
    """The edited text and its fingerprint, from both texts' span hashes; only spans across the joint are hashed anew."""
    half = doc.hashes.n // 2
    keep, take = doc.hashes.n - half, min(half, after.hashes.n)
    text = doc.text[:keep] + after.text[:take]
    if keep + take < SPAN:
        return text, fingerprint(text)
    joint = PrefixHash(doc.text[max(0, keep - SPAN + 1) : keep] + after.text[: min(take, SPAN - 1)])
    across = U.mix64(joint.all_spans(SPAN)) if joint.n >= SPAN else np.zeros(0, np.uint64)
    own = doc.values[: max(0, keep - SPAN + 1)]
    their = after.values[: max(0, take - SPAN + 1)]
    return text, _hex(doc.hashes.joined(keep, after.hashes, take), _minima(np.concatenate([own, across, their])))


def _result(doc: _Doc, after: _Doc) -> tuple:
    text, edited = _edited(doc, after)
    n, half = doc.hashes.n, doc.hashes.n // 2
    common = longest_common_extension(doc.hashes, 0, after.hashes, 0)
    kept = n - half + longest_common_extension(doc.hashes, n - half, after.hashes, 0)
    return doc.id, doc.hashes.n, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), doc.print, edited, likeness(doc.print, edited), likeness(doc.print, after.print), kept, common


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
#: Text bytes of a range partition.
PART_BYTES = 24 << 20


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x.decode("utf-8", "replace") for x in U.byte_texts(batch, column)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row a document of docs (doc_id, text): its fingerprint, how like it is to those of the edited text and of the next document (near_*), and
    how many code points it has in common with either from the beginning (common_*, longest common extensions).

    The order is ascending doc_id (nulls first, equal ids by text), the last document's next is the first. Null texts count as empty; an empty
    table gives none; repeated rows follow each other. Very long texts are hashed whole, in about 100 bytes a code point. Other columns are
    ignored, whatever their names. The text is shuffled once, by ranges of doc_id and, among equal ids, of text. Each range's first and last text,
    one of each for a partition, meet in a small join.
    """
    start = F.substring("text", 1, 64)  # parts rows of one doc_id, or of none, without reading texts twice
    ordered = docs.select("doc_id", "text").repartitionByRange(U.partitions_for(docs, "text", PART_BYTES), F.col("doc_id"), start).sortWithinPartitions("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, done, edge = TaskContext.get().partitionId(), None, [], []

        def batch() -> pa.RecordBatch:
            cells = [(0, None, None, *x) for x in done] + edge
            done.clear()
            edge.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*cells, strict=True), [pa.int32(), pa.int32(), pa.string(), *_KINDS], strict=True)], names=["kind", "part", "text", *_NAMES])

        for piece in U.slices(batches, "text"):
            ids = piece.column(piece.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, _texts(piece, "text"), strict=True):
                doc = _Doc(doc_id, text)
                if before is None:
                    edge.append((1, part, text, doc_id, *[None] * 8))
                else:
                    done.append(_result(before, doc))
                before = doc
            if done or edge:
                yield batch()
        if before is not None:
            edge.append((2, part, before.text, before.id, *[None] * 8))
            yield batch()

    found = U.written(ordered.mapInArrow(rows, f"kind int, part int, text string, {RESULT}"))
    parts = sorted(r[0] for r in found.where("kind = 1").select("part").collect())
    after = found.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = found.where("kind = 2").select("part", F.col("doc_id"), "text").join(after, "part")
    first = found.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_result(_Doc(i, a), _Doc(None, b)) for i, a, b in zip(batch.column(0).to_pylist(), _texts(batch, "text"), _texts(batch, "next_text"), strict=True)]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*cells, strict=True), _KINDS, strict=True)], names=_NAMES)

    ends = last.join(first, "next").select("doc_id", "text", "next_text").mapInArrow(pairs, RESULT)
    return found.where("kind = 0").select(*_NAMES).unionByName(ends)


def op3_span_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts and of their neighbours."""
    return fingerprint_documents(U.table(spark, sf_dir, "documents"))
