"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into overlapping passages, which become TF-IDF rows whose document frequencies are counted over the whole corpus; a
distributed randomised SVD of the passages gives the latent space. Every window of every document is folded in, and items of a passage with a
cosine of NEAR or more are its candidates. A candidate is a leak if the longest common subsequence of words with the text around covers most of
the whole item, or, for a paraphrase, less of it but its answer (the item's last words) as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

#: Half a window, in words; windows advance by it, and so do the passages of items that are longer than a window.
BLOCK = 32
#: Rank of the latent space, columns more in the random sketch, and power iterations.
RANK, MORE, POWER = 128, 16, 2
#: Terms in a larger share of documents say nothing, but for each passage's rarest.
COMMON, RAREST = 0.02, 8
#: Least cosine of a candidate, least share of the passage's vector that its window holds, and the most terms that a window is asked to hold.
NEAR, SHARE, TERMS = 0.35, 0.25, 2
#: Shares of an item in the longest common subsequence that make a leak, alone or with the answer.
COPY, PARAPHRASE = 0.75, 0.5
#: Last words of an item that count as its answer, and the share of them that must be there.
ANSWER, ANSWER_SHARE = 4, 0.5
#: Benchmark items that are searched for at once.
ITEMS = 4096
_MARKS = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def terms(text: bytes) -> list[bytes]:
    """Lower-cased words without marks around them; words of marks alone are left out."""
    return [w for w in (x.strip(_MARKS) for x in text.translate(U.LOWER).split()) if w]


def passages(words: list[bytes]) -> list[list[bytes]]:
    """The words, or where they are more than a window holds, windows of them that overlap by half; none where there are none."""
    size, n = 2 * BLOCK, len(words)
    if n <= size:
        return [words] if words else []
    return [words[a : a + size] for a in [*range(0, n - size, BLOCK), n - size]]


def table_of(numbers: dict[bytes, int]) -> U.HashTable:
    """Looks up the numbers 0, 1, ... of terms by their hashes."""
    known = sorted(numbers, key=numbers.get)
    ends = np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))
    return U.HashTable(U.hash_spans(b"".join(known), np.append(0, ends[:-1])[: len(known)], ends))


def document_frequencies(docs: DataFrame, numbers: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many of docs (text) each term is, over all of them, and how many there are. Each task sends one count for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, df, n = table_of(numbers), np.zeros(len(numbers) + 1, np.int64), 0
        for part in U.slices(batches, "text"):
            words = U.Words(U.byte_texts(part))
            ids = table.find(words.hashes(*words.bare()))
            some = ids >= 0
            df[:-1] += np.bincount(np.unique(words.text[some] * len(numbers) + ids[some]) % max(1, len(numbers)), minlength=len(numbers))
            n += len(part)
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    df = np.zeros(len(numbers) + 1, np.int64)
    for term, count in docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = count
    return df[:-1], int(df[-1])


def _rows(texts: list[bytes], numbers: dict[bytes, int], weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF rows of unit length."""
    out = []
    for text in texts:
        ids, tf = np.unique([numbers[w] for w in terms(text) if w in numbers], return_counts=True)
        ids, values = ids.astype(np.int64), tf * weight[ids.astype(np.int64)]
        out.append((ids, values / (np.sqrt((values * values).sum()) or 1.0)))
    return out


def _gather(passages: DataFrame, numbers: dict[bytes, int], weight: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """Sums over all passages of A'(A basis), or of (A basis)'(A basis): one matrix from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1] if gram else len(weight), basis.shape[1]))
        for batch in batches:
            for ids, values in _rows(U.byte_texts(batch), numbers, weight):
                y = values @ basis[ids]
                if gram:
                    total += np.outer(y, y)
                else:
                    total[ids] += np.outer(values, y)
        some = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["row", "values"])

    out = np.zeros((basis.shape[1] if gram else len(weight), basis.shape[1]))
    for row, values in passages.select("text").mapInArrow(run, "row long, values array<double>").toLocalIterator():
        out[row] += values
    return out


def latent_space(passages: DataFrame, numbers: dict[bytes, int], weight: np.ndarray, rank: int = RANK, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors (a row a term) of the passages' TF-IDF matrix, by a randomised SVD with power iterations."""
    width = min(rank + MORE, len(weight))
    basis = np.random.default_rng(seed).normal(size=(len(weight), width))
    for _ in range(1 + POWER):
        basis = np.linalg.qr(_gather(passages, numbers, weight, basis, False))[0]
    values, vectors = np.linalg.eigh(_gather(passages, numbers, weight, basis, True))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(initial=0), 1e-300)]
    return basis @ vectors[:, keep]


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judged(item: list[bytes], around: list[bytes]) -> tuple[float, float]:
    """The share of the item that the text holds in order and close together, as a passage does, and the share of its answer; 0 where it is less than
    a paraphrase holds."""
    n = len(item)
    if lcs(item, around) < PARAPHRASE * n:
        return 0.0, 0.0
    got = max(lcs(item, around[k : k + n + n // 2]) for k in range(0, max(1, len(around) - n // 2), max(1, n // 4))) / n
    answer = item[-ANSWER:]
    return got, lcs(answer, around) / len(answer)


def leaked(got: float, answer: float) -> bool:
    return got >= COPY or (got >= PARAPHRASE and answer >= ANSWER_SHARE)


class Index:
    """A block of benchmark items, by their passages in the latent space."""

    def __init__(self, items: list[tuple[int, list[bytes]]], numbers: dict[bytes, int], weight: np.ndarray, space: np.ndarray) -> None:
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        cut = [(k, p) for k, (_, words) in enumerate(items) for p in passages(words)]
        self.item = np.array([k for k, _ in cut], np.int64)
        #: Terms that count, by their numbers, and their vectors.
        used = np.flatnonzero(weight > 0)
        place = np.full(len(weight), -1)
        place[used] = np.arange(len(used))
        self.numbers = {w: int(place[i]) for w, i in numbers.items() if weight[i] > 0}
        self.vectors = (weight[:, None] * space)[used].astype(np.float32)
        rows = [v @ space[i] for i, v in _rows([b" ".join(p) for _, p in cut], numbers, weight)]
        own = np.array(rows, np.float32).reshape(len(cut), space.shape[1])
        length = np.maximum(np.linalg.norm(own, axis=1), 1e-9)
        self.rows = own / length[:, None]
        whole = np.array([np.sqrt(sum((weight[i] ** 2 for i in {numbers[w] for w in p}), 0.0)) for _, p in cut], np.float32)
        self.size = np.maximum(length * whole, 1e-9)  # of the passage as a window would hold it
        self.least = max(1, min([TERMS, *(len({w for w in p if w in self.numbers}) // 2 for _, p in cut)]))

    def search(self, texts: list[bytes], table: U.HashTable) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share of the item in the longest common subsequence, share of its answer) of the leaks, the best window of each.
        table: that of the numbers."""
        words = U.Words(texts)
        begin, end = words.bare()
        ids = table.find(words.hashes(begin, end))
        hit = np.flatnonzero(ids >= 0)
        if not len(hit) or not len(self.rows):
            return []
        first = np.cumsum(words.counts) - words.counts
        doc = words.text[hit]
        blocks = -(-words.counts // BLOCK) + 1  # one more, so that windows don't cross from text to text
        before = np.cumsum(blocks) - blocks
        key = before[doc] + (hit - first[doc]) // BLOCK
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes, own = np.diff(np.append(heads, len(key))), key[heads]
        followed = np.append(own[1:] == own[:-1] + 1, False)
        n = sizes + np.where(followed, np.append(sizes[1:], 0), 0)
        near = np.flatnonzero(n >= self.least)  # blocks that begin a window with terms enough
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for at in range(0, len(near), 4096):
            self._windows(near[at : at + 4096], ids[hit], sizes, followed, heads, doc[heads], own - before[doc[heads]], words, begin, end, first, best)
        return [(d, self.ids[i], *x) for (d, i), x in best.items()]

    def _windows(self, near, ids, sizes, followed, heads, doc, block, words, begin, end, first, best) -> None:  # noqa: ANN001
        """Finds the leaks of some windows, each a block of hits and the next one."""
        used = np.unique(np.concatenate([near, near[followed[near]] + 1]))
        rows = U.ragged(heads[used], sizes[used])
        sums = np.add.reduceat(self.vectors[ids[rows]], np.cumsum(sizes[used]) - sizes[used], axis=0)
        at = np.searchsorted(used, near)
        windows, both = sums[at], followed[near]
        windows[both] += sums[at[both] + 1]
        dot = windows @ self.rows.T
        cosine = dot / np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
        w, p = np.nonzero((cosine >= NEAR) & (dot >= SHARE * self.size))
        tried: set[tuple[int, int]] = set()
        for w, i, c in zip(w.tolist(), self.item[p].tolist(), cosine[w, p].tolist(), strict=True):
            d, item = int(doc[near[w]]), self.words[i]
            known = best.get((d, i), (0.0, 0.0, 0.0))
            if (w, i) in tried or known[1] >= 1:
                continue
            tried.add((w, i))
            at = int(block[near[w]]) * BLOCK
            a, b = max(0, at - len(item)), min(int(words.counts[d]), at + 2 * BLOCK + len(item))
            some = slice(int(first[d]) + a, int(first[d]) + b)
            around = [words.buffer[x:y] for x, y in zip(begin[some].tolist(), end[some].tolist(), strict=True) if y > x]
            got, answer = judged(item, around)
            if leaked(got, answer) and got > known[1]:
                best[d, i] = (c, got, answer)


LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): items of benchmark (item_id, text) that docs (doc_id, text) hold, each pair once.

    Whole texts are searched, whatever their length, for whole items, whatever theirs. Null and empty texts hold nothing; items without terms are
    found nowhere; a null doc_id or item_id stays null in its pairs. Items of rows with one doc_id come once for each such row, and equal items
    each for itself; of windows that hold an item equally well the first counts. Other columns are ignored, whatever their names; an empty table
    gives none. The benchmark is searched for in blocks of about ITEMS items, one after another; a block's vocabulary, vectors and items are what
    the driver and each task hold of it.
    """
    benchmark, found = benchmark.select("item_id", "text"), None
    blocks = -(-benchmark.count() // ITEMS)
    for k in range(blocks):
        some = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        index = _index(docs, [(r[0], terms((r[1] or "").encode())) for r in some.collect()])
        if index is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            table = table_of(index.numbers)
            for part in U.slices(batches, "text"):
                rows = index.search(U.byte_texts(part), table)
                if rows:
                    which, item, *more = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in more)], names=[x.split()[0] for x in LEAKS.split(", ")])

        one = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEAKS)
        found = one if found is None else found.union(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], LEAKS)


def _index(docs: DataFrame, items: list[tuple[int, list[bytes]]]) -> Index | None:
    """The index of a block of items; None where they have no terms."""
    numbers: dict[bytes, int] = {}
    for _, words in items:
        for w in words:
            numbers.setdefault(w, len(numbers))
    if not numbers:
        return None
    df, n = document_frequencies(docs, numbers)
    common = df > max(COMMON * n, 10)
    cut = [p for _, words in items for p in passages(words)]
    for p in cut:
        common[sorted({numbers[w] for w in p}, key=lambda i: (df[i], i))[:RAREST]] = False
    weight = np.where(common, 0.0, np.log((n + 1) / (df + 1)) + 1)
    rows = docs.sparkSession.createDataFrame([(b" ".join(p).decode("utf-8", "replace"),) for p in cut], "text string")
    return Index(items, numbers, weight, latent_space(rows, numbers, weight))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they hold."""
    return leaks(U.table(spark, sf_dir, "documents"), U.table(spark, sf_dir, "benchmark"))
