"""Language-model scoring by a hashed maximum-entropy model.

The next token's class has a softmax over hashed features of what stands before it: the last symbol, the last two (n-grams), and the symbols two
and three back alone (skips). Frequent words are dealt into classes by the company they keep, all others by their last letters. Within a
class of frequent words, a softmax over each word and its pairing with the class before; within the others, counts with the Good-Turing share for
words never seen (one event). So the probabilities of a token's V + 1 events add up to no more than 1.

Counts cover all training tokens. The weights are trained by rounds of distributed gradient updates: each task goes through its documents in
batches with its own AdaGrad steps (one rate for each row of weights), and the rows of weights are averaged by how often each task used them. Scores are sums of log10
probabilities, worked out for batches of tokens in numpy. Words beyond a bounded list of frequent ones get their counts by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

#: Words with a probability of their own within a class; words (of at most LONGEST bytes) whose counts every task knows.
HEAD, LISTED, LONGEST = 4096, 100_000, 64
#: Classes of frequent words and of all others; rows of hashed weights.
HEAD_CLASSES, TAIL_CLASSES, ROW_BITS = 32, 16, 14
CLASSES, ROWS = HEAD_CLASSES + TAIL_CLASSES, 1 << ROW_BITS
#: Each training document is in one of the rounds; each batch of its tokens takes a step.
ROUNDS, BATCH, RATE = 2, 2048, 0.15
#: Context words by which the classes of frequent words are found.
CONTEXTS = 256
#: Rows of weights, or of counts of context words, that travel as one.
BLOCK = 256
#: Batch rows of one feature that are added one by one; those beyond are added by reduceat, which is slow where sums are many and short.
SHORT = 12
END = b""  # no word is empty
LOG10 = math.log(10)


def tokens(text: bytes) -> list[bytes]:
    words = text.translate(U.LOWER).split()
    words.append(END)
    return words


def tail_classes(words: list[bytes]) -> np.ndarray:
    """The class of each word by its last letters."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    begin = np.append(0, ends[:-1])[: len(words)]
    return _tail_classes(b"".join(words), begin, ends)


def _tail_classes(buffer: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (U.hash_spans(buffer, np.maximum(begin, end - 3), end) % np.uint64(TAIL_CLASSES)).astype(np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of docs (text), counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for part in U.slices(batches, "text"):
            for text in U.byte_texts(part):
                held.update(tokens(text))
            if len(held) > 150_000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """All that tasks need; its size is bounded by the parameters above."""

    listed: list[bytes]  # by falling count; the first HEAD are the head
    counts: np.ndarray
    total: int
    distinct: int
    head_class: np.ndarray
    tail_total: np.ndarray  # of each tail class
    tail_unseen: np.ndarray  # the share of words never seen
    weights: np.ndarray | None = None  # ROWS x CLASSES
    bias: np.ndarray | None = None
    within: np.ndarray | None = None  # log P(head word | its class, class before)

    @property
    def base_unit(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))


@dataclass
class Rare:
    """Tokens that aren't listed: their places among the words, hashes, text numbers and classes."""

    words: U.Words
    at: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    cls: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One of the tokens (by its number) for each text and word, and how many there are."""
        key = U.mix64(self.hashes ^ U.mix64(self.doc.astype(np.uint64) + np.uint64(1)))
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        return first, times


class Reader:
    """Texts to symbols, classes and feature rows, for one task."""

    def __init__(self, model: Model) -> None:
        self.model, self.n = model, len(model.listed)
        self.head = min(HEAD, self.n)
        self.symbols = self.head + TAIL_CLASSES + 1  # the last: before the text
        ends = np.cumsum(np.fromiter(map(len, model.listed), np.int64, self.n))
        buffer, begin = b"".join(model.listed), np.append(0, ends[:-1])[: self.n]
        self.table = U.HashTable(U.hash_spans(buffer, begin, ends))
        self.end = model.listed.index(END)
        self.cls = np.concatenate([model.head_class, HEAD_CLASSES + _tail_classes(buffer, begin, ends)[self.head :]])
        s = np.arange(self.symbols, dtype=np.uint64)
        self.rows = [(U.mix64(s + np.uint64(k << 32)) >> np.uint64(64 - ROW_BITS)).astype(np.int64) for k in (1, 3, 4)]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rare]:
        """Text number, place among the listed words (their number for all others) and class of each token, and the tokens that aren't listed."""
        words = U.Words(texts)
        h = words.hashes()
        found = self.table.find(h)
        found[found < 0] = self.n
        cls = np.append(self.cls, 0).take(found)
        rare = np.flatnonzero(found == self.n)
        cls[rare] = HEAD_CLASSES + _tail_classes(words.buffer, words.begin[rare], words.end[rare])
        doc = np.repeat(np.arange(len(texts)), words.counts + 1)
        word, of = np.full(len(doc), self.end), np.full(len(doc), self.cls[self.end])
        place = np.arange(len(words)) + words.text
        word[place], of[place] = found, cls
        return doc, word, of, Rare(words, rare, h[rare], words.text[rare], cls[rare])

    def features(self, doc: np.ndarray, word: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class before (CLASSES: none) and the four feature rows of each token."""
        symbol = np.where(word < self.head, word, self.head + cls - HEAD_CLASSES)
        start = self.symbols - 1
        back = []
        for k in (1, 2, 3):
            s = np.full(len(word), start)
            s[k:] = np.where(doc[k:] == doc[: len(doc) - k], symbol[: len(doc) - k], start)
            back.append(s)
        pair = U.mix64((back[0] * self.symbols + back[1]).astype(np.uint64) + np.uint64(2 << 32)) >> np.uint64(64 - ROW_BITS)
        rows = np.stack([self.rows[0][back[0]], pair.astype(np.int64), self.rows[1][back[1]], self.rows[2][back[2]]])
        before = np.full(len(word), CLASSES)
        before[1:] = np.where(doc[1:] == doc[:-1], cls[:-1], CLASSES)
        return before, rows


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], 0)
    for r in rows[1:]:
        z += weights.take(r, 0)
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def row_sums(g: np.ndarray, of: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows g[of[head : head + size]], for heads in order of falling size: the first row of all sums, then the second of those that have
    one, and so on."""
    out = g.take(of[heads], 0)
    falling = -sizes
    for k in range(1, SHORT):
        n = int(np.searchsorted(falling, -k))  # sizes beyond k
        if not n:
            return out
        out[:n] += g.take(of[heads[:n] + k], 0)
    n = int(np.searchsorted(falling, -SHORT))
    if n:
        rest = sizes[:n] - SHORT
        out[:n] += np.add.reduceat(g.take(of[U.ragged(heads[:n] + SHORT, rest)], 0), np.cumsum(rest) - rest, axis=0)
    return out


def find_classes(model: Model, docs: DataFrame) -> np.ndarray:
    """Classes of the head words: k-means of the leading singular vectors of their positive mutual information with the words around them, in all
    documents. The end of a text has a class of its own."""
    head = min(HEAD, len(model.listed))
    other = max(head, CONTEXTS)
    model.head_class = np.zeros(head, np.int64)  # not known yet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, near = Reader(model), np.zeros(head * CONTEXTS, np.int64)
        for part in U.slices(batches, "text"):
            doc, word, _, _ = reader.read(U.byte_texts(part))
            word[word >= head], cells = other, []
            frequent = np.flatnonzero(word < CONTEXTS)
            for k in (1, 2, 3):
                for side in (-k, k):
                    y = frequent[(frequent + side >= 0) & (frequent + side < len(word))]
                    x = y + side
                    use = (doc[x] == doc[y]) & (word[x] < head)
                    cells.append(word[x[use]] * CONTEXTS + word[y[use]])
            near += np.bincount(np.concatenate(cells), minlength=len(near))
        step = BLOCK * CONTEXTS
        some = [(k, x.tobytes()) for k in range(-(-head // BLOCK)) if (x := near[k * step : (k + 1) * step]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.int64)
                held[k] = held[k] + x if k in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "sums"])

    near = np.zeros((head, CONTEXTS))
    for k, x in docs.select("text").mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary").collect():
        near[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(x, np.int64).reshape(-1, CONTEXTS)
    total = max(near.sum(), 1)
    expected = near.sum(1, keepdims=True) @ near.sum(0, keepdims=True) / total
    ppmi = np.log(np.maximum((near + 1e-3) / (expected + 1e-3), 1))
    u, s, _ = np.linalg.svd(ppmi, full_matrices=False)
    x = u[:, :16] * s[:16]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    k = min(HEAD_CLASSES - 1, head)
    centre = x[np.linspace(0, head - 1, k).astype(int)]
    for _ in range(15):
        own = (x @ centre.T).argmax(1)
        for c in range(k):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
    own = own.astype(np.int64)
    if END in model.listed[:head]:
        own[model.listed.index(END)] = HEAD_CLASSES - 1
    return own


def train_round(model: Model, docs: DataFrame, within: np.ndarray) -> None:
    """One round over docs: new weights and bias of the model; adds the pairs of class before and head word to within."""
    head = min(HEAD, len(model.listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        w, b = model.weights.copy(), model.bias.copy()
        square, square_b, used = np.full(ROWS, 1e-2, np.float32), np.full(b.shape, 1e-2, np.float32), np.zeros(ROWS, np.float32)
        pairs, n = np.zeros((CLASSES + 1) * head, np.float32), 0
        for part in U.slices(batches, "text"):
            doc, word, cls, _ = reader.read(U.byte_texts(part))
            before, rows = reader.features(doc, word, cls)
            own = word < head
            pairs += np.bincount(before[own] * head + word[own], minlength=len(pairs))
            n += 1
            for at in range(0, len(word), BATCH):
                f, y = rows[:, at : at + BATCH], cls[at : at + BATCH]
                g = np.exp(_logits(w, b, f))
                g /= g.sum(1, keepdims=True)
                g[np.arange(len(y)), y] -= 1
                flat = f.reshape(-1)
                order = np.argsort(flat.astype(np.uint16), kind="stable")  # ROW_BITS are fewer than 16, which sort fast
                flat = flat[order]
                heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                sizes = np.diff(np.append(heads, len(flat)))
                falling = np.argsort(-sizes.astype(np.int16), kind="stable")
                heads, sizes = heads[falling], sizes[falling]
                touched = flat[heads]
                slope = row_sums(g, order % len(y), heads, sizes)
                square[touched] += np.einsum("ij,ij->i", slope, slope) / CLASSES
                slope *= (-RATE / np.sqrt(square[touched]))[:, None]
                slope += w.take(touched, 0)
                w[touched] = slope
                used[touched] += sizes
                slope = g.sum(0)
                square_b += slope * slope
                b -= RATE * slope / np.sqrt(square_b)
        if n:
            moved = np.concatenate([(w - model.weights) * used[:, None], used[:, None]], 1).astype(np.float32)
            blocks = [moved[i : i + BLOCK].tobytes() for i in range(0, ROWS, BLOCK)]
            rest = [np.concatenate([(b - model.bias) * n, [n]]).astype(np.float64).tobytes(), pairs.astype(np.float64).tobytes()]
            kinds = [*range(len(blocks)), -1, -2]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([*blocks, *rest], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32 if k >= 0 else np.float64).astype(np.float64)
                held[k] = held[k] + x if k in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "sums"])

    sums = dict(docs.select("text").mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary").collect())
    for k, x in sums.items():
        x = np.frombuffer(x, np.float64)
        if k >= 0:
            x = x.reshape(BLOCK, CLASSES + 1)
            model.weights[k * BLOCK : (k + 1) * BLOCK] += (x[:, :-1] / np.maximum(x[:, -1:], 1)).astype(np.float32)
        elif k == -1:
            model.bias += (x[:-1] / x[-1]).astype(np.float32)
        else:
            within += x.reshape(within.shape)


def fit_within(model: Model, pairs: np.ndarray, steps: int = 60) -> np.ndarray:
    """log P(word | its class, class before) of a softmax with a weight for each word and for each (class before, word), by gradient ascent on
    the gathered counts with an L2 penalty on the pairings."""
    head, cls = pairs.shape[1], model.head_class
    counts = model.counts[:head].astype(np.float64)
    base = np.log(counts + 0.5)
    member = np.zeros((head, HEAD_CLASSES))
    member[np.arange(head), cls] = 1
    v = np.zeros_like(pairs)

    def logp() -> np.ndarray:
        z = base[None, :] + v
        e = np.exp(z)
        return z - np.log(np.maximum(e @ member, 1e-300))[:, cls]

    group = (pairs @ member)[:, cls]
    for _ in range(steps):  # steps scaled by the curvature's bound
        v += (pairs - group * np.exp(logp()) - 2.0 * v) / (2.0 + 0.5 * group)
        np.clip(v, -6, 6, out=v)
    return logp().astype(np.float32)


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """Trains on all of train (doc_id, text); also the table (word, c) of all counts."""
    counts = U.written(count_tokens(train))
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(LISTED).toArrow()
    listed, numbers = top["word"].to_pylist(), top["c"].to_numpy().astype(np.int64)
    if END not in listed:  # rarer than all of these, or never seen
        listed, numbers = [*listed, END], np.append(numbers, [(counts.where(F.octet_length("word") == 0).first() or (END, 0))[1]])
    model = Model(listed, numbers, int(total or 0), int(distinct), np.zeros(0, np.int64), np.zeros(TAIL_CLASSES), np.ones(TAIL_CLASSES))
    head = min(HEAD, len(listed))
    model.head_class = find_classes(model, train)

    frequent = set(listed[:head])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            rest = np.array([w not in frequent for w in words], bool)
            cls, c = tail_classes(words)[rest], c[rest]
            sums = [np.bincount(cls, x, TAIL_CLASSES).astype(np.int64) for x in (c, c == 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL_CLASSES)), *map(pa.array, sums)], names=["cls", "n", "once"])

    for cls, n, once in counts.mapInArrow(tails, "cls long, n long, once long").groupBy("cls").agg(F.sum("n"), F.sum("once")).collect():
        model.tail_total[cls], model.tail_unseen[cls] = n, (once + 0.5) / (n + 1) if n else 1.0
    model.weights, model.bias = np.zeros((ROWS, CLASSES), np.float32), np.zeros(CLASSES, np.float32)
    pairs = np.zeros((CLASSES + 1, head))
    for k in range(ROUNDS):
        train_round(model, train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k), pairs)
    model.within = fit_within(model, pairs)
    return model, counts


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row a document of docs (doc_id, text): doc_id, n_tokens, n_known, base_score and score (log10 probabilities of the whole text).

    Null texts are empty: their one token is the end. Rows with one doc_id are scored each for itself, equal ones equally; a null doc_id stays
    null. Very long texts are scored whole. Other columns are ignored, whatever their names; an empty table gives none. A model that has seen no
    text knows no token: base_score is that of counts of 0, and score that of equally likely classes whose words are all unseen. Words that no
    task knows meet their counts in a join on the word.
    """
    spark, n_listed, head = docs.sparkSession, len(model.listed), min(HEAD, len(model.listed))
    known_unseen = [(k, float(np.log10(max((1 - u) / t, 1e-300))) if t else -300.0, float(np.log10(u))) for k, (t, u) in enumerate(zip(model.tail_total, model.tail_unseen, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        base = np.log10(model.counts + 0.5)
        tail_known, tail_unseen = (np.array([x[k] for x in known_unseen]) for k in (1, 2))
        count_log = np.log10(np.maximum(model.counts, 1))
        for part in U.slices(batches, "text"):
            doc, word, cls, rare = reader.read(U.byte_texts(part))
            before, rows = reader.features(doc, word, cls)
            log = np.empty(len(word))
            for at in range(0, len(word), BATCH):
                y = cls[at : at + BATCH]
                z = _logits(model.weights, model.bias, rows[:, at : at + BATCH])
                log[at : at + BATCH] = z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))
            own = word < head
            log[own] += model.within[before[own], word[own]]
            log /= LOG10
            listed = np.flatnonzero(word < n_listed)
            tail = listed[word[listed] >= head]
            log[tail] += np.where(model.counts[word[tail]] > 0, tail_known[cls[tail] - HEAD_CLASSES] + count_log[word[tail]], tail_unseen[cls[tail] - HEAD_CLASSES])
            n = len(part)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(np.bincount(doc, minlength=n)),
                pa.array(np.bincount(doc[listed[model.counts[word[listed]] > 0]], minlength=n)), pa.array(np.bincount(doc[listed], base[word[listed]], n).astype(np.float64)), pa.array(np.bincount(doc, log, n)),
            ], names=names)
            if len(rare.at):
                which, times = rare.distinct()
                m, of = len(which), pa.array(rare.doc[which])
                zero = pa.array(np.zeros(m))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(rare.words.take(rare.at[which]), pa.binary()), pa.array(rare.cls[which] - HEAD_CLASSES, pa.int32()), pa.array(times), pa.array(np.zeros(m, np.int64)), zero, zero], names=names)

    names = ["doc_id", "digest", "word", "cls", "n", "known", "base", "log"]
    kinds = "doc_id long, digest long, word binary, cls int, n long, known long, base double, log double"
    rows = U.written(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, kinds))
    whole = rows.where("word is null").select("doc_id", "digest", F.lit(1).alias("copies"), "n", "known", "base", "log")
    classes = F.broadcast(spark.createDataFrame(known_unseen, "cls int, seen double, unseen double"))
    found = rows.where("word is not null").select("doc_id", "digest", "word", "cls", F.col("n").alias("times")).join(counts, "word", "left").join(classes, "cls")
    c = F.col("c")
    joined = found.select(
        "doc_id", "digest", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("n"), F.when(c.isNotNull(), F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10(F.coalesce(c, F.lit(0)) + 0.5)).alias("base"),
        (F.col("times") * F.when(c.isNotNull(), F.col("seen") + F.log10(c)).otherwise(F.col("unseen"))).alias("log"),
    )
    sums = whole.union(joined).groupBy("doc_id", "digest").agg(*(F.sum(x).alias(x) for x in ("copies", "n", "known", "base", "log")))
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # equal rows with one doc_id were added up
    n = F.col("n") / F.col("copies")
    return each.select(
        "doc_id", n.cast("long").alias("n_tokens"), (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        (F.col("base") / F.col("copies") - n * model.base_unit).alias("base_score"), (F.col("log") / F.col("copies")).alias("score"),
    )


def op1_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents under a model trained on those whose crc32(doc_id as text) mod 5 is not 1."""
    docs = U.table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(docs.where(U.remainder5(F.col("doc_id")) != 1))
    held_out = (U.remainder5(F.col("doc_id")) == 1).alias("held_out")
    scored = score_documents(docs, model, counts)
    return scored.select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
