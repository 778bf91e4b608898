"""Near duplicates by SimHash: fingerprints of shingles, candidates by blocks that close fingerprints must share, Hamming distance, components.

A fingerprint of 64 bits is cut into `blocks` pieces. Two fingerprints that differ in at most `distance` bits agree in blocks - distance pieces or
more, so that they meet in the bucket of one choice of that many pieces; every pair that meets is measured. Equal fingerprints count once from the
start. A bucket's links leave its task as a spanning forest, and a bucket of many fingerprints is compared part by part in as many tasks as it
takes, so that no group of copies becomes all its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U
from .components import FOREST, components, forest

#: Words of a shingle, and bits in which linked fingerprints may differ.
WIDTH, DISTANCE = 4, 4
#: Seed of the shingles' XXH64.
SEED = 42
#: Fingerprints of a part of a large bucket, and those that a bucket should hold on average at most.
PART, FULL = 4096, 16
#: Rows of buckets that a task compares at once.
ROWS = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: For each byte, its bits as eight one-byte counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
_LINKS = "u long, v long"


def _ones(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in runs of hashes (sizes: theirs, none empty). One-byte counters for eight bits each add up runs of at
    most 255 hashes."""
    parts = -(-sizes // 255)
    first = np.repeat(np.cumsum(sizes) - sizes, parts)
    heads = first + 255 * (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts))
    eight = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_SPREAD.take(eight[:, k]), heads) for k in range(8)], axis=1)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)


def _counted(texts: list[list[bytes]], width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts of set bits, and shingles, of each list of words; short: a list of fewer words than a shingle is one."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    n = np.maximum(counts - width + 1, (counts > 0) & short)
    out = np.zeros((len(texts), 64), np.int64)
    if n.any():
        buffer = b" ".join([b" ".join(words) for words in texts if words])
        space = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        begin, end = np.append(0, space + 1), np.append(space, len(buffer))
        starts = U.ragged(np.cumsum(counts) - counts, n)
        last = starts + np.repeat(np.minimum(counts, width), n) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(buffer[a:b], SEED) for a, b in zip(begin[starts].tolist(), end[last].tolist(), strict=True)], np.uint64)
        out[n > 0] = _ones(hashes, n[n > 0])
    return out, n


def _pieces(text: bytes, width: int, limit: int) -> Iterator[list[bytes]]:
    """The words of a long text, about `limit` bytes at a time; each piece begins with the width - 1 words before it."""
    at, before = 0, []
    while at < len(text):
        found = _SPACE.search(text, min(at + limit, len(text)))
        to = found.start() if found else len(text)
        words = before + text[at:to].translate(U.LOWER).split()
        yield words
        at, before = to + 1, words[-(width - 1) :] if width > 1 else []


def simhashes(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text; 0 for one without words."""
    ones, n = _counted([t.translate(U.LOWER).split() if len(t) <= U.CHUNK_BYTES else [] for t in texts], width, True)
    for i, text in enumerate(texts):
        if len(text) > U.CHUNK_BYTES:
            words = 0
            for piece in _pieces(text, width, U.CHUNK_BYTES):
                own, some = _counted([piece], width, False)
                ones[i] += own[0]
                n[i] += some[0]
                words += len(piece)
            if words and not n[i]:
                ones[i : i + 1], n[i : i + 1] = _counted([text.translate(U.LOWER).split()], width, True)
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) to (doc_id, print): the fingerprint of each row's text, as a signed LONG of the same bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in U.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhashes(U.byte_texts(batch), width).view(np.int64))], names=["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


def masks(blocks: int, distance: int) -> list[int]:
    """The bits of each choice of blocks - distance blocks of 64 bits, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    whole = [sum(chosen) for chosen in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def blocks_for(n: int, distance: int) -> int:
    """Blocks, so that a bucket of n evenly spread fingerprints holds FULL or fewer; the links are the same for any number."""
    blocks = distance + 2
    while blocks < 3 * distance and n > FULL << (64 * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def close_pairs(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal keys (a column for each row; rows in order of key) that differ in `distance` bits or fewer, as a spanning
    forest: each row meets the next ones of its bucket, one step further at a time for all rows at once."""
    new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
    heads = np.flatnonzero(new)
    ends = np.repeat(np.append(heads[1:], len(new)), np.diff(np.append(heads, len(new))))
    at, step = np.arange(len(new)), 1
    u, v, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(at := at[at + step < ends[at]]):
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= distance]
        u.append(prints[near].view(np.int64))
        v.append(prints[near + step].view(np.int64))
        size, step = size + len(near), step + 1
        if size > FOREST:
            a, b = forest(np.concatenate(u), np.concatenate(v))
            u, v, size = [a], [b], 0
    return forest(np.concatenate(u), np.concatenate(v))


def _compared(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray) -> pa.RecordBatch:
            u, v = close_pairs(rows[:-1], rows[-1].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += len(batch)
            if size < ROWS:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[:-1] != rows[:-1, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(np.ascontiguousarray(rows[:, :cut]))
            held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield links(np.ascontiguousarray(np.concatenate(held, axis=1)))

    return run


def close_links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """prints (print; distinct) to links (u, v) that join all fingerprints that chains of steps of `distance` bits or fewer do."""
    chosen = masks(blocks or blocks_for(prints.count(), distance), distance)
    choices = F.array(*(F.struct(F.lit(i).cast("long").alias("choice"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("bucket")) for i, m in enumerate(chosen)))
    rows = prints.select("print", F.inline(choices))
    large = U.written(rows.groupBy("choice", "bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > PART))
    part = F.lit(0).cast("long")
    if not large.isEmpty():
        n = F.ceil(F.coalesce("_n", F.lit(1)) / PART).cast("long")
        own = F.pmod(F.xxhash64("print"), n)
        others = F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: j != own)
        pairs = F.when(n == 1, F.array(part)).otherwise(F.transform(others, lambda j: F.least(own, j) * n + F.greatest(own, j)))
        rows = rows.join(large, ["choice", "bucket"], "left").select("choice", "bucket", F.explode(pairs).alias("part"), "print")
    else:
        rows = rows.select("choice", "bucket", part.alias("part"), "print")
    keys = ["choice", "bucket", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "print").mapInArrow(_compared(distance), _LINKS)


def link_documents(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """docs (doc_id, text, more columns) to (doc_id, print, component_id), a row for each row: its fingerprint, and the smallest doc_id that links
    of fingerprints reach.

    Null and empty texts, and those of white space alone, have fingerprint 0 and are linked like any other; a text of fewer words than a shingle is
    one shingle; very long texts are read whole, piece by piece. Equal texts and repeated rows share fingerprint and component. A row without doc_id
    links like others but names no component: component_id is null where no row of the component has one. An empty table gives no rows. Other
    columns, whatever their names, count for nothing.
    """
    prints = U.written(fingerprints(docs, width))
    classes = U.written(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    labels = components(close_links(classes.select("print"), distance)).select(F.col("node").alias("print"), "label")
    labelled = U.written(classes.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print")))
    least = U.written(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    of = U.written(labelled.join(least, "label").select("print", "component_id"))
    return prints.join(of, "print").select("doc_id", "print", "component_id")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    return link_documents(U.table(spark, sf_dir, "documents")).select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")
