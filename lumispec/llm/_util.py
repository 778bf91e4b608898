"""Helpers shared by the text operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a Python worker handles at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch; Spark's own number is meant for narrow rows.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS: rows hold whole texts, of which executors and workers keep several batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a local session gets one of our own; a cluster must have
    one."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="lumispec-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def give_back() -> None:
    """Returns freed memory to the system: a fit's arrays would else count as the driver's for good."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Paths of the tables that the run at hand has made and not deleted; each run has a list of its own, in its own thread too.
_RUN: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def own_tables() -> Iterator[list[str]]:
    """The list of the tables that written() makes within."""
    made: list[str] = []
    token = _RUN.set(made)
    try:
        yield made
    finally:
        _RUN.reset(token)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table written in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/lumispec-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    run = _RUN.get()
    if run is not None:
        run.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, made: list[str], keep: int) -> None:
    """Deletes all tables of a run but its last `keep`, which are what is still read."""
    jvm = spark.sparkContext._jvm
    for path in made[: len(made) - keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        made.remove(path)


def finished(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query with its result written, so that all other tables that it has made can go."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with own_tables() as made:
            out = written(query(spark, sf_dir))
            drop_tables(spark, made, 1)
        return out

    return run


def column(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str = "") -> DataFrame:
    """docs.mapInArrow(run) with the columns of docs and those of added (DDL), which replace any of their names. Other columns than text have plain
    names on the way, so that theirs may hold any signs."""
    more = StructType.fromDDL(added) if added else StructType()
    names = [c for c in docs.columns if c not in more.names]
    held = docs.select(*(column(c).alias(c if c == "text" else f"c{i}") for i, c in enumerate(names)))
    return held.mapInArrow(run, StructType([*held.schema, *more])).toDF(*names, *more.names)


def remainder5(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def partitions_for(df: DataFrame, column: str, target_bytes: int) -> int:
    """How many partitions give each about target_bytes of a column; a scan of that column alone."""
    n = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-int(n) // target_bytes))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, size: Callable[[bytes], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a column's bytes (or what `size` makes of them) stay within limit, or the slice is one row. What the worker's last
    task has freed goes back to the system first."""
    pa.set_memory_pool(pa.system_memory_pool())  # the worker's: gives memory back between batches, where others keep it
    give_back()
    for batch in batches:
        k = batch.schema.get_field_index(column)
        if size:
            sizes = np.array([size(x) if x else 0 for x in batch.column(k).to_pylist()], np.int64)
        else:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each span, one span after another."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def mix64(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True) if out is None else out
    t = x >> np.uint64(30)
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint64(factor), out=x)
        np.right_shift(x, np.uint64(shift), out=t)
    return np.bitwise_xor(x, t, out=x)


#: bytes.translate table that lower-cases A-Z alone.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


#: White space between words: the bytes 9 to 13 and 32.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MARK = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Bytes of a word beyond which its hash is worked out by itself.
LONG_WORD = 64


class Words:
    """The words of some texts as places in one buffer, found for all texts at once: no word becomes an object of its own.

    counts: the words of each text; begin, end: the places of each word's bytes in buffer.
    """

    def __init__(self, texts: list[bytes], lower: bool = True) -> None:
        texts_and_breaks = b"\n".join([*texts, b""])
        self.buffer = texts_and_breaks.translate(LOWER) if lower else texts_and_breaks
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        breaks = np.flatnonzero(_SPACE.take(self.bytes))
        begin = np.append(0, breaks[:-1] + 1) if len(breaks) else breaks
        some = breaks > begin
        self.begin, self.end = begin[some], breaks[some]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        at = np.searchsorted(self.begin, np.append(0, np.cumsum(sizes)))
        self.counts = np.diff(at)

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def take(self, which: np.ndarray) -> list[bytes]:
        """Those words as bytes."""
        buffer = self.buffer
        return [buffer[a:b] for a, b in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)]

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """begin and end of each word without the ASCII marks around it; words of marks alone have none."""
        begin, end = self.begin.copy(), self.end.copy()
        for places, step, last in ((begin, 1, 0), (end, -1, -1)):
            some, turns = np.flatnonzero(_MARK.take(self.bytes.take(places + last))) if len(places) else np.zeros(0, np.int64), 0
            while len(some) and turns < 16:
                places[some] += step
                some = some[begin[some] < end[some]]
                some, turns = some[_MARK.take(self.bytes.take(places[some] + last))], turns + 1
            if len(some):  # long runs of marks
                kept = np.append(np.flatnonzero(~(_MARK | _SPACE).take(self.bytes)), len(self.bytes))
                found = np.searchsorted(kept, places[some], side="left")
                places[some] = np.minimum(kept[found], end[some]) if step > 0 else np.maximum(kept[found - 1] + 1, begin[some])
        return begin, end

    def hashes(self, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of the bytes between other places, by its bytes alone."""
        return hash_spans(self.buffer, self.begin if begin is None else begin, self.end if end is None else end)


def hash_spans(buffer: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a buffer, eight bytes at a time for all spans at once."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    padded = buffer + bytes(8)
    eight = np.ndarray(len(buffer) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = end - begin
    h = eight[begin] & _LOW_BYTES.take(np.minimum(size, 8))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h += size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = mix64(h, out=h)
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        own = (eight[begin[more] + at] & _LOW_BYTES.take(np.minimum(size[more] - at, 8))) * np.uint64(0x9E3779B97F4A7C15)
        h[more] = mix64(own + mix64(h[more]))
        at += 8
        more = more[size[more] > at]
    if len(long := np.flatnonzero(size > LONG_WORD)):
        import xxhash

        h[long] = np.array([xxhash.xxh3_64_intdigest(buffer[a:b]) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)], np.uint64)
    return h


class HashTable:
    """Numbers of known 64-bit hashes, looked up for many at once."""

    def __init__(self, known: np.ndarray) -> None:
        """known: distinct hashes; their numbers are their places."""
        self.order = np.argsort(known, kind="stable").astype(np.int64)
        self.sorted = np.append(known[self.order], np.uint64(2**64 - 1))
        bits = max(1, len(known).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.sorted[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        if len(self.sorted) == 1:
            return np.full(len(hashes), -1, np.int64)
        at = self.first.take((hashes >> self.shift).astype(np.int64)).astype(np.int64)
        here = self.sorted.take(at)
        behind = np.flatnonzero(here < hashes)
        while len(behind):
            at[behind] += 1
            here[behind] = self.sorted[at[behind]]
            behind = behind[here[behind] < hashes[behind]]
        found = np.append(self.order, -1).take(at)
        found[here != hashes] = -1
        return found


class Memo:
    """What `make` gives for each distinct word, by its hash, each worked out once by a Python worker; all are forgotten beyond a limit."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], limit: int = 200_000) -> None:
        self.make, self.limit = make, limit
        self.table, self.known, self.values = HashTable(np.zeros(0, np.uint64)), np.zeros(0, np.uint64), None

    def of(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """The value of each word (hashes: theirs, whatever their case)."""
        at = self.table.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new) or self.values is None:
            fresh, first = np.unique(hashes[new], return_index=True)
            made = self.make(words.take(new[first]))
            if self.values is None or len(self.known) > self.limit:
                if self.values is not None:  # those at hand stay
                    old = np.unique(at[at >= 0])
                    self.known, self.values = self.known[old], self.values[old]
                else:
                    self.values = made[:0]
            self.known, self.values = np.concatenate([self.known, fresh]), np.concatenate([self.values, made])
            self.table = HashTable(self.known)
            at = self.table.find(hashes)
        return self.values[at]
