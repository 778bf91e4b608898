"""Token-ID output: fixed-width bit packing with block offsets.

A token file is a run of blocks in ascending doc_id order. A block holds whole documents and is laid out as

    magic "LFWB", version u16, bits u16, n_docs u64, n_ids u64      (24 bytes, little-endian)
    first u64[n_docs + 1]     id offset of each document in the block
    words u64[...]            the ids, bits wide, little-endian bit stream

Sixty-four ids fill exactly `bits` words, so id i starts at bit i * bits: packing and unpacking go lane by lane in numpy, and any id or
document is read without unpacking the rest. Files are kept in a Parquet container (one row a block), which Spark can write to any store.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

MAGIC, HEADER = b"LFWB", struct.Struct("<4sHHQQ")
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: Text bytes for each file.
FILE_BYTES = 24 << 20
BLOCKS = "file int, block int, part_start long, n_docs long, n_ids long, doc_ids binary, null_ids binary, payload binary"


def bits_for(vocabulary: int) -> int:
    """The least width that holds ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (each below 2**bits, bits at most 32) as a little-endian bit stream in whole 64-bit words."""
    groups = -(-len(ids) // 64)
    if bits in (8, 16, 32):
        out = np.zeros(groups * 64, f"<u{bits // 8}")
        out[: len(ids)] = ids
        return out.tobytes()
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(buffer: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of a packed stream."""
    if bits in (8, 16, 32):
        return np.frombuffer(buffer, f"<u{bits // 8}", n).astype("<u4")
    words = np.frombuffer(buffer, "<u8").reshape(-1, bits)
    mask, out = np.uint64((1 << bits) - 1), np.empty((len(words), 64), np.uint32)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = lane & mask
    return out.reshape(-1)[:n].astype("<u4")


def unpack_span(buffer: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop - 1 alone: only the groups of 64 that hold them are read."""
    first = start // 64
    ids = unpack(buffer[first * bits * 8 : -(-stop // 64) * bits * 8], bits, stop - first * 64)
    return ids[start - first * 64 :]


def encode_block(docs: list[np.ndarray] | tuple[np.ndarray, np.ndarray], bits: int) -> bytes:
    """docs: id arrays, or all ids and the count of each document."""
    ids, counts = docs if isinstance(docs, tuple) else (np.concatenate(docs) if docs else np.zeros(0, np.uint32), np.array([len(x) for x in docs], np.int64))
    first = np.zeros(len(counts) + 1, "<u8")
    first[1:] = np.cumsum(counts)
    return HEADER.pack(MAGIC, 1, bits, len(counts), len(ids)) + first.tobytes() + pack(ids, bits)


def block_header(block: bytes) -> tuple[int, np.ndarray, int]:
    """bits, the documents' offsets and where the packed words begin."""
    magic, version, bits, n_docs, _ = HEADER.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    at = HEADER.size + 8 * (n_docs + 1)
    return bits, np.frombuffer(block, "<u8", n_docs + 1, HEADER.size).astype(np.int64), at


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the documents' offsets."""
    bits, first, at = block_header(block)
    return unpack(memoryview(block)[at:], bits, int(first[-1])), first


def read_document(block: bytes, k: int) -> np.ndarray:
    """Random access: the ids of the block's document k."""
    bits, first, at = block_header(block)
    return unpack_span(memoryview(block)[at:], bits, int(first[k]), int(first[k + 1]))


class Encoder:
    """Texts to ids. Words between ASCII white space are encoded once and remembered.

    That equals encoding the whole text where the tokenizer drops white space and joins nothing across it, as the word-level BPE
    vocabulary does; with whole=True each text is encoded as one piece instead. Where the tokenizer lower-cases and parts a letter from
    the stop or comma after it, so do we before looking words up: fewer distinct words are left to encode. Texts that may hold special
    tokens, whose case counts, are left as they are.
    """

    #: A run of ASCII marks between a small Latin letter (or one of Latin-1) and white space; words of such letters, composed and in lower case.
    STOP = re.compile(rb"([!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))[!-/:-@\[-`{-~]*)(?=[ \n])")
    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, tokenizer_path: str, end_id: int | None, whole: bool = False, limit: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.whole, self.limit = Tokenizer.from_file(tokenizer_path), end_id, whole, limit
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.lower = ids("Az") == ids("az")
        self.parts = self.lower and all(ids(f"az{x} \u00e9{x}{x}\nc") == ids(f"az {x} \u00e9 {x}{x} c") for x in map(chr, range(33, 127)) if not x.isalnum())
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}  # how byte-level vocabularies write bytes
        self.plain = all(ids(w) == self.by_model(w.encode()) for w in ("a", "the", "internationally", "qzxv", "\u00e9\u00e0\u00fc\u00df\u00f1o"))
        self.forget()

    def forget(self) -> None:
        #: No word contains white space, so b" " can stand for the end of a document.
        self.at: dict[bytes, int] = {b" ": 0}
        end = [] if self.end is None else [self.end]
        self.flat, self.used = np.zeros(1 << 16, np.uint32), len(end)
        self.flat[: len(end)] = end
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.lens[0] = len(end)

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.at))
        plain = [w for w in new if self.PLAIN.fullmatch(w)] if self.plain else []
        if plain:  # the model alone: such a word is one piece, and normalised
            self.keep(plain, [self.by_model(w) for w in plain])
            new = [w for w in new if w not in self.at]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.keep(part, [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)])

    def by_model(self, word: bytes) -> list[int]:
        return [x.id for x in self.tokenizer.model.tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters))]

    def keep(self, words: list[bytes], ids: list[list[int]]) -> None:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(lens.sum()), len(self.at)
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < n + len(words):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.starts[n : n + len(words)], self.lens[n : n + len(words)] = self.used + np.cumsum(lens) - lens, lens
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += total

    def words(self, text: bytes) -> list[bytes]:
        if self.lower and b"<|" not in text:
            text = text.translate(U.LOWER)
            if self.parts:
                text = self.STOP.sub(rb" \1 ", text)
        return text.split()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's count of them, its end included."""
        if self.whole:
            ids = [x.ids + ([] if self.end is None else [self.end]) for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        words: list[bytes] = []
        n_words = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(words)
            words += self.words(text)
            words.append(b" ")
            n_words[k] = len(words) - before
        if len(self.at) > self.limit:
            self.forget()
        self.learn(set(words))
        index = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        lens = self.lens[index]
        ids = self.flat[U.ragged(self.starts[index], lens)]
        return ids, np.add.reduceat(lens, np.cumsum(n_words) - n_words) if len(texts) else n_words


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*key: object) -> Encoder:
    """One for each Python worker, kept from task to task."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 2, whole: bool = False, bits: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Encodes docs (doc_id, text) and writes token files to path, in ascending doc_id (nulls first, equal ids by text).

    Null texts count as empty. Each range partition is one file; its blocks hold whole documents, one block at least for each BLOCK_IDS ids.
    An empty table makes an empty set of files. Other columns are ignored. The text is shuffled once.
    """
    parts = U.partitions_for(docs, "text", file_bytes)
    start = F.substring("text", 1, 64)  # parts rows of one doc_id, or of none
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id"), start).sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, file, block, start = encoder(tokenizer_path, end_id, whole), TaskContext.get().partitionId(), 0, 0
        width = bits or bits_for(made.vocabulary)
        held: list[tuple] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal held, n, block, start
            doc_ids, nulls, ids, counts = (np.concatenate([x[i] for x in held]) for i in range(4))
            row = [file, block, start, len(counts), len(ids), doc_ids.astype("<i8").tobytes(), np.packbits(nulls).tobytes(), encode_block((ids, counts), width)]
            block, start, held, n = block + 1, start + len(ids), [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for part in U.slices(batches, "text"):
            ids, counts = made.encode(U.byte_texts(part))
            col = part.column(part.schema.get_field_index("doc_id"))
            held.append((pa.compute.fill_null(col, 0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False), ids, counts))
            n += len(ids)
            if n >= BLOCK_IDS:
                yield close()
        if held:
            yield close()

    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, each: object = None, schema: str = "doc_id long, start long, n_tokens long, ids array<int>") -> DataFrame:
    """Reads token files back: one row a document with start (ids of all documents before it) and its ids, or what `each` makes of them.

    each(ids, offsets) gives the further columns of a block as arrays. What the driver gathers is one total for each file.
    """
    files = spark.read.schema(BLOCKS).parquet(path)
    totals = dict(files.groupBy("file").agg(F.sum("n_ids")).collect())
    base, before = {}, 0
    for file in sorted(totals):
        base[file], before = before, before + totals[file]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                ids, first = decode_block(x["payload"])
                n = x["n_docs"]
                nulls = np.unpackbits(np.frombuffer(x["null_ids"], np.uint8), count=n).astype(bool)
                doc_id = pa.array(np.frombuffer(x["doc_ids"], "<i8"), mask=nulls)
                more = each(ids, first) if each else [pa.ListArray.from_arrays(first.astype(np.int32), ids.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(base[x["file"]] + x["part_start"] + first[:-1]), pa.array(np.diff(first)), *more], names=names)

    return files.select("file", "part_start", "n_docs", "doc_ids", "null_ids", "payload").mapInArrow(rows, schema)


def crc_of_ids(ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    view = memoryview(ids.astype("<u4").tobytes())
    return [pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.int64())]


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes documents with the word-level BPE vocabulary, writes token files in the shared folder and digests what is read back."""
    import uuid

    import public_tokenizers

    path = f"{U.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(U.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_token_files(spark, path, crc_of_ids, "doc_id long, start long, n_tokens long, ids_crc32 long")
