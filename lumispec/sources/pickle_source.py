"""Library sources in pickle files, read without ever unpickling: opcodes are walked one by one and only strings, floats and containers count.

The data source "peak_pickle" streams dict[str, list[float]] as (ordinal, accession, peaks) in the file's order; a pickle is one stream, so it
is read by one task, and rows are handed on as they are met. strict=true accepts what a protocol-4 stream of framed, short-keyed, chunked
lists holds, and nothing else.
"""

from __future__ import annotations

import io
import pickletools
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import LIBRARY_SOURCE

#: Opcodes of the strict grammar. Fixed values.
STRICT = {"PROTO", "FRAME", "EMPTY_DICT", "MEMOIZE", "MARK", "SHORT_BINUNICODE", "EMPTY_LIST", "BINFLOAT", "APPENDS", "SETITEMS", "STOP"}
_STRINGS = {"SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8", "UNICODE"}
_NUMBERS = {"BINFLOAT", "FLOAT", "BININT", "BININT1", "BININT2", "INT", "LONG", "LONG1", "LONG4"}
_SKIP = {"PROTO", "FRAME", "STOP"}
_MARK = object()


class DecodeError(ValueError):
    pass


def _opcodes(stream: BinaryIO, strict: bool) -> Iterator[tuple[str, object, int]]:
    """Name, argument and offset of each opcode."""
    at = 0
    source = pickletools.genops(stream)
    first = True
    while True:
        at = stream.tell()
        try:
            op, arg, pos = next(source)
        except StopIteration:
            return
        except ValueError as e:
            stream.seek(at)
            byte = stream.read(1)
            raise DecodeError(f"unknown opcode 0x{byte[0]:02x} at offset {at}" if byte and "opcode" in str(e) else f"bad stream at offset {at}: {e}") from e
        if first and (op.name != "PROTO" or strict and arg not in (4, 5)):
            raise DecodeError(f"unsupported protocol: {arg if op.name == 'PROTO' else 'none'}")
        if strict and op.name not in STRICT:
            raise DecodeError(f"unknown opcode 0x{ord(op.code):02x} at offset {pos}")
        first = False
        yield op.name, arg, pos


def walk(stream: BinaryIO, strict: bool = False, keep: bool = False) -> Iterator[tuple[str, object]]:
    """Items of the outermost dict in its order: values are floats, ints, strings, lists or dicts of them. Each item is handed on as soon as it is
    whole, so that memory holds one batch of a pickler (a thousand items at most). With keep, containers that come again are held as well."""
    stack: list = []
    memo: dict[int, object] = {}
    root = None
    for name, arg, pos in _opcodes(stream, strict):
        if name in _SKIP:
            continue
        if name == "EMPTY_DICT" or name == "EMPTY_LIST":
            stack.append({} if name == "EMPTY_DICT" else [])
            if root is None:
                root = stack[-1]
                if not isinstance(root, dict):
                    raise DecodeError("the stream isn't a dict")
        elif name == "MARK":
            stack.append(_MARK)
        elif name in _STRINGS or name in _NUMBERS:
            stack.append(arg)
        elif name == "NONE":
            stack.append(None)
        elif name in ("MEMOIZE", "BINPUT", "LONG_BINPUT"):
            if keep or isinstance(stack[-1], str):
                memo[len(memo) if name == "MEMOIZE" else arg] = stack[-1]
            elif name == "MEMOIZE":
                memo[len(memo)] = None
        elif name in ("BINGET", "LONG_BINGET"):
            if memo.get(arg) is None:
                raise DecodeError(f"shared container at offset {pos}")
            stack.append(memo[arg])
        elif name in ("APPENDS", "SETITEMS"):
            at = len(stack) - 1
            while at >= 0 and stack[at] is not _MARK:
                at -= 1
            if at < 1:
                raise DecodeError(f"no mark at offset {pos}")
            items, target = stack[at + 1 :], stack[at - 1]
            del stack[at:]
            yield from _put(target, items, root, pos, name == "APPENDS")
        elif name in ("APPEND", "SETITEM"):
            n = 1 if name == "APPEND" else 2
            items = stack[-n:]
            del stack[-n:]
            yield from _put(stack[-1], items, root, pos, name == "APPEND")
        else:
            raise DecodeError(f"opcode {name} at offset {pos} isn't part of plain data")
    if root is None:
        raise DecodeError("the stream is empty")


def _put(target: object, items: list, root: object, pos: int, append: bool) -> Iterator[tuple[str, object]]:
    if append and isinstance(target, list):
        target.extend(items)
    elif not append and isinstance(target, dict) and len(items) % 2 == 0:
        if target is root:
            yield from zip(items[::2], items[1::2], strict=True)
        else:
            target.update(zip(items[::2], items[1::2], strict=True))
    else:
        raise DecodeError(f"unexpected container at offset {pos}")


def peak_lists(stream: BinaryIO, strict: bool = False) -> Iterator[tuple[str, list[float]]]:
    for key, value in walk(stream, strict):
        if not isinstance(key, str) or not isinstance(value, list) or not all(isinstance(x, (float, int)) for x in value):
            raise DecodeError(f"entry {key!r} isn't a list of numbers")
        yield key, [float(x) for x in value]


def for_each_entry(path: str, callback: Callable[[str, list[float]], None], strict: bool = False) -> None:
    """Calls back for each entry in order; the first error, the callback's or the decoder's, ends the walk."""
    with open(path, "rb") as f:
        for key, peaks in peak_lists(io.BufferedReader(f.raw if isinstance(f, io.BufferedReader) else f, 1 << 20), strict):
            callback(key, peaks)


class _Reader(DataSourceReader):
    def __init__(self, path: str, strict: bool) -> None:
        self.path, self.strict = path, strict

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for i, (key, peaks) in enumerate(peak_lists(f, self.strict)):
                yield i, key, peaks


class PeakPickle(DataSource):
    """spark.read.format("peak_pickle").load(path); the path is one that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "peak_pickle"

    def schema(self) -> str:
        return LIBRARY_SOURCE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], str(self.options.get("strict", "false")).lower() == "true")


def read_peaks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    spark.dataSource.register(PeakPickle)
    return spark.read.format("peak_pickle").option("strict", str(strict).lower()).load(path)


def _genes(key: str, value: object) -> tuple:
    return key, int(value)


def _name(key: str, value: object) -> tuple:
    return key, str(value)


def _taxon(key: str, value: object) -> tuple:
    return (key, 0, value) if isinstance(value, str) else (key, int(value.get("id", 0)), value.get("text", ""))


#: Rows of each kind of metadata, and what makes them.
METADATA = {"genes": ("accession string, gene_count long", _genes), "names": ("accession string, name string", _name), "taxonomy": ("accession string, taxonomy_id long, taxonomy string", _taxon)}


class _ItemReader(DataSourceReader):
    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        row = METADATA[self.kind][1]
        with open(self.path, "rb") as f:
            for key, value in walk(f, keep=True):
                yield row(key, value)


class MetadataPickle(DataSource):
    """spark.read.format("metadata_pickle").option("kind", "genes" | "names" | "taxonomy").load(path): rows go from the task that walks the file to
    Spark, none through the driver."""

    @classmethod
    def name(cls) -> str:
        return "metadata_pickle"

    def schema(self) -> str:
        return METADATA[self.options["kind"]][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ItemReader(self.options["path"], self.options["kind"])


def _metadata(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], METADATA[kind][0])
    spark.dataSource.register(MetadataPickle)
    return spark.read.format("metadata_pickle").option("kind", kind).load(path)


def read_genes(spark: SparkSession, path: str | None) -> DataFrame:
    return _metadata(spark, path, "genes")


def read_names(spark: SparkSession, path: str | None) -> DataFrame:
    return _metadata(spark, path, "names")


def read_taxonomy(spark: SparkSession, path: str | None) -> DataFrame:
    """A record {id, text}, either of which may be missing, or the text alone."""
    return _metadata(spark, path, "taxonomy")
