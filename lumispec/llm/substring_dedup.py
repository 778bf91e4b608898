"""Substring deduplication with super-k-mers.

A window is `window` consecutive words. Its minimiser is the least hash among the runs of MMER words in it. Consecutive windows of a document
that share a minimiser overlap in all but a word each; they travel as one packed string (a super-k-mer: their words, once) to the minimiser's
bucket. Equal windows have equal minimisers and so meet in one bucket, where sorting the windows groups the equal ones exactly, whole bytes
compared. Each occurrence in a document with a larger doc_id than the window's first one is removed.

Words travel only where they can matter: a first shuffle deals the minimisers with their places, and super-k-mers of minimisers that one
document alone holds stay where they are. Those of a minimiser with more than HOT places, or in more than LOCAL documents of a chunk, travel window by
window, each to the bucket of its words, so that a frequent minimiser is shared out among the tasks. Of its places a task sends few to the
minimiser's own bucket. Of equal windows that travel so, a task sends those alone that no smaller document of its own has preceded, and decides
the others at once: a window in a third of all documents sends a few rows from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _util as U

MMER = 5
#: Packed bytes of a bucket that are sorted at once; a larger bucket is met in pieces of that size.
BUCKET_BYTES = 4 << 20
#: Places of a minimiser from which its super-k-mers are dealt by their windows.
HOT = 4096
#: Documents of a chunk that share a minimiser, from which the task deals it by windows itself; minimisers and windows that a task remembers.
LOCAL, REMEMBERED = 64, 200_000
#: place: first word << 32 | number of words; kind: of PLAIN places, those whose windows are all known to be later ones (DONE), or of a hot
#: minimiser. A HINT is no place: it tells its minimiser's bucket that a task found it hot.
PLAIN, DONE, SPREAD, HINT = range(4)
PLACES = "key long, doc_id long, digest long, place long, kind int"
#: packed is null where all windows of the words from at to last are known to be later ones.
PIECES = "key long, doc_id long, digest long, at int, last int, packed binary"
RANGES = "doc_id long, digest long, first int, last int"


def _rows(schema: str, *columns: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _merged(docs: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that begin a run of touching ranges of one document, and each run's end; rows are in order of docs, first."""
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (first[1:] > last[:-1])
    heads = np.flatnonzero(new)
    return heads, np.maximum.reduceat(last, heads) if len(heads) else last[:0]


class SuperKmers:
    """The super-k-mers of some texts: document number, first word, number of words and minimiser of each."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.words = words = U.Words(texts, lower=False)
        n, m = len(words), min(MMER, window)
        if n < window:
            self.doc = self.at = self.size = self.key = self.first = np.zeros(0, np.int64)
            return
        h = words.hashes()
        mers = h[: n - m + 1].copy()
        for j in range(1, m):
            mers = U.mix64(mers) + h[j : n - m + 1 + j]
        mers = U.mix64(mers)
        least, width, target = mers, 1, window - m + 1
        while width < target:  # sliding minimum by doubling
            step = min(width, target - width)
            least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
        ends = np.cumsum(words.counts)
        doc = words.text[: len(least)]
        inside = np.arange(len(least)) + window <= ends[doc]
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(new)
        stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
        self.first, self.doc, self.size = starts, doc[starts], stop - 1 + window - starts
        self.at, self.key = starts - (ends - words.counts)[self.doc], least[starts].view(np.int64)

    def __len__(self) -> int:
        return len(self.key)

    def packed(self, i: int) -> bytes:
        return packed(self.words, self.first[i], self.size[i])


def packed(words: U.Words, first: int, n: int) -> bytes:
    """n words from the first on, joined by one space."""
    return b" ".join(words.buffer[words.begin[first] : words.end[first + n - 1]].split())


def _places(window: int):
    """Minimisers and places of a partition's super-k-mers. Of equal ones in a chunk only the smallest document's travel; the others are decided
    at once (done), so that a group of copies sends a row for each chunk, not for each copy. A minimiser that more than LOCAL documents of a chunk
    send is hot from there on: its bucket gets a hint, and its places are dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.zeros(0, np.int64)  # in order
        for part in U.slices(batches, "text"):
            doc_ids, digests = part.column(0).to_numpy(), part.column(1).to_numpy()
            found = SuperKmers(U.byte_texts(part), window)
            if not len(found):
                continue
            ids = doc_ids[found.doc]
            order = np.lexsort((ids, found.key))
            key, own = found.key[order], ids[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lasts = np.append(heads[1:], len(key)) - 1
            later = np.zeros(len(found), bool)
            for a, b in zip(heads[own[heads] != own[lasts]].tolist(), lasts[own[heads] != own[lasts]].tolist(), strict=True):
                first: dict[bytes, int] = {}
                for i in order[a : b + 1].tolist():  # in order of doc_id
                    if first.setdefault(found.packed(i), ids[i]) < ids[i]:
                        later[i] = True
            send = np.flatnonzero(~later)
            order = np.lexsort((ids[send], found.key[send]))
            key, own = found.key[send][order], ids[send][order]
            new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)]  # rows that begin a document's places of a key
            keys, documents = np.unique(key[new], return_counts=True)
            if len(more := np.setdiff1d(keys[documents > LOCAL], hot, assume_unique=True)):
                none = np.zeros(len(more), np.int64)
                yield _rows(PLACES, more, none, none, none, np.full(len(more), HINT))
                hot = np.union1d(hot, more) if len(hot) < REMEMBERED else more
            spread = np.isin(found.key[send], hot)
            key = np.where(spread, U.mix64(ids[send] + found.at[send]).view(np.int64), found.key[send])
            yield _rows(PLACES, key, ids[send], digests[found.doc[send]], found.at[send] << 32 | found.size[send], np.where(spread, SPREAD, PLAIN))
            if len(late := np.flatnonzero(later)):
                heads, last = _merged(found.doc[late], found.at[late], (found.at + found.size)[late])
                late = late[heads]
                at = found.at[late]
                yield _rows(PLACES, U.mix64(ids[late] + at).view(np.int64), ids[late], digests[found.doc[late]], at << 32 | last - at, np.full(len(late), DONE))

    return run


def _shared(hot: int):
    """Of rows in order of key and doc_id, those whose key more than one document has, and those that are done or dealt by windows already. A key's
    rows are held until it ends, or has more than `hot` of them: from there on they pass at once. A key with a hint is hot as well."""

    def kept(rows: pa.Table, spread: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows of whole keys, or of one hot key."""
        key, ids = rows["key"].to_numpy(), rows["doc_id"].to_numpy()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        hint = rows["kind"].to_numpy() == HINT
        hinted = np.logical_or.reduceat(hint, heads) | spread
        several = np.repeat((ids[heads] != ids[heads + sizes - 1]) | hinted, sizes) & ~hint
        kind = np.where(np.repeat((sizes > hot) | hinted, sizes), SPREAD, PLAIN)
        rows = rows.set_column(4, "kind", pa.array(kind, pa.int32())).filter(pa.array(several))
        yield from rows.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_key = None, None
        for batch in batches:
            done = pc.or_(pc.equal(batch.column(4), DONE), pc.equal(batch.column(4), SPREAD))
            if len(late := batch.filter(done)):
                yield late
            rows = pa.Table.from_batches([batch.filter(pc.invert(done))])
            if hot_key is not None and len(rows):
                n = int(np.searchsorted(rows["key"].to_numpy(), hot_key, side="right"))
                if n:
                    yield from kept(rows.slice(0, n), True)
                if n == len(rows):
                    continue
                rows, hot_key = rows.slice(n), None
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from kept(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks()
            if len(held) > hot:
                yield from kept(held, True)
                held, hot_key = None, key[-1]
        if held is not None and len(held):
            yield from kept(held)

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts compressed, as they are shuffled to be read once or twice."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.columns[-1].cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x if x is None else press.compress(x) for x in texts], pa.binary())], names=batch.schema.names)


def _unfolded(part: pa.RecordBatch) -> list[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [press.decompress(x) if x else b"" for x in part.column(part.schema.get_field_index("text")).to_pylist()]


def _whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices by the texts' own sizes: a repetitive text is many times its compressed size."""
    import zstandard

    return U.slices(batches, "text", size=zstandard.frame_content_size)


def _pieces(window: int):
    """The packed words of the places asked for in each document; those of hot minimisers window by window, with a key from their words. Of these,
    windows that began in a smaller document of this task are decided at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}  # the smallest document so far of windows of hot minimisers
        for part in _whole_slices(batches):
            ids, digests = part.column(0).to_numpy(), part.column(1).to_numpy()
            column = part.column(part.schema.get_field_index("places"))
            keys, places, kinds = (pc.list_flatten(column).field(i).to_numpy() for i in range(3))
            rows = np.repeat(np.arange(len(ids)), pc.list_value_length(column).to_numpy())
            words = U.Words(_unfolded(part), lower=False)
            begin = np.cumsum(words.counts) - words.counts
            at, size, spread = places >> 32, places & 0xFFFFFFFF, kinds == SPREAD
            n = np.where(spread, size - window + 1, 1)  # pieces of each place
            rows, keys, at = np.repeat(rows, n), np.repeat(keys, n), U.ragged(at, n)
            size, spread = np.repeat(np.where(spread, window, size), n), np.repeat(spread, n)
            made = [packed(words, a, k) for a, k in zip((begin[rows] + at).tolist(), size.tolist(), strict=True)]
            if spread.any():
                import xxhash

                some = np.flatnonzero(spread)
                keys = keys.copy()
                own = list(zip(some.tolist(), ids[rows[some]].tolist(), strict=True))
                for i, x in own:
                    if least.setdefault(made[i], x) > x:
                        least[made[i]] = x
                late = np.array([i for i, x in own if least[made[i]] < x], np.int64)
                if len(least) > REMEMBERED:
                    least = {}
                stay = np.ones(len(rows), bool)
                stay[late] = False
                if len(late):
                    order = late[np.lexsort((at[late], rows[late]))]
                    heads, last = _merged(rows[order], at[order], at[order] + window)
                    heads = order[heads]
                    first = at[heads]
                    yield _rows(PIECES, U.mix64(ids[rows[heads]] + first).view(np.int64), ids[rows[heads]], digests[rows[heads]], first, last, pa.nulls(len(heads), pa.binary()))
                some = some[stay[some]]
                keys[some] = np.array([xxhash.xxh3_64_intdigest(made[i]) for i in some.tolist()], np.uint64).view(np.int64)
                stay = np.flatnonzero(stay)
                keys, rows, at, size = keys[stay], rows[stay], at[stay], size[stay]
                made = [made[i] for i in stay.tolist()]
            yield _rows(PIECES, keys, ids[rows], digests[rows], at, at + size, made)

    return run


def later_windows(ids: np.ndarray, packed: pa.Array, window: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the packed strings (in order): the string's number, and whether the window also begins in a smaller document."""
    texts = packed.to_pylist()
    buffer = b" ".join(texts)
    space = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    begin = np.concatenate([[0], space + 1])
    end = np.append(space, len(buffer))
    counts = np.fromiter((t.count(b" ") for t in texts), np.int64, len(texts)) + 1
    n_windows = counts - window + 1
    starts = U.ragged(np.cumsum(counts) - counts, n_windows)
    of = np.repeat(np.arange(len(texts)), n_windows)
    cut = pa.array([buffer[a:b] for a, b in zip(begin[starts].tolist(), end[starts + window - 1].tolist(), strict=True)], pa.binary())
    order = pc.sort_indices(cut)
    ordered = cut.take(order)
    new = np.ones(len(cut), bool)
    new[1:] = pc.not_equal(ordered[1:], ordered[:-1]).to_numpy(zero_copy_only=False)
    order, heads = order.to_numpy(), np.flatnonzero(new)
    least = np.minimum.reduceat(ids[of[order]], heads)
    if known is not None:
        least = np.array([min(x, known.setdefault(w, x)) for w, x in zip(ordered.take(pa.array(heads)).to_pylist(), least.tolist(), strict=True)])
    later = np.zeros(len(cut), bool)
    later[order] = ids[of[order]] > np.repeat(least, np.diff(np.append(heads, len(cut))))
    return of, later


def _decided(window: int, limit: int):
    """Ranges of words to remove, from pieces in order of key and doc_id: whole buckets at once, or a large one piece by piece in order of doc_id."""

    def sort(held: pa.Table, known: dict | None) -> Iterator[pa.RecordBatch]:
        key, ids = held["key"].to_numpy(), held["doc_id"].to_numpy()
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        if known is None:  # rows are in order: a bucket whose first and last document are one shares nothing
            lasts = np.append(heads[1:], len(key)) - 1
            shared = np.repeat(ids[heads] != ids[lasts], lasts - heads + 1)
            if not shared.any():
                return
            held = held.filter(pa.array(shared))
            ids = held["doc_id"].to_numpy()
        of, later = later_windows(ids, held["packed"].combine_chunks() if held["packed"].num_chunks != 1 else held["packed"].chunk(0), window, known)
        if not later.any():
            return
        first_of = np.searchsorted(of, np.arange(len(ids)))
        w = np.flatnonzero(later)
        piece = of[w]
        at = held["at"].to_numpy().astype(np.int64)[piece] + w - first_of[piece]
        heads, last = _merged(piece, at, at + window)
        rows = piece[heads]
        yield _rows(RANGES, ids[rows], held["digest"].to_numpy()[rows], at[heads], last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, known, known_key = 0, None, None
        for batch in batches:
            known_later = pc.is_null(batch.column(5))
            if len(late := batch.filter(known_later)):
                yield late.select(["doc_id", "digest", "at", "last"]).rename_columns(["doc_id", "digest", "first", "last"])
                batch = batch.filter(pc.invert(known_later))
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            held.append(rows)
            size += pc.sum(pc.binary_length(rows["packed"])).as_py()
            if size < limit:
                continue
            both = pa.concat_tables(held)
            key = both["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if known_key is not None:  # the rest of a bucket that came in pieces
                rest = int(np.searchsorted(key, known_key, side="right"))
                if rest:
                    yield from sort(both.slice(0, rest), known)
                if rest < len(key):
                    known = known_key = None
                both, key, cut = both.slice(rest), key[rest:], max(0, cut - rest)
            if cut:
                yield from sort(both.slice(0, cut), None)
                both = both.slice(cut)
            size = pc.sum(pc.binary_length(both["packed"])).as_py() or 0 if len(both) else 0
            if size >= limit:
                known, known_key = {}, key[-1]
                yield from sort(both, known)
                both, size = both.slice(0, 0), 0
            held = [both] if len(both) else []
        if held:
            both = pa.concat_tables(held)
            if known_key is not None:
                rest = int(np.searchsorted(both["key"].to_numpy(), known_key, side="right"))
                if rest:
                    yield from sort(both.slice(0, rest), known)
                both = both.slice(rest)
            if len(both):
                yield from sort(both, None)

    return run


def _without_ranges(batches: Iterator[pa.RecordBatch], as_they_are: bool) -> Iterator[pa.RecordBatch]:
    """Adds kept, n_words and n_removed in place of the last two columns (text, ranges)."""
    for part in _whole_slices(batches):
        kept, total, removed = [], [], []
        column = part.column(part.schema.get_field_index("text"))
        for text, ranges, null in zip(_unfolded(part), part.column(part.schema.get_field_index("ranges")).to_pylist(), column.is_null().to_pylist(), strict=True):
            words = text.split()
            n = len(words)
            if ranges:
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, [r["first"] for r in ranges], 1)
                np.add.at(gone, [r["last"] for r in ranges], -1)
                stay = np.cumsum(gone[:n]) <= 0
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            kept.append(None if null and as_they_are else (text if as_they_are and len(words) == n else b" ".join(words)).decode("utf-8", "replace"))
            total.append(n)
            removed.append(n - len(words))
        more = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays([*part.columns[:-2], *more], names=[*part.schema.names[:-2], "kept", "n_words", "n_removed"])


def repeated_ranges(docs: DataFrame, folded: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, digest, first, last): ranges of words of docs (doc_id, digest, text; no nulls) that windows also beginning in smaller documents
    cover. folded: the same with compressed texts."""
    places = docs.select("doc_id", "digest", "text").mapInArrow(_places(window), PLACES).repartition("key").sortWithinPartitions("key", "doc_id")
    dealt = U.written(places.mapInArrow(_shared(HOT), PLACES))
    first = F.shiftrightunsigned("place", 32)
    done = dealt.where(F.col("kind") == DONE).select("doc_id", "digest", first.cast("int").alias("first"), (first + F.col("place").bitwiseAND(0xFFFFFFFF)).cast("int").alias("last"))
    wanted = dealt.where(F.col("kind") != DONE).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("key", "place", "kind")).alias("places"))
    pieces = folded.join(wanted, ["doc_id", "digest"]).select("doc_id", "digest", "text", "places").mapInArrow(_pieces(window), PIECES)
    found = pieces.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_decided(window, BUCKET_BYTES), RANGES)
    return found.union(done)


def _cut(docs: DataFrame, window: int, as_they_are: bool) -> DataFrame:
    """doc_id, rest (a structure of all other columns, if there are any), kept, n_words and n_removed of docs."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", *([F.struct(*(U.column(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("rest")] if rest else []), "text")
    own = [c for c in ("doc_id", "rest") if c in named.columns]
    fields = {f.name: f for f in named.schema}

    def kinds(columns: list[str], more: str) -> StructType:
        return StructType([*(fields[c] for c in columns), *StructType.fromDDL(more)])

    whole = named.where("doc_id is not null and text is not null").withColumn("digest", F.xxhash64("text"))

    def fold(df: DataFrame) -> DataFrame:
        """Other columns, the digest and the compressed text."""
        return df.select(*own, "digest", "text").mapInArrow(_folded, kinds(own, "digest long, text binary"))

    folded = fold(whole).where("doc_id is not null and digest is not null")  # as the joins ask, so that one shuffle serves both
    ranges = repeated_ranges(whole, folded, window).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = folded.join(ranges, ["doc_id", "digest"], "left").select(*own, "text", "ranges")
    others = named.where("doc_id is null or text is null").withColumn("digest", F.lit(0).cast("long"))
    all_ = joined.union(fold(others).select(*own, "text", F.lit(None).cast("array<struct<first:int,last:int>>").alias("ranges")))
    return all_.mapInArrow(lambda batches: _without_ranges(batches, as_they_are), kinds(own, "kept string, n_words long, n_removed long"))


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs (doc_id, text, more columns) without text, and with kept (the words that stay, joined by one space), n_words and n_removed.

    A word goes if a window over it has a word sequence that also begins in a document with a smaller doc_id; windows are judged on the input.
    Null and empty texts have no words; their kept is empty. Very long texts are read whole. A document with a null doc_id keeps all and takes
    nothing from others; rows with one doc_id take nothing from each other, so that repeated rows have equal results. An empty table gives none.
    Other columns pass through, whatever their names; one named kept, n_words or n_removed gets _in at its end, as often as it takes.
    """
    taken = {"kept", "n_words", "n_removed", *docs.columns}
    out, names = [], []
    for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text")):
        name = c
        while name in ("kept", "n_words", "n_removed") or (name != c and name in taken):
            name += "_in"
        taken.add(name)
        names.append(name)
        out.append(F.col(f"rest.c{i}").alias(name))
    return _cut(docs, window, False).select("doc_id", *out, "kept", "n_words", "n_removed")


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """The columns of docs (doc_id, text, more columns), the text without the words that dedup_substrings removes. Texts that lose nothing stay as
    they are, null ones too; documents that lose all their words go. n_chars, where there is such a column, follows a changed text."""
    cut = _cut(docs, window, True).where("n_removed = 0 or n_removed < n_words")
    at = {c: f"rest.c{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    changed = F.col("n_removed") > 0

    def column(c: str) -> Column:
        if c == "n_chars":
            return F.when(changed, F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(F.col(at[c]))
        return F.col("doc_id") if c == "doc_id" else F.col("kept") if c == "text" else F.col(at[c])

    return cut.select(*(column(c).alias(c) for c in docs.columns))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that repeated 13-word windows cover."""
    docs = U.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i AS head, array_to_string(words[i:i + 12], ' ') AS seq FROM w, unnest(range(1, len(words) - 11)) AS t(i) WHERE len(words) >= 13),
firsts AS (SELECT seq, min(doc_id) AS lo, max(doc_id) AS hi FROM win GROUP BY seq HAVING min(doc_id) < max(doc_id)),
late AS (SELECT doc_id, head FROM win JOIN firsts USING (seq) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, head + k AS pos FROM late, unnest(range(0, 13)) AS t(k)),
pos AS (SELECT doc_id, i AS pos, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS kept, count(*) AS n_kept
         FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos WHERE g.pos IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
