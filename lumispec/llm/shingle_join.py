"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two sets of sizes a and b can reach the threshold only if they differ in at most D = (a + b)(100 - p) / (100 + p) n-grams. The n-gram columns
are cut into more than D blocks, so that the two rows of such a pair are equal in some blocks that aren't empty: only pairs with an equal block
are candidates, and only of rows with as many equal blocks as a pair needs, whatever n-grams are frequent. The overlap counts of many
candidates are then accumulated at once, block of columns by block of columns, as a sparse product in numpy; a pair is discarded as soon as what
is left can't lift it over its bound. Documents with equal sets are one node.

A bucket isn't expanded into all pairs. Its nodes are compared with its hub, the one that shares most blocks. Where that leaves more than one
component in a bucket, all pairs across components are compared that share one of the rarest n-grams that their bounds leave them to differ in,
so that no link is lost. Where these would be many, open buckets are compared with further hubs first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U
from .components import components

#: Rounds in which each open bucket compares a further hub with the other components, and the pairs left over for each row of rare n-grams that
#: make such a round worth while.
ROUNDS, MANY = 3, 200
#: Growth of the size classes' upper bounds.
RATIO = 1.4
#: Members of a bucket that joins on its key deal to one task.
PIECE = 512
#: Bits for each candidate document of the filter on them, and its most bits; beyond, more documents pass than are asked for.
FILTER_SHARE, FILTER_BITS = 16, 1 << 27
#: Bytes of n-grams whose overlaps are counted at once, and blocks of columns.
PRODUCT_BYTES, COLUMNS = 4 << 20, 8
ROWS = "key long, node long, n long, doc_id long, is_doc boolean"
_ROW_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: `width` words, or all words where there are fewer."""
    words = U.Words(texts)
    h = words.hashes()
    mers = h[: max(0, len(h) - width + 1)].copy()
    for j in range(1, width):
        mers = U.mix64(mers) + h[j : len(mers) + j]
    mers = U.mix64(mers)
    out, at = [], 0
    for n in words.counts.tolist():
        if n >= width:
            own = np.sort(mers[at : at + n - width + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            short = np.uint64([n])
            for x in h[at : at + n]:
                short = U.mix64(short) + x
            own = U.mix64(short + np.uint64(0x9E3779B97F4A7C15))
        else:
            own = mers[:0]
        out.append(own)
        at += n
    return out


class Classes:
    """Size classes and the number of column blocks of each, for a threshold in per cent."""

    def __init__(self, percent: int) -> None:
        self.percent, self.upper = percent, np.array([1], np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        while self.upper[-1] < n.max(initial=1) * 2:
            self.upper = np.append(self.upper, max(self.upper[-1] + 1, int(self.upper[-1] * RATIO)))
        return np.searchsorted(self.upper, n)

    def differ(self, c: np.ndarray) -> np.ndarray:
        """D of the class."""
        return 2 * self.upper[c] * (100 - self.percent) // (100 + self.percent)

    def spare(self, c: np.ndarray) -> np.ndarray:
        """Blocks beyond D + 1: as many may be empty, or else are equal as well in a pair that links."""
        return 2 + self.differ(c) // 4


def block_keys(sets: list[np.ndarray], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the set, key, and size | need << 32 | next << 62, for each block that a set is to be compared by: it needs `need` equal blocks at
    least to have a partner, among those of its own class or (next 1) the next. Sets must not be empty."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    own = classes.of(n)
    further = n * 100 // classes.percent > classes.upper[own]  # may have partners in the next class
    all_sets, all_keys, all_marks = [], [], []
    for further_class, chosen, c in ((0, np.arange(len(sets)), own), (1, np.flatnonzero(further), own[further] + 1)):
        some = classes.differ(c) > 0
        chosen, c = chosen[some], c[some]
        if not len(chosen):
            continue
        blocks = classes.differ(c) + 1 + classes.spare(c)
        h = np.concatenate([sets[i] for i in chosen])
        of = np.repeat(np.arange(len(chosen)), n[chosen])
        block = ((h >> np.uint64(32)) * blocks[of].astype(np.uint64)) >> np.uint64(32)
        new = np.append(True, (block[1:] != block[:-1]) | (of[1:] != of[:-1]))
        heads = np.flatnonzero(new)
        total = np.add.reduceat(U.mix64(h), heads)
        place = block[heads] + (c[of[heads]].astype(np.uint64) << np.uint64(40)) + np.uint64(1 << 60)
        filled = np.bincount(of[heads], minlength=len(chosen))
        need = np.maximum(1, 1 + classes.spare(c) - (blocks - filled))  # of the D + 1 + spare blocks, D differ at most, and empty ones have no key
        marks = n[chosen] | need << 32 | further_class << 62
        all_sets.append(chosen[of[heads]])
        all_keys.append(U.mix64(total + U.mix64(place)))
        all_marks.append(marks[of[heads]])
        for i in np.flatnonzero(blocks - filled > classes.spare(c)):  # too many empty blocks: they count as well
            empty = np.setdiff1d(np.arange(blocks[i], dtype=np.uint64), block[heads][of[heads] == i])
            all_sets.append(np.full(len(empty), chosen[i]))
            all_keys.append(U.mix64(U.mix64(empty + (np.uint64(c[i]) << np.uint64(40)) + np.uint64(1 << 61))))
            all_marks.append(np.full(len(empty), marks[i]))
    if not all_sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(all_sets), np.concatenate(all_keys), np.concatenate(all_marks)


def _digest(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def _incidence(width: int, percent: int):
    """A row for each document (its node and size), and the node's block keys once for each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(percent), set()
        for part in U.slices(batches, "text"):
            sets = shingle_sets(U.byte_texts(part), width)
            nodes = np.array([_digest(s) for s in sets], np.int64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(U.mix64(nodes.view(np.uint64) + np.arange(len(sets), dtype=np.uint64)).view(np.int64)), pa.array(nodes), pa.array(n), part.column(0), pa.array(np.ones(len(sets), bool))], names=_ROW_NAMES)
            ids = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            if len(seen) > 100_000:
                seen.clear()
            first = {}
            for i in np.flatnonzero((n > 0) & ids).tolist():
                if nodes[i] not in seen:
                    first[int(nodes[i])] = i
            seen.update(first)
            chosen = list(first.values())
            if not chosen:
                continue
            of, keys, marks = block_keys([sets[i] for i in chosen], classes)
            if len(of):
                rows = np.array(chosen)[of]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[rows]), pa.array(marks), pa.nulls(len(of), pa.int64()), pa.array(np.zeros(len(of), bool))], names=_ROW_NAMES)

    return run


FOUND = "kind int, a long, b long, n long, part int"
_FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _found(kind: int, a: np.ndarray | pa.Array, b: np.ndarray, n: np.ndarray, part: np.ndarray | int = 0) -> pa.RecordBatch:
    part = np.broadcast_to(part, len(b)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), a if isinstance(a, pa.Array) else pa.array(a), pa.array(b), pa.array(n), pa.array(part)], names=_FOUND_NAMES)


def _buckets(piece: int):
    """From rows in order of key and node: documents (kind 0: doc_id, node, n) and members of buckets of two nodes or more (kind 1: key, node, n and
    the part of the bucket, `piece` rows each). One row is held of a bucket, however large it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = node = size = None
        sent, before = False, 0  # whether the last row is sent; rows of its bucket before it
        for batch in batches:
            is_doc = batch.column(4).to_numpy(zero_copy_only=False)
            docs = batch.filter(batch.column(4))
            if len(docs):
                yield _found(0, docs.column(3), docs.column(1).to_numpy(), docs.column(2).to_numpy())
            keys, nodes, sizes = (batch.column(i).to_numpy()[~is_doc] for i in range(3))
            if not len(keys):
                continue
            carried, earlier = None, 0
            if key is not None and keys[0] == key:  # the last row again, as the bucket goes on
                keys, nodes, sizes = (np.append(x, y).astype(y.dtype) for x, y in ((key, keys), (node, nodes), (size, sizes)))
                carried, earlier = sent, before
            fresh = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
            keys, nodes, sizes = keys[fresh], nodes[fresh], sizes[fresh]
            with_next = np.append(keys[1:] == keys[:-1], False)
            heads = np.flatnonzero(np.append(True, ~with_next[:-1]))
            place = np.arange(len(keys)) - np.repeat(heads, np.diff(np.append(heads, len(keys))))
            place[: heads[1] if len(heads) > 1 else len(keys)] += earlier
            send = with_next | np.append(False, with_next[:-1])
            key, node, size, before, sent = keys[-1], nodes[-1], sizes[-1], int(place[-1]), bool(send[-1]) or (len(keys) == 1 and bool(carried))
            if carried:
                send[0] = False  # it is sent already
            if send.any():
                yield _found(1, keys[send], nodes[send], sizes[send], place[send] // piece)

    return run

def _sets_of(width: int, bits: bytes):
    """(node, grams) of the documents that the filter lets through: all that are asked for, and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits, np.uint8)
        for whole in batches:
            place = whole.column(1).to_numpy()
            whole = whole.filter(pa.array((held[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0))
            for part in U.slices(iter([whole]), "text"):
                sets = shingle_sets(U.byte_texts(part), width)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return run


def overlaps_reach(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """For each pair of sets of distinct hashes, whether 100 * overlap >= percent * union.

    The product of the two incidence matrices' rows, pair by pair, is summed block of columns by block of columns; pairs that what is left can't
    lift over their bound leave.
    """
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    need = -(-percent * (n_a + n_b) // (100 + percent))
    got, open_ = np.zeros(len(a), np.int64), np.minimum(n_a, n_b) >= need
    pairs = [np.repeat(np.arange(len(a)), n) for n in (n_a, n_b)]
    grams = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in (a, b)]
    column = [(g >> np.uint64(61)).astype(np.int64) for g in grams]
    rest = [np.bincount(p * COLUMNS + c, minlength=len(a) * COLUMNS).reshape(-1, COLUMNS) for p, c in zip(pairs, column, strict=True)]
    left = [x[:, ::-1].cumsum(1)[:, ::-1] for x in rest]  # n-grams in this block and those after it
    for k in range(COLUMNS):
        cells = []
        for p, g, c in zip(pairs, grams, column, strict=True):
            use = np.flatnonzero((c == k) & open_[p])
            cells.append((p[use], U.mix64(g[use] + U.mix64(p[use].astype(np.uint64) + np.uint64(1)))))
        both = np.concatenate([x for _, x in cells])
        order = both.argsort(kind="stable")
        twice = order[:-1][both[order[1:]] == both[order[:-1]]]  # a cell of both rows, that of a first
        got += np.bincount(cells[0][0][twice], minlength=len(a))
        after = np.minimum(*(x[:, k + 1] for x in left)) if k + 1 < COLUMNS else 0
        open_ &= got + after >= need
    return open_


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in U.slices(batches, "gu", PRODUCT_BYTES):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            keep = pa.array(overlaps_reach(a, b, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), pa.array(nodes)], names=["gram", "node"])


def _least_overlap(percent: int) -> Column:
    """The fewest common n-grams with which a node of size n links with one of size lo, or of the least size that can link at all."""
    return F.ceil(percent * (F.col("n") + F.greatest("lo", F.ceil(percent * F.col("n") / 100))) / (100 + percent))


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(gram, node, label, n, rest, ...) of the n-grams by which nodes (node, label, n, lo) meet all that they may still link with, those of one label
    left out: two sets with an overlap of o share one of the first n - o + 1 n-grams of each, in one order of all n-grams. The order is by
    rarity, so that what a large group has in common is in few of these prefixes; a node with so many n-grams of its own that no other can reach
    the bound has none."""
    grams = U.written(sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "grams").mapInArrow(_grams, "gram long, node long"))
    df = U.written(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))  # a table, so that Spark can split the join
    first = (F.col("n") - _least_overlap(percent) + 1).cast("int")
    ordered = grams.join(df, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    shared = F.size("grams")
    left = nodes.join(ordered, "node").withColumn("own", F.col("n").cast("int") - shared).withColumn("left", first - F.col("own")).where("left > 0")
    # rest: the n-grams from this one on
    prefix = left.select("node", "label", "n", "own", F.posexplode(F.slice("grams", F.lit(1), F.col("left"))["gram"]).alias("at", "gram")).select("node", "label", "n", "gram", (F.col("n") - F.col("own") - F.col("at")).alias("rest"))
    prefix = U.written(prefix)
    each = prefix.groupBy("gram", "label").agg(F.count("*").alias("c"))
    several = each.groupBy("gram").agg(F.count("*").alias("labels"), F.sum("c").alias("m"), F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("of_major"))
    return U.written(prefix.join(U.written(several.where("labels > 1").drop("labels")), "gram"))


def _prefix_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs across labels that share an n-gram. Those within the label that most of an n-gram's nodes have aren't even looked at."""
    other = prefix.select("gram", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
    # at the first n-gram that two sets share, each has enough left for their overlap
    enough = (100 + percent) * F.least("rest", "rx") >= percent * (F.col("n") + F.col("nx"))
    once = (F.col("lx") == F.col("major")) | (F.col("node") < F.col("x"))
    across = prefix.where("label != major").join(other, "gram").where((F.col("label") != F.col("lx")) & once & enough)
    return across.select(F.least("node", "x").alias("u"), F.greatest("node", "x").alias("v")).distinct()


def link_documents(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One row a document of docs (doc_id, text): doc_id, n_shingles (distinct) and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their sets of shingles (`width` lower-cased words; all words where there are
    fewer). Null and empty texts and those without words have no shingles and are linked with nothing; so are documents with a null doc_id, whose
    component is null. Rows with one doc_id are documents of their own, with one component if they link. Equal sets are one node, whatever their
    number; very long texts are read whole, and a pair of exactly the threshold links. Other columns are ignored, whatever their names; an empty
    table gives none.
    """
    docs = docs.select("doc_id", "text")
    rows = docs.mapInArrow(_incidence(width, percent), ROWS)
    found = U.written(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_buckets(PIECE), FOUND))
    owners = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "n")
    mark = F.col("n")
    inside = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "part", mark.bitwiseAND(0xFFFFFFFF).alias("n"), F.shiftright(mark, 62).alias("class"), F.shiftright(mark, 32).bitwiseAND(0x3FFFFFFF).alias("need"))
    of_node = Window.partitionBy("node", "class")  # a node's blocks: a part of its n-grams at most
    counted = inside.withColumn("blocks", F.count("*").over(of_node)).withColumn("need", F.max("need").over(of_node))
    kept = U.written(counted.where("blocks >= need").drop("need", "class"))  # nodes with too few equal blocks have no partner

    def by_piece(buckets: DataFrame) -> DataFrame:
        """Buckets (key, parts, ...), a row for each piece, so that members of a large one meet it in several tasks."""
        return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), "parts"))).drop("parts")

    def hubs(held: DataFrame, order: Column) -> DataFrame:
        best = held.groupBy("key").agg(F.max_by(F.struct("node", "label", "n"), order).alias("hub"), F.count("*").alias("m"), F.max("part").alias("parts")).where("m > 1")
        return best.select("key", "parts", "m", F.col("hub.node").alias("x"), F.col("hub.label").alias("lx"), F.col("hub.n").alias("nx"))

    def pairs(across: DataFrame) -> DataFrame:
        """Pairs of a bucket's nodes and its hub that differ in component and whose sizes allow a link."""
        across = across.where((F.col("label") != F.col("lx")) & (100 * F.least("n", "nx") >= percent * F.greatest("n", "nx")))
        return across.select(F.least("node", "x").alias("u"), F.greatest("node", "x").alias("v")).distinct()

    alone = kept.withColumn("label", F.col("node"))
    members = U.written(alone.join(by_piece(hubs(alone, F.struct("blocks", "node"))), ["key", "part"]))

    # the sets of nodes that take part, made anew from one document each
    central = members.select("node").distinct()
    reps = U.written(owners.where("n > 0 and doc_id is not null").join(central, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    size = min(FILTER_BITS, max(1 << 15, 1 << (FILTER_SHARE * reps.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    bits = bytearray(size // 8)
    for k, some in reps.groupBy(F.shiftright(place, 15)).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1))).collect():  # size / 8 bytes
        bits[k << 12 : (k + 1) << 12] = some
    passing = docs.where("doc_id is not null").select("doc_id", place.alias("place"), "text").mapInArrow(_sets_of(width, bytes(bits)), "node long, grams binary")
    sets = U.written(passing)

    def linked(tried: DataFrame) -> DataFrame:
        both = tried.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u").join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v")
        return U.written(both.select("u", "v", "gu", "gv").mapInArrow(_linked(percent), "u long, v long"))

    def still_open(labels: DataFrame) -> DataFrame:
        """Members, with their components, of the buckets that have more than one, and the smallest size in it. A bucket of two is done."""
        held = members.where("m > 2").select("key", "part", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = held.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("n").alias("lo"), F.max("part").alias("parts")).where("a != b").select("key", "lo", "parts")
        return U.written(held.join(by_piece(several), ["key", "part"]))

    links = linked(pairs(members))
    labels = components(links)
    for turn in range(ROUNDS + 1):
        held = still_open(labels)
        if held.isEmpty():
            break
        nodes = U.written(held.groupBy("node").agg(F.max("label").alias("label"), F.max("n").alias("n"), F.min("lo").alias("lo")))
        prefix = _prefixes(nodes, sets, percent)
        n_pairs, n_rows = prefix.agg(F.sum((F.col("m") - F.col("of_major")).cast("double")), F.count("*")).first()  # each row with those of other labels
        last = turn == ROUNDS or (n_pairs or 0) <= MANY * n_rows
        further = hubs(held, F.xxhash64("node", F.lit(turn))).drop("m")
        fresh = linked(_prefix_pairs(prefix, percent) if last else pairs(held.join(by_piece(further), ["key", "part"])))
        if not fresh.isEmpty():
            links = links.union(fresh)
            labels = components(links)
        if last:
            break

    U.give_back()  # plans of the rounds
    labelled = owners.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = U.written(labelled.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least")))
    out = labelled.join(least, "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return link_documents(U.table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
