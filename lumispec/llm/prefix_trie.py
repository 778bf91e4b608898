"""Trie of the prefixes that conversations share, its subtree totals by leaf-peeling messages.

A node stands for all conversations that begin with the same turns. Its smallest conversation names it: (conv_id, depth) is one node, and the
nodes of one conv_id are a run, a chain of consecutive depths that ends with that conversation. So the trie is a tree of runs, each hanging on one
node of a run of a smaller conv_id, and messages go from run to run: a run counts the runs on it that haven't finished; at zero it sends its
totals to the run above, until only the root's run finishes. Rounds follow the changes of the smallest conversation on a path, not its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U

#: Conversations of one family share the head of its first one; a head has fewer turns than HEADS.
FAMILY, HEADS = 100, 6
#: Consecutive turns of a conversation that one task sums up.
BLOCK = 4096
#: Sums of 31-bit numbers that tell prefixes apart.
_SUMS = ["s0", "s1", "s2", "s3"]


def _elements(at: Column, digest: Column) -> list[Column]:
    """Four 31-bit numbers of a turn at its place; their sums over a prefix, with its length, stand for it."""
    both = [F.xxhash64(F.lit(k), at, digest) for k in (1, 2)]
    return [x for b in both for x in (b.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(b, 33))]


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(k), depth.cast("long"), *sums) for k in (3, 4)]


def running(df: DataFrame, key: str, at: str, values: list[str], down: bool = False) -> DataFrame:
    """df with each value summed over the rows of its key up to its own place `at` (down: from its own place on). A key may hold any number of rows:
    blocks of BLOCK places are summed first, and a window of one key runs over its blocks alone."""
    held = df.withColumn("_block", F.floor(F.col(at) / BLOCK).cast("long"))
    way = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    sums = held.groupBy(key, "_block").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    above = Window.partitionBy(key).orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, "_block", *(F.coalesce(F.sum(f"_{v}").over(above), F.lit(0)).alias(f"_{v}") for v in values))
    within = Window.partitionBy(key, "_block").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    own = held.withColumns({v: F.sum(v).over(within) for v in values})
    return own.join(before, [key, "_block"]).withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_block", *(f"_{v}" for v in values))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, n_chars): the turns of each conversation from 0 on, by turn (null first), of equal turns by the digest of role and text.
    Rows are sorted by ranges that part a conversation of any length; places follow from the counts of earlier ranges."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("_tie")]
    dealt = U.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_chars", F.monotonically_increasing_id().alias("_row")))
    range_ = F.shiftrightunsigned("_row", 33).alias("_range")
    parts = dealt.groupBy("conv_id", range_).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return dealt.withColumn("_range", range_).join(starts, ["conv_id", "_range"]).select("conv_id", (F.col("_row") - F.col("_first") + F.col("_start")).alias("at"), "digest", "n_chars")


def members(turns: DataFrame, rebuild: bool = True) -> DataFrame:
    """numbered() turns to a row for each conversation and prefix of it: conv_id, depth, the prefix's key (k0, k1) and its parent's (p0, p1), n_chars
    of the last turn, and whether it is the whole conversation. With rebuild, a conversation begins with the first h turns of its family's first
    one, and has only its own turns after its first h; h is crc32(conv_id) mod HEADS, and 0 for the first itself."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    asked = F.when(F.lit(not rebuild) | (F.col("conv_id") % FAMILY == 0), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).select("conv_id", "n_own", asked.alias("h"), base.alias("base"))
    e = {s: x for s, x in zip(_SUMS, _elements(F.col("at"), F.col("digest")), strict=True)}
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS - 1)).withColumns({f"e{s}": x for s, x in e.items()})
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # over HEADS - 1 rows at most
    first = first.withColumns({s: F.sum(f"e{s}").over(upto) for s in _SUMS})
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "n_chars", *_SUMS, *(f"e{s}" for s in _SUMS)))).alias("head"))
    whole = sizes.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType)))
    k, last = F.size("head"), F.try_element_at("head", F.lit(-1))
    whole = whole.select("conv_id", "h", "head", k.cast("long").alias("k"), (k + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("long").alias("n"), *(F.coalesce(last[s], F.lit(0)).alias(f"head_{s}") for s in _SUMS))
    whole = U.written(whole)
    place = (F.col("at") - F.col("h") + F.col("k")).alias("at")
    own = turns.join(whole.drop("head"), "conv_id").where(F.col("at") >= F.col("h")).select("conv_id", place, "digest", "n_chars", "n", *(f"head_{s}" for s in _SUMS))
    own = own.withColumns({f"e{s}": x for s, x in e.items()}).withColumns({s: F.col(f"e{s}") for s in _SUMS}).drop("digest")
    own = running(own, "conv_id", "at", _SUMS).withColumns({s: F.col(s) + F.col(f"head_{s}") for s in _SUMS})
    head = whole.select("conv_id", "n", F.inline("head"))
    columns = ["conv_id", "n", "at", "n_chars", *_SUMS, *(f"e{s}" for s in _SUMS)]
    depth = F.col("at") + 1
    (k0, k1), (p0, p1) = _key(depth, [F.col(s) for s in _SUMS]), _key(F.col("at"), [F.col(s) - F.col(f"e{s}") for s in _SUMS])
    rows = own.select(*columns).union(head.select(*columns)).select("conv_id", depth.alias("depth"), k0.alias("k0"), k1.alias("k1"), p0.alias("p0"), p1.alias("p1"), "n_chars", (depth == F.col("n")).alias("whole"))
    zero = F.lit(0).cast("long")
    k0, k1 = _key(F.lit(0), [zero] * len(_SUMS))
    none = F.lit(None).cast("long")
    return rows.union(whole.select("conv_id", zero, k0, k1, none, none, zero, F.col("n") == 0))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k0, k1, ends) of rows sorted by (k0, k1, conv_id): the ids of a key stream through one hash, however many they are."""
    held, own = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([own.hexdigest()])], names=["k0", "k1", "ends"])

    for batch in batches:
        if not len(batch):
            continue
        k0, k1, ids = (batch.column(i).to_numpy() for i in range(3))
        heads = np.flatnonzero(np.append(True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])))
        text = ids.astype("U21").tolist()
        done: tuple[list, list, list] = ([], [], [])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)], strict=True):
            key = (int(k0[a]), int(k1[a]))
            if key != held:
                if held is not None:
                    for column, x in zip(done, (*held, own.hexdigest()), strict=True):
                        column.append(x)
                held, own = key, hashlib.sha256()
            else:
                own.update(b",")
            own.update(",".join(text[a:b]).encode())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["k0", "k1", "ends"])
    if held is not None:
        yield row()


def _nodes(rows: DataFrame) -> DataFrame:
    """A row for each node of members(): conv_id, depth, parent_conv_id, n_convs, n_children, ends_sha256, and saved, its own part of the total."""
    keys = ["k0", "k1"]
    nodes = U.written(rows.groupBy(*keys).agg(*(F.min(c).alias(c) for c in ("conv_id", "depth", "p0", "p1", "n_chars")), F.count("*").alias("n_convs")))
    ends = rows.where("whole").select(*keys, "conv_id").repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(_digests, "k0 long, k1 long, ends string")
    children = nodes.where("p0 is not null").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    own = nodes.join(parents, ["p0", "p1"], "left").join(children, keys, "left").join(ends, keys, "left")
    return own.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
    )


def _peeled(nodes: DataFrame) -> DataFrame:
    """(conv_id, above, at, saved, leaves): the totals of each run of nodes, and the node (above, at) that it hangs on. Each round is a written
    table of the runs that are still open; those without an open run on them finish with it."""
    runs = nodes.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("above"), (F.min("depth") - 1).alias("at"), F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    runs = U.written(runs)
    waiting = runs.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.count("*").alias("remaining"))
    open_ = U.written(runs.join(waiting, "conv_id", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)).cast("long")))
    finished = []
    while True:
        ready = open_.where("remaining = 0")
        finished.append(ready)
        rest = open_.where("remaining > 0")
        if rest.isEmpty():
            return reduce(DataFrame.union, finished).drop("remaining")
        sent = ready.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.count("*").alias("_n"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
        more = lambda c: F.coalesce(f"_{c}", F.lit(0))
        open_ = U.written(rest.join(sent, "conv_id", "left").select("conv_id", "above", "at", (F.col("saved") + more("saved")).alias("saved"), (F.col("leaves") + more("leaves")).alias("leaves"), (F.col("remaining") - more("n")).cast("long").alias("remaining")))


def prefix_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """conversations (conv_id, turn, role, text, more columns) to the nodes of their trie.

    Null roles and texts are empty. Turns of one conversation with equal numbers are in order of the digests of their role and text; repeated rows
    are turns of their own. Rows without conv_id belong to no conversation and count nowhere. Conversations of any number of turns, nodes of any
    number of members and children, and very long texts (of which only a digest moves) are whole. An empty table has no nodes, not even a root.
    Other columns, whatever their names, count for nothing. The digest of a node's whole conversations is one sequential hash: their ids stream
    through one task in order, eight bytes each.
    """
    rows = U.written(members(U.written(numbered(conversations)), rebuild))
    nodes = U.written(_nodes(rows))
    runs = _peeled(nodes)
    came = runs.where("above is not null").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
    own = nodes.join(came, ["conv_id", "depth"], "left").withColumns({
        "saved_tokens": F.col("saved") + F.coalesce("_saved", F.lit(0)), "n_leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("_leaves", F.lit(0)),
    })
    out = running(own.drop("_saved", "_leaves"), "conv_id", "depth", ["saved_tokens", "n_leaves"], down=True)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    return prefix_trie(U.table(spark, sf_dir, "conversations"))


_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x : CAST(ascii(x) AS BIGINT))), lambda a, b : list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"

OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'d': sha256(length(r) || ':' || r || x), 'n': length(x)}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS turns FROM t GROUP BY conv_id),
asked AS (SELECT *, CASE WHEN conv_id % {FAMILY} = 0 THEN 0 ELSE {_CRC} % {HEADS} END AS h FROM own),
built AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM asked a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
pre AS (SELECT conv_id, len(turns) AS n, d AS depth, sha256(array_to_string(list_transform(turns[1:d], lambda t : t.d), ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda t : t.d), ',')) END AS p, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS chars
 FROM built, unnest(range(0, len(turns) + 1)) AS u(d)),
node AS (SELECT k, depth, min(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM pre GROUP BY k, depth),
kids AS (SELECT depth, p AS k, count(*) AS n_children FROM (SELECT depth - 1 AS depth, p FROM node WHERE p IS NOT NULL) GROUP BY depth, p),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k, depth)),
up AS (SELECT q.k, q.depth, w.saved, w.n_children FROM whole w JOIN pre q ON q.conv_id = w.conv_id AND q.depth <= w.depth),
sums AS (SELECT k, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY k, depth)
SELECT w.conv_id, w.depth, b.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (k, depth) LEFT JOIN node b ON b.k = w.p AND b.depth = w.depth - 1
"""
