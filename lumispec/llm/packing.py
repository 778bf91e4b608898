"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that minimise padding; within each bucket, documents
form batches that hold as many rows of the boundary's length as a token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U
from ._util import ragged

BUCKETS, BUDGET = 8, 65_536
#: Documents that one task numbers, about.
SHARD_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` of the lengths (ascending) as boundaries, the largest among them, so that the sum of each document's boundary is least.
    Of equal solutions, the one whose last buckets begin at the least lengths.

    The best last cut grows with the length (the cost of a bucket is concave in its ends), so that each round halves the lengths that are left
    between lengths whose cuts are known: n log n steps for n lengths and each bucket.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, before = lengths.astype(np.int64), np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    cost = lengths * before[1:]  # one bucket over the first j + 1 lengths
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, cut = cost.copy(), np.full(n, -1)
        low, high = np.array([1]), np.array([n - 1])  # spans of lengths, and of their possible cuts
        first, last = np.array([0]), np.array([n - 2])
        while len(low):
            mid = (low + high) // 2
            sizes = np.minimum(last, mid - 1) - first + 1
            heads = np.cumsum(sizes) - sizes
            i, j = ragged(first, sizes), np.repeat(mid, sizes)
            each = cost[i] + lengths[j] * (before[j + 1] - before[i + 1])
            least = np.minimum.reduceat(each, heads)
            hits = np.flatnonzero(each == np.repeat(least, sizes))
            best = i[hits[np.searchsorted(hits, heads)]]
            better = least < new[mid]
            new[mid[better]], cut[mid[better]] = least[better], best[better]
            low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, best), (best, last)))
            some = low <= high
            low, high, first, last = low[some], high[some], first[some], last[some]
        cuts.append(cut)
        cost = new
    out, j = [int(lengths[-1])], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(int(lengths[j]))
    return out[::-1]


def pack(docs: DataFrame, length: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs (doc_id, a length column, more columns) with bucket (from 0), bucket_length, batch and slot.

    batch numbers the bucket's batches in ascending doc_id (nulls first, equal ids by length, equal rows in any order); slot is the row within its
    batch. A document longer than the budget is a batch of its own; a null length, or one below 1, counts as 1. Columns of these names are
    replaced, others pass through, whatever their names. An empty table gives none. The driver gathers one count for each distinct length.
    """
    own = [c for c in docs.columns if c not in ("bucket", "bucket_length", "batch", "slot")]
    row = F.struct(*(U.column(c).alias(f"c{i}") for i, c in enumerate(own))).alias("row")
    held = docs.select(row, F.col("doc_id").alias("id"), F.greatest(F.coalesce(U.column(length), F.lit(1)), F.lit(1)).cast("long").alias("length"))
    histogram = held.groupBy("length").count().toPandas().sort_values("length")
    cuts = boundaries(histogram["length"].to_numpy(), histogram["count"].to_numpy(), buckets) or [1]
    shards = max(1, -(-int(histogram["count"].sum()) // SHARD_ROWS))
    number = F.lit(0)
    for k, cut in enumerate(cuts[:-1]):
        number = F.when(F.col("length") > cut, k + 1).otherwise(number)
    held = held.withColumn("bucket", number.cast("int")).withColumn("bucket_length", F.element_at(F.array(*(F.lit(c).cast("long") for c in cuts)), F.col("bucket") + 1))
    # ranges of ascending doc_id with about as many rows each; a table, as each row's range must not change
    held = U.written(held.repartitionByRange(shards, "id", "length").withColumn("shard", F.spark_partition_id()))
    counts = held.groupBy("bucket", "shard").count()
    before = counts.select("bucket", "shard", (F.sum("count").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "length")) - 1
    numbered = held.withColumn("place", place).join(before, ["bucket", "shard"]).withColumn("place", F.col("place") + F.col("before"))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length")))
    return numbered.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(own)), "bucket", "bucket_length", F.floor(F.col("place") / per).alias("batch"), (F.col("place") % per).alias("slot"))


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens, written once: the words of the whole text, and one end. Null and empty texts have the end alone."""
    return U.written(docs.select("doc_id", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) + 1).cast("long").alias("n_tokens")))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document, by its number of words."""
    return pack(word_lengths(U.table(spark, sf_dir, "documents")), "n_tokens")


def oracle(documents: str = "documents", buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL for op6: the dynamic programme as a chain of joins, one for each bucket more."""
    parts = [
        rf"n AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS BIGINT) AS n_tokens FROM {documents})",
        "g AS (SELECT doc_id, n_tokens, n_tokens AS v FROM n)",
        "h AS (SELECT v, row_number() OVER (ORDER BY v) AS j, sum(count(*)) OVER (ORDER BY v) AS c FROM g GROUP BY v)",
        "f1 AS (SELECT j, v, c, v * c AS cost, CAST(NULL AS BIGINT) AS cut FROM h)",
    ]
    for k in range(2, buckets + 1):
        parts.append(
            f"s{k} AS (SELECT h.j, min(p.cost + h.v * (h.c - p.c)) AS cost, arg_min(p.j, (p.cost + h.v * (h.c - p.c), p.j)) AS cut FROM h JOIN f{k - 1} p ON p.j < h.j GROUP BY h.j), "
            f"f{k} AS (SELECT p.j, p.v, p.c, least(p.cost, coalesce(s.cost, p.cost)) AS cost, CASE WHEN s.cost < p.cost THEN s.cut END AS cut FROM f{k - 1} p LEFT JOIN s{k} s ON s.j = p.j)"
        )
    parts.append(f"b{buckets} AS (SELECT max(j) AS j FROM h)")
    for k in range(buckets, 1, -1):
        parts.append(f"b{k - 1} AS (SELECT coalesce(f.cut, b.j) AS j FROM b{k} b JOIN f{k} f USING (j))")
    parts.append("cuts AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS bucket FROM (" + " UNION ".join(f"SELECT h.v FROM b{k} JOIN h USING (j)" for k in range(1, buckets + 1)) + "))")
    parts.append("d AS (SELECT doc_id, n_tokens, min(bucket) AS bucket, min(cuts.v) AS bucket_length FROM g JOIN cuts ON g.v <= cuts.v GROUP BY doc_id, n_tokens)")
    parts.append(f"r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, n_tokens) - 1 AS p, greatest(1, {budget} // bucket_length) AS per FROM d)")
    return "WITH " + ", ".join(parts) + " SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(bucket_length AS BIGINT) AS bucket_length, CAST(p // per AS BIGINT) AS batch, CAST(p % per AS BIGINT) AS slot FROM r"
