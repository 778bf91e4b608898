"""A corpus pipeline of the text operators: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispec.llm import _util as U
from lumispec.llm import decontaminate, packing, quality, shingle_join, substring_dedup

#: Quality below which a document goes.
LEAST_QUALITY = 0.3
#: Words of a shingle, and per cent of shingles in common from which two documents are near duplicates. The query op5 has its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality LEAST_QUALITY or more. The classifier learns from labels.quality of this stage's documents, but for a fifth of them.
    Null and empty texts are judged as texts without words, equal texts alike; columns pass through, whatever their names."""
    labels = U.table(spark, sf_dir, "labels").where(U.remainder5(F.col("doc_id")) != 0)
    return quality.keep_good(docs, quality.fit(docs, labels), LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles with a Jaccard similarity of 0.8 or more): that of the smallest
    doc_id. Documents without words or doc_id stay. Of rows with one doc_id all stay or go. Very long texts are compared whole; an empty table
    stays empty."""
    found = shingle_join.link_documents(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    gone = found.where("component_id is not null and component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(U.column, docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that smaller doc_ids hold already; those of which nothing is left go. Unchanged texts stay as they are, null and
    empty ones too; n_chars follows a changed one. Rows with one doc_id, or none, take nothing from each other."""
    return substring_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its own text, with a doc_id or without, and equal texts alike; null and empty
    texts hold none. Very long texts are searched whole; an empty table stays empty."""
    digest = F.xxhash64("text")
    found = U.written(decontaminate.leaks(docs.select(digest.alias("doc_id"), "text"), U.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_digest")).distinct())
    return docs.join(found, digest == F.col("_digest"), "left_anti").select(*map(U.column, docs.columns))


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document, by its words and one end; repeated and null doc_ids are rows of their own."""
    return packing.pack(packing.word_lengths(docs), "n_tokens")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("packing", pack_lengths),
]

#: The classifier, the latent space and the components' iteration aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again by the next. A stage's own tables are deleted when it is done, and
    its result when the next is."""
    docs = U.table(spark, sf_dir, "documents")
    with U.own_tables() as made:
        for _, stage in STAGES:
            docs = U.written(stage(spark, docs, sf_dir))
            U.drop_tables(spark, made, 1)
    return docs
