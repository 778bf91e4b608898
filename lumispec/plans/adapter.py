"""Deterministic views that give the driver's tables the shape of spectra, as DataFrames and as the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import encode as E

#: Stages that the kinds of events stand for.
STAGES = {"signup": "start", "click": "genome", "view": "indexStart", "purchase": "metaStart", "error": "done"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome_id, milli_mz)"""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("genome_id"), E.encode_mz(F.col("l_extendedprice") / 10).alias("milli_mz"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome_id, local_peak_idx, milli_mz)"""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("genome_id"), E.encode_mz(F.col("l_extendedprice") / 10).alias("milli_mz"), "l_orderkey", "l_linenumber")
    order = Window.partitionBy("genome_id").orderBy("milli_mz", "l_orderkey", "l_linenumber")
    return rows.select("genome_id", (F.row_number().over(order) - 1).cast("long").alias("local_peak_idx"), "milli_mz")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, ord, milli_mz, intensity)"""
    intensity = (F.substring("o_orderpriority", 1, 1).cast("int") / F.lit(7)).cast("float")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey", E.encode_mz(F.col("o_totalprice") / 50).alias("milli_mz"), intensity.alias("intensity"))
    order = Window.partitionBy("query_id").orderBy("o_orderkey")  # by the name that it keeps, so that what is dealt by query_id isn't dealt again
    return rows.select("query_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), "milli_mz", "intensity")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome_id, accession)"""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("genome_id"), F.concat(F.lit("acc_"), F.col("s_suppkey").cast("string")).alias("accession"))


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, accession, peaks): the lists of m/z of all genomes, some of them empty."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).cast("double").alias("mz")))).alias("rows"))
    rows = genomes(spark, sf_dir).join(lists, F.col("genome_id") == F.col("l_suppkey"), "left")
    return rows.select(F.col("genome_id").cast("long").alias("ordinal"), "accession", F.coalesce(F.col("rows.mz"), F.array().cast("array<double>")).alias("peaks"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_file, content): the orders of each customer as lines of a query file."""
    line = F.concat(F.format_string("%.4f", F.col("o_totalprice").cast("double") / 50), F.lit(" "), F.substring("o_orderpriority", 1, 1))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    name = F.concat(F.lit("q"), F.col("o_custkey").cast("string"), F.lit(".mgf"))
    return lists.select(F.col("o_custkey").alias("query_id"), name.alias("query_file"), F.concat(F.lit("BEGIN IONS\r\nTITLE=x\n# none\n"), F.array_join("lines", "\nCOM=1 2\n\n"), F.lit("\nEND IONS\n")).alias("content"))


def metadata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """genes, names and taxonomy by accession; some names and taxa are left out, and some counts are negative."""
    s = table(spark, sf_dir, "supplier").withColumn("accession", F.concat(F.lit("acc_"), F.col("s_suppkey").cast("string")))
    genes = s.select("accession", F.col("s_acctbal").cast("long").alias("gene_count"))
    names = s.where("s_suppkey % 7 != 0").select("accession", F.col("s_name").alias("name"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    taxa = s.where("s_suppkey % 5 != 0").join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    text = F.concat(F.lit("d__"), F.col("r_name"), F.lit(";p__"), F.col("n_name"))
    return genes, names, taxa.select("accession", F.col("n_nationkey").cast("long").alias("taxonomy_id"), text.alias("taxonomy"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq, ts, stage, genomes, peaks)"""
    kinds = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", kinds[F.col("event_type")].alias("stage"), F.col("event_id").alias("genomes"), F.floor(F.col("value") * 100).cast("long").alias("peaks"))


def peak_line() -> Column:
    """An order as a peak line, of several spellings."""
    whole, kind, part = F.floor("o_totalprice").cast("long").cast("string"), F.col("o_orderkey") % 8, F.substring("o_orderpriority", 1, 1)
    return (
        F.when(kind == 0, F.concat(whole, F.lit(".25 "), part))
        .when(kind == 1, F.concat(whole, F.lit(","), part, F.lit(".5")))
        .when(kind == 2, F.concat(F.lit("# "), whole))
        .when(kind == 3, F.concat(F.lit("COM="), whole))
        .when(kind == 4, F.concat(F.lit(" \t"), whole, F.lit("  ")))
        .when(kind == 5, F.concat(whole, F.lit(" x 3")))
        .when(kind == 6, F.concat(whole, F.lit("e-1\t.5 9 9")))
        .otherwise(F.concat(F.lit("BEGIN "), whole))
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, line): peak lines of several spellings, and all lines of documents."""
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"), peak_line().alias("line"))
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    return o.union(d)


#: The same views for DuckDB.
SQL = {
    "lib0": "lib0 AS (SELECT l_suppkey AS genome_id, CAST(floor(l_extendedprice / 10 * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS milli_mz, l_orderkey, l_linenumber FROM lineitem)",
    "peaks": "peaks AS (SELECT genome_id, CAST(row_number() OVER (PARTITION BY genome_id ORDER BY milli_mz, l_orderkey, l_linenumber) - 1 AS BIGINT) AS local_peak_idx, milli_mz FROM lib0)",
    "q": "q AS (SELECT o_custkey AS query_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, CAST(floor(o_totalprice / 50 * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS q_mz, CAST(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 7 AS FLOAT) AS intensity FROM orders)",
    "genomes": "genomes AS (SELECT s_suppkey AS genome_id, 'acc_' || s_suppkey AS accession FROM supplier)",
    "meta": "meta AS (SELECT s_suppkey AS genome_id, 'acc_' || s_suppkey AS accession, CASE WHEN s_suppkey % 7 <> 0 THEN s_name ELSE 'acc_' || s_suppkey END AS display_name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(n_nationkey AS BIGINT) ELSE 0 END AS taxonomy_id, CASE WHEN s_suppkey % 5 <> 0 THEN 'd__' || r_name || ';p__' || n_name ELSE '' END AS taxonomy, greatest(CAST(trunc(s_acctbal) AS BIGINT), 0) AS gene_count FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "ev": "ev AS (SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'genome' WHEN 'view' THEN 'indexStart' WHEN 'purchase' THEN 'metaStart' ELSE 'done' END AS stage, event_id AS genomes, CAST(floor(value * 100) AS BIGINT) AS peaks FROM events)",
    "lines": r"""lines AS (SELECT 'orders' AS src, o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN w || '.25 ' || p WHEN 1 THEN w || ',' || p || '.5' WHEN 2 THEN '# ' || w WHEN 3 THEN 'COM=' || w
 WHEN 4 THEN ' ' || chr(9) || w || '  ' WHEN 5 THEN w || ' x 3' WHEN 6 THEN w || 'e-1' || chr(9) || '.5 9 9' ELSE 'BEGIN ' || w END AS line
 FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS w, substr(o_orderpriority, 1, 1) AS p FROM orders) UNION ALL SELECT 'documents', doc_id, unnest(string_split(text, chr(10))) FROM documents)""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
