"""Queries of the spectral operators over the adapter's views, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions.peaks import NUMBER, SPACE, parse_peak_line
from ..operators import layout
from ..operators import library as L
from ..operators import progress as P
from ..operators import search as S
from ..operators import validate as V
from ..schemas import BIN_WIDTH, COARSE_LIMIT, PPM
from ..shared import new_folder
from ..sources import export as X
from ..sources.spectra import numbered_lines, parse_files, parse_lines, text_lines
from . import adapter as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Genome events closer than this to the last one emitted are held back.
INTERVAL_US = 3 * 24 * 3600 * 1_000_000


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def hits_sql(width: int = BIN_WIDTH) -> str:
    return f"hits AS (SELECT query_id, genome_id, count(*) AS hit_count FROM q JOIN lib0 ON q_mz // {width} = milli_mz // {width} GROUP BY query_id, genome_id)"


def candidates_sql(limit: int | None) -> str:
    if limit is None:
        return "cand AS (SELECT * FROM hits)"
    return f"cand AS (SELECT query_id, genome_id, hit_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, genome_id) AS r FROM hits) WHERE r <= {limit})"


def ranked_sql(ppm: int) -> str:
    return f"""best AS (SELECT c.query_id, c.genome_id, q.ord, q.intensity, min(abs(q_mz - milli_mz) * 1000000 // nullif(q_mz, 0)) AS d
 FROM cand c JOIN q USING (query_id) JOIN lib0 l ON l.genome_id = c.genome_id AND l.milli_mz >= q_mz - (q_mz * {ppm}) // 1000000 AND l.milli_mz <= q_mz + (q_mz * {ppm + 1} - 1) // 1000000
 WHERE q_mz > 0 GROUP BY c.query_id, c.genome_id, q.ord, q.intensity),
fold AS (SELECT query_id, genome_id, count(*) AS matched_total, list_reduce(list_prepend(CAST(0 AS FLOAT), list(CAST(intensity * CAST(CAST(1 AS FLOAT) - CAST(CAST(d AS FLOAT) / CAST({ppm} AS FLOAT) AS FLOAT) AS FLOAT) AS FLOAT) ORDER BY ord)), lambda a, x : CAST(a + x AS FLOAT)) AS score FROM best GROUP BY query_id, genome_id),
res AS (SELECT c.query_id, c.genome_id, coalesce(score, CAST(0 AS FLOAT)) AS score, CAST(hit_count AS BIGINT) AS matched_ribosomal, CAST(coalesce(matched_total, 0) AS BIGINT) AS matched_total FROM cand c LEFT JOIN fold f ON f.query_id = c.query_id AND f.genome_id = c.genome_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched_total DESC, genome_id) AS BIGINT) AS rank FROM res)"""


def _identify(limit: int | None, ppm: int = PPM, where: str = "") -> str:
    return f"{A.with_views('lib0', 'q')}, {hits_sql()}, {candidates_sql(limit)}, {ranked_sql(ppm)} SELECT query_id, genome_id, score, matched_ribosomal, matched_total, rank FROM ranked {where}"


@query(_identify(COARSE_LIMIT))
def identify_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse search, top candidates, rerank and ranking of all queries."""
    return S.identify(A.library(spark, sf_dir), A.queries(spark, sf_dir))


@query(f"{A.with_views('lib0', 'q')}, {hits_sql()} SELECT query_id, genome_id, CAST(hit_count AS BIGINT) AS hit_count FROM hits")
def coarse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coarse_hits(A.library(spark, sf_dir), A.queries(spark, sf_dir))


@query(f"{A.with_views('lib0', 'q')}, {hits_sql()}, {candidates_sql(COARSE_LIMIT)} SELECT query_id, genome_id, CAST(hit_count AS BIGINT) AS hit_count FROM cand")
def coarse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coarse_candidates(A.library(spark, sf_dir), A.queries(spark, sf_dir), COARSE_LIMIT)


@query(f"{A.with_views('lib0', 'q')}, {hits_sql()}, {candidates_sql(1)} SELECT query_id, genome_id, CAST(hit_count AS BIGINT) AS hit_count FROM cand")
def coarse_limit_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coarse_candidates(A.library(spark, sf_dir), A.queries(spark, sf_dir), 1)


@query(_identify(None))
def rerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coarse hits reranked."""
    return S.identify(A.library(spark, sf_dir), A.queries(spark, sf_dir), None)


@query(_identify(COARSE_LIMIT, where="WHERE matched_total = 0"))
def rerank_zero_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a peak in any ppm window: they stay, with score 0."""
    return identify_flagship(spark, sf_dir).where("matched_total = 0")


_EDGES = f"q_mz - (q_mz * {PPM}) // 1000000 AS low, q_mz + (q_mz * {PPM + 1} - 1) // 1000000 AS high"


@query(f"{A.with_views('q')}, e AS (SELECT query_id, ord, q_mz, {_EDGES} FROM q) SELECT *, abs(q_mz - low) * 1000000 // nullif(q_mz, 0) AS low_ppm, abs(q_mz - high) * 1000000 // nullif(q_mz, 0) AS high_ppm, abs(q_mz - (high + 1)) * 1000000 // nullif(q_mz, 0) > {PPM} AS beyond FROM e")
def ppm_window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last peaks within each query peak's window, and whether the next one lies beyond."""
    low, high = E.ppm_bounds("q_mz", PPM)
    rows = A.queries(spark, sf_dir).select("query_id", "ord", F.col("milli_mz").alias("q_mz")).withColumns({"low": low, "high": high})
    return rows.withColumns({"low_ppm": E.ppm_distance("q_mz", "low"), "high_ppm": E.ppm_distance("q_mz", "high"), "beyond": E.ppm_distance("q_mz", "(high + 1)") > PPM})


def _sweep_sql() -> str:
    parts = []
    for ppm in (5, 50, 500):
        renamed = ranked_sql(ppm)
        for name in ("best", "fold", "res", "ranked"):
            renamed = renamed.replace(f"{name} AS (SELECT", f"{name}{ppm} AS (SELECT").replace(f"FROM {name} ", f"FROM {name}{ppm} ").replace(f"JOIN {name} ", f"JOIN {name}{ppm} ").replace(f"FROM {name})", f"FROM {name}{ppm})")
        parts.append(renamed)
    union = " UNION ALL ".join(f"SELECT {p} AS ppm, query_id, genome_id, score, matched_ribosomal, matched_total, rank FROM ranked{p}" for p in (5, 50, 500))
    return f"{A.with_views('lib0', 'q')}, {hits_sql()}, {candidates_sql(COARSE_LIMIT)}, {', '.join(parts)} {union}"


@query(_sweep_sql())
def ppm_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship under three tolerances."""
    return S.ppm_sweep(A.library(spark, sf_dir), A.queries(spark, sf_dir), [5, 50, 500])


_WIDTHS = (50, 100, 1000)


@query(f"{A.with_views('lib0', 'q')} " + " UNION ALL ".join(f"SELECT {w} AS bin_width, query_id, genome_id, CAST(hit_count AS BIGINT) AS hit_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, genome_id) AS r FROM (SELECT query_id, genome_id, count(*) AS hit_count FROM q JOIN lib0 ON q_mz // {w} = milli_mz // {w} GROUP BY query_id, genome_id)) WHERE r <= {COARSE_LIMIT}" for w in _WIDTHS))
def bin_width_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coarse_sweep(A.library(spark, sf_dir), A.queries(spark, sf_dir), list(_WIDTHS), COARSE_LIMIT)


@query(f"{A.with_views('lib0', 'peaks')} SELECT milli_mz // {BIN_WIDTH} AS bin_id, genome_id, local_peak_idx FROM peaks")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.postings(A.peaks(spark, sf_dir))


@query(f"{A.with_views('lib0')} SELECT milli_mz // {BIN_WIDTH} AS bin_id, count(*) AS peak_count FROM lib0 GROUP BY 1")
def bin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bin_histogram(A.library(spark, sf_dir))


@query(f"{A.with_views('lib0')}, h AS (SELECT milli_mz // {BIN_WIDTH} AS b, count(*) AS n FROM lib0 GROUP BY 1), d AS (SELECT unnest(range((SELECT max(b) FROM h) + 2)) AS bin_id) SELECT bin_id, CAST(sum(coalesce(n, 0)) OVER (ORDER BY bin_id) - coalesce(n, 0) AS BIGINT) AS \"offset\" FROM d LEFT JOIN h ON b = bin_id")
def bin_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bin_offsets(A.library(spark, sf_dir))


@query(f"{A.with_views('lib0', 'genomes')}, c AS (SELECT g.genome_id, count(l.genome_id) AS n FROM genomes g LEFT JOIN lib0 l USING (genome_id) GROUP BY 1) SELECT genome_id, n AS total_peaks, CAST(sum(n) OVER (ORDER BY genome_id) - n AS BIGINT) AS start_offset, CAST(sum(n) OVER (ORDER BY genome_id) AS BIGINT) AS end_offset FROM c")
def genome_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.genome_offsets(A.library(spark, sf_dir), A.genomes(spark, sf_dir))


@query(f"{A.with_views('lib0')} SELECT (SELECT count(*) FROM supplier) AS genome_count, count(*) AS total_peak_count, coalesce(max(milli_mz // {BIN_WIDTH}) + 1, 1) AS bin_count FROM lib0")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build_report(A.library(spark, sf_dir), A.genomes(spark, sf_dir))


@query(f"{A.with_views('lib0')} SELECT genome_id, milli_mz, milli_mz // {BIN_WIDTH} AS bin_id, l_orderkey, l_linenumber FROM lib0")
def encode_mz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("genome_id"), E.encode_mz(F.col("l_extendedprice") / 10).alias("milli_mz"), "l_orderkey", "l_linenumber")
    return rows.withColumn("bin_id", E.bin_id("milli_mz", BIN_WIDTH))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.enrich(A.genomes(spark, sf_dir), *A.metadata(spark, sf_dir))


@query(f"{A.with_views('meta')} SELECT * FROM meta")
def metadata_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir)


def _dictionary_sql(column: str) -> str:
    return f"{A.with_views('meta')}, f AS (SELECT {column} AS value, min(genome_id) AS g FROM meta WHERE {column} <> '' GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY g, value) AS BIGINT) AS dict_id, value FROM f UNION ALL SELECT 0, ''"


@query(_dictionary_sql("display_name"))
def name_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dictionary(_enriched(spark, sf_dir), "display_name", "genome_id")


@query(_dictionary_sql("taxonomy"))
def taxonomy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dictionary(_enriched(spark, sf_dir), "taxonomy", "genome_id")


def _csv(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[,\"\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


@query(f"{A.with_views('lib0', 'meta')}, c AS (SELECT genome_id, count(*) AS n FROM lib0 GROUP BY 1) SELECT genome_id, genome_id || ',' || {_csv('display_name')} || ',' || {_csv('taxonomy')} || ',' || coalesce(n, 0) || ',' || gene_count AS line FROM meta LEFT JOIN c USING (genome_id)")
def csv_database_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = genome_offsets(spark, sf_dir).select("genome_id", "total_peaks")
    return X.genome_lines(_enriched(spark, sf_dir).join(sizes, "genome_id"))


_FILE = "'q' || query_id || CASE query_id % 3 WHEN 0 THEN ',a.txt' WHEN 1 THEN ' \"b\".mgf' ELSE '.txt' END"


@query(f"{A.with_views('lib0', 'q')}, {hits_sql()}, {candidates_sql(COARSE_LIMIT)}, {ranked_sql(PPM)}, f AS (SELECT *, {_FILE} AS query_file FROM ranked) SELECT query_id, rank, {_csv('query_file')} || ',' || genome_id || ',' || printf('%.6f', CAST(score AS DOUBLE)) || ',' || matched_ribosomal || ',' || matched_total AS line FROM f")
def csv_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("query_id") % 3
    file = F.concat(F.lit("/data/q"), F.col("query_id").cast("string"), F.when(kind == 0, ",a.txt").when(kind == 1, ' "b".mgf').otherwise(".txt"))
    return X.result_lines(identify_flagship(spark, sf_dir).withColumn("query_file", E.basename(file)))


RE2 = SPACE.replace("\\x0B", "\\x{0B}")


@query(
    rf"""{A.with_views('lines')}, t AS (SELECT src, id, line, regexp_replace(line, '^[{RE2}]+|[{RE2}]+$', '', 'g') AS s FROM lines),
f AS (SELECT *, list_filter(regexp_split_to_array(s, '[{RE2},]+'), lambda x : x <> '') AS a FROM t WHERE s <> '' AND NOT starts_with(s, '#') AND NOT starts_with(s, 'COM='))
SELECT src, id, CAST(a[1] AS DOUBLE) AS mz, CASE WHEN len(a) > 1 THEN TRY_CAST(a[2] AS DOUBLE) ELSE 1.0::DOUBLE END AS intensity FROM f
WHERE regexp_matches(a[1], '{NUMBER}') AND (len(a) = 1 OR regexp_matches(a[2], '{NUMBER}'))"""
)
def parse_peak_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.array_compact(F.array(parse_peak_line("line"))))  # parsed once for filter and columns
    return A.lines(spark, sf_dir).select("src", "id", found.alias("peak")).select("src", "id", "peak.*")


@query("SELECT p_partkey, regexp_replace(p_name || '/' || p_brand || ':' || p_type || '.db', '[^A-Za-z0-9._-]', '_', 'g') AS name FROM part")
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("/"), "p_brand", F.lit(":"), "p_type", F.lit(".db"))
    return A.table(spark, sf_dir, "part").select("p_partkey", E.sanitize_filename(name).alias("name"))


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with faults of each kind, so that the rules have something to count."""
    rows = L.postings(A.peaks(spark, sf_dir))
    return rows.select(
        (F.col("bin_id") + F.when(F.col("local_peak_idx") % 101 == 7, 1).otherwise(0)).alias("bin_id"),
        (F.col("genome_id") + F.when(F.col("local_peak_idx") % 97 == 5, 1_000_000).otherwise(0)).alias("genome_id"),
        (F.col("local_peak_idx") + F.when(F.col("local_peak_idx") % 89 == 3, 100_000).otherwise(0)).alias("local_peak_idx"),
    )


_TAMPERED = A.with_views("lib0", "peaks", "genomes") + f", post AS (SELECT milli_mz // {BIN_WIDTH} + CASE WHEN local_peak_idx % 101 = 7 THEN 1 ELSE 0 END AS bin_id, genome_id + CASE WHEN local_peak_idx % 97 = 5 THEN 1000000 ELSE 0 END AS genome_id, local_peak_idx + CASE WHEN local_peak_idx % 89 = 3 THEN 100000 ELSE 0 END AS local_peak_idx FROM peaks), sz AS (SELECT genome_id, count(*) AS n FROM peaks GROUP BY 1)"


@query(f"{_TAMPERED} SELECT 'genome_bound' AS rule, count(*) AS violations FROM post WHERE genome_id NOT IN (SELECT genome_id FROM genomes)")
def invariant_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.genome_bound(_tampered(spark, sf_dir), A.genomes(spark, sf_dir))


@query(f"{_TAMPERED} SELECT 'local_index_bound' AS rule, count(*) AS violations FROM post JOIN sz USING (genome_id) WHERE local_peak_idx < 0 OR local_peak_idx >= n")
def invariant_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.local_index_bound(_tampered(spark, sf_dir), A.peaks(spark, sf_dir))


@query(f"{_TAMPERED}, o AS (SELECT genome_id, sum(n) OVER (ORDER BY genome_id) - n AS s FROM sz) SELECT 'global_index_bound' AS rule, count(*) AS violations FROM post JOIN o USING (genome_id) WHERE s + local_peak_idx >= (SELECT count(*) FROM peaks)")
def invariant_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = A.library(spark, sf_dir)
    return V.global_index_bound(_tampered(spark, sf_dir), L.genome_offsets(library, A.genomes(spark, sf_dir)), library.count())


@query(f"{_TAMPERED} SELECT 'bin_consistency' AS rule, count(*) AS violations FROM post JOIN peaks USING (genome_id, local_peak_idx) WHERE bin_id <> milli_mz // {BIN_WIDTH}")
def invariant_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bin_consistency(_tampered(spark, sf_dir), A.peaks(spark, sf_dir), BIN_WIDTH)


@query(f"{_TAMPERED}, c AS (SELECT genome_id, local_peak_idx, count(*) AS n FROM post GROUP BY ALL) SELECT 'coverage' AS rule, count(*) AS violations FROM peaks p FULL JOIN c ON p.genome_id = c.genome_id AND p.local_peak_idx = c.local_peak_idx WHERE p.genome_id IS NULL OR c.n IS NULL OR c.n <> 1")
def invariant_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.coverage(_tampered(spark, sf_dir), A.peaks(spark, sf_dir))


@query(
    f"""{A.with_views('ev')}, g AS (SELECT run_id, seq, epoch_us(ts) AS us FROM ev WHERE stage = 'genome'),
nxt AS (SELECT a.run_id, a.us, min({{'us': b.us, 'seq': b.seq}}) AS after FROM (SELECT DISTINCT run_id, us FROM g) a JOIN g b ON a.run_id = b.run_id AND b.us >= a.us + {INTERVAL_US} GROUP BY 1, 2),
walk AS (SELECT run_id, min({{'us': us, 'seq': seq}}) AS x FROM g GROUP BY 1 UNION ALL SELECT w.run_id, n.after FROM walk w JOIN nxt n ON n.run_id = w.run_id AND n.us = w.x.us)
SELECT run_id, seq, stage FROM ev WHERE stage <> 'genome' UNION ALL SELECT run_id, x.seq, 'genome' FROM walk"""
)
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.throttle(A.events(spark, sf_dir), INTERVAL_US).select("run_id", "seq", "stage")


def _carried(name: str) -> str:
    return f"coalesce(last_value(CASE WHEN stage = 'start' THEN 0 WHEN stage IN ('genome', 'done') THEN {name} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS {name}_processed"


@query(f"{A.with_views('ev')} SELECT run_id, seq, stage, {_carried('genomes')}, {_carried('peaks')} FROM ev")
def progress_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reduce_status(A.events(spark, sf_dir))


def _streamed(spark: SparkSession, sf_dir: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a fold of a stream of the events writes: they are stored shuffled, with one event of no run a day after the last, which lets all out."""
    path = new_folder(spark, "lumispec-events")
    events = A.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("long")
    end = events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(none.alias("run_id"), none.alias("seq"), "ts", F.lit("start").alias("stage"), none.alias("genomes"), none.alias("peaks"))
    events.repartition(4, F.xxhash64("seq")).unionByName(end).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    query = fold(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").where("run_id is not null")


@query(ORACLE_SQL["progress_throttle"])
def progress_throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throttling of a stream of shuffled events."""
    return _streamed(spark, sf_dir, lambda events: P.throttle_late_stream(events, INTERVAL_US, "1 hour"))


@query(ORACLE_SQL["progress_reduce"])
def progress_reduce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status after each event of a stream of shuffled events."""
    return _streamed(spark, sf_dir, lambda events: P.reduce_stream(events, "1 hour"))


def _first(stage: str) -> str:
    return f"min(epoch_us(ts)) FILTER (WHERE stage = '{stage}')"


@query(f"{A.with_views('ev')} SELECT run_id, {_first('indexStart')} - {_first('start')} AS decode_us, {_first('metaStart')} - {_first('indexStart')} AS index_us, {_first('done')} - {_first('start')} AS total_us FROM ev GROUP BY run_id")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stage_durations(A.events(spark, sf_dir))


#: Messages to classify, one for each remainder of the supplier's key. Fixed values.
MESSAGES = ["header Magic mismatch", "mass index is too small", "failed to open header", "Permission denied", "missing required all.db", "cannot decode names pickle", "stream all.db: bad opcode", "disk full"]
_MESSAGE_SQL = "CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"


def _kind_sql(kinds: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{k}'" for k, p in kinds) + " ELSE 'other' END"


@query(f"SELECT s_suppkey, {_kind_sql(E.DATABASE_ERRORS)} AS database_error, {_kind_sql(E.BUILD_ERRORS)} AS build_error FROM (SELECT s_suppkey, {_MESSAGE_SQL} AS m FROM supplier)")
def error_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("s_suppkey") % len(MESSAGES) + 1).cast("int"))
    rows = A.table(spark, sf_dir, "supplier").select("s_suppkey", message.alias("m"))
    return rows.select("s_suppkey", E.classify_error("m", E.DATABASE_ERRORS).alias("database_error"), E.classify_error("m", E.BUILD_ERRORS).alias("build_error"))


@query(f"{A.with_views('lib0', 'peaks')} SELECT milli_mz // {BIN_WIDTH} AS bin_id, genome_id, local_peak_idx FROM peaks WHERE milli_mz // {BIN_WIDTH} = (SELECT any_value(milli_mz) FROM peaks WHERE genome_id = 3 AND local_peak_idx = 0) // {BIN_WIDTH}")
def postings_of_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings in the bin of one m/z, that of a genome's first peak."""
    peaks = A.peaks(spark, sf_dir)
    one = L.lookup_peaks(peaks, 3).where("local_peak_idx = 0").first()
    return L.lookup_postings(L.postings(peaks), one.milli_mz, BIN_WIDTH)


@query(f"{A.with_views('lib0', 'peaks')} SELECT local_peak_idx, milli_mz FROM peaks WHERE genome_id = 3")
def peaks_of_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lookup_peaks(A.peaks(spark, sf_dir), 3)


@query(f"{A.with_views('meta')} SELECT * FROM meta WHERE genome_id = 3")
def metadata_of_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).where("genome_id = 3")


@query(f"{A.with_views('meta')} SELECT genome_id, display_name, taxonomy FROM meta")
def dictionary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and taxonomy by way of their dictionary ids."""
    rows = _enriched(spark, sf_dir)
    out = rows.select("genome_id")
    for column in ("display_name", "taxonomy"):
        entries = L.dictionary(rows, column, "genome_id")
        ids = rows.select("genome_id", F.col(column).alias("value")).join(entries, "value").select("genome_id", "dict_id")
        out = out.join(ids.join(entries, "dict_id").select("genome_id", F.col("value").alias(column)), "genome_id")
    return out


@query(f"{A.with_views('meta')} SELECT * FROM meta WHERE genome_id % 7 <> 0 AND genome_id % 5 <> 0")
def metadata_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment that no genome's metadata may be missing from, of those that have all."""
    return L.enrich(A.genomes(spark, sf_dir).where("genome_id % 7 != 0 and genome_id % 5 != 0"), *A.metadata(spark, sf_dir), strict=True)


@query(f"{A.with_views('genomes')} SELECT genome_id, accession, 'name' AS lacks FROM genomes WHERE genome_id % 7 = 0 UNION ALL SELECT genome_id, accession, 'taxonomy' FROM genomes WHERE genome_id % 5 = 0")
def metadata_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict enrichment of all genomes would refuse."""
    return L.missing_metadata(A.genomes(spark, sf_dir), *A.metadata(spark, sf_dir))


@query(f"{A.with_views('lib0', 'genomes')}, c AS (SELECT accession, count(l.genome_id) AS n FROM genomes g LEFT JOIN lib0 l USING (genome_id) GROUP BY 1) SELECT row_number() OVER (ORDER BY accession) - 1 AS genome_id, accession, n AS total_peaks FROM c")
def accession_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes numbered by accession, those without peaks too."""
    return L.numbered(A.source(spark, sf_dir), "accession").select("genome_id", "accession", F.size("peaks").cast("long").alias("total_peaks"))


@query(f"{A.with_views('lib0', 'genomes')}, p AS (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY l_orderkey, l_linenumber, milli_mz) - 1 AS local_peak_idx FROM lib0) SELECT genome_id, accession, local_peak_idx, milli_mz FROM p JOIN genomes USING (genome_id)")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of genomes numbered as they come, and in their lists' order."""
    return L.peaks_of(A.source(spark, sf_dir))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_acctbal AS FLOAT) END AS intensity, CASE WHEN s_acctbal < 0 OR s_acctbal * 1000000 + 0.5 >= 4294967296 THEN NULL ELSE CAST(floor(CAST(s_acctbal * 1000 AS DOUBLE) * 1000 + 0.5) AS BIGINT) END AS milli_mz FROM supplier")
def encode_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensities and m/z, null where they are out of range."""
    value = F.col("s_acctbal")
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", E.encode_intensity(value, False).alias("intensity"), E.encode_mz(value * 1000, False).alias("milli_mz"))


@query("SELECT s_suppkey, greatest(CAST(trunc(s_acctbal) AS BIGINT), 0) AS gene_count, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE greatest(s_nationkey - 5, 0) END AS BIGINT) AS taxonomy_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS taxonomy FROM supplier")
def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative counts and ids, and what is missing, as their defaults."""
    id_, text = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") - 5), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name"))
    tax = E.normalise_taxonomy(id_, text)
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", E.clamp_gene_count("s_acctbal").alias("gene_count"), tax["id"].alias("taxonomy_id"), tax["text"].alias("taxonomy"))


@query("SELECT o_orderkey, printf('%.2f', CAST(floor(o_custkey / 8 * 100 + 0.5) / 100 AS DOUBLE)) AS score, regexp_replace(reverse(regexp_replace(reverse(CAST(o_orderkey * 1000 AS VARCHAR)), '([0-9]{3})', '\\1,', 'g')), '^,', '') AS peaks, printf('%.2f', CAST(o_custkey / 4 AS DOUBLE)) || ' s' AS duration FROM orders")
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores (halves up), counts and durations as they are shown."""
    rows = A.table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", E.score_text(F.col("o_custkey") / 8).alias("score"), E.count_text(F.col("o_orderkey") * 1000).alias("peaks"), E.seconds_text(F.col("o_custkey") * 250_000).alias("duration"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || '.mgf' WHEN 1 THEN '///' WHEN 2 THEN 'x' || s_suppkey ELSE 'b' END AS name FROM supplier")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    path = F.when(key % 4 == 0, F.concat(F.lit("/data/"), "s_name", F.lit(".mgf"))).when(key % 4 == 1, "///").when(key % 4 == 2, F.concat(F.lit("x"), key.cast("string"))).otherwise("a//b/")
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", E.basename(path).alias("name"))


_FILES_SQL = "parsed AS (SELECT o_custkey AS query_id, 'q' || o_custkey || '.mgf' AS query_file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, CAST(floor(CAST(printf('%.4f', CAST(o_totalprice AS DOUBLE) / 50) AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS q_mz, CAST(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS FLOAT) AS intensity FROM orders)"


@query(f"{A.with_views('lib0')}, {_FILES_SQL} SELECT query_id, query_file, ord, q_mz AS milli_mz, intensity FROM parsed")
def parse_query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks of whole query files, with titles, comments and junk between them."""
    return parse_files(A.files(spark, sf_dir))


@query(f"{A.with_views('lib0')}, {_FILES_SQL}, q AS (SELECT * FROM parsed), {hits_sql()}, {candidates_sql(COARSE_LIMIT)}, {ranked_sql(PPM)} SELECT DISTINCT r.query_id, query_file, genome_id, score, matched_ribosomal, matched_total, rank FROM ranked r JOIN parsed USING (query_id) WHERE rank <= 3")
def identify_query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best results of each query file, from its text."""
    files = A.files(spark, sf_dir)
    found = S.identify(A.library(spark, sf_dir), parse_files(files), top=3)
    return found.join(files.select("query_id", "query_file"), "query_id")  # names of files, whose texts needn't be parsed again


@query(f"{_identify(COARSE_LIMIT).rpartition(' SELECT ')[0]} SELECT count(DISTINCT query_id) AS queries, count(*) AS results, CAST(sum(matched_total) AS BIGINT) AS matched FROM ranked")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch has come to: queries with results, results, and matched peaks."""
    return S.totals(identify_flagship(spark, sf_dir))


@query(f"{A.with_views('lib0', 'q')}, {hits_sql()}, {candidates_sql(COARSE_LIMIT)}, asked AS (SELECT query_id, genome_id, hit_count FROM cand UNION ALL SELECT query_id, genome_id + 1000000, hit_count FROM cand) SELECT query_id, genome_id FROM asked WHERE genome_id IN (SELECT genome_id FROM lib0)")
def known_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of genomes that the library hasn't got are dropped by the rerank."""
    library, queries = A.library(spark, sf_dir), A.queries(spark, sf_dir)
    packed = S.packed_library(library)
    found = S.coarse_candidates(library, queries, packed=packed)
    asked = found.select("query_id", F.explode(F.array("genome_id", F.col("genome_id") + 1_000_000)).alias("genome_id"), "hit_count")
    return S.rerank(asked, library, queries, genomes=A.genomes(spark, sf_dir), packed=packed).select("query_id", "genome_id")


@query(f"""{A.with_views('lib0', 'genomes')}, r AS (SELECT genome_id, row_number() OVER (ORDER BY genome_id) AS n, least(5, count(*) OVER ()) AS total FROM genomes QUALIFY n <= 5),
p AS (SELECT l_suppkey AS genome_id, string_agg(printf('%.4f 1.0', CAST(l_extendedprice AS DOUBLE) / 10), chr(10) ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rows FROM lineitem GROUP BY 1)
SELECT printf('%02d', n) || '-acc_' || genome_id || CASE WHEN n = total THEN '.mgf' ELSE '.txt' END AS name, CASE WHEN n = total THEN 'BEGIN IONS' || chr(10) || 'TITLE=acc_' || genome_id || chr(10) || 'COM=acc_' || genome_id || chr(10) || coalesce(rows, '') || chr(10) || 'END IONS' || chr(10)
 ELSE 'COM=acc_' || genome_id || chr(10) || '# generated from all.db' || chr(10) || coalesce(rows, '') || chr(10) END AS content FROM r LEFT JOIN p USING (genome_id)""")
def sample_query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query files of the first five genomes, the last of them in MGF."""
    return X.sample_queries(A.source(spark, sf_dir), 5)


def _edges_sql(rule: str) -> str:
    """The four rules of offsets o (id, pos) of `total` rows."""
    return f"""n AS (SELECT id, pos, lead(id) OVER w AS nid, lead(pos) OVER w AS npos FROM o WINDOW w AS (ORDER BY id)), e AS (SELECT min(id) AS low, arg_min(pos, id) AS first, arg_max(pos, id) AS last FROM o)
SELECT '{rule}_first' AS rule, CAST(CASE WHEN first <> 0 OR low <> 0 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM e UNION ALL SELECT '{rule}_last', CAST(CASE WHEN last <> (SELECT count(*) FROM lib0) THEN 1 ELSE 0 END AS BIGINT) FROM e
UNION ALL SELECT '{rule}_gap', count(*) FROM n WHERE nid <> id + 1 UNION ALL SELECT '{rule}_fall', count(*) FROM n WHERE npos < pos"""


def _tampered_offsets(offsets: DataFrame, id_: str, offset: str) -> DataFrame:
    """Offsets with faults of each kind: some fall, some are missing, and all begin one too late."""
    fallen = F.col(offset) + 1 - F.when(F.col(id_) % 11 == 4, 1_000_000).otherwise(0)
    return offsets.where(F.col(id_) % 13 != 5).select(id_, fallen.alias(offset))


_FAULTS = "o AS (SELECT id, CASE WHEN id % 11 = 4 THEN pos + 1 - 1000000 ELSE pos + 1 END AS pos FROM o0 WHERE id % 13 <> 5)"


@query(f"{A.with_views('lib0')}, h AS (SELECT milli_mz // {BIN_WIDTH} AS b, count(*) AS n FROM lib0 GROUP BY 1), d AS (SELECT unnest(range((SELECT max(b) FROM h) + 2)) AS id), o0 AS (SELECT id, sum(coalesce(n, 0)) OVER (ORDER BY id) - coalesce(n, 0) AS pos FROM d LEFT JOIN h ON b = id), {_FAULTS}, {_edges_sql('bin_offsets')}")
def invariant_bin_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a bin table with faults."""
    library = A.library(spark, sf_dir)
    return V.offset_edges(_tampered_offsets(L.bin_offsets(library), "bin_id", "offset"), "bin_id", "offset", library.count(), "bin_offsets")


@query(f"{A.with_views('lib0', 'genomes')}, c AS (SELECT g.genome_id AS id, count(l.genome_id) AS n FROM genomes g LEFT JOIN lib0 l USING (genome_id) GROUP BY 1), o0 AS (SELECT id, sum(n) OVER (ORDER BY id) - n AS pos FROM c), {_FAULTS}, {_edges_sql('genome_offsets')}")
def invariant_genome_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a genome table with faults."""
    library = A.library(spark, sf_dir)
    offsets = L.genome_offsets(library, A.genomes(spark, sf_dir))
    return V.offset_edges(_tampered_offsets(offsets, "genome_id", "start_offset"), "genome_id", "start_offset", library.count(), "genome_offsets")


@query(f"{A.with_views('lib0')}, h AS (SELECT milli_mz // {BIN_WIDTH} AS b, count(*) AS n FROM lib0 GROUP BY 1) SELECT 'bin_offsets_agree' AS rule, count(*) AS violations FROM h WHERE b % 17 = 3")
def invariant_offsets_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins whose stored offsets don't fit an index that lacks the postings of some bins."""
    library = A.library(spark, sf_dir)
    lacking = L.bin_histogram(library).where("bin_id % 17 != 3")
    return V.offsets_agree(L.bin_offsets(library), "bin_id", "offset", lacking, "peak_count", "bin_offsets_agree")


def _dictionary_rule_sql(column: str) -> str:
    inner = _dictionary_sql(column)
    head, _, rest = inner.partition(", f AS ")
    f, _, tail = rest.partition(" SELECT CAST(row_number()")
    entries = f"d AS (SELECT CAST(row_number(){tail})"
    return f"{head}, f AS {f}, {entries}, used AS (SELECT dict_id + CASE WHEN genome_id % 13 = 2 THEN 1000000 ELSE 0 END AS id FROM meta JOIN d ON d.value = meta.{column}) SELECT '{column}_ids' AS rule, count(*) AS violations FROM used WHERE id NOT IN (SELECT dict_id FROM d)"


def _dictionary_rule(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    rows = _enriched(spark, sf_dir)
    entries = L.dictionary(rows, column, "genome_id")
    used = rows.join(entries, rows[column] == entries["value"]).select((F.col("dict_id") + F.when(F.col("genome_id") % 13 == 2, 1_000_000).otherwise(0)).alias("id"))
    return V.dictionary_ids(used, "id", entries, f"{column}_ids")


@query(_dictionary_rule_sql("display_name"))
def invariant_name_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary_rule(spark, sf_dir, "display_name")


@query(_dictionary_rule_sql("taxonomy"))
def invariant_taxonomy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary_rule(spark, sf_dir, "taxonomy")


@query("SELECT 'name_utf8' AS rule, count(*) AS violations FROM supplier WHERE s_suppkey % 9 = 1")
def invariant_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that aren't UTF-8, of which every ninth is made one."""
    broken = F.concat(F.col("s_name").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    rows = A.table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 9 == 1, broken).otherwise(F.col("s_name")).alias("name"))
    return V.strings(rows, "name", "name_utf8")


@query(f"""{_TAMPERED}, claim AS (SELECT (SELECT count(*) FROM customer) AS genomes, (SELECT count(*) FROM orders) AS peaks, (SELECT max(milli_mz) // {BIN_WIDTH} + 1 FROM lib0) AS bins),
kept AS (SELECT * FROM post WHERE genome_id IN (SELECT genome_id FROM genomes))
SELECT 'schema_version' AS rule, CAST(CASE WHEN (SELECT count(*) FROM region) = 1 THEN 0 ELSE 1 END AS BIGINT) AS violations UNION ALL SELECT 'bin_width', CAST(CASE WHEN (SELECT count(*) FROM nation) > 0 THEN 0 ELSE 1 END AS BIGINT) UNION ALL SELECT 'bin_count', CAST(CASE WHEN bins = (SELECT max(milli_mz) // (SELECT count(*) FROM nation) + 1 FROM lib0) THEN 0 ELSE 1 END AS BIGINT) FROM claim
UNION ALL SELECT 'posting_count', CAST(CASE WHEN (SELECT count(*) FROM kept) = (SELECT count(*) FROM lib0) THEN 0 ELSE 1 END AS BIGINT) UNION ALL SELECT 'total_peak_count', CAST(CASE WHEN peaks = (SELECT count(*) FROM lib0) THEN 0 ELSE 1 END AS BIGINT) FROM claim UNION ALL SELECT 'genome_count', CAST(CASE WHEN genomes = (SELECT count(*) FROM genomes) THEN 0 ELSE 1 END AS BIGINT) FROM claim""")
def invariant_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that takes its numbers from other tables, against a library whose index lacks postings."""
    count = lambda name: A.table(spark, sf_dir, name).count()
    peaks, genomes = A.peaks(spark, sf_dir), A.genomes(spark, sf_dir)
    bins = L.build_report(peaks, genomes).first().bin_count
    manifest = {"schema_version": count("region"), "bin_width": count("nation"), "bin_count": bins, "total_peak_count": count("orders"), "genome_count": count("customer")}
    return V.manifest_rules(manifest, peaks, _tampered(spark, sf_dir).join(genomes, "genome_id", "left_semi"), genomes)


def _built(spark: SparkSession, sf_dir: str, order: str = "accession") -> L.Library:
    """A library of the views, built in a new folder of the shared one."""
    return L.build_library(A.source(spark, sf_dir), *A.metadata(spark, sf_dir), new_folder(spark, "lumispec-library"), order=order)


_BUILT = f"""{A.with_views('lib0', 'genomes', 'meta')}, ids AS (SELECT genome_id AS old_id, row_number() OVER (ORDER BY accession) - 1 AS genome_id, accession FROM genomes),
bp AS (SELECT i.genome_id, row_number() OVER (PARTITION BY i.genome_id ORDER BY l_orderkey, l_linenumber, milli_mz) - 1 AS local_peak_idx, milli_mz FROM lib0 JOIN ids i ON i.old_id = lib0.genome_id)"""


@query(f"{_BUILT} SELECT genome_id, accession, local_peak_idx, milli_mz FROM bp JOIN ids USING (genome_id)")
def built_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks of a library that is built in order of accessions and read back, each with its genome's accession."""
    library = _built(spark, sf_dir)
    return library.peaks.join(library.genomes.select("genome_id", "accession"), "genome_id").select("genome_id", "accession", "local_peak_idx", "milli_mz")


@query(f"""{_BUILT}, c AS (SELECT genome_id, count(*) AS n FROM bp GROUP BY 1),
b AS (SELECT i.genome_id, i.accession, display_name, taxonomy, taxonomy_id, gene_count, coalesce(n, 0) AS total_peaks FROM ids i JOIN meta m ON m.genome_id = i.old_id LEFT JOIN c ON c.genome_id = i.genome_id),
dn AS (SELECT display_name, row_number() OVER (ORDER BY g, display_name) AS name_id FROM (SELECT display_name, min(genome_id) AS g FROM b WHERE display_name <> '' GROUP BY 1)),
dt AS (SELECT taxonomy, row_number() OVER (ORDER BY g, taxonomy) AS taxon_id FROM (SELECT taxonomy, min(genome_id) AS g FROM b WHERE taxonomy <> '' GROUP BY 1))
SELECT b.*, coalesce(name_id, 0) AS name_id, coalesce(taxon_id, 0) AS taxon_id, CAST(sum(total_peaks) OVER (ORDER BY genome_id) - total_peaks AS BIGINT) AS start_offset FROM b LEFT JOIN dn USING (display_name) LEFT JOIN dt USING (taxonomy)""")
def built_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genomes of such a library with their dictionary ids and offsets."""
    library = _built(spark, sf_dir)
    return library.genomes.join(library.genome_offsets.select("genome_id", "start_offset"), "genome_id")


@query(f"""{_BUILT}, asked AS (SELECT DISTINCT milli_mz FROM bp WHERE local_peak_idx = 0)
SELECT a.milli_mz, bp.milli_mz // {BIN_WIDTH} AS bin_id, genome_id, local_peak_idx FROM asked a JOIN bp ON bp.milli_mz // {BIN_WIDTH} = a.milli_mz // {BIN_WIDTH}""")
def stored_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings of the bins of all genomes' first peaks, by the index's folders and bins."""
    library = _built(spark, sf_dir)
    return library.postings_of(library.peaks.where("local_peak_idx = 0"))


@query(f"{A.with_views('lib0')} SELECT 'row_order' AS rule, count(*) AS rows, CAST(0 AS BIGINT) AS violations FROM lib0")
def stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored index, and places where they aren't in order, from row to row and from file to file."""
    library = _built(spark, sf_dir, "source")
    return layout.order_faults(spark, f"{library.path}/postings", L.STORED["postings"][0])


_WHOLE = 64


@query(f"SELECT o_custkey % {_WHOLE} AS query_id, 'query_id=' || o_custkey % {_WHOLE} AS query_file, CAST(row_number() OVER (PARTITION BY o_custkey % {_WHOLE} ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, CAST(floor(CAST(printf('%.4f', CAST(o_totalprice AS DOUBLE) / 50) AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS milli_mz, CAST(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS FLOAT) AS intensity FROM orders")
def stored_query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query files that are written as text, a folder each, and read back: their lines come from as many splits as Spark makes of them."""
    line = F.concat(F.format_string("%.4f", F.col("o_totalprice").cast("double") / 50), F.lit(" "), F.substring("o_orderpriority", 1, 1), F.lit("\r"))
    rows = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % _WHOLE).alias("query_id"), "o_orderkey", line.alias("value"))
    path = new_folder(spark, "lumispec-queries")
    rows.repartition("query_id").sortWithinPartitions("query_id", "o_orderkey").select("query_id", "value").write.partitionBy("query_id").option("lineSep", "\n").text(path)
    found = spark.read.schema("value string, query_id long").option("lineSep", "\n").text(path)
    lines = text_lines(found, "query_id").withColumn("query_file", F.concat(F.lit("query_id="), F.col("query_id").cast("string")))
    return parse_lines(lines, lines.select("query_id", "query_file").distinct())


@query(f"{_identify(COARSE_LIMIT).rpartition(' SELECT ')[0]}, l AS (SELECT query_id, rank, 'q' || query_id || ',' || genome_id || ',' || printf('%.6f', CAST(score AS DOUBLE)) || ',' || matched_ribosomal || ',' || matched_total AS line FROM ranked) SELECT CAST(0 AS BIGINT) AS line_no, '{X.RESULTS_HEADER}' AS line UNION ALL SELECT row_number() OVER (ORDER BY query_id, rank), line FROM l")
def csv_result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one written CSV text by their places in it: the header, then all results by query and rank."""
    path = new_folder(spark, "lumispec-csv")
    results = identify_flagship(spark, sf_dir).withColumn("query_file", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    X.write_lines(X.result_lines(results), X.RESULTS_HEADER, ["query_id", "rank"], path)
    return numbered_lines(text_lines(spark.read.option("lineSep", "\n").text(path)))
