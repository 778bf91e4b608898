"""The jobs as queries, each with DuckDB SQL for its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumispec.functions.peaks import NUMBER
from lumispec.plans import adapter as A
from lumispec.plans import queries as Q
from lumispec.schemas import COARSE_LIMIT, PPM, TOP_RESULTS

from .identify_run import UNCLASSIFIED, job1_identify_run
from .text_intake import job2_text_intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_identify_run": job1_identify_run, "job2_text_intake": job2_text_intake}

_WHITE = Q.RE2
_LINES = rf"""{A.with_views('lines')}, raw AS (SELECT 'documents' AS source, doc_id AS id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM documents UNION ALL SELECT src, id, [line] FROM lines WHERE src = 'orders'),
l AS (SELECT source, id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no FROM raw),
t AS (SELECT source, id, line_no, regexp_replace(line, '^[{_WHITE}]+', '') AS s, list_filter(regexp_split_to_array(regexp_replace(line, '^[{_WHITE},]+|[{_WHITE},]+$', '', 'g'), '[{_WHITE},]+'), lambda x : x <> '') AS a FROM l),
n AS (SELECT *, CASE WHEN regexp_matches(a[1], '{NUMBER}') THEN TRY_CAST(a[1] AS DOUBLE) END AS mz, CASE WHEN len(a) < 2 THEN CAST(1 AS DOUBLE) WHEN regexp_matches(a[2], '{NUMBER}') THEN TRY_CAST(a[2] AS DOUBLE) END AS i FROM t),
k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN starts_with(s, '#') THEN 'comment' WHEN starts_with(s, 'COM=') THEN 'title' WHEN mz IS NULL THEN 'no_mz' WHEN i IS NULL THEN 'no_intensity'
 WHEN isnan(mz) OR isinf(mz) OR mz < 0 OR mz * 1000 + 0.5 >= 4294967296 OR isnan(i) OR i < 0 OR i > 3.4028234663852886e38 THEN 'out_of_range' ELSE 'peak' END AS kind FROM n)
SELECT source, id, line_no, kind, CASE WHEN kind = 'peak' THEN CAST(floor(mz * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS milli_mz, CASE WHEN kind = 'peak' THEN CAST(i AS FLOAT) END AS intensity FROM k"""

ORACLE_SQL: dict[str, str] = {
    "job1_identify_run": f"""{A.with_views('lib0', 'q', 'meta')}, {Q.hits_sql()}, {Q.candidates_sql(COARSE_LIMIT)}, {Q.ranked_sql(PPM)}
SELECT query_id, rank, genome_id, accession, display_name, taxonomy, score, matched_ribosomal, matched_total, CASE WHEN taxonomy = '' THEN '{UNCLASSIFIED}' ELSE regexp_extract(taxonomy, '^d__([^;]+)', 1) END AS domain FROM ranked JOIN meta USING (genome_id) WHERE rank <= {TOP_RESULTS}""",
    "job2_text_intake": _LINES,
}
