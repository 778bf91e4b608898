"""Fixed schemas; unsigned 32- and 64-bit values are LONG, as Spark has no unsigned types."""

LIBRARY_SOURCE = "ordinal long, accession string, peaks array<double>"
PEAKS = "genome_id long, local_peak_idx long, milli_mz long"
POSTINGS = "bin_id long, genome_id long, local_peak_idx long"
GENOMES = "genome_id long, accession string, display_name string, taxonomy string, taxonomy_id long, gene_count long, total_peaks long"
QUERIES = "query_id long, query_file string, ord long, milli_mz long, intensity float"
RESULTS = "query_id long, genome_id long, score float, matched_ribosomal long, matched_total long, rank long"

#: Fixed values of the domain.
BIN_WIDTH = 100
SHARDS = 64
COARSE_LIMIT = 8
TOP_RESULTS = 8
PPM = 50
MAX_U32 = 4294967295
SCHEMA_VERSION = 1
