"""SQL functions and table functions of the sequence library."""
from __future__ import annotations

from pyspark.sql import SparkSession

from .scalar import ALPHABET, LETTER_BASES, MOTIFS, NO_MOTIF

_MOTIF = "CASE concat(first2, last2) " + " ".join(f"WHEN '{m}' THEN {{{m}}}" for m in MOTIFS)

#: SQL-bodied functions: they are inlined, so they stay in generated code.
FUNCTIONS = {
    "dna(t STRING) RETURNS STRING": f"regexp_replace(translate(upper(regexp_replace(t, '[^A-Za-z]+', '#')), '{ALPHABET}', '{LETTER_BASES}'), '#', '')",
    "revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGT', 'TGCA'))",
    "kmer_code(s STRING, k INT) RETURNS BIGINT": "CASE WHEN length(s) >= k AND substr(s, 1, k) RLIKE '^[ACGT]+$' THEN CAST(conv(translate(substr(s, 1, k), 'ACGT', '0123'), 4, 10) AS BIGINT) ELSE -1L END",
    "lce(a STRING, b STRING) RETURNS INT": "aggregate(array(1048576, 524288, 262144, 131072, 65536, 32768, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1), 0, (n, d) -> CASE WHEN n + d <= least(length(a), length(b)) AND substr(a, 1, n + d) = substr(b, 1, n + d) THEN n + d ELSE n END)",
    "splice_motif(first2 STRING, last2 STRING) RETURNS INT": _MOTIF.format(**{m: v[0] for m, v in MOTIFS.items()}) + f" ELSE {NO_MOTIF[0]} END",
    "splice_penalty(first2 STRING, last2 STRING) RETURNS INT": _MOTIF.format(**{m: v[1] for m, v in MOTIFS.items()}) + f" ELSE {NO_MOTIF[1]} END",
    "kmers(s STRING, k INT) RETURNS TABLE(pos INT, kmer STRING)": "SELECT p, substr(s, p + 1, k) FROM explode(CASE WHEN length(s) >= k THEN sequence(0, length(s) - k) ELSE array() END) AS t(p)",
}


def register(spark: SparkSession) -> None:
    """Make the functions available to spark.sql in this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
