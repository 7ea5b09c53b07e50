"""GTF annotation: exons with defaults, warnings and dictionaries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AnnotationConfig
from ..functions import scalar as fn
from .lines import lines, running


def read_exons(spark: SparkSession, path: str, config: AnnotationConfig = AnnotationConfig()) -> DataFrame:
    """(line_no, chr, start, end, strand, transcript_id, gene_id, gene_name, gene_type, warning) of the feature's lines.

    Missing ids get defaults and a warning text.
    """
    rows = running(lines(spark, path), line_no=F.lit(1))
    f = F.split("value", "\t")
    rows = rows.where(~F.col("value").startswith("#") & (F.get(f, 2) == config.feature))
    attrs = F.get(f, 8)
    rows = rows.select(
        "line_no", F.concat(F.lit(config.chr_prefix), F.get(f, 0)).alias("chr"), F.get(f, 3).cast("long").alias("start"), F.get(f, 4).cast("long").alias("end"), fn.strand_code(F.get(f, 6)).alias("strand"),
        fn.attribute(attrs, config.transcript_tag).alias("t"), fn.attribute(attrs, config.gene_tag).alias("g"), fn.attribute(attrs, *config.gene_name_tags).alias("n"), fn.attribute(attrs, *config.gene_type_tags).alias("k"),
    )
    made = F.concat_ws("_", F.lit("tr"), "chr", F.col("start").cast("string"), F.col("end").cast("string"), F.col("line_no").cast("string"))
    warning = F.concat_ws("; ", F.when(F.col("t").isNull(), "no transcript id"), F.when(F.col("g").isNull(), "no gene id"))
    return rows.select(
        "line_no", "chr", "start", "end", "strand", F.coalesce("t", made).alias("transcript_id"), F.coalesce("g", F.lit("MissingGeneID")).alias("gene_id"),
        F.coalesce("n", "g", F.lit("MissingGeneID")).alias("gene_name"), F.coalesce("k", F.lit("MissingGeneType")).alias("gene_type"), F.nullif(warning, F.lit("")).alias("warning"),
    )
