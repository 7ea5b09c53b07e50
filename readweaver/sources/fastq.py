"""FASTQ: single and paired reads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as fn
from .lines import lines, running


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(read_idx, name, seq, quality): four lines a record by line number; a record that isn't whole at the end is left out."""
    rows = running(lines(spark, path), line=F.lit(1))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    records = rows.groupBy(F.expr("line div 4").alias("read_idx")).agg(part(0).alias("h"), part(1).alias("seq"), part(3).alias("quality")).where("quality is not null")
    return records.select("read_idx", fn.header_name(F.expr("substr(h, 2)")).alias("name"), F.upper("seq").alias("seq"), "quality")


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """(read_idx, name, seq_fwd, seq_rc, quality, length, mate1_length, mate2_length) of single reads."""
    none = F.lit(None).cast("int")
    return read_records(spark, path).select("read_idx", "name", F.col("seq").alias("seq_fwd"), fn.revcomp_read("seq").alias("seq_rc"), "quality", F.length("seq").alias("length"), none.alias("mate1_length"), none.alias("mate2_length"))


def read_paired(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """The same of pairs, joined by record number: mate 1, #, reverse complement of mate 2; a record that one file lacks is left out."""
    a = read_records(spark, path1)
    b = read_records(spark, path2).select("read_idx", F.col("seq").alias("seq2"), F.col("quality").alias("quality2"))
    both = a.join(b, "read_idx").withColumn("whole", F.concat("seq", F.lit("#"), fn.revcomp_mate("seq2")))
    return both.select(
        "read_idx", "name", F.col("whole").alias("seq_fwd"), fn.revcomp_read("whole").alias("seq_rc"), F.concat("quality", F.lit(" "), F.reverse("quality2")).alias("quality"),
        F.length("whole").alias("length"), F.length("seq").alias("mate1_length"), F.length("seq2").alias("mate2_length"),
    )
