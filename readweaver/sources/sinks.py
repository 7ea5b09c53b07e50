"""Index tables, SAM text, chromosome tables and the final report."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_index(path: str, **tables: DataFrame) -> None:
    """Each table as Parquet below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def sam_header(chrs: DataFrame) -> DataFrame:
    """(value): @HD and a @SQ line for each chromosome (name, length)."""
    first = chrs.sparkSession.range(1).select(F.lit("@HD\tVN:1.6\tSO:unknown").alias("value"))
    return first.unionByName(chrs.select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value")))


def write_sam(records: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """SAM lines as text, one file a partition; a header goes to a folder of its own, to be put in front."""
    if header is not None:
        header.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    records.select("value").write.mode("overwrite").text(f"{path}/records")


def write_chromosomes(chrs: DataFrame, path: str) -> None:
    """Names, lengths and starts as text tables."""
    for c in ("name", "length", "start"):
        chrs.orderBy("chr_idx").select(F.col(c).cast("string").alias("value")).write.mode("overwrite").text(f"{path}/{c}")


def write_report(report: DataFrame, path: str) -> None:
    """The final report as one line for each figure."""
    pairs = F.explode(F.create_map(*(x for c in report.columns for x in (F.lit(c), F.col(c).cast("string")))))
    report.select(pairs.alias("k", "v")).select(F.concat_ws("\t", "k", "v").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_progress(spark: SparkSession, path: str, began: float, ended: float, reads: int) -> None:
    """Start, elapsed seconds, reads and million reads an hour of a run, from epoch seconds, as one line each."""
    took = max(ended - began, 1e-9)
    start = datetime.fromtimestamp(began, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    pairs = [("started", start), ("elapsed", f"{took:.0f}"), ("reads", str(reads)), ("million_reads_per_hour", f"{reads / took * 3600 / 1e6:.1f}")]
    spark.createDataFrame(pairs, "k string, v string").coalesce(1).select(F.concat_ws("\t", "k", "v").alias("value")).write.mode("overwrite").text(path)
