"""FASTA: chromosomes and sequence pieces."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as fn
from .lines import lines, running


class EmptyGenomeError(ValueError):
    """No sequence in the file."""


def read_pieces(spark: SparkSession, *paths: str) -> DataFrame:
    """(chr_idx, name, offset, piece): one row a sequence line, in upper case without white space; lines before the first header are left out."""
    rows = lines(spark, *paths)
    head = F.col("value").startswith(">")
    rows = rows.withColumn("head", head).withColumn("piece", F.when(head, "").otherwise(fn.clean_sequence("value")))
    placed = running(rows, heads=F.col("head").cast("int"), bases=F.length("piece"))
    named = placed.where("head").select(F.col("heads").alias("chr_idx"), fn.header_name(F.expr("substr(value, 2)")).alias("name"), F.col("bases").alias("first"))
    body = placed.where("not head and piece <> '' and heads > 0").select((F.col("heads") - 1).alias("chr_idx"), "bases", "piece")
    return body.join(named, "chr_idx").select("chr_idx", "name", (F.col("bases") - F.col("first")).alias("offset"), "piece")


def chromosome_lengths(pieces: DataFrame) -> DataFrame:
    """(chr_idx, name, length)."""
    return pieces.groupBy("chr_idx", "name").agg(F.sum(F.length("piece")).cast("long").alias("length"))


def rechunk(pieces: DataFrame, size: int = 1024, overlap: int = 0) -> DataFrame:
    """(chr_idx, name, chunk_start, chunk): even chunks with `overlap` more bases from lines of any length."""
    end = F.col("offset") + F.length("piece")
    first = F.greatest(F.floor((F.col("offset") - overlap) / size), F.lit(0))
    cut = pieces.withColumn("c", F.explode(F.sequence(first, F.floor((end - 1) / size)))).withColumn("lo", F.greatest(F.col("c") * size, F.col("offset"))).withColumn("hi", F.least((F.col("c") + 1) * size + overlap, end))
    cut = cut.where("lo < hi").withColumn("part", F.struct("lo", F.substr("piece", (F.col("lo") - F.col("offset") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("s")))
    joined = cut.groupBy("chr_idx", "name", "c").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return joined.select("chr_idx", "name", (F.col("c") * size).alias("chunk_start"), F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("chunk"))


def read_genome(spark: SparkSession, *paths: str) -> DataFrame:
    """(chr_idx, name, seq): whole chromosomes, for those that fit a row; raises on files without sequence."""
    pieces = read_pieces(spark, *paths)
    whole = pieces.groupBy("chr_idx", "name").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("p"))
    out = whole.select("chr_idx", "name", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("seq"))
    if out.limit(1).count() == 0:
        raise EmptyGenomeError(", ".join(paths))
    return out
