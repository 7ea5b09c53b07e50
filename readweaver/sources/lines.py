"""Numbered lines of text files, read by Spark's own reader so that any store it knows will do."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_no, block, at, value): lines with a sort key; file_no is the path's place in the arguments, block the split's offset."""
    out = None
    for k, path in enumerate(paths):
        part = spark.read.text(path).select(
            F.lit(k).alias("file_no"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


BLOCK = ["file_no", "file", "block"]


def running(rows: DataFrame, **sums: Column) -> DataFrame:
    """rows with, for each name, the sum of its column over all lines before (exclusive), in file order.

    Two levels: within each split, and over the splits' totals, of which there is one for each 128 MB or so of input.
    """
    valued = rows.select("*", *(v.cast("long").alias(f"__{n}") for n, v in sums.items()))
    totals = valued.groupBy(*BLOCK).agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    ahead = Window.orderBy(*BLOCK)
    totals = totals.select(*BLOCK, *((F.sum(f"__t_{n}").over(ahead) - F.col(f"__t_{n}")).alias(f"__b_{n}") for n in sums))
    own = Window.partitionBy(*BLOCK).orderBy("at")
    inner = valued.select("*", *((F.sum(f"__{n}").over(own) - F.col(f"__{n}")).alias(f"__w_{n}") for n in sums))
    return inner.join(F.broadcast(totals), BLOCK).select(*rows.columns, *((F.col(f"__b_{n}") + F.col(f"__w_{n}")).alias(n) for n in sums))
