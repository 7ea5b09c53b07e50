"""Chromosomes, padding, strands, chunks and k-mers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as fn

#: Chromosomes a bucket of the two-level running sum.
BUCKET = 4096
#: Bases a chunk: substrings are taken from short strings, never from whole chromosomes.
CHUNK = 256


def running_before(df: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """df with the sum of `value` over all rows of smaller `order` (a dense whole number).

    Two levels: sums of buckets of 4,096 orders are summed in one task, rows within their bucket; no task sees all rows.
    """
    valued = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(order) / BUCKET))
    buckets = valued.groupBy("__b").agg(F.sum("__v").alias("__s"))
    ahead = buckets.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"))
    within = F.sum("__v").over(Window.partitionBy("__b").orderBy(order)) - F.col("__v")
    return valued.withColumn("__w", within).join(ahead, "__b").withColumn(out, (F.col("__before") + F.col("__w")).cast("long")).drop("__v", "__b", "__w", "__before")


def chromosomes(genome: DataFrame, bin_bits: int = 18) -> DataFrame:
    """(chr_idx, name, start, length): the padded layout of the concatenated genome, from (chr_idx, name, seq)."""
    rows = genome.select("chr_idx", "name", F.length("seq").cast("long").alias("length"))
    return running_before(rows, "chr_idx", fn.padded_length("length", bin_bits, F.lit(False)), "start").select("chr_idx", "name", "start", "length")


def with_padding(chrs: DataFrame, bin_bits: int = 18) -> DataFrame:
    """Chromosomes with their padded length; the last one is rounded up and may get no padding."""
    last = chrs.agg(F.max("chr_idx").alias("last_idx"))
    return chrs.join(F.broadcast(last)).select(*chrs.columns, fn.padded_length("length", bin_bits, F.col("chr_idx") == F.col("last_idx")).alias("padded"))


def chromosome_of(positions: DataFrame, chrs: DataFrame, bin_bits: int = 18, pos: str = "pos") -> DataFrame:
    """positions with the chromosome whose start is the greatest not beyond pos, and the place on it.

    Chromosomes start at multiples of the bin, so the as-of lookup is an equality of bins; the last chromosome takes everything beyond it.
    """
    spans = chrs.select("chr_idx", "start", F.explode(F.sequence(F.shiftright("start", bin_bits), F.shiftright(F.col("start") + F.col("length"), bin_bits))).alias("__bin"))
    found = positions.withColumn("__bin", F.shiftright(F.col(pos).cast("long"), bin_bits)).join(spans, "__bin", "left")
    end = chrs.select("chr_idx", "start").orderBy(F.desc("chr_idx")).limit(1).select(F.col("chr_idx").alias("__c"), F.col("start").alias("__s"))
    got = found.join(F.broadcast(end))
    tail = F.col("start").isNull() & (F.col(pos) >= F.col("__s"))
    start = F.when(tail, F.col("__s")).otherwise(F.col("start"))
    return got.select(*positions.columns, F.when(tail, F.col("__c")).otherwise(F.col("chr_idx")).alias("chr_idx"), (F.col(pos) - start).alias("offset"))


def two_strands(genome: DataFrame) -> DataFrame:
    """(chr_idx, strand, seq): every sequence and its reverse complement."""
    own = genome.select("chr_idx", F.lit(0).alias("strand"), "seq")
    return own.unionByName(genome.select("chr_idx", F.lit(1).alias("strand"), fn.revcomp("seq").alias("seq")))


def chunks(df: DataFrame, seq: str, overlap: int, *keep: str, size: int = CHUNK) -> DataFrame:
    """(keep..., chunk_start, chunk): pieces of `size` bases with `overlap` more, so every window of overlap + 1 bases is whole in the chunk it starts in.

    Sequences are of one-byte characters.  The work is in proportion to their length.
    """
    n = F.octet_length(seq)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    # bytes are cut in place, where characters would be counted from the sequence's start for every piece; the array of one evaluates the bytes once a row
    piece = lambda whole, k: F.struct((k.cast("long") * size).alias("chunk_start"), F.substr(whole, k * size + 1, F.lit(size + overlap)).cast("string").alias("chunk"))
    pieces = F.flatten(F.transform(F.array(F.col(seq).cast("binary")), lambda whole: F.transform(starts, lambda k: piece(whole, k))))
    # the pieces are made within the row, so no row of the result carries the whole sequence
    return df.select(*keep, F.inline(pieces))


def kmers(df: DataFrame, seq: str, k: int, *keep: str, whole: bool = True) -> DataFrame:
    """(keep..., pos, kmer) of every place; with whole=False the shorter ones at the end, too."""
    pieces = chunks(df, seq, k - 1, *keep)
    n = F.length("chunk")
    last = F.least(F.lit(CHUNK), n - (k - 1 if whole else 0)) - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    # explode and substring are generated code; a function over the array of places would be interpreted
    return pieces.select(*keep, "chunk_start", "chunk", F.explode(places).alias("__p")).select(
        *keep, (F.col("chunk_start") + F.col("__p")).alias("pos"), F.substr("chunk", F.col("__p") + 1, F.lit(k)).alias("kmer")
    )
