"""SAM records from alignments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as fn


def records(alignments: DataFrame, reads: DataFrame, names: DataFrame) -> DataFrame:
    """(read_idx, value): SAM lines of selected alignments (with hits); reads have name, seq_fwd, seq_rc, quality, length, mate1_length; names chr_idx, chr.

    A pair whose alignment covers both mates gives two lines, one whose alignment covers one mate a line with the mate unmapped.
    """
    rows = alignments.select("read_idx", "direction", "chr_idx", "genome_start", "genome_end", "hits", "exons", "sj").join(reads, "read_idx").join(names, "chr_idx")
    forward = F.col("direction") == 0
    single = rows.where("mate1_length is null")
    seq, qual = F.when(forward, F.col("seq_fwd")).otherwise(F.col("seq_rc")), F.when(forward, F.col("quality")).otherwise(F.reverse("quality"))
    flag = fn.sam_flag(F.lit(False), F.col("direction"), F.lit(1))
    one = single.select("read_idx", _line(F.col("name"), flag, F.col("chr"), F.col("genome_start") + 1, fn.mapq("hits"), fn.cigar(F.col("length").cast("long"), F.col("exons"), F.col("sj")), F.lit("*"), F.lit(0), F.lit(0), seq, qual).alias("value"))
    return one.unionByName(_paired(rows.where("mate1_length is not null")))


def _line(*fields: Column) -> Column:
    return F.concat_ws("\t", *(f.cast("string") for f in fields))


def _paired(rows: DataFrame) -> DataFrame:
    """Two lines a pair: the joined read is cut at the separator, the exons and gaps at the mate boundary."""
    forward = F.col("direction") == 0
    first_length = F.when(forward, F.col("mate1_length")).otherwise(F.col("mate2_length"))
    rows = rows.withColumn("seq", F.when(forward, F.col("seq_fwd")).otherwise(F.col("seq_rc"))).withColumn("qual", F.when(forward, F.col("quality")).otherwise(F.reverse("quality"))).withColumn("cut", first_length)
    rows = rows.withColumn("e1", F.expr("filter(exons, e -> e.read_start < cut)")).withColumn("e2", F.expr("transform(filter(exons, e -> e.read_start > cut), e -> named_struct('start', e.start, 'length', e.length, 'read_start', e.read_start - cut - 1))"))
    gap = F.expr("array_position(transform(sj, s -> s.type), -3)").cast("int")
    rows = rows.withColumn("s1", F.when(gap > 0, F.slice("sj", F.lit(1), gap - 1)).otherwise(F.col("sj"))).withColumn("s2", F.when(gap > 0, F.slice("sj", gap + 1, F.greatest(F.size("sj") - gap, F.lit(0)))).otherwise(F.col("sj")))
    out = None
    for k, other in ((1, 2), (2, 1)):
        length = F.col("cut") if k == 1 else F.length("seq") - F.col("cut") - 1
        own_seq = F.substr("seq", F.lit(1) if k == 1 else F.col("cut") + 2, length)
        own_qual = F.substr("qual", F.lit(1) if k == 1 else F.col("cut") + 2, length)
        mapped, mate_mapped = F.size(f"e{k}") > 0, F.size(f"e{other}") > 0
        mate = F.when(forward, k).otherwise(other)
        both = fn.sam_flag(F.lit(True), F.col("direction"), mate)
        reverse = k == 2  # the right line of a proper pair lies on the reverse strand
        lone = 1 + F.when(~mapped, 4).otherwise(0) + F.when(~mate_mapped, 8).otherwise(0) + F.when(mapped & F.lit(reverse), 16).otherwise(0) + F.when(mate_mapped & F.lit(not reverse), 32).otherwise(0) + F.when(mate == 1, 64).otherwise(128)
        flag = F.when(mapped & mate_mapped, both).otherwise(lone)
        pos = F.when(mapped, F.col(f"e{k}")[0]["start"] + 1).otherwise(F.col(f"e{other}")[0]["start"] + 1)
        mate_pos = F.when(mate_mapped, F.col(f"e{other}")[0]["start"] + 1).otherwise(pos)
        size = F.when(mapped & mate_mapped, (F.col("genome_end") - F.col("genome_start")) * (1 if k == 1 else -1)).otherwise(0)
        cigar = F.when(mapped, fn.cigar(length.cast("long"), F.col(f"e{k}"), F.col(f"s{k}"))).otherwise("*")
        line = rows.select("read_idx", _line(F.col("name"), flag, F.col("chr"), pos, F.when(mapped, fn.mapq("hits")).otherwise(0), cigar, F.lit("="), mate_pos, size, own_seq, own_qual).alias("value"))
        out = line if out is None else out.unionByName(line)
    return out
