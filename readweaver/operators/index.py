"""The genome index as tables: k-mer ranges, prefix presence, sorted suffixes and their common prefixes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalar as fn
from ..tables import durable
from . import codes as cd, genome as gn

#: Leading bases that a sorted neighbourhood is divided by.
LEAD = 4


def kmer_index(genome: DataFrame, k: int) -> DataFrame:
    """(kmer, code, first_rank, count): rank of each k-mer's first suffix among all k-mers in order, and how many it has.

    Ranks are a two-level running sum: over the leading groups, then within each.
    """
    if k > cd.MOST:
        return ranked(cd.counted(genome, "seq", k), "kmer", "count", "first_rank").select("kmer", "code", "first_rank", "count")
    groups = durable(cd.grouped(genome, "seq", k))
    ahead = groups.select("lead", (F.sum("total").over(Window.orderBy("lead")) - F.col("total")).alias("before"))
    return cd.ranked_groups(groups.join(F.broadcast(ahead), "lead"), k)


def kmer_places(genome: DataFrame, index: DataFrame | None, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """(code, count, chr_idx, pos): every place of the k-mers of bases, with how many places its k-mer has; what alignments look seeds up in.

    Ranges of code and place: a file holds neighbouring codes, so a scan skips what the reads don't have, and a frequent k-mer fills several files.
    Without an index the places themselves are counted.  With wanted (code, distinct) the table is that of those codes, and few others, with all their places.
    """
    if k > cd.MOST:  # more than a code made from pieces holds
        places = gn.kmers(genome, "seq", k, "chr_idx").select(fn.kmer_code("kmer", k).alias("code"), "chr_idx", "pos").where("code >= 0")
    else:
        places = cd.places(genome, "seq", k, "chr_idx", wanted)
    counts = places.groupBy("code").agg(F.count(F.lit(1)).alias("count")) if index is None else index.where("code >= 0").select("code", "count")
    counted = places.join(counts, "code").select("code", "count", "chr_idx", "pos")
    return counted.repartitionByRange("code", "chr_idx", "pos").sortWithinPartitions("code", "chr_idx", "pos")


def ranked(counted: DataFrame, key: str, count: str, out: str) -> DataFrame:
    """counted with the number of rows of all smaller keys (strings)."""
    led = counted.withColumn("__lead", F.substring(key, 1, LEAD))
    ahead = led.groupBy("__lead").agg(F.sum(count).alias("__s")).select("__lead", (F.sum("__s").over(Window.orderBy("__lead")) - F.col("__s")).alias("__before"))
    within = F.sum(count).over(Window.partitionBy("__lead").orderBy(key)) - F.col(count)
    return led.withColumn("__w", within).join(F.broadcast(ahead), "__lead").withColumn(out, (F.col("__before") + F.col("__w")).cast("long")).drop("__lead", "__w", "__before")


def prefix_presence(genome: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(kmer, length): for each distinct string of the queries the longest prefix that occurs on either strand.

    The longest common prefix with any genome string is that with a neighbour in
    sorted order, looked for among the strings with the same LEAD bases; only where
    none has them do shorter prefixes, at most 4**LEAD, decide.  Genome strings are cut
    to what they have in common with a query, so few are left to sort.
    """
    both = gn.two_strands(genome)
    asked = queries.select("kmer").distinct()
    strings = cd.near_prefixes(both, "seq", k, asked)
    # beginnings of fewer bases are strings, too, and queries look among them; so the genome is read once
    starts = lambda least: F.explode(F.array_distinct(F.array(*(F.substring("kmer", 1, n) for n in range(1, LEAD)), least)))
    own = strings.select(starts(F.col("kmer")).alias("kmer")).distinct().select("kmer", F.lit(True).alias("own"), F.substring("kmer", 1, LEAD).alias("__lead"))
    rows = own.unionByName(asked.select("kmer", F.lit(False).alias("own"), starts(F.substring("kmer", 1, LEAD)).alias("__lead")))
    order = Window.partitionBy("__lead").orderBy("kmer", F.desc("own"))
    text = F.when(F.col("own"), F.col("kmer"))
    before = F.last(text, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # backwards: a frame that starts anew at each row up to the end would take the square of the rows
    back = Window.partitionBy("__lead").orderBy(F.desc("kmer"), "own")
    after = F.last(text, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    near = rows.withColumn("a", before).withColumn("b", after).where(~F.col("own"))
    close = F.greatest(F.coalesce(fn.common_prefix("kmer", "a"), F.lit(0)), F.coalesce(fn.common_prefix("kmer", "b"), F.lit(0)))
    return near.select("kmer", close.alias("n")).groupBy("kmer").agg(F.max("n").cast("long").alias("length"))


def sample_points(genome: DataFrame, k: int, points: int = 16) -> DataFrame:
    """(kmer, point, next_kmer): for each k-mer with more than `points` occurrences the following k bases at equally deep places of its range."""
    long = gn.kmers(genome, "seq", 2 * k, "chr_idx")
    split = long.select(F.substring("kmer", 1, k).alias("kmer"), F.substring("kmer", k + 1, k).alias("next_kmer"), "chr_idx", "pos")
    within = Window.partitionBy("kmer")
    rows = split.withColumn("n", F.count(F.lit(1)).over(within)).where(F.col("n") > points)
    rows = rows.withColumn("rn", F.row_number().over(within.orderBy("next_kmer", "chr_idx", "pos")) - 1).withColumn("step", F.expr(f"n div {points}"))
    return rows.where((F.col("rn") % F.col("step") == 0) & (F.expr("rn div step") < points)).select("kmer", F.expr("cast(rn div step as long)").alias("point"), "next_kmer")


def fill_bounds(index: DataFrame, k: int) -> DataFrame:
    """(code, first_rank, count) for every code from 0 to 4**k - 1: codes that don't occur take the rank where they would stand, count 0."""
    codes = index.sparkSession.range(4**k).select(F.col("id").alias("code"))
    joined = codes.join(index.select("code", "first_rank", "count"), "code", "left").withColumn("part", F.shiftright("code", max(0, 2 * k - 2 * LEAD)))
    # the end of the last range before: within the part, else the end of the parts before it
    end = F.last(F.col("first_rank") + F.col("count"), ignorenulls=True).over(Window.partitionBy("part").orderBy("code").rowsBetween(Window.unboundedPreceding, -1))
    parts = joined.groupBy("part").agg(F.sum("count").alias("s")).select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return joined.withColumn("end", end).join(F.broadcast(parts), "part").select("code", F.coalesce("first_rank", "end", "before").cast("long").alias("first_rank"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def suffixes(seqs: DataFrame, depth: int, *keep: str) -> DataFrame:
    """(keep..., pos, suffix): the first `depth` bases of every suffix that starts with a base."""
    return gn.kmers(seqs, "seq", depth, *keep, whole=False).withColumnRenamed("kmer", "suffix").where(F.col("suffix").rlike("^[ACGT]"))


def suffix_ranks(sfx: DataFrame, *tie: str) -> DataFrame:
    """sfx with its rank in suffix order (N and # last, longer first on a tie of prefixes by the closing character), ties by `tie`; divided by leading bases."""
    keyed = sfx.withColumn("__key", F.concat(fn.suffix_key("suffix"), F.lit("\x7f"))).withColumn("__lead", F.substring("__key", 1, LEAD))
    ahead = keyed.groupBy("__lead").agg(F.count(F.lit(1)).alias("__s")).select("__lead", (F.sum("__s").over(Window.orderBy("__lead")) - F.col("__s")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__lead").orderBy("__key", *tie))
    return keyed.withColumn("__own", own).join(F.broadcast(ahead), "__lead").withColumn("rank", (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__own", "__before", "__lead", "__key")


def neighbour_lcp(ranked_sfx: DataFrame, most: int = 255) -> DataFrame:
    """(rank, lcp): common prefix of each suffix with the one before it in order, `most` at most; the previous suffix is fetched by an equality of ranks."""
    prev = ranked_sfx.select((F.col("rank") + 1).alias("rank"), F.col("suffix").alias("prev"))
    got = ranked_sfx.select("rank", "suffix").join(prev, "rank", "left")
    return got.select("rank", F.least(F.coalesce(fn.common_prefix("suffix", "prev"), F.lit(0)), F.lit(most)).cast("long").alias("lcp"))


def merge_suffixes(old: DataFrame, new: DataFrame, *tie: str) -> DataFrame:
    """(source, keep..., rank, insert_rank): old and new suffixes in one order; insert_rank of a new one is the number of old ones before it."""
    both = old.withColumn("source", F.lit(0)).unionByName(new.withColumn("source", F.lit(1)))
    merged = suffix_ranks(both, "source", *tie)
    lead = merged.withColumn("__p", F.expr("rank div 65536"))
    per = lead.groupBy("__p").agg(F.sum(1 - F.col("source")).alias("s")).select("__p", (F.sum("s").over(Window.orderBy("__p")) - F.col("s")).alias("before"))
    own = F.sum(1 - F.col("source")).over(Window.partitionBy("__p").orderBy("rank"))
    return lead.withColumn("own", own).join(F.broadcast(per), "__p").withColumn("insert_rank", F.when(F.col("source") == 1, F.col("before") + F.col("own")).cast("long")).drop("__p", "own", "before")
