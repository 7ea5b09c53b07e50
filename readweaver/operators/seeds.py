"""Read splitting, exact-match seeds, maximal mappable prefixes and seed chains."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import SeedConfig
from ..functions import scalar as fn
from . import codes as cd, genome as gn, index as ix


def split_runs(reads: DataFrame, min_length: int = 20) -> DataFrame:
    """(read_idx, fragment, read_start, length): stretches of at least min_length bases between N and #; # starts the next fragment.

    The pieces between separators give the places by a running sum; all within the row.
    """
    rows = _runs(reads, min_length, "read_idx", "seq")
    fragment = F.col("read_start") - F.length(F.regexp_replace(F.substr("seq", F.lit(1), F.col("read_start")), "#", ""))
    return rows.select("read_idx", fragment.cast("int").alias("fragment"), "read_start", F.length("piece").alias("length"))


def _runs(df: DataFrame, min_length: int, *keep: str) -> DataFrame:
    """(keep..., read_start, piece): the stretches of bases of seq."""
    pieces = F.split("seq", "[^ACGT]", -1)
    rows = df.select(*keep, pieces.alias("all"), F.posexplode(pieces).alias("i", "piece"))
    before = F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0), lambda a, p: a + F.length(p) + 1)
    return rows.where(F.length("piece") >= min_length).select(*keep, before.alias("read_start"), "piece")


def oriented(reads: DataFrame) -> DataFrame:
    """(read_idx, direction, n, seq): every read and its reverse complement."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("direction"), F.col("seq")), F.struct(F.lit(1).alias("direction"), fn.revcomp("seq").alias("seq"))))
    return reads.select("read_idx", both.alias("o")).select("read_idx", "o.direction", F.length("o.seq").alias("n"), "o.seq")


def read_kmers(reads: DataFrame, k: int, min_run: int = 1) -> DataFrame:
    """(read_idx, direction, n, s, kmer) of both orientations, in stretches of at least min_run bases; k-mers with N or # match nothing and are left out."""
    own = ["read_idx", "direction", "n"]
    found = gn.kmers(_runs(oriented(reads), max(min_run, k), *own), "piece", k, *own, "read_start")
    return found.select(*own, (F.col("read_start") + F.col("pos")).alias("s"), "kmer")


def seed_hits(genome: DataFrame, reads: DataFrame, k: int, max_rep: int = 10_000, min_run: int = 1) -> DataFrame:
    """(read_idx, direction, n, s, chr_idx, pos): places on the forward strand of every k-mer of the reads.

    The genome's k-mers are reduced to those that the reads have, by a bit filter of their codes (longer ones than a code holds by a semi-join),
    before they are counted and joined; k-mers that occur more than max_rep times give no hits.
    """
    queries = read_kmers(reads, k, min_run)
    if k <= cd.MOST:
        coded = queries.withColumn("code", fn.kmer_code("kmer", k)).drop("kmer")
        places = cd.places(genome, "seq", k, "chr_idx", coded.select("code").distinct())
        rare = places.groupBy("code").agg(F.count(F.lit(1)).alias("rep")).where(F.col("rep") <= max_rep).select("code")
        return coded.join(places.join(rare, "code", "left_semi"), "code").select("read_idx", "direction", "n", "s", "chr_idx", "pos")
    wanted = queries.select("kmer").distinct()
    places = gn.kmers(genome, "seq", k, "chr_idx").join(wanted, "kmer", "left_semi")
    rare = places.groupBy("kmer").agg(F.count(F.lit(1)).alias("rep")).where(F.col("rep") <= max_rep).select("kmer")
    return queries.join(places.join(rare, "kmer", "left_semi"), "kmer").select("read_idx", "direction", "n", "s", "chr_idx", "pos")


def stored_hits(places: DataFrame, reads: DataFrame, k: int, max_rep: int = 10_000, min_run: int = 1) -> DataFrame:
    """`seed_hits` from a table of places (`index.kmer_places`) instead of the genome; frequent k-mers are left out by the scan."""
    queries = read_kmers(reads, k, min_run).withColumn("code", fn.kmer_code("kmer", k)).drop("kmer")
    return queries.join(places.where(F.col("count") <= max_rep), "code").select("read_idx", "direction", "n", "s", "chr_idx", "pos")


def mem_islands(hits: DataFrame, k: int) -> DataFrame:
    """(read_idx, direction, n, chr_idx, read_start, length, pos): maximal exact matches, islands of consecutive hits on a diagonal."""
    diagonal = hits.withColumn("diag", F.col("pos") - F.col("s"))
    key = ["read_idx", "direction", "n", "chr_idx", "diag"]
    island = F.col("s") - F.row_number().over(Window.partitionBy(*key).orderBy("s"))
    runs = diagonal.withColumn("island", island).groupBy(*key, "island").agg(F.min("s").alias("read_start"), (F.max("s") - F.min("s") + k).alias("length"))
    return runs.select("read_idx", "direction", "n", "chr_idx", "read_start", "length", (F.col("read_start") + F.col("diag")).alias("pos"))


def both_strands(islands: DataFrame) -> DataFrame:
    """(read_idx, direction, n, a, b, chr_idx, pos, strand): matches of each orientation on either strand; a match of the other orientation is one at the mirrored place on the reverse strand."""
    end = F.col("read_start") + F.col("length")
    own = islands.select("read_idx", "direction", "n", F.col("read_start").alias("a"), end.alias("b"), "chr_idx", "pos", F.lit(0).alias("strand"))
    other = islands.select("read_idx", (1 - F.col("direction")).alias("direction"), "n", (F.col("n") - end).alias("a"), (F.col("n") - F.col("read_start")).alias("b"), "chr_idx", "pos", F.lit(1).alias("strand"))
    return own.unionByName(other)


def mmp(genome: DataFrame, reads: DataFrame, k: int, max_rep: int = 10_000) -> DataFrame:
    """(read_idx, direction, s, length, rep): the longest prefix from each place on that occurs on either strand, and how often; rep is null below k."""
    matched = both_strands(mem_islands(seed_hits(genome, reads, k, max_rep), k))
    at = matched.select("read_idx", "direction", "b", F.explode(F.sequence("a", F.col("b") - k)).alias("s")).withColumn("length", F.col("b") - F.col("s"))
    # count at the maximum, without collecting: (length, occurrences) first, then the largest length
    per = at.groupBy("read_idx", "direction", "s", "length").agg(F.count(F.lit(1)).alias("rep"))
    best = per.groupBy("read_idx", "direction", "s").agg(F.max(F.struct("length", "rep")).alias("m")).select("read_idx", "direction", "s", "m.length", "m.rep")
    places = gn.kmers(oriented(reads), "seq", k, "read_idx", "direction", whole=False).withColumnRenamed("pos", "s")
    short = ix.prefix_presence(genome, places, k).withColumnRenamed("length", "short")
    joined = places.join(best, ["read_idx", "direction", "s"], "left").join(short, "kmer", "left")
    return joined.select("read_idx", "direction", "s", F.coalesce(F.col("length").cast("long"), "short").alias("length"), "rep")


def seed_chain(genome: DataFrame, reads: DataFrame, k: int, config: SeedConfig = SeedConfig()) -> DataFrame:
    """(read_idx, direction, read_start, length, rep): seeds met from evenly spaced starts, each jump as long as the match.

    A match over the whole read, in the first orientation that has one, is its only seed.  Seeds shorter than k have no rep.
    """
    step = F.expr(f"n div (1 + n div {config.start_every})")
    found = mmp(genome, reads, k, 10_000)
    rows = found.groupBy("read_idx", "direction").agg(F.array_sort(F.collect_list(F.struct("s", "length", "rep"))).alias("m")).withColumn("n", F.size("m"))

    def visit(acc, x):
        reached = ((x["s"] % F.greatest(step, F.lit(1)) == 0) & (F.expr("n") - x["s"] >= config.min_tail) & (x["s"] < step * (1 + F.expr(f"n div {config.start_every}")))) | (F.array_contains(acc["next"], x["s"]) & (F.expr("n") - x["s"] >= config.min_tail))
        return F.struct(
            F.when(reached, F.concat(acc["next"], F.array(x["s"] + F.greatest(x["length"], F.lit(1))))).otherwise(acc["next"]).alias("next"),
            F.when(reached & (x["length"] > 0), F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), x["length"].alias("length"), x["rep"].alias("rep"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("next"), F.expr("cast(array() as array<struct<s:bigint,length:bigint,rep:bigint>>)").alias("out"))
    chained = rows.select("read_idx", "direction", "n", F.aggregate("m", start, visit, lambda acc: acc["out"]).alias("seeds"), (F.col("m")[0]["length"] == F.col("n")).alias("whole"))
    first_whole = F.min(F.when(F.col("whole"), F.col("direction"))).over(Window.partitionBy("read_idx"))
    kept = chained.withColumn("first_whole", first_whole).where(F.col("first_whole").isNull() | (F.col("first_whole") == F.col("direction")))
    seeds = kept.select("read_idx", "direction", "first_whole", F.explode("seeds").alias("x")).where(F.col("first_whole").isNull() | (F.col("x.s") == 0))
    ordered = seeds.select("read_idx", "direction", F.col("x.s").alias("read_start"), "x.length", "x.rep")
    rank = F.row_number().over(Window.partitionBy("read_idx").orderBy("read_start", "length", "direction"))
    return ordered.withColumn("rn", rank).where(F.col("rn") <= config.max_seeds_per_read).drop("rn")


def best_mem(islands: DataFrame) -> DataFrame:
    """(read_idx, direction, chr_idx, read_start, length, pos) of the longest match of each read."""
    order = Window.partitionBy("read_idx").orderBy(F.desc("length"), "direction", "chr_idx", "pos", "read_start")
    return islands.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("read_idx", "direction", "chr_idx", "read_start", "length", "pos")


def with_rep(islands: DataFrame) -> DataFrame:
    """Matches with rep: how many places the same piece of the read matches."""
    piece = Window.partitionBy("read_idx", "direction", "read_start", "length")
    return islands.withColumn("rep", F.count(F.lit(1)).over(piece))


def anchor_flags(islands: DataFrame, max_rep: int = 50) -> DataFrame:
    return with_rep(islands).withColumn("is_anchor", F.col("rep") <= max_rep)
