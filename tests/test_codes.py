"""K-mers as codes, against plain loops, and how much of a genome is left to sort."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readweaver.operators import codes as cd, genome as gn, index as ix

RNG = random.Random(11)


def bases(n, of="ACGT"):
    return "".join(RNG.choice(of) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    sizes = (0, 1, 6, 7, 8, cd.PIECE - 1, cd.PIECE, cd.PIECE + 3, cd.PIECE + 6, 2 * cd.PIECE + 7, 9000)
    return [*(bases(n) for n in sizes), bases(5000, "ACGTN"), "N" * 50 + "#" + bases(40), "ACG" * 2000]


@pytest.fixture(scope="module")
def genome(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (99, None)], "chr_idx long, seq string")


@pytest.mark.parametrize("k", [1, 7, 14, 31, 32])
def test_counted(genome, texts, k):
    want = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    got = {r.kmer: (r.code, r["count"]) for r in cd.counted(genome, "seq", k).collect()}
    assert {x: n for x, (_, n) in got.items()} == want
    value = lambda x: sum("ACGT".index(c) * 4 ** (k - 1 - i) for i, c in enumerate(x)) if k <= cd.MOST and set(x) <= set("ACGT") else -1
    assert all(c == value(x) for x, (c, _) in got.items())


@pytest.mark.parametrize("held", [cd.HELD, 3])
def test_prefixes(spark, genome, texts, held, monkeypatch):
    """Longest prefixes against all k-mers; few strings are left of a genome that has little of the queries, also where these are too many to be held."""
    monkeypatch.setattr(cd, "HELD", held)
    rc = str.maketrans("ACGT", "TGCA")
    for k in (6, 14):
        both = [*texts, *(t[::-1].translate(rc) for t in texts)]
        strings = {t[i : i + k] for t in both for i in range(len(t))}
        heads = {s[:n] for s in strings for n in range(1, k + 1)}
        asked = [texts[8][100 : 100 + k], texts[9][-3:], "ACGNNN", "NNNNNNNN"[:k], "#", bases(k), bases(k), "TTTTTTTTTTTTTTTT"[:k], "A"]
        q = spark.createDataFrame([(x,) for x in asked], "kmer string")
        got = {r.kmer: r.length for r in ix.prefix_presence(genome, q, k).collect()}
        assert got == {x: max((n for n in range(1, len(x) + 1) if x[:n] in heads), default=0) for x in asked}
    plain = spark.createDataFrame([(0, bases(20_000))], "chr_idx long, seq string")
    left = cd.near_prefixes(plain, "seq", 14, q.limit(3)).count()
    assert left <= 200 < gn.kmers(plain, "seq", 14).select("kmer").distinct().count()


def test_one_beginning_for_each_query(spark):
    """A task gives one string for each query and the shorter ends, however long the genome is."""
    plain = spark.createDataFrame([(0, bases(60_000))], "chr_idx long, seq string").coalesce(1)
    asked = spark.createDataFrame([(bases(14),) for _ in range(50)], "kmer string").distinct()
    assert cd.near_prefixes(plain, "seq", 14, asked).count() <= 50 + 13


def test_places(spark, genome, texts):
    """Places of the wanted codes, and hardly any others, before anything is joined."""
    got = sorted(map(tuple, cd.places(genome, "seq", 9, "chr_idx").collect()))
    value = lambda x: sum("ACGT".index(c) * 4 ** (8 - i) for i, c in enumerate(x))
    every = sorted((j, i, value(t[i : i + 9])) for j, t in enumerate(texts) for i in range(len(t) - 8) if set(t[i : i + 9]) <= set("ACGT"))
    assert got == every
    wanted = {c for _, _, c in every[::500]}
    few = set(map(tuple, cd.places(genome, "seq", 9, "chr_idx", spark.createDataFrame([(c,) for c in wanted], "code long")).collect()))
    right = {x for x in every if x[2] in wanted}
    assert right <= few and len(few) <= 2 * len(right) + 100 < len(every)


def test_places_table(spark, genome, texts):
    """The table of places without an index of all k-mers: counts are of the whole genome; with wanted codes hardly any others are dealt out."""
    every = sorted((c, i, j) for i, j, c in map(tuple, cd.places(genome, "seq", 9, "chr_idx").collect()))
    n = Counter(c for c, _, _ in every)
    rows = lambda df: sorted(map(tuple, df.select("code", "count", "chr_idx", "pos").collect()))
    whole = [(c, n[c], i, j) for c, i, j in every]
    assert rows(ix.kmer_places(genome, None, 9)) == whole == rows(ix.kmer_places(genome, ix.kmer_index(genome, 9), 9))
    wanted = {every[i][0] for i in range(0, len(every), 500)}
    few = rows(ix.kmer_places(genome, None, 9, spark.createDataFrame([(c,) for c in wanted], "code long")))
    right = {x for x in whole if x[0] in wanted}
    assert right <= set(few) <= set(whole) and len(few) <= 2 * len(right) + 100 < len(whole)


def test_index_counts_and_ranks_whole_groups(spark):
    """Against Python, with k-mers of other characters; no task deals rows of single k-mers."""
    rng = random.Random(41)
    seqs = ["".join(rng.choice("AACGTN#" if i % 2 else "ACGT") for _ in range(n)) for i, n in enumerate((0, 3, 9, 40, 5000, 9000))]
    genome = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "chr_idx long, seq string")
    for k in (3, 7, 14, 25):
        counts = Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))
        want, before = [], 0
        for kmer in sorted(counts):
            want.append((kmer, before, counts[kmer]))
            before += counts[kmer]
        got = sorted((r.kmer, r.first_rank, r["count"], r.code) for r in ix.kmer_index(genome, k).collect())
        assert [g[:3] for g in got] == want
        assert all((g[3] < 0) == bool(set(g[0]) - set("ACGT")) for g in got)
    assert dict(cd.grouped(genome, "seq", 14).dtypes)["codes"] == "binary"
    assert ix.kmer_index(genome.where("chr_idx = 0"), 14).collect() == []


def test_filter_comes_to_the_driver_as_bits(spark, monkeypatch):
    """The bits are packed by the executors; a row for each of their bytes was collected at once."""
    wanted = spark.range(200_000).select((F.col("id") * 7919).alias("code"))
    rows, keep = [], cd.fetched
    monkeypatch.setattr(type(wanted), "toArrow", lambda self: (_ for _ in ()).throw(AssertionError("collected whole")))
    monkeypatch.setattr(cd, "fetched", lambda df: (rows.append(r) or r for r in keep(df)))
    out, bits = cd.code_filter(wanted)
    slot = cd._slots(np.arange(200_000) * 7919, bits)
    expected = np.zeros(1 << bits, np.uint8)
    expected[slot] = 1
    assert (np.unpackbits(out, bitorder="little") == expected).all()
    assert len(rows) == 1 << bits - cd.LEAST_BITS
