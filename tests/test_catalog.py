"""Every catalogue query with SQL against DuckDB, on the smallest tables; the others must have rows."""
import duckdb
import pytest

from readweaver.plans import catalog, oracles

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    rel = con.sql(oracles.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    pick = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in pick) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.ORACLES)))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_seeds_leave_out_n(spark):
    """A run of N matches no run of N; the bases beside it do."""
    from readweaver.operators import seeds

    g = spark.createDataFrame([(0, "AACCTGATCG" + "N" * 30 + "GGATCCATTA")], "chr_idx long, seq string")
    r = spark.createDataFrame([(0, "AACCTGATCG" + "N" * 30), (1, "N" * 40)], "read_idx long, seq string")
    found = seeds.mem_islands(seeds.seed_hits(g, r, 8), 8).collect()
    assert [(x.read_idx, x.direction, x.read_start, x.length, x.pos) for x in found] == [(0, 0, 0, 10, 0)]


def test_stored_places(spark):
    """The table of places gives the hits that the genome gives, N and frequent k-mers left out; short stretches give none."""
    from readweaver.operators import index, seeds

    g = spark.createDataFrame([(0, "AACCTGATCG" + "N" * 30 + "GGATCCATTA" + "A" * 40), (1, "TTAACCTGATCGGATC"), (2, "")], "chr_idx long, seq string")
    r = spark.createDataFrame([(0, "AACCTGATCGGATCNGGATCCATT"), (1, "N" * 40), (2, "A" * 20), (3, ""), (4, None)], "read_idx long, seq string")
    places = index.kmer_places(g, index.kmer_index(g, 8), 8)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for most, least in ((10_000, 1), (5, 1), (10_000, 10), (10_000, 14)):
        want = rows(seeds.seed_hits(g, r, 8, most, least))
        assert rows(seeds.stored_hits(places, r, 8, most, least)) == want and want
    assert all(x[3] + 8 <= 14 for x in rows(seeds.seed_hits(g, r.where("read_idx = 0"), 8, 10_000, 14)) if x[1] == 0)


def test_first_windows(spark):
    from readweaver.config import WindowConfig
    from readweaver.operators import windows

    w = spark.createDataFrame([(0, d, c, i) for d in (0, 1) for c in (0, 1) for i in (1, 2)] + [(1, 1, 5, 1)], "read_idx long, direction int, chr_idx long, window_id long")
    assert sorted(map(tuple, windows.first_windows(w, WindowConfig(max_windows=3)).collect())) == [(0, 0, 0, 1), (0, 0, 0, 2), (0, 0, 1, 1), (1, 1, 5, 1)]


def test_matches_and_common_prefix_in_linear_time(spark):
    from pyspark.sql import functions as F

    from readweaver.functions import scalar as fn

    a, b = "ACGN" * 750_000, "ACGN" * 700_000 + "TTTT" * 50_000
    m = spark.createDataFrame([(a, b), ("", ""), ("N", "A")], "a string, b string").select(fn.matches("a", "b").alias("m"), fn.common_prefix("a", "b").alias("p")).collect()
    assert [(x.m.matched, x.m.unmatched, x.p) for x in m] == [(2_100_000, 150_000, 2_800_000), (0, 0, 0), (0, 0, 0)]
