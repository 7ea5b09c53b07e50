import os

from pyspark.sql import functions as F

from readweaver import cli, functions as fn
from readweaver.operators import genome as gn, index as ix, junctions as jn, seeds as sd
from readweaver.sources import fasta, fastq, gtf, sinks


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = write(tmp_path / "g.fa", ">one first\r\nacg tn\nACGTA\n\n>two\tx\nGGG\n>three\nTTTTT\nT\n")
    got = {r.name: (r.chr_idx, r.seq) for r in fasta.read_genome(spark, p).collect()}
    assert got == {"one": (0, "ACGTNACGTA"), "two": (1, "GGG"), "three": (2, "TTTTTT")}
    chunks = sorted((r.chr_idx, r.chunk_start, r.chunk) for r in fasta.rechunk(fasta.read_pieces(spark, p), 4, 2).collect())
    assert chunks == [(0, 0, "ACGTNA"), (0, 4, "NACGTA"), (0, 8, "TA"), (1, 0, "GGG"), (2, 0, "TTTTTT"), (2, 4, "TT")]
    lengths = {r.name: r.length for r in fasta.chromosome_lengths(fasta.read_pieces(spark, p)).collect()}
    assert lengths == {"one": 10, "two": 3, "three": 6}


def test_fasta_without_sequence(spark, tmp_path):
    import pytest

    with pytest.raises(fasta.EmptyGenomeError):
        fasta.read_genome(spark, write(tmp_path / "e.fa", ">x\n"))


def test_padding(spark):
    g = spark.createDataFrame([(0, "a", "A" * 16), (1, "b", "C" * 5), (2, "c", "G" * 16)], "chr_idx long, name string, seq string")
    rows = {r["name"]: (r.start, r.padded) for r in gn.with_padding(gn.chromosomes(g, 4), 4).join(gn.chromosomes(g, 4).select("chr_idx"), "chr_idx").collect()}
    assert rows == {"a": (0, 32), "b": (32, 16), "c": (48, 16)}
    where = gn.chromosome_of(spark.createDataFrame([(0,), (31,), (32,), (47,), (48,), (99,)], "pos long"), gn.chromosomes(g, 4), 4)
    assert {r.pos: (r.chr_idx, r.offset) for r in where.collect()} == {0: (0, 0), 31: (0, 31), 32: (1, 0), 47: (1, 15), 48: (2, 0), 99: (2, 51)}


def test_fastq(spark, tmp_path):
    a = write(tmp_path / "a.fq", "@r1 x\nACGTN\n+\n@@%II\n@r2\nGGCC\n+\nIIII\n@cut\nAC\n")
    b = write(tmp_path / "b.fq", "@r1/2\nAACC\n+\nABCD\n")
    one = {r.read_idx: r for r in fastq.read_single(spark, a).collect()}
    assert (one[0].name, one[0].seq_fwd, one[0].seq_rc, one[0].quality) == ("r1", "ACGTN", "NACGT", "@@%II") and len(one) == 2
    pair = fastq.read_paired(spark, a, b).collect()
    assert [(r.seq_fwd, r.quality, r.length, r.mate1_length, r.mate2_length) for r in pair] == [("ACGTN#GGTT", "@@%II DCBA", 10, 5, 4)]


GTF = """#c
one\ts\texon\t1\t10\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; gene_name "N"; gene_biotype "k";
one\ts\texon\t21\t30\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
one\ts\texon\t31\t40\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
one\ts\texon\t1\t10\t.\t+\t.\tgene_id "g2"; transcript_id "t2";
one\ts\texon\t21\t30\t.\t+\t.\tgene_id "g2"; transcript_id "t2";
one\ts\tgene\t1\t30\t.\t+\t.\tgene_id "g1";
nope\ts\texon\t1\t5\t.\t-\t.\tgene_id "g3"; transcript_id "t3";
one\ts\texon\t90\t101\t.\t-\t.\tgene_id "g3"; transcript_id "t3";
one\ts\texon\t50\t60\t.\t.\t.\tx "y";
"""


def test_gtf_to_junctions(spark, tmp_path):
    exons = gtf.read_exons(spark, write(tmp_path / "a.gtf", GTF))
    rows = {r.line_no: r for r in exons.collect()}
    assert rows[1].gene_name == "N" and rows[1].gene_type == "k" and rows[2].gene_name == "g1" and rows[2].gene_type == "MissingGeneType"
    assert rows[9].transcript_id == "tr_one_50_60_9" and rows[9].gene_id == "MissingGeneID" and rows[9].warning and rows[1].warning is None
    chrs = spark.createDataFrame([("one", 1000, 100)], "name string, start long, length long")
    kept, rejected = jn.exons_on(exons, chrs)
    assert {r.line_no: r.reason for r in rejected.collect()} == {7: "unknown chromosome", 8: "past the chromosome's end"}
    named = kept.withColumnsRenamed({"transcript_id": "transcript", "gene_id": "gene"})
    got = [(r.sj_start, r.sj_end, r.strand, r.genes) for r in jn.collapse(jn.introns(named)).collect()]
    assert got == [(1010, 1019, 1, ["g1", "g2"])]
    assert {r.gene: r.code for r in jn.encode(named, "gene", "line_no", "gene_name").collect()} == {"g1": 0, "g2": 1, "MissingGeneID": 2}


def test_repeat_shift(spark):
    rows = [("AAACCCGTTTTTTCCCGAA", 6, 15), ("ACGTNACGTN", 4, 8), ("A" * 600, 280, 299)]
    d = spark.createDataFrame(rows, "seq string, s int, e int")
    got = [(r.shift_left, r.shift_right) for r in jn.repeat_shift(d, "seq", "s", "e").collect()]

    def plain(seq, s, e):
        left = right = 0
        while left < 255 and s - left - 1 >= 0 and seq[s - left - 1] == seq[e - left] and seq[e - left] not in "N#":
            left += 1
        while right < 255 and e + 1 + right < len(seq) and seq[s + right] == seq[e + 1 + right] and seq[s + right] not in "N#":
            right += 1
        return left, right

    assert got == [plain(*r) for r in rows]


def test_suffixes_against_a_plain_sort(spark):
    seqs = ["ACGTACGNAC", "GGA", "ACG"]
    d = spark.createDataFrame(list(enumerate(seqs)), "i long, seq string")
    ranked = ix.suffix_ranks(ix.suffixes(d, 50, "i"), "i", "pos")
    got = [(r.i, r.pos) for r in ranked.orderBy("rank").collect()]
    key = lambda s: s.replace("N", "~") + "\x7f"
    want = sorted(((key(s[p:]), i, p) for i, s in enumerate(seqs) for p in range(len(s)) if s[p] != "N"))
    assert got == [(i, p) for _, i, p in want]


def test_mmp_against_brute_force(spark):
    import random

    rng = random.Random(2)
    g = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(3)]
    r = ["".join(rng.choice("ACGT") for _ in range(25)) for _ in range(4)] + [g[0][5:30], g[1][10:20] + g[2][3:15]]
    k = 4
    genome = spark.createDataFrame(list(enumerate(g)), "chr_idx long, seq string")
    reads = spark.createDataFrame(list(enumerate(r)), "read_idx long, seq string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    text = g + [rc(s) for s in g]
    count = lambda p: sum(s.startswith(p, i) for s in text for i in range(len(s)))
    for row in sd.mmp(genome, reads, k).collect():
        s = r[row.read_idx] if row.direction == 0 else rc(r[row.read_idx])
        piece = s[row.s :]
        n = max(x for x in range(len(piece) + 1) if x == 0 or count(piece[:x]))
        assert row.length == n and row.rep == (count(piece[:n]) if n >= k else None), (row, n)


def test_sql_functions(spark):
    fn.register(spark)
    row = spark.sql("SELECT dna('Hello, wörld') a, revcomp('ACGN#') b, kmer_code('ACGTT', 3) c, lce('abcdef', 'abcxef') d, splice_motif('GT', 'AG') e").first()
    assert tuple(row) == ("TATTGGCTT", "#NCGT", 6, 3, 1)
    assert [tuple(r) for r in spark.sql("SELECT * FROM kmers('ACGTA', 4) ORDER BY pos").collect()] == [(0, "ACGT"), (1, "CGTA")]


def test_command_line(spark, tmp_path):
    import random

    rng = random.Random(4)
    c = "".join(rng.choice("ACGT") for _ in range(3000))
    fa = write(tmp_path / "g.fa", ">chrA\n" + "\n".join(c[i : i + 70] for i in range(0, 3000, 70)) + "\n")
    fq = write(tmp_path / "r.fq", "".join(f"@q{i}\n{c[100 * i : 100 * i + 90]}\n+\n{'I' * 90}\n" for i in range(5)))
    gt = write(tmp_path / "a.gtf", 'chrA\ts\texon\t1\t10\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchrA\ts\texon\t100\t110\t.\t+\t.\tgene_id "g"; transcript_id "t";\n')
    args = cli.parser().parse_args(["--mode", "both", "--genomeFile", fa, "--readFile", fq, "--gtfFile", gt, "--genomeDir", f"{tmp_path}/idx", "--outPutDir", f"{tmp_path}/out", "--filters.max_multimap", "5"])
    config = cli.config_of(args)
    assert config.filters.max_multimap == 5
    cli.generate(spark, args, config)
    cli.align(spark, args, config)
    records = sorted(r.value.split("\t")[0:6] for r in spark.read.text(f"{tmp_path}/out/sam/records").collect())
    assert records == [[f"q{i}", "0", "chrA", str(100 * i + 1), "255", "90M"] for i in range(5)]
    assert {r.value for r in spark.read.text(f"{tmp_path}/out/report").collect()} >= {"total\t5", "unique\t5"}
    assert sinks.load_index(spark, f"{tmp_path}/idx", "junction")["junction"].count() == 1
    assert os.path.isdir(f"{tmp_path}/idx/text/name")


def test_streams(spark, tmp_path):
    from readweaver.streaming import reads as rs

    c = "ACGTTGCAAGCTTAGGCTTACCGATCGGATTACAGATTACACGGATTCAGGCATTACGGATCAGGACTTAAGC" * 1
    genome = spark.createDataFrame([(0, "x", c)], "chr_idx long, name string, seq string")
    rows = spark.createDataFrame([(0, c[:60], 0), (1, c[5:65], 100), (2, "T" * 60, 100)], "read_idx long, seq string, t long").select("read_idx", "seq", F.timestamp_seconds("t").alias("arrived"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    q = rs.align_stream(rs.read_stream(spark, f"{tmp_path}/in"), genome, f"{tmp_path}/out", f"{tmp_path}/ck", report=lambda n, c: seen.append(c))
    q.processAllAvailable()
    q.stop()
    assert seen == [{"reads": 3, "aligned": 2}]
    w = rs.reads_per_window(rs.read_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("complete").start()
    w.processAllAvailable()
    assert sorted(r.reads for r in spark.sql("select * from w").collect()) == [1, 2]
    w.stop()
