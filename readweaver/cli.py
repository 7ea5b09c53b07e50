"""Command line: python -m readweaver.cli --mode genomeGenerate|readAlign ..."""
from __future__ import annotations

import argparse
import time
from dataclasses import fields, replace

from pyspark.sql import SparkSession, functions as F

from .config import AlignConfig
from .operators import genome as gn, index as ix, junctions as jn, sam, select as sl
from .plans import align as al
from .sources import fasta, fastq, gtf, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readweaver")
    p.add_argument("--mode", choices=("genomeGenerate", "readAlign", "both"), required=True)
    for name in ("genomeFile", "readFile", "readFile2", "gtfFile"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--outPutDir", default=".")
    p.add_argument("--genomeDir", default=".")
    for part in fields(AlignConfig):
        kind = part.default_factory
        for f in fields(kind):
            default = getattr(kind(), f.name)
            if isinstance(default, (int, float, str)):
                p.add_argument(f"--{part.name}.{f.name}", type=type(default), default=default)
    return p


def config_of(args: argparse.Namespace) -> AlignConfig:
    out = AlignConfig()
    for part in fields(AlignConfig):
        own = getattr(out, part.name)
        given = {f.name: getattr(args, f"{part.name}.{f.name}") for f in fields(own) if hasattr(args, f"{part.name}.{f.name}")}
        out = replace(out, **{part.name: replace(own, **given)})
    return out


def generate(spark: SparkSession, args: argparse.Namespace, config: AlignConfig) -> None:
    """Genome, chromosome, k-mer and, with annotation, junction tables."""
    genome = fasta.read_genome(spark, args.genomeFile)
    chrs = gn.chromosomes(genome, config.genome.bin_size)
    tables = {"genome": genome, "chromosome": chrs, "kmer": ix.kmer_index(genome, config.genome.kmer_size)}
    loci = None
    if args.gtfFile:
        exons, rejected = jn.exons_on(gtf.read_exons(spark, args.gtfFile, config.annotation), chrs)
        renamed = exons.withColumnsRenamed({"transcript_id": "transcript", "gene_id": "gene"})
        tables |= {"junction": jn.collapse(jn.introns(renamed)), "transcript": jn.encode(renamed, "transcript", "line_no", "strand"), "gene": jn.encode(renamed, "gene", "line_no", "gene_name", "gene_type"), "exon_rejected": rejected, "exon_warning": exons.where("warning is not null")}
        loci = gn.chromosome_of(tables["junction"], chrs, config.genome.bin_size, "sj_start").select("chr_idx", F.col("offset").alias("start"), (F.col("sj_end") - F.col("sj_start") + F.col("offset")).alias("end"), "strand", "priority", "genes")
    sinks.write_index(args.genomeDir, **tables)
    k = config.genome.kmer_size
    stored = sinks.load_index(spark, args.genomeDir, "genome", "kmer")
    sinks.write_index(args.genomeDir, place=ix.kmer_places(stored["genome"], stored["kmer"], k))
    # without annotation the table of junctions is empty, so that an index holds no other's
    nothing = spark.createDataFrame([], f"chr_idx {dict(genome.dtypes)['chr_idx']}, start long, end long, strand int, priority int, genes array<string>")
    sinks.write_index(args.genomeDir, sjdb=jn.database(nothing if loci is None else loci, genome, config.annotation.overhang))
    sjdb = sinks.load_index(spark, args.genomeDir, "sjdb")["sjdb"]
    spliced = sjdb.select(F.col("sj_idx").alias("chr_idx"), F.col("sj_seq").alias("seq"))
    sinks.write_index(args.genomeDir, sjdb_kmer=ix.kmer_index(spliced, k))
    sinks.write_index(args.genomeDir, sjdb_place=ix.kmer_places(spliced, sinks.load_index(spark, args.genomeDir, "sjdb_kmer")["sjdb_kmer"], k))
    sinks.write_index(args.genomeDir, info=spark.createDataFrame([(k,)], "kmer_size int"))
    sinks.write_chromosomes(chrs, f"{args.genomeDir}/text")


def align(spark: SparkSession, args: argparse.Namespace, config: AlignConfig) -> None:
    """SAM records, the final report and that of the progress."""
    began = time.time()
    tables = sinks.load_index(spark, args.genomeDir, "genome", "chromosome", "sjdb", "place", "sjdb_place", "info")
    if (k := tables["info"].first().kmer_size) != config.genome.kmer_size:
        raise ValueError(f"the index has k-mers of {k} bases, the options ask for {config.genome.kmer_size}")
    reads = fastq.read_paired(spark, args.readFile, args.readFile2) if args.readFile2 else fastq.read_single(spark, args.readFile)
    plain = reads.select("read_idx", F.col("seq_fwd").alias("seq"))
    seeds = al.placed_seeds(tables["genome"], plain, config, tables["sjdb"], tables["place"], tables["sjdb_place"])
    # the alignment and the status of reads without one both need the seeds: they are found once
    seeds.write.mode("overwrite").parquet(f"{args.outPutDir}/seed")
    seeds = spark.read.parquet(f"{args.outPutDir}/seed")
    _, kept = al.seeded_windows(tables["genome"], seeds, config)
    found = sl.select_alignments(al.stitched(tables["genome"], plain, kept, config), config.filters)
    found.write.mode("overwrite").parquet(f"{args.outPutDir}/alignment")
    found = spark.read.parquet(f"{args.outPutDir}/alignment")
    names = tables["chromosome"].select("chr_idx", F.col("name").alias("chr"))
    sinks.write_sam(sam.records(found.where("status = 'SUCCESS'"), reads, names), f"{args.outPutDir}/sam", sinks.sam_header(tables["chromosome"]))
    sinks.write_report(sl.report(sl.read_status(plain, seeds, found)), f"{args.outPutDir}/report")
    sinks.write_progress(spark, f"{args.outPutDir}/progress", began, time.time(), plain.count())


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("readweaver").getOrCreate()
    config = config_of(args)
    if args.mode in ("genomeGenerate", "both"):
        generate(spark, args, config)
    if args.mode in ("readAlign", "both"):
        align(spark, args, config)


if __name__ == "__main__":
    main()
