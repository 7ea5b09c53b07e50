"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from readweaver.plans import catalog  # noqa: E402

HEADLINE = (
    "dna_derive", "base_composition", "kmer_index", "seed_hits", "best_mem", "seed_anchor_flag", "window_topk", "stitch_dp", "align_report",
    "chromosome_of_pos", "event_sessions", "exon_introns", "junction_collapse", "junction_dedup1",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["two_strand_union"](spark, d).write.format("noop").mode("overwrite").save()  # start-up and code generation aren't timed
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    reads = spark.read.parquet(f"{d}/benchmark.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d).removeprefix("sf"),
        "million_reads_per_hour": round(reads / max(took["stitch_dp"], 1e-9) * 3600 / 1e6, 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
