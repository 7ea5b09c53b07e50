"""Reads as a stream: the same stateless plan for each micro-batch, and running counts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import AlignConfig
from ..plans import align as al

SCHEMA = "read_idx long, seq string, arrived timestamp"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Reads from Parquet files as they come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def align_stream(reads: DataFrame, genome: DataFrame, out: str, checkpoint: str, config: AlignConfig = AlignConfig(), report: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Aligns each micro-batch into out/batch=N, overwritten if a batch is tried again, so results come once; report gets the counts of each."""

    def one(batch: DataFrame, number: int) -> None:
        found = al.align(genome, batch.select("read_idx", "seq"), config)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if report:
            done = batch.sparkSession.read.parquet(f"{out}/batch={number}")
            report(number, {"reads": batch.count(), "aligned": done.where("status = 'SUCCESS'").select("read_idx").distinct().count()})

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def reads_per_window(reads: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Reads and bases that arrived in each window, late ones up to `late` included."""
    timed = reads.withWatermark("arrived", late)
    return timed.groupBy(F.window("arrived", width)).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions by gap: the merge of anchors into windows, over time."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.col(key), F.session_window(ts, gap).alias("session")).agg(F.count(F.lit(1)).alias("n")).select(key, "session.start", "session.end", "n")
