"""Small helpers shared by the operators: inputs, checkpoints and column choice."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import PARTS, discard, durable, fetched  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator works on, named doc_id and text; all other columns are left behind, so their names cannot clash."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Texts in an Arrow batch where whole texts go to Python by the million.
BATCH = 1024


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Queries that run inside hand at most so many rows at once to Python: an executor holds batches of both sides for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most `per_class` labelled documents of each class.

    Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are used.
    The rows are those with the smallest hash of doc_id, so the choice is
    repeatable and independent of order and partitioning.  The id list that is
    broadcast has at most 2 * per_class rows (rows with the same doc_id and
    different labels or texts count once, the smaller label winning).
    """
    lab = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    chosen = None
    for k in (0, 1):
        part = lab.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
