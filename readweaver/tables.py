"""Tables between the steps of a query."""
from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, Row

#: Parts in which a result of bounded size comes to the driver.
PARTS = 8


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as a table below the folder that the cluster names in spark.checkpoint.dir, and read back.

    A table, unlike a checkpoint, brings its own size along; sizes estimated through the rounds of a loop double their digits each time.
    Where no folder is named, a local master, whose executors are this machine, takes a temporary one; any other is told to name one.
    """
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(named or _local_folder()).rstrip('/')}/tables/{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `durable` gave and nothing reads any more; others are left alone.

    The driver's JVM is told to collect garbage, too: shuffle files stay on the disks until it does.
    """
    for df in tables:
        if path := df.__dict__.pop("_durable", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            sc._jvm.System.gc()


def fetched(df: DataFrame) -> Iterator[Row]:
    """The rows of a result of bounded size, an eighth of it at once; one job fetches a part, so in its own parts it would take a job for each shuffle partition."""
    return df.repartition(PARTS).toLocalIterator()


@cache
def _local_folder() -> str:
    """One for each process, which goes with it."""
    folder = tempfile.mkdtemp(prefix="tables-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
