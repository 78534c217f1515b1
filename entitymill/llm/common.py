"""Shared helpers: durable intermediate tables, table access and Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a local session may go without; it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-entitymill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def _lean(spark: SparkSession):
    """Inside, Spark removes the shuffle files of each execution at its end, and Arrow batches have 8 MB at most."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Scratch:
    """Intermediate tables of one run, written as Parquet to the shared folder.

    A written table cuts the lineage and outlives the executor that wrote it,
    and the shuffle files behind it go as soon as it stands. ``drop`` removes a
    table that no later step reads. What the result itself reads stays until the session's
    folder is cleared.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        with _lean(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str | pa.Array, most: int = 1 << 18, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows whose texts hold about ``most`` bytes; a longer text stands alone.

    ``column`` is the texts or their name. Numpy work on a run takes some
    hundred times its bytes, so short runs keep workers small.
    """
    texts = batch.column(column) if isinstance(column, str) else column
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def few(df: DataFrame, by: Column, most: int) -> DataFrame:
    """The ``most`` rows of smallest hash ``by``: a cut by value first, so that no task sorts more than some times ``most`` rows."""
    n = df.count()
    if n > 2 * most:
        df = df.where(by < F.lit(int(-(1 << 63) + (1 << 64) * 1.5 * most / n)))
    return df.orderBy(by).limit(most)
