"""A folder that driver and executors share, for files that operators write and read again, and small files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; a local session that has none gets a local folder, a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-entitymill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; a folder that isn't there has none."""
    at, fs = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new file; one that is there already is an error, so of two writers one fails."""
    at, fs = _hadoop(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    at, fs = _hadoop(spark, path)
    read = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8")
    finally:
        read.close()


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    at, fs = _hadoop(spark, path)
    return fs.makeQualified(at).toString()


def unescaped(spark: SparkSession, name: str) -> str:
    """The value that a partition folder's name stands for."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether the path was renamed; not where the new name is taken."""
    at, fs = _hadoop(spark, old)
    to, _ = _hadoop(spark, new)
    return not fs.exists(to) and fs.rename(at, to)


def make(spark: SparkSession, folder: str) -> None:
    at, fs = _hadoop(spark, folder)
    fs.mkdirs(at)


def state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and newest change of a file, or of the files right in a folder."""
    at, fs = _hadoop(spark, path)
    found = list(fs.listStatus(at))
    return sum(s.getLen() for s in found), max((s.getModificationTime() for s in found), default=0)
