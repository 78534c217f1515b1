"""Tables kept in order of a key: files by ranges, sorted inside, with a small table of the ranges.

``data/r=<n>`` holds the n-th range of keys and ``zones`` its smallest and largest key and its
rows. A look-up asks the zones which ranges it needs, so no other file is opened; within a file,
row groups are skipped by their least and largest keys and by Bloom filters.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import shared

#: Keys of a look-up that are sent into the scan as a filter; the ranges are chosen for any number of keys.
MOST_POINTS = 1000
_ROWS_PER_RANGE = 1_000_000


def write_sorted(rows: DataFrame, key: str, path: str, ranges: int | None = None) -> None:
    """Ranges of about equal size; without a number of them, one for each million rows, at least 8.

    Rows are worked out once, into a folder that goes: they are counted, sampled for the ranges' edges and dealt out from there.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/undealt")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/undealt")
    if ranges is None:
        ranges = max(8, -(-rows.count() // _ROWS_PER_RANGE))
    dealt = rows.repartitionByRange(ranges, key).withColumn("r", F.spark_partition_id()).sortWithinPartitions(key)
    dealt.write.mode("overwrite").partitionBy("r").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(_ROWS_PER_RANGE)).parquet(f"{path}/data")
    kept = spark.read.schema(f"{dealt.schema[key].name} {dealt.schema[key].dataType.simpleString()}, r int").parquet(f"{path}/data")
    kept.groupBy("r").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
    shared.remove(spark, f"{path}/undealt")


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data").drop("r")


def zones(spark: SparkSession, path: str) -> list:
    """A row for each range, in order of keys: one for a million rows."""
    return sorted(spark.read.parquet(f"{path}/zones").collect(), key=lambda z: z.r)


def _ranges(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/data").where(F.col("r").isin(wanted or [-1])).drop("r")


def seek(spark: SparkSession, path: str, key: str, at, most: int) -> DataFrame:
    """The first ``most`` rows with a key of ``at`` or more; of the files only the first few ranges that hold them are read."""
    wanted, sure = [], 0
    for z in zones(spark, path):
        if z.high >= at and sure < most:
            wanted.append(z.r)
            sure += z.n if z.low >= at else 0
    return _ranges(spark, path, wanted).where(F.col(key) >= at).orderBy(key).limit(most)


def _bytes(value):
    return value.encode() if isinstance(value, str) else value


def around(spark: SparkSession, path: str, key: str, probes: DataFrame, probe: str) -> DataFrame:
    """Rows of the ranges that any probe's key may lie in; few probes also filter inside the files."""
    known = zones(spark, path)
    lows, highs = [_bytes(z.low) for z in known], [_bytes(z.high) for z in known]

    @F.pandas_udf(IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        def of(k) -> int:
            i = bisect.bisect_right(lows, _bytes(k)) - 1
            return i if i >= 0 and _bytes(k) <= highs[i] else -1

        return keys.map(of).astype("int32")

    keys = probes.where(F.col(probe).isNotNull()).select(F.col(probe).alias("k")).distinct()
    placed = keys.select("k", place("k").alias("z")).where("z >= 0")
    wanted = placed.groupBy("z").agg(F.count("*").alias("n")).collect()  # at most a row for each range
    rows = _ranges(spark, path, [known[w.z].r for w in wanted])
    if sum(w.n for w in wanted) <= MOST_POINTS:
        rows = rows.where(F.col(key).isin([r.k for r in placed.select("k").collect()]))
    return rows
