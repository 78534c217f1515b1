"""Exact-key lookups as joins; Catalyst broadcasts a side only where its size allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..sources import sorted as sorted_


def key_lookup(probes: DataFrame, records: DataFrame, probe: str, key: str) -> DataFrame:
    """Every probe row with the record's columns and ``found``."""
    return probes.join(records.withColumn("found", F.lit(True)), probes[probe] == records[key], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def search_index(records: DataFrame, index_a: DataFrame, index_b: DataFrame) -> DataFrame:
    """One table ``(kind, key, id)`` of all exact keys; an alias whose record is missing finds nothing."""
    keys = records.select(F.lit("id").alias("kind"), F.col("id").alias("key"), "id")
    for kind, index in (("alias_a", index_a), ("alias_b", index_b)):
        keys = keys.unionByName(index.join(records.select("id"), "id", "left_semi").select(F.lit(kind).alias("kind"), F.col("alias").alias("key"), "id"))
    return keys


#: The kept tables and their keys.
TABLES = {"records": "id", "alias_a": "alias", "alias_b": "alias"}


def write_indexes(records: DataFrame, index_a: DataFrame, index_b: DataFrame, path: str, ranges: int | None = None) -> None:
    """The three keyed tables as files by ranges of their keys, so a look-up opens only those that can hold its keys."""
    for (name, key), rows in zip(TABLES.items(), (records, index_a, index_b)):
        sorted_.write_sorted(rows, key, f"{path}/{name}", ranges)


def read_indexes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(sorted_.read_sorted(spark, f"{path}/{name}") for name in TABLES)


def kept_key_lookup(probes: DataFrame, path: str, probe: str, name: str = "records") -> DataFrame:
    """``key_lookup`` over a kept table: ranges that no probe falls in are not read."""
    key = TABLES[name]
    return key_lookup(probes, sorted_.around(probes.sparkSession, f"{path}/{name}", key, probes, probe), probe, key)


def kept_alias_lookup(probes: DataFrame, path: str, probe: str, name: str) -> DataFrame:
    """Alias to id to record over kept tables, two exact hops; ``found`` tells whether both met."""
    spark = probes.sparkSession
    index = sorted_.around(spark, f"{path}/{name}", "alias", probes, probe).select(F.col("alias").alias("key"), F.col("id").alias("of"))
    hop = probes.join(index, F.col(probe) == F.col("key"), "left").drop("key")
    records = sorted_.around(spark, f"{path}/records", "id", hop, "of")
    return hop.join(records.withColumn("found", F.lit(True)), F.col("of") == F.col("id"), "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("of")


def routed_lookup(probes: DataFrame, index: DataFrame, probe: str = "probe") -> DataFrame:
    """Adds kind, key, id and outcome (hit, miss or invalid) to every probe row, by one equi-join on (kind, key)."""
    # a probe is routed once, behind a generator that no filter by kind or outcome is moved through
    routed = probes.withColumn("routed", F.struct(C.route(probe).alias("kind"), C.probe_key(probe).alias("key"))).select(*probes.columns, F.inline(F.array("routed")))
    found = routed.join(index.select(F.col("kind").alias("ik"), F.col("key").alias("iv"), "id"), (F.col("kind") == F.col("ik")) & (F.col("key") == F.col("iv")), "left").drop("ik", "iv")
    return found.withColumn("outcome", F.when(F.col("key").isNull(), "invalid").when(F.col("id").isNull(), "miss").otherwise("hit"))
