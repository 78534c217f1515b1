"""Keyed tables that are kept from batch to batch: hashed buckets, of which a batch rewrites only those that it touches.

``data/<table>/v=<batch>/bucket=<b>`` holds a bucket as a batch left it, and a
manifest for each batch says which version of every bucket counts. The manifest is one small file,
so the tables of a batch change together or not at all. A batch whose manifest
stands is never applied again; one that failed before is, over its own leftovers.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


class KeyedTables:
    """``tables`` maps a table's name to its key column and the DDL of its columns."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifests(self) -> list[dict]:
        """Manifests in order of their batches; each names every bucket's version."""
        at = f"{self.path}/manifests"
        return [json.loads(shared.get_text(self.spark, f"{at}/{n}")) for n in shared.names(self.spark, at) if n.endswith(".json")]

    def current(self) -> dict:
        found = [n for n in shared.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        if not found:
            return {"batch": -1, "versions": {name: {} for name in self.tables}}
        return json.loads(shared.get_text(self.spark, f"{self.path}/manifests/{found[-1]}"))

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets that rows fall in: at most as many numbers as there are buckets."""
        return [r.b for r in rows.select(self.bucket(key).alias("b")).distinct().collect()]

    def read(self, name: str, only: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table as the last manifest (or another one) has it; with ``only``, these buckets and no file of others."""
        versions = (manifest or self.current())["versions"][name]
        wanted = set(versions) if only is None else {str(b) for b in only} & set(versions)
        paths = [f"{self.path}/data/{name}/v={versions[b]}/bucket={b}" for b in sorted(wanted, key=int)]
        schema = self.tables[name][1]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, name: str, batch: int, rows: DataFrame) -> None:
        """Writes the new rows of whole buckets, each bucket from one task, sorted by key; nothing reads them before ``commit``."""
        key, schema = self.tables[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        out = rows.select(*columns, self.bucket(key).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", key)
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}/v={batch}")

    def commit(self, batch: int, rewritten: dict[str, list[int]], counts: dict | None = None) -> None:
        versions = self.current()["versions"]
        for name, buckets in rewritten.items():
            there = {n.removeprefix("bucket=") for n in shared.names(self.spark, f"{self.path}/data/{name}/v={batch}")}
            versions[name] = {b: v for b, v in versions[name].items() if int(b) not in buckets} | {str(b): batch for b in buckets if str(b) in there}
        body = {"batch": batch, "versions": versions, "rewritten": {n: sorted(b) for n, b in rewritten.items()}, "counts": counts or {}}
        shared.put_text(self.spark, f"{self.path}/manifests/{batch:012d}.json", json.dumps(body))

    def vacuum(self) -> int:
        """Removes bucket versions that the last manifest doesn't name; the number of those."""
        versions, gone = self.current()["versions"], 0
        for name in self.tables:
            for v in shared.names(self.spark, f"{self.path}/data/{name}"):
                for b in shared.names(self.spark, f"{self.path}/data/{name}/{v}"):
                    if b.startswith("bucket=") and versions[name].get(b.removeprefix("bucket=")) != int(v.removeprefix("v=")):
                        shared.remove(self.spark, f"{self.path}/data/{name}/{v}/{b}")
                        gone += 1
        return gone
