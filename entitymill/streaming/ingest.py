"""Resumable ingest, a kept keyed target and progress records, with Structured Streaming."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from ..operators import merge, validate
from ..sources import files
from ..sources.keyed import KeyedTables

#: The record table and the index of each alias: key and columns.
TARGET = {
    "records": ("id", "id string, name string, alias_a string, alias_b string, n_rows long, extras string"),
    "alias_a": ("alias", "alias string, id string, seq long"),
    "alias_b": ("alias", "alias string, id string, seq long"),
    "progress": ("part", "part string, lines long"),
}
#: Lines of a file at most, in the numbers that order the rows of all deliveries.
_FILE_LINES = 1 << 36


class Recorder(StreamingQueryListener):
    """A row for every batch of the queries that run while it listens; nothing is forgotten, however many batches there are."""

    def __init__(self):
        self.batches: list[dict] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {k: v for row in (p.observedMetrics or {}).values() for k, v in row.asDict().items()}
        kept = sum(s.numRowsTotal for s in p.stateOperators)
        self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "ms": dict(p.durationMs).get("triggerExecution", 0), "state": kept, **seen})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def run_to_end(spark: SparkSession, start: Callable[[], object], wait: float = 60) -> list[dict]:
    """Starts a query that ends by itself and gives the record of each batch, in order."""
    recorder = Recorder()
    spark.streams.addListener(recorder)
    try:
        start().awaitTermination()
        recorder.ended.wait(wait)
    finally:
        spark.streams.removeListener(recorder)
    return sorted(recorder.batches, key=lambda b: b["batch"])


def counters(reason: Column) -> list[Column]:
    """What a pass over rows with a reason of rejection counts on its way."""
    return [F.count(F.lit(1)).alias("read"), F.count_if(reason.isNull()).alias("parsed"), F.count_if(reason.isNotNull()).alias("invalid")]


def ingest(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, files: int = 4) -> list[dict]:
    """One run over the files that earlier runs have not committed; the record of each batch with its counts."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    reason = validate.reason("id_raw")
    rows = rows.observe("rows", *counters(reason))
    return run_to_end(spark, lambda: rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def target(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTables:
    return KeyedTables(spark, path, TARGET, buckets)


def upsert_batch(tables: KeyedTables, raw: DataFrame, batch: int, also: dict[str, DataFrame] | None = None, notes: dict | None = None) -> None:
    """Merges a batch of raw rows into the record table and both alias indexes; of each only the buckets that it touches.

    A batch that is committed already changes nothing. Rows within a batch go in order of seq, batches in their own order.
    ``also`` are rows of other tables that replace those of their keys under the same manifest, ``notes`` numbers that go with its counts.
    """
    if batch <= tables.current()["batch"]:
        return
    counted = Observation()
    checked = validate.validate(raw).persist()
    try:
        rows = checked.observe(counted, *counters(F.col("reason"))).where("reason is null").drop("reason", "id_raw")
        # which buckets are touched is asked of the whole batch once; the counts come with it
        touched = {"records": tables.touched(rows, "id")}
        before = tables.current()
        replaced = {name: tables.touched(new, tables.tables[name][0]) for name, new in (also or {}).items()}
        for name, new in (also or {}).items():
            key = tables.tables[name][0]
            kept = tables.read(name, replaced[name], before).join(new.select(key), key, "left_anti")
            tables.stage(name, batch, kept.unionByName(new))
        if not touched["records"]:
            tables.commit(batch, replaced, (notes or {}) | counted.get | {"inserts": 0, "updates": 0})
            return
        old = tables.read("records", touched["records"], before)
        merged, added = Observation(), F.col("n_rows") - F.col("n_old")
        new = merge.upsert_with_extras(rows, old, tell_old=True)
        new = new.observe(merged, F.count_if((F.col("n_old") == 0) & (added > 0)).alias("inserts"), F.coalesce(F.sum(F.when(F.col("n_old") > 0, added).otherwise(added - 1)), F.lit(0)).alias("updates"))
        tables.stage("records", batch, new)
        for alias in ("alias_a", "alias_b"):
            writes = merge.alias_writes(rows, alias, old).persist()
            touched[alias] = tables.touched(writes, "alias")
            tables.stage(alias, batch, merge.last_writes(tables.read(alias, touched[alias], before).unionByName(writes)))
            writes.unpersist()
        tables.commit(batch, touched | replaced, (notes or {}) | counted.get | merged.get)
    finally:
        checked.unpersist()


def ingest_files(tables: KeyedTables, folder: str) -> bool:
    """Upserts the lines of a folder's files beyond those that earlier runs took; whether there were any.

    What was taken is a kept table of (part, lines), committed with the records. So a file
    that has grown adds its new lines, one delivered again adds none, and a run that failed is
    as if it had never been. Lines that come while a run reads are left to the next one.
    """
    spark, before = tables.spark, tables.current()
    facts = files.report(spark, folder).persist()
    try:
        counts = files.split_lines(spark, folder, facts).persist()
        done = tables.read("progress", manifest=before).withColumnRenamed("lines", "done")
        now = counts.groupBy("file", "part").agg(F.sum("n").alias("lines")).withColumn("key", F.concat_ws("/", "file", "part"))
        # a row for each part file with new lines
        grown = now.join(done.withColumnRenamed("part", "key"), "key", "left").where("lines > coalesce(done, 0)")
        grown = grown.withColumn("place_of_file", F.row_number().over(Window.orderBy("key"))).select(F.col("file").alias("gf"), F.col("part").alias("gp"), "key", "lines", "done", "place_of_file").persist()
        n, base = grown.count(), before.get("counts", {}).get("top", 0)
        if n:
            # lines that earlier runs took are never split into fields
            rows = files.line_numbers(files.lines(spark, folder, facts), counts).join(grown, (F.col("file") == F.col("gf")) & (F.col("part") == F.col("gp")))
            rows = rows.where("line_no > coalesce(done, 0) and line_no <= lines")
            rows = files.records(rows, jsonl=not facts.where("jsonl").isEmpty(), keep=("line_no", "place_of_file"))
            seq = F.lit(base) + F.col("place_of_file") * F.lit(_FILE_LINES) + F.col("line_no")
            raw = rows.select(seq.alias("seq"), F.col("file").alias("source_file"), F.col("id").alias("id_raw"), F.col("name").alias("name_raw"), F.col("phone").alias("alias_a_raw"), F.col("username").alias("alias_b_raw"), F.col("extras").alias("extras_raw"))
            progressed = grown.select(F.col("key").alias("part"), "lines")
            upsert_batch(tables, raw, before["batch"] + 1, {"progress": progressed}, {"top": base + (n + 1) * _FILE_LINES})
        grown.unpersist()
        counts.unpersist()
        return n > 0
    finally:
        facts.unpersist()


def upsert_stream(spark: SparkSession, source: str, schema: StructType, tables: KeyedTables, checkpoint: str, files: int = 1) -> list[dict]:
    """Upserts the files that earlier runs have not committed, ``files`` to a batch, in order of their arrival."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return run_to_end(spark, lambda: rows.writeStream.foreachBatch(lambda batch, n: upsert_batch(tables, batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def progress(batches: list[dict], total: int) -> list[tuple[int, int, int, float, float, float]]:
    """(batch, rows, rows so far, percent of the total, rows a second so far, seconds left at that rate) of each batch."""
    out, done, seconds = [], 0, 0.0
    for b in batches:
        done += b["rows"]
        seconds += max(b["ms"], 1) / 1000
        rate = done / seconds
        out.append((b["batch"], b["rows"], done, round(min(100.0, 100.0 * done / max(total, 1)), 4), round(rate, 3), round(max(total - done, 0) / rate, 3) if rate else 0.0))
    return out


def count_days(events: DataFrame) -> DataFrame:
    """Events by day with a watermark, so the state of old days is dropped."""
    return events.withWatermark("at", "2 days").groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
