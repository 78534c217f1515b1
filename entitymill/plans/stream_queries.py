"""Streaming forms over the given tables; each runs its stream to the end of the available data and returns the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, merge
from ..sources import shared
from ..sources.shared import new_folder
from ..sources.views import raw_entities, usage_events
from ..streaming import ingest as I
from ..streaming import state as S
from .queries import kept_tables


#: Rows of a file that a query writes for its stream, and input rows for each bucket of its kept tables.
_ROWS_PER_FILE, _ROWS_PER_BUCKET = 100_000, 500_000


def _buckets(n: int) -> int:
    return max(8, -(-n // _ROWS_PER_BUCKET))


def _in_order(rows: DataFrame, by: str, at: str, n: int) -> int:
    """Rows as ``n`` slices by value of ``by``, one after the other; the number of files of each: two or more, by its rows (fewer where a slice is tiny)."""
    files = max(2, -(-rows.count() // n // _ROWS_PER_FILE))
    cuts = sorted(set(rows.approxQuantile(by, [i / n for i in range(1, n)], 0.25 / n)))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.where(F.col(by) > int(low))
        part = part if high is None else part.where(F.col(by) <= int(high))
        part.repartition(files).write.mode("append").parquet(at)
    return files


def incremental_ingest(spark, d):
    at, raw = new_folder(spark, "ingest"), raw_entities(spark, d)
    schema = raw.schema
    for s in ("0", "1", "2"):
        raw.where(F.col("source_file") == s).write.mode("append").parquet(f"{at}/in")
        I.ingest(spark, f"{at}/in", schema, f"{at}/out", f"{at}/checkpoint")
    I.ingest(spark, f"{at}/in", schema, f"{at}/out", f"{at}/checkpoint")  # nothing new: adds no rows
    return spark.read.parquet(f"{at}/out").select("seq", "source_file", "id_raw")


def resumed_ingest(spark, d):
    """Rows by id after three deliveries of the same growing files: half of the lines, all of them, and all of them again."""
    at, raw = new_folder(spark, "resumed"), raw_entities(spark, d)
    half = raw.approxQuantile("seq", [0.5], 0.1)[0]
    n = raw.count()
    tables, parts = I.target(spark, f"{at}/target", _buckets(n)), max(1, n // (3 * _ROWS_PER_FILE))
    for k, part in enumerate((raw.where(F.col("seq") <= half), raw, raw)):
        out = part.select("source_file", "seq", F.col("id_raw").alias("id"), F.col("name_raw").alias("name"), F.col("alias_a_raw").alias("phone"), F.col("alias_b_raw").alias("username"))
        # part files of each source, whose lines only grow; each is written by one task
        lines = out.withColumn("p", F.pmod(F.xxhash64("seq"), F.lit(parts))).repartition(3 * parts, "source_file", "p").sortWithinPartitions("source_file", "p", "seq").drop("seq")
        lines.write.partitionBy("source_file", "p").options(header="true", emptyValue="", nullValue="").csv(f"{at}/new-{k}")
        shared.remove(spark, f"{at}/in")
        for s in ("0", "1", "2"):
            shared.make(spark, f"{at}/in/{s}.csv")
            for p in range(parts):
                new = f"{at}/new-{k}/source_file={s}/p={p}"
                for name in shared.names(spark, new):
                    if name.startswith("part-"):
                        shared.rename(spark, f"{new}/{name}", f"{at}/in/{s}.csv/part-{p:06d}.csv")
        I.ingest_files(tables, f"{at}/in")
    return tables.read("records").select("id", "n_rows")


def _upserted(spark: SparkSession, d: str):
    """The kept tables after a stream of three batches, each a slice of the raw rows in order."""
    at, raw = new_folder(spark, "upsert"), raw_entities(spark, d)
    files = _in_order(raw, "seq", f"{at}/in", 3)
    tables = I.target(spark, f"{at}/target", _buckets(raw.count()))
    I.upsert_stream(spark, f"{at}/in", raw.schema, tables, f"{at}/checkpoint", files)
    return tables


def stream_upsert(spark, d):
    return _upserted(spark, d).read("records").select("id", "name", "alias_a", "alias_b", "n_rows", "extras")


def stream_alias_index(spark, d):
    tables = _upserted(spark, d)
    records, out = tables.read("records"), None
    for alias in ("alias_a", "alias_b"):
        one = merge.with_current(tables.read(alias), records, alias).withColumn("kind", F.lit(alias))
        out = one if out is None else out.unionByName(one)
    return out


def stream_counts(spark, d):
    """Counts of all batches together, as each batch's own passes counted them."""
    kept = [m["counts"] for m in _upserted(spark, d).manifests()]
    names = ("read", "parsed", "invalid", "inserts", "updates")
    return spark.createDataFrame([tuple(sum(c[n] for c in kept) for n in names)], ", ".join(f"{n} long" for n in names))


def _drain(spark: SparkSession, stream: DataFrame, at: str, mode: str = "append") -> tuple[DataFrame, list[dict]]:
    """Runs one stream to the end of its input; what it wrote, with the batch of each row, and the record of each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    start = lambda: stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    batches = I.run_to_end(spark, start)
    return spark.read.parquet(f"{at}/out"), batches


def _timely(spark: SparkSession, rows: DataFrame, at: str, n: int = 6) -> DataFrame:
    """Rows as a stream of ``n`` micro-batches in order of time; each row is written once and read once."""
    files = _in_order(rows, "us", f"{at}/in", n)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")


def stream_rate_limit(spark, d):
    at = new_folder(spark, "limits")
    events = usage_events(spark, d).select("event_id", "user_id", "us")
    return _drain(spark, S.rate_limit_stream(_timely(spark, events, at)), at)[0].select("event_id", "user_id", "allowed")


def stream_ttl_hits(spark, d):
    """Probes of all kinds stream by, are looked up in the written index, and meet the cache's state."""
    at = new_folder(spark, "ttl")
    probes = _timely(spark, usage_events(spark, d).select("event_id", "us", "probe"), at)
    looked = lookup.routed_lookup(probes, lookup.search_index(*lookup.read_indexes(spark, kept_tables(spark, d))))
    return _drain(spark, S.ttl_hits_stream(looked), at)[0].select("event_id", "key", "cache_hit")


def stream_daily_usage(spark, d):
    at = new_folder(spark, "days")
    events = usage_events(spark, d).select("event_id", "us")
    stream = _timely(spark, events, at).withColumn("at", F.timestamp_micros("us"))
    out, _ = _drain(spark, I.count_days(stream), at, "update")
    return out.groupBy("day").agg(F.max_by("n", "batch").alias("n"))  # an updated day replaces its earlier count


def stream_progress(spark, d):
    """A row for every batch: its counts, how far the stream is, its rate and the time left."""
    at = new_folder(spark, "progress")
    raw = raw_entities(spark, d)
    raw.repartition(12).write.parquet(f"{at}/in")
    batches = [b for b in I.ingest(spark, f"{at}/in", raw.schema, f"{at}/out", f"{at}/checkpoint") if b["rows"]]
    rows = [(*p, b["parsed"], b["invalid"]) for p, b in zip(I.progress(batches, raw.count()), batches)]
    return spark.createDataFrame(rows, "batch long, rows long, done long, percent double, rows_per_second double, seconds_left double, parsed long, invalid long")


def stream_progress_totals(spark, d):
    """What all batches of ``stream_progress`` add up to: the part of it that no clock decides."""
    p = stream_progress(spark, d)
    return p.agg(F.sum("rows").alias("rows"), F.max("done").alias("done"), F.sum("parsed").alias("parsed"), F.sum("invalid").alias("invalid"), F.max("percent").alias("percent"), (F.max("batch") + 1 == F.count("*")).alias("every_batch"), F.min_by("seconds_left", "done").isNotNull().alias("timed"))
