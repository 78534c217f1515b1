"""Counters of ingest, conversion and lookups as grouped jobs; a hot id is never one task's window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons of lines that never came to be fields.
MALFORMED = ("line too long", "no record")


def _since(column: str) -> Column:
    """Whether an id has had a value by a row's time, from the first row of the id that has one."""
    return F.coalesce(F.col("seq") >= F.col(column), F.lit(False))


def ingest_stats(checked: DataFrame, skip_known: bool = False) -> DataFrame:
    """``checked(source_file, seq, id, alias_a, alias_b, extras, reason)`` to counts by file, and in total.

    A later row of an id updates it; with ``skip_known`` it is a duplicate that writes
    nothing. An update writes the aliases that its id carries by then, and retains extras if any row so far had some.
    """
    ok = checked.where("reason is null")
    first = lambda condition: F.min(F.when(condition, F.col("seq")))
    filled = F.trim("extras").isin("", "{}") == F.lit(False)
    ids = ok.groupBy("id").agg(F.min("seq").alias("born"), *(first(F.col(c) != "").alias(f"has_{c}") for c in ("alias_a", "alias_b")), first(filled).alias("has_extras"))
    facts = ok.join(ids.withColumnRenamed("id", "of"), F.col("id") == F.col("of"))
    new = F.col("seq") == F.col("born")
    if skip_known:
        writes = {c: new & (F.col(c) != "") for c in ("alias_a", "alias_b")}
        kept = new & filled
    else:
        writes = {c: _since(f"has_{c}") for c in ("alias_a", "alias_b")}
        kept = _since("has_extras")
    number = lambda c: F.when(c, 1).otherwise(0).cast("long")
    done = facts.select("source_file", F.lit(1).alias("parsed"), F.lit(0).alias("invalid"), number(new).alias("inserts"), number(~new).alias("later"), (number(writes["alias_a"]) + number(writes["alias_b"])).alias("writes"), number(kept).alias("kept"))
    zero = F.lit(0).cast("long")
    lost = checked.where("reason is not null").select("source_file", F.when(F.col("reason").isin(*MALFORMED), 0).otherwise(1).alias("parsed"), F.lit(1).alias("invalid"), *(zero.alias(c) for c in ("inserts", "later", "writes", "kept")))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    sums = done.unionByName(lost).rollup("source_file").agg(F.count("*").alias("read"), *(total(c, c) for c in ("parsed", "invalid", "inserts")), total(F.lit(0) if skip_known else "later", "updates"), total("later" if skip_known else F.lit(0), "duplicates"), total("writes", "alias_writes"), total("kept", "extras_retained"))
    return sums.withColumn("source_file", F.coalesce("source_file", F.lit("total")))


def convert_stats(checked: DataFrame, size: Column, seconds: DataFrame) -> DataFrame:
    """Rows in, out and skipped of each file, and how far the conversion is once it is done with it.

    ``size`` is a row's bytes, ``seconds(source_file, seconds)`` what each file took; files go in order of name.
    The windows run over a row for each file.
    """
    files = checked.groupBy("source_file").agg(F.count("*").alias("input_rows"), F.count_if(F.col("reason").isNull()).alias("output_rows"), F.count_if(F.col("reason").isNotNull()).alias("skipped_rows"), F.sum(size).alias("bytes"))
    files = files.join(seconds, "source_file")
    so_far = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, 0)
    files = files.withColumns({"done": F.sum("bytes").over(so_far), "spent": F.sum("seconds").over(so_far), "total": F.sum("bytes").over(Window.partitionBy())})
    rate = F.when(F.col("seconds") > 0, F.col("input_rows") / F.col("seconds")).otherwise(F.lit(0.0))
    left = F.when((F.col("done") > 0) & (F.col("done") < F.col("total")), (F.col("total") - F.col("done")) / (F.col("done") / F.col("spent"))).otherwise(F.lit(0.0))
    percent = F.when(F.col("total") > 0, F.least(F.lit(100.0), 100.0 * F.col("done") / F.col("total"))).otherwise(F.lit(0.0))
    return files.select("source_file", "input_rows", "output_rows", "skipped_rows", "bytes", F.round(rate, 3).alias("rows_per_second"), F.round(percent, 4).alias("percent"), F.round(left, 4).alias("seconds_left"))


def ops_metrics(looked_up: DataFrame, today: Column, import_rows: int, import_seconds: float) -> DataFrame:
    """One row of lookup and import metrics, and the same as JSON. Negative latencies count in nothing but the number of lookups."""
    outcome = F.col("outcome")
    hits, misses = F.count_if(outcome == "hit"), F.count_if(outcome == "miss")
    latency = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    rate = F.lit(import_rows / import_seconds if import_seconds > 0 else 0.0)
    row = looked_up.agg(
        F.count("*").alias("total"),
        hits.alias("successful"),
        F.count_if(outcome != "hit").alias("failed"),
        F.count_if(F.col("day") == today).alias("today"),
        F.count_distinct("user_id").alias("users"),
        F.round(F.avg(latency), 4).alias("avg_latency"),
        F.max(latency).alias("peak_latency"),
        hits.alias("hits"),
        misses.alias("misses"),
        F.round(F.when(hits + misses > 0, hits / (hits + misses)).otherwise(F.lit(0.0)), 6).alias("hit_rate"),
        F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)).alias("point_usage"),
    ).withColumn("rows_per_second", F.round(rate, 3))
    return row.withColumn("export", F.to_json(F.struct(*row.columns)))
