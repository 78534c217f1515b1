"""Counters by value: ingest in both modes, conversion progress, metrics."""

import json

from entitymill.operators import stats, validate
from pyspark.sql import functions as F

RAW = "seq long, source_file string, id_raw string, name_raw string, alias_a_raw string, alias_b_raw string, extras_raw string"


def checked(spark):
    rows = [(1, "a", "1", "N", "+15550000001", "ann", '{"a":1}'), (2, "a", "0x", "", "", "", ""), (3, "a", "2", "", "", "bob", "{}"), (4, "b", "1", "", "", "", ""), (5, "b", "3", "", "12", "x!", " {} "), (6, "b", "2", "", "+15550000002", "", '{"b":2}'), (7, "b", "", "", "", "", "")]
    return validate.validate(spark.createDataFrame(rows, RAW))


def test_ingest_counts_in_both_modes(spark):
    names = ("read", "parsed", "invalid", "inserts", "updates", "duplicates", "alias_writes", "extras_retained")
    got = {r.source_file: tuple(r[n] for n in names) for r in stats.ingest_stats(checked(spark)).collect()}
    # row 4 writes both aliases that id 1 carries, row 6 both of id 2; id 1 keeps its extras
    assert got == {"a": (3, 3, 1, 2, 0, 0, 3, 1), "b": (4, 4, 1, 1, 2, 0, 4, 2), "total": (7, 7, 2, 3, 2, 0, 7, 3)}
    got = {r.source_file: tuple(r[n] for n in names) for r in stats.ingest_stats(checked(spark), skip_known=True).collect()}
    assert got == {"a": (3, 3, 1, 2, 0, 0, 3, 1), "b": (4, 4, 1, 1, 0, 2, 0, 0), "total": (7, 7, 2, 3, 0, 2, 3, 1)}
    malformed = checked(spark).withColumn("reason", F.when(F.col("seq") == 2, "line too long").otherwise(F.col("reason")))
    assert {r.source_file: (r.read, r.parsed, r.invalid) for r in stats.ingest_stats(malformed).collect()}["a"] == (3, 2, 1)


def test_ingest_counts_of_nothing(spark):
    assert [(r.source_file, r.read) for r in stats.ingest_stats(checked(spark).where("false")).collect()] in ([], [("total", 0)])


def test_conversion_progress(spark):
    seconds = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "source_file string, seconds double")
    got = {r.source_file: tuple(r)[1:] for r in stats.convert_stats(checked(spark), F.lit(10), seconds).collect()}
    assert got["a"] == (3, 2, 1, 30, 1.5, round(300 / 7, 4), round(40 / 15, 4))
    assert got["b"] == (4, 3, 1, 40, 0.0, 100.0, 0.0)


def test_metrics(spark):
    rows = [(1, "hit", 10.0, "d1", 2), (1, "miss", 30.0, "d2", -3), (2, "invalid", -5.0, "d2", None)]
    looked = spark.createDataFrame(rows, "user_id long, outcome string, latency_ms double, day string, amount long")
    r = stats.ops_metrics(looked, F.lit("d2"), 1000, 1.0).first()
    assert (r.total, r.successful, r.failed, r.today, r.users, r.avg_latency, r.peak_latency, r.hit_rate, r.point_usage, r.rows_per_second) == (3, 1, 2, 2, 2, 20.0, 30.0, 0.5, 2, 1000.0)
    assert json.loads(r.export) == {k: v for k, v in r.asDict().items() if k != "export"}
    none = stats.ops_metrics(looked.where("false"), F.lit("d2"), 0, 0.0).first()
    assert (none.total, none.hit_rate, none.point_usage, none.rows_per_second) == (0, 0.0, 0, 0.0)
