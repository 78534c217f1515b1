"""The kept keyed tables: repeated batches, rewritten buckets, leftovers, and progress of every batch."""

import json

import pytest
from entitymill.operators import merge, validate
from entitymill.sources import shared
from entitymill.streaming import ingest as I
from pyspark.sql import functions as F

RAW = "seq long, source_file string, id_raw string, name_raw string, alias_a_raw string, alias_b_raw string, extras_raw string"


def raw(spark, rows):
    return spark.createDataFrame([(s, "f", i, n, a, b, x) for s, i, n, a, b, x in rows], RAW)


def state(tables):
    records = tables.read("records")
    index = merge.with_current(tables.read("alias_a"), records, "alias_a")
    return sorted(map(tuple, records.collect())), sorted(map(tuple, index.collect()))


FIRST = [(1, "1", "A", "+15550000001", "", '{"wo":"1","o":{"k":1}}'), (2, "2", "B", "+15550000002", "bob", "{}"), (3, "0x", "", "", "", "")]
SECOND = [(4, "1", "", "", "ann", '{"wo":"2","o":{"m":2}}'), (5, "3", "C", "+15550000001", "", ""), (6, "1", "", "", "", "")]


def test_batches_merge_into_kept_tables(spark, tmp_path):
    tables = I.target(spark, f"file://{tmp_path}/t", 8)
    I.upsert_batch(tables, raw(spark, FIRST), 0)
    I.upsert_batch(tables, raw(spark, SECOND), 1)
    records, index = state(tables)
    assert records == [("1", "A", "+15550000001", "ann", 3, '{"o":{"k":1,"m":2},"wo":["1","2"]}'), ("2", "B", "+15550000002", "bob", 1, "{}"), ("3", "C", "+15550000001", "", 1, "{}")]
    # a later row of id 1 without an alias takes its old one back from id 3
    assert index == [("+15550000001", "1", True), ("+15550000002", "2", True)]
    assert [m["counts"] for m in tables.manifests()] == [dict(read=3, parsed=2, invalid=1, inserts=2, updates=0), dict(read=3, parsed=3, invalid=0, inserts=1, updates=2)]
    # all in one batch gives the same
    once = I.target(spark, f"file://{tmp_path}/once", 8)
    I.upsert_batch(once, raw(spark, FIRST + SECOND), 0)
    assert state(once) == (records, index)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    tables = I.target(spark, f"file://{tmp_path}/t", 8)
    I.upsert_batch(tables, raw(spark, FIRST), 0)
    before, manifests = state(tables), tables.manifests()
    I.upsert_batch(tables, raw(spark, FIRST), 0)
    assert state(tables) == before and tables.manifests() == manifests
    # a batch that died after it had written, before its manifest, is applied over its leftovers
    tables.stage("records", 1, merge.upsert_with_extras(raw(spark, SECOND).select(F.col("id_raw").alias("id"), "seq", F.lit("junk").alias("name"), F.lit("").alias("alias_a"), F.lit("").alias("alias_b"), F.lit("").alias("extras"))))
    assert state(tables) == before
    I.upsert_batch(tables, raw(spark, SECOND), 1)
    assert [r[1] for r in state(tables)[0]] == ["A", "B", "C"]
    with pytest.raises(Exception, match="already exists"):
        shared.put_text(spark, f"{tables.path}/manifests/{1:012d}.json", "{}")


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    tables = I.target(spark, f"file://{tmp_path}/t", 16)
    I.upsert_batch(tables, raw(spark, [(i, str(i), "N", f"+1555{i:07d}", "", "") for i in range(1, 200)]), 0)
    before = tables.current()
    I.upsert_batch(tables, raw(spark, [(900, "7", "", "", "", '{"a":1}')]), 1)
    after = tables.current()
    assert {n: len(b) for n, b in after["rewritten"].items()} == {"records": 1, "alias_a": 1, "alias_b": 0}
    changed = [b for b, v in after["versions"]["records"].items() if before["versions"]["records"].get(b) != v]
    assert changed == [str(b) for b in after["rewritten"]["records"]]
    assert tables.read("records").count() == 199 and tables.read("records", tables.touched(raw(spark, [(1, "7", "", "", "", "")]), "id_raw")).where("id = '7'").first().extras == '{"a":1}'
    assert tables.vacuum() == 2 and tables.read("records").count() == 199
    assert json.loads(shared.get_text(spark, f"{tables.path}/manifests/{1:012d}.json"))["counts"] == dict(read=1, parsed=1, invalid=0, inserts=0, updates=1)


def test_an_empty_batch(spark, tmp_path):
    tables = I.target(spark, f"file://{tmp_path}/t", 4)
    I.upsert_batch(tables, raw(spark, [(1, "x", "", "", "", "")]), 0)
    assert tables.read("records").count() == 0 and tables.current()["counts"] == dict(read=1, parsed=0, invalid=1, inserts=0, updates=0)


def test_progress_of_every_batch(spark, tmp_path):
    """150 batches give 150 records: nothing depends on how many updates a query remembers."""
    src = f"file://{tmp_path}/in"
    rows = spark.range(0, 300, 1, 150).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("id_raw"))
    rows.write.parquet(src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src).observe("rows", *I.counters(validate.reason("id_raw")))
        batches = I.run_to_end(spark, lambda: stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start())
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert [b["batch"] for b in batches] == list(range(150)) and all(b["rows"] == b["read"] == 2 for b in batches)
    assert (sum(b["parsed"] for b in batches), sum(b["invalid"] for b in batches)) == (200, 100)
    assert I.progress(batches, 300)[-1][2:4] == (300, 100.0)
