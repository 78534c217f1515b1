"""Kept tables in order of a key: which files a look-up opens, and that its rows are those of a plain join."""

from entitymill.operators import lookup
from entitymill.sources import sorted as S
from pyspark.sql import functions as F


def files_read(df):
    """Files that the scans of a plan opened, by their own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in metrics if m.contains("numFiles"))


def test_range_and_point_look_ups_skip_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(0, 20_000, 2).select(F.col("id").cast("string").alias("id"), (F.col("id") * 3).alias("v"))
    S.write_sorted(rows, "id", path, 16)
    everything = files_read(S.read_sorted(spark, path))
    assert everything == 16 and S.read_sorted(spark, path).count() == 10_000
    order = sorted(str(i) for i in range(0, 20_000, 2))
    for at, most in (("15", 20), ("0", 3), ("9999", 50), ("x", 5), ("9998", 1), ("", 2000)):
        got = S.seek(spark, path, "id", at, most)
        assert [r.id for r in got.collect()] == [k for k in order if k >= at][:most]
        assert files_read(got) <= 2 + most // 500
    probes = spark.createDataFrame([("100",), ("101",), (None,), ("19998",), ("zzz",), ("",)], "probe string")
    near = S.around(spark, path, "id", probes, "probe")
    assert files_read(near) <= 3 < everything and sorted(r.id for r in near.collect()) == ["100", "19998"]
    many = spark.range(0, 3000).select(F.col("id").cast("string").alias("probe"))
    near = S.around(spark, path, "id", many, "probe")
    assert {str(i) for i in range(0, 3000, 2)} <= {r.id for r in near.collect()}


def test_bloom_filters_are_written(spark, tmp_path):
    import pyarrow.parquet as pq

    S.write_sorted(spark.range(100).select(F.col("id").alias("k")), "k", f"file://{tmp_path}/t", 2)
    file = next((tmp_path / "t" / "data" / "r=0").glob("*.parquet"))
    with open(file, "rb") as f:
        assert pq.read_metadata(f).num_rows > 0
    assert file.stat().st_size > 100_000  # the filter for a million keys


def test_kept_look_ups_equal_plain_joins(spark, tmp_path, data):
    from entitymill.plans import queries

    path = f"file://{tmp_path}/i"
    records, a, b = queries.indexes(spark, data)
    lookup.write_indexes(records, a, b, path, 4)
    some = records.orderBy("id").limit(5).select(F.col("id").alias("probe")).unionByName(spark.createDataFrame([("none",), (None,)], "probe string"))
    plain = lookup.key_lookup(some, records, "probe", "id")
    kept = lookup.kept_key_lookup(some, path, "probe")
    assert sorted(map(str, kept.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    aliases = a.limit(20).select(F.col("alias").alias("probe")).unionByName(spark.createDataFrame([("+10",), (None,)], "probe string"))
    got = {r.probe: (r.id, r.found) for r in lookup.kept_alias_lookup(aliases, path, "probe", "alias_a").collect()}
    want = {r.alias: (r.id, True) for r in a.collect()}
    assert all(v == want.get(k, (None, False)) for k, v in got.items()) and len(got) == aliases.count()


def test_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    S.write_sorted(spark.createDataFrame([], "k string, v long"), "k", path)
    assert S.zones(spark, path) == [] or S.zones(spark, path)[0].n == 0
