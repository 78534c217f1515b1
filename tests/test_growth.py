"""Work that is done once for each row, and tables and files whose number goes with the rows."""

from entitymill.functions import clean as C
from entitymill.operators import jsontree, lookup
from entitymill.plans import stream_queries
from entitymill.sources import files, shared
from entitymill.sources import sorted as sorted_
from entitymill.streaming import ingest as I
from pyspark.sql import functions as F


def test_trim_strips_the_white_space_of_the_regular_expression(spark):
    chars = [chr(i) for i in [*range(1, 0x3100), 0xFEFF, 0x1F600]]
    rows = spark.createDataFrame([(a + "x" + a + "y" + b,) for c in chars for a, b in ((c, c), (" " + c, c + "\n"))] + [("",), (" 　",), (None,)], "v string")
    old = F.regexp_replace(C.text("v"), "(?U)^\\s++|(?<!\\s)\\s++$", "")
    assert rows.where(~C.trim("v").eqNullSafe(old)).count() == 0


def test_lines_taken_before_are_not_split_again(spark, tmp_path, monkeypatch):
    """a second delivery splits only its new lines, of every part file."""
    tables, split = I.target(spark, f"file://{tmp_path}/t", 4), []
    real = files.records
    monkeypatch.setattr(files, "records", lambda rows, *a, **k: (split.append(rows.count()), real(rows, *a, **k))[1])
    (tmp_path / "in" / "a.csv").mkdir(parents=True)
    for part in range(3):
        (tmp_path / "in" / "a.csv" / f"part-{part}.csv").write_text("id,phone\n" + "".join(f"{part}{i},\n".lstrip("0") for i in range(10, 20)))
    assert I.ingest_files(tables, f"file://{tmp_path}/in")
    with open(tmp_path / "in" / "a.csv" / "part-1.csv", "a") as f:
        f.write("7,\n8,\n")
    assert I.ingest_files(tables, f"file://{tmp_path}/in") and not I.ingest_files(tables, f"file://{tmp_path}/in")
    assert split == [33, 2] and tables.read("records").count() == 32


def test_growing_files_are_dealt_to_parts(spark, data, monkeypatch):
    """each source is as many part files as its rows need, and the same rows come out."""
    want = sorted(map(tuple, stream_queries.resumed_ingest(spark, data).collect()))
    at = []
    monkeypatch.setattr(stream_queries, "_ROWS_PER_FILE", 100, raising=False)
    monkeypatch.setattr(stream_queries, "new_folder", lambda s, what: at.append(shared.new_folder(s, what)) or at[-1])
    assert sorted(map(tuple, stream_queries.resumed_ingest(spark, data).collect())) == want
    assert [len(shared.names(spark, f"{at[0]}/in/{s}.csv")) for s in "012"] == [5, 5, 5]


def test_records_without_json_files_need_no_python(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,phone,city\n1,2,x\n,3,\n")
    folder = f"file://{tmp_path}"
    lines = files.lines(spark, folder, files.report(spark, folder))
    assert sorted(map(tuple, files.records(lines, jsonl=False).drop("start").collect()), key=str) == sorted(map(tuple, files.records(lines).drop("start").collect()), key=str)
    assert "ArrowEvalPython" not in files.records(lines, jsonl=False)._jdf.queryExecution().executedPlan().toString()


def test_an_earlier_merge_is_read_only_when_a_text_comes():
    """a record that a batch does not meet is passed on as it is."""
    assert jsontree.Merged('{"b":1, "a":2}').take("{}").text() == '{"b":1, "a":2}'
    assert jsontree.Merged('{"b":1, "a":2}').take('{"a":2}').text() == '{"a":2,"b":1}'
    plain = ['{"b":"\\u20ac","a":["x",null]}', '{"a":"q\\"\\n","c":{"d":true}}', '{"b":"z"}']
    merged = jsontree.Merged()
    for text in plain:
        merged.take(text)
    assert merged.left == jsontree._FEW - 3 and merged.text() == jsontree.write(merged.tree)
    assert merged.take('{"n":1.50}').left == 0 and merged.text() == jsontree.write(merged.tree)
    assert jsontree.Merged().take('{"a":"\\ud800"}').left == 0
    for i in range(5000):
        merged.take(f'{{"b":"{i}"}}')
    assert merged.text() == jsontree.write(merged.tree)


def test_buckets_and_files_go_with_the_rows(spark, tmp_path, monkeypatch):
    """no fixed number of tasks holds all rows of a batch or a kept table."""
    assert stream_queries._buckets(1000) == 8 and stream_queries._buckets(54_000_000) == 108
    monkeypatch.setattr(stream_queries, "_ROWS_PER_FILE", 50)
    assert stream_queries._in_order(spark.range(900), "id", f"file://{tmp_path}/in", 3) == 6
    assert len(list((tmp_path / "in").glob("part-*"))) == 18


def test_rows_of_a_sorted_table_are_worked_out_once(spark, tmp_path):
    """counting, sampling and dealing out read what was written once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    sorted_.write_sorted(spark.range(1000).mapInArrow(count, "id long"), "id", f"file://{tmp_path}/t")
    assert seen.value == 1000 and sorted_.read_sorted(spark, f"file://{tmp_path}/t").count() == 1000
    assert not (tmp_path / "t" / "undealt").exists()


def test_a_filter_by_kind_routes_no_probe_again(spark):
    """the filter reads the routed kind and holds no copy of what it comes from."""
    probes = spark.createDataFrame([(1, " 12 "), (2, "@Ann_1"), (3, "0x"), (4, None)], "event_id long, probe string")
    index = spark.createDataFrame([("id", "12", "12")], "kind string, key string, id string")
    looked = lookup.routed_lookup(probes, index)
    assert sorted((r.event_id, r.kind, r.key, r.outcome) for r in looked.collect()) == [(1, "id", "12", "hit"), (2, "alias_b", "ann_1", "miss"), (3, "alias_b", None, "invalid"), (4, "alias_b", None, "invalid")]
    plan = looked.where("kind = 'id'")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line]
