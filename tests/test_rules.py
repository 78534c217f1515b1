"""Literal cases of the rules."""

import json
from collections import deque

from entitymill.functions import clean as C
from entitymill.operators import mapping, merge, profile, usage, validate
from entitymill.operators.ordered import allow
from entitymill.plans import file_queries
from entitymill.sources import files
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_cleaning(spark):
    cases = [
        (C.clean_alias_a, "+1 (555) 123-4567", "+15551234567"),
        (C.clean_alias_a, "12", ""),
        (C.clean_alias_a, None, ""),
        (C.canonical_alias_a, "+1 (555) 123-4567", "15551234567"),
        (C.canonical_alias_a, "555x1234567", ""),
        (C.clean_alias_b, "@Alice_User", "alice_user"),
        (C.clean_alias_b, "ab", ""),
        (C.clean_alias_b, "x!", ""),
        (C.clean_alias_b, "\U0001f525PeRes_OK\U0001f525", "peres_ok"),
        (C.trim, "  a b ", "a b"),
        (C.route, "123", "id"),
        (C.route, "+1 555", "alias_a"),
        (C.route, "(555) 12-34-56", "alias_a"),
        (C.route, "", "alias_b"),
        (C.probe_key, "007", None),
        (C.probe_key, "@Bob_1", "bob_1"),
    ]
    for f, value, want in cases:
        assert one(spark, value, f("v")) == want, (f.__name__, value)
    assert [one(spark, v, C.is_id(F.col("v"))) for v in ("0", "01", "0x1", "9" * 32, "9" * 33)] == [True, False, False, True, False]


def test_rows_in_are_accepted_or_rejected(spark, data):
    from entitymill.sources.views import raw_entities

    raw = raw_entities(spark, data)
    assert validate.accepted(raw).count() + validate.rejects(raw).count() == raw.count()


def test_update_merge_keeps_earlier_fields(spark):
    rows = spark.createDataFrame([("1", 1, "A", "+1555", "", '{"wo":"1","x":"y"}'), ("1", 2, "", "", "bob", '{"wo":"2"}'), ("1", 3, "", "", "", '{"wo":"3"}')], "id string, seq long, name string, alias_a string, alias_b string, extras string")
    got = merge.upsert(rows).first()
    assert (got.name, got.alias_a, got.alias_b, got.n_rows) == ("A", "+1555", "bob", 3)
    assert {r.key: r.merged for r in merge.merge_json_keys(rows).collect()} == {"wo": '[["1","2"],"3"]', "x": '"y"'}
    assert merge.first_wins(rows).first().seq == 1


def test_alias_is_reclaimed_by_a_later_row(spark):
    rows = spark.createDataFrame([("1", 1, "a"), ("2", 2, "a"), ("1", 3, "")], "id string, seq long, alias_a string")
    assert merge.alias_index(rows, "alias_a").collect() == [("a", "1", True)]


def test_sliding_log():
    log = deque()
    assert [allow(log, t, 2, 10) for t in (0, 1, 5, 10, 11, 11)] == [True, True, False, True, True, False]
    assert allow(deque(), 0, 0, 10)


def test_balances_agree(spark, data):
    from entitymill.sources.views import usage_events

    e = usage_events(spark, data)
    total = usage.ledger(e).agg(F.sum("signed")).first()[0]
    last = usage.running_balance(e).groupBy("user_id").agg(F.max_by("balance", "event_id").alias("b")).agg(F.sum("b")).first()[0]
    assert total == last


def test_a_hot_ledger_is_summed_in_blocks(spark):
    """One user, or the rows without one, with half of all rows: blocks of ids give the sums that one window gives."""
    rows = [(i, 7 if i % 2 else (None if i % 6 == 0 else i % 5), "credit" if i % 3 else "debit", 1 + i % 4) for i in range(3000)]
    money = spark.createDataFrame(rows, "event_id long, user_id long, ledger_type string, amount long")
    want = sorted(map(str, usage.running_balance(money).collect()))
    got = usage.running_balance(money, hot_rows=300, block_ids=64)
    assert sorted(map(str, got.collect())) == want
    largest = usage.ledger(money).where("user_id = 7").groupBy(F.floor(F.col("event_id") / 64)).count().agg(F.max("count")).first()[0]
    assert largest <= 64


def test_text_rules(spark):
    texts = ["a\tb\n c", "x" * 4097, "a\x01b", None, "  ", "zero​width"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: (r.clean, r.reason) for r in validate.sanitize_text(df, "text").collect()}
    assert got == {0: ("a b c", None), 1: (None, "exceeds size"), 2: (None, "control characters"), 3: (None, "is empty"), 4: (None, "is empty"), 5: ("zerowidth", None)}
    bad = spark.createDataFrame([("1' OR 1=1",), ("O'Brien",)], "text string")
    assert sum(r.matches for r in validate.injection_counts(bad, "text").collect()) >= 1
    assert sum(r.matches for r in validate.injection_counts(bad.where("text like 'O%'"), "text").collect()) == 0
    paths = spark.createDataFrame([("../x",), ("..\\x",), ("/ok/a",)], "p string").select(validate.path_reason("p", ["/ok/"]).alias("r"))
    assert [r.r for r in paths.collect()] == ["parent segment", "parent segment", None]


def test_header_roles(spark):
    df = spark.createDataFrame([(1, ["Telegram_ID", "user-id", "First Name", "last_name", "Mobile", "NickName", "foo"])], "file int, fields array<string>")
    assert [r.role for r in mapping.header_roles(df).orderBy("idx").collect()] == ["id", "extras", "name", "lastname", "phone", "username", "extras"]


def test_records(spark):
    lines = ['{"telegram_id": "", "name": "A"}', '{"id": 5, "name": "B"}', '{"userId": 12345678901234567890, "firstName": "C", "nick": "Иван", "t": [1]}', '{"uid": "7", "nick": "Tanya_y"}', "nonsense"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    got = {r.line_no: tuple(r)[1:] for r in mapping.map_records(df).collect()}
    assert [got[i][0] for i in range(5)] == [None, None, "12345678901234567890", "7", None]
    assert got[2][1:4] == ("C", "", "") and '"t":[1]' in got[2][4]
    assert got[3] == ("7", "Tanya_y", "", "tanya_y", "{}")


def test_extras_keep_their_types(spark):
    """Numbers, booleans, lists, objects and escapes of extras are the JSON they were."""
    line = '{"uid": "7", "n": 7, "b": true, "o": {"a": 1}, "s": "x\\"y", "z": null, "city": "x"}'
    got = mapping.map_records(spark.createDataFrame([(1, line)], "line_no int, value string")).first()
    assert json.loads(got.extras) == {"n": 7, "b": True, "o": {"a": 1}, "s": 'x"y', "z": None, "city": "x"}
    rows = spark.createDataFrame([("1", 1, '{"a":"x\\"y","b":1}'), ("1", 2, '{"a":5,"b":true}'), ("1", 3, "no json"), ("2", 1, "{}")], "id string, seq long, extras string")
    assert {r.key: json.loads(r.merged) for r in merge.merge_json_keys(rows).collect()} == {"a": ['x"y', 5], "b": [1, True]}
    full = {r.id: r for r in merge.upsert_with_extras(rows.withColumns({c: F.lit("v") for c in ("name", "alias_a", "alias_b")})).collect()}
    assert json.loads(full["1"].extras) == {"a": ['x"y', 5], "b": [1, True]} and full["2"].extras == "{}"


def test_rules_without_a_user_and_with_large_ids(spark):
    big = 1152921504606846977
    rows = [(1, None, 1), (2, big, 2), (3, None, 3), (4, 3, 4)] + [(10 + i, big, 10 + i) for i in range(6)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, us long")
    got = {r.event_id: (r.user_id, r.allowed) for r in usage.rate_limit(events).collect()}
    assert got[1] == got[3] == (None, False) and got[2] == (big, True) and got[15] == (big, False) and got[4] == (3, True)
    money = spark.createDataFrame([(1, None, "credit", 2), (2, None, "debit", 1), (3, None, "debit", 2), (4, big, "debit", 1)], "event_id long, user_id long, ledger_type string, amount long")
    assert {r.event_id: (r.user_id, r.applied, r.balance) for r in usage.guarded_debits(money).collect()} == {1: (None, True, 2), 2: (None, True, 1), 3: (None, False, 1), 4: (big, False, 0)}


def test_delimited_files_as_they_come(spark, tmp_path):
    """Quoted headers go by their place, equal data lines stay, U+0001 cuts nothing, over-long lines are counted."""
    (tmp_path / "q.csv").write_text('\n"id";"name";"phone"\n1;"A";+15551234567\n"id";"name";"phone"\n2;B\x01b;3\n3;' + "x" * 3000 + ";4\n")
    facts = files.report(spark, f"file://{tmp_path}")
    assert [(r.file, r.delimiter, r.has_header) for r in facts.collect()] == [("q.csv", ";", True)]
    rows = files.records(files.lines(spark, f"file://{tmp_path}", facts), most_bytes=1000).orderBy("place").collect()
    assert [(r.id, r.name, r.phone) for r in rows if r.reason is None] == [("1", "A", "+15551234567"), ("id", "name", "phone"), ("2", "B\x01b", "3")]
    assert [r.reason for r in rows if r.reason] == ["line too long"]


def test_prefixes_end_at_their_size(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\n" * 40_000)
    (tmp_path / "b.txt").write_bytes(b"\xe9\n" + b"y" * 200_000)
    got = {r.file: r.prefix for r in profile.file_prefixes(files.raw_lines(spark, f"file://{tmp_path}")).collect()}
    assert got == {"a.txt": ("ab\n" * 40_000)[:65536], "b.txt": ("é\n" + "y" * 200_000)[:65536]}


def test_blank_lines_and_long_runs(spark):
    import time

    assert one(spark, "\n \t\n a\r\n\u2003\nb\n" + "c\n" * 30, profile.first_lines(F.col("v"), 3)) == [" a", "b", "c"]
    began = time.time()
    assert one(spark, "x" + " " * 200_000 + "y", F.length(C.trim("v"))) == 200_002
    assert time.time() - began < 20


def test_progress_has_rate_and_time_left():
    from entitymill.streaming import ingest

    assert ingest.progress([dict(batch=0, rows=10, ms=1000), dict(batch=1, rows=30, ms=1000)], 80) == [(0, 10, 10, 12.5, 10.0, 7.0), (1, 30, 40, 50.0, 20.0, 2.0)]


def test_delimiters(spark):
    for text, want in [("a;b;c\n1;2;3", ";"), ("a\tb\n1\t2", "\t"), ("a|b\nc|d", "|"), ("abc\ndef", ","), ("", ",")]:
        assert one(spark, text, profile.delimiter(profile.first_lines(F.col("v")))) == want


def test_file_profiles(spark, data):
    at = file_queries._write_samples(spark, data)
    found = {r.file: r for r in files.report(spark, at).collect()}
    assert {f: r.encoding for f, r in found.items() if f in ("semi.csv", "cp1251.csv", "latin1.csv", "utf16.csv")} == {"semi.csv": "utf-8", "cp1251.csv": "windows-1251", "latin1.csv": "iso-8859-1", "utf16.csv": "utf-16le"}
    assert {f: (r.delimiter, r.has_header) for f, r in found.items() if f in ("semi.csv", "tab.txt", "pipe.txt")} == {"semi.csv": (";", True), "tab.txt": ("\t", True), "pipe.txt": ("|", False)}
    assert found["recs.jsonl"].jsonl and not found["tab.txt"].jsonl
    assert [r.file for r in files.discover(spark, at).collect()] == sorted(f for f in found if f != "x.standard.csv")


def test_flat_merge_streams(spark):
    """No aggregate collects the values of an (id, key); a long run of changes folds in order."""
    rows = [("1", i, '{"k":"%d"}' % (i % 3)) for i in range(2000)] + [("2", 1, '{"k":"a"}'), ("2", 2, '{"k":"a"}'), (None, 1, '{"k":"b"}')]
    merged = merge.merge_json_keys(spark.createDataFrame(rows, "id string, seq long, extras string"))
    assert "collect_list" not in merged._jdf.queryExecution().toString()
    got = {(r.id, r.key): r.merged for r in merged.collect()}
    want = '"0"'
    for i in range(1, 2000):
        want = f'[{want},"{i % 3}"]'
    assert got == {("1", "k"): want, ("2", "k"): '"a"', (None, "k"): '"b"'}


def test_streams_decide_as_the_ordered_pass(spark, data, tmp_path):
    """One stream of eight micro-batches, its state on disk, decides as the one ordered pass does; each input row is read once, and state goes with time."""
    from entitymill.plans import queries, registry, stream_queries
    from entitymill.sources.views import usage_events
    from entitymill.streaming import state

    events = usage_events(spark, data)
    # users of the first days never come back, so what was kept of them goes
    shifted = events.withColumn("user_id", F.col("user_id") + F.floor(F.col("us") / (3 * usage.DAY)) * 100_000)
    at = f"file://{tmp_path}/limits"
    out, batches = stream_queries._drain(spark, state.rate_limit_stream(stream_queries._timely(spark, shifted.select("event_id", "user_id", "us"), at, 8)), at)
    assert sorted(map(tuple, out.select("event_id", "user_id", "allowed").collect())) == sorted(map(tuple, usage.rate_limit(shifted).collect()))
    fed = [b for b in batches if b["rows"]]
    assert len(fed) == 8 and sum(b["rows"] for b in fed) == events.count()
    kept = [b["state"] for b in batches]
    assert 0 < kept[-1] < max(kept)
    at = f"file://{tmp_path}/hits"
    looked = queries.lookup.routed_lookup(stream_queries._timely(spark, events.select("event_id", "us", "probe"), at, 8), queries.lookup.search_index(*queries.indexes(spark, data)))
    out, batches = stream_queries._drain(spark, state.ttl_hits_stream(looked), at)
    want = registry.QUERIES["ttl_hits_all"](spark, data)
    assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len({b["batch"] for b in batches if b["rows"]}) == 8 and min(b["state"] for b in batches[1:]) < max(b["state"] for b in batches)


def test_a_batch_writes_a_state_for_each_bucket_not_each_user(spark, tmp_path):
    """500 users in 4 buckets: as many kept rows as buckets and their timers, and the decisions of the ordered pass."""
    from entitymill.plans import stream_queries
    from entitymill.streaming import state

    events = spark.range(0, 8000, 1, 4).selectExpr("id AS event_id", "id * 7919 % 500 - 3 AS user_id", "(id + 1) * 60000000 AS us")
    at = f"file://{tmp_path}/limits"
    stream = stream_queries._timely(spark, events, at, 2)
    out, batches = stream_queries._drain(spark, state.rate_limit_stream(stream, buckets=4), at)
    want = usage.rate_limit(events).collect()
    assert sorted(map(tuple, out.select("event_id", "user_id", "allowed").collect())) == sorted(map(tuple, want)) and len({r.allowed for r in want}) == 2
    assert 0 < max(b["state"] for b in batches) <= 16


def test_cache_hits_take_probes_of_all_kinds(spark, tmp_path):
    """a fetch by alias has its own row and restarts the id's entry."""
    from entitymill.plans import registry

    spark.createDataFrame([(1, 38, "O", "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    probes = [(1, 0, 69), (2, 12, 38), (3, 30, 69), (4, 31, 17), (5, 32, 1)]  # id 1038, its alias, the id again, an invalid one, an alias of no record
    events = spark.createDataFrame([(i, h * 3600, f'{{"k": {k}}}') for i, h, k in probes], "event_id long, s long, props string")
    events.selectExpr("event_id", "timestamp_seconds(s) AS ts", "1L AS user_id", "'view' AS event_type", "1.0D AS value", "props").write.parquet(f"{tmp_path}/events.parquet")
    want = [(1, "id:1038", False), (2, "alias_b:user_38", False), (3, "id:1038", True), (5, "alias_a:+15550010001", False)]
    assert sorted(map(tuple, registry.QUERIES["ttl_hits"](spark, f"file://{tmp_path}").collect())) == want


def test_settled_columns_are_computed_once(spark):
    """A filter on a settled column is not moved before it, where it would carry a copy of all that the column is made of."""
    rows = spark.createDataFrame([(1, '{"uid":"7","name":"A"}')], "line_no int, value string")
    plan = mapping.map_records(rows).where("id is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
