"""Files as they come: quotes, rejects by file and line, splits, encodings in one plan, prefixes and resumed files."""

import random
import time

import pytest
from entitymill.operators import profile
from entitymill.sources import files, prefixes
from entitymill.streaming import ingest as I
from pyspark.sql import functions as F


def plain_fields(line, delimiter):
    out, field, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1 : i + 2] == '"':
            field, i = field + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            out, field = [*out, field], ""
        else:
            field += c
        i += 1
    return [*out, field]


def test_fields_equal_a_plain_reader(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices('ab ";,|\t', k=rng.randint(0, 14))), d) for d in profile.DELIMITERS for _ in range(400)]
    rows += [('"a";"b;c";', ";"), ('""', ","), ('""""', ","), ('"a""b",c', ","), ('x"y,z"w,q', ","), ('"open,end', ","), ("x" * 100_000 + "," + '"' + '""' * 500 + '"', ",")]
    got = spark.createDataFrame(rows, "line string, d string").select("line", "d", profile.split_fields(F.col("line"), F.col("d")).alias("f")).collect()
    assert all(list(r.f) == plain_fields(r.line, r.d) for r in got)


def test_quoted_header_and_rejects_by_line(spark, tmp_path):
    (tmp_path / "q.csv").write_text('\n id;"name;full";phone\n7;"A;B";5551234567\n\n;no id;1\n8\n9;x;1;more;fields\n"10";"say ""hi""";2\n' + "z" * 3000 + "\n  \n;;\n11;end;3")
    folder = f"file://{tmp_path}"
    facts = files.report(spark, folder)
    assert [(r.file, r.delimiter, r.has_header, list(r.fields), list(r.roles)) for r in facts.collect()] == [("q.csv", ";", True, ["id", "name;full", "phone"], ["id", "extras", "phone"])]
    rows = files.line_numbers(files.records(files.lines(spark, folder, facts), most_bytes=1000), files.split_lines(spark, folder, facts)).collect()
    assert sorted((r.line_no, r.id, r.phone, r.extras) for r in rows if r.reason is None) == [(3, "7", "5551234567", '{"name;full":"A;B"}'), (6, "8", "", "{}"), (7, "9", "1", '{"name;full":"x"}'), (8, "10", "2", '{"name;full":"say \\"hi\\""}'), (12, "11", "3", '{"name;full":"end"}')]
    assert sorted((r.file, r.line_no, r.reason, len(r.raw)) for r in rows if r.reason) == [("q.csv", 5, "missing id", 8), ("q.csv", 9, "line too long", 3000), ("q.csv", 11, "missing id", 2)]


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Files cut into many splits: numbers are those of a plain reader, and the header is found once."""
    want = {}
    for k, n in enumerate((700, 3, 250)):
        text = ["id,name"] + [f"{i},n{i}" if i % 9 else ("" if i % 2 else ",lost") for i in range(n)]
        (tmp_path / f"f{k}.csv").write_text("\n".join(text) + "\n")
        want |= {(f"f{k}.csv", i + 1): line.split(",")[0] for i, line in enumerate(text) if i and line}
    for key, value in {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "1"}.items():
        spark.conf.set(key, value)
    try:
        folder = f"file://{tmp_path}"
        facts = files.report(spark, folder)
        assert files.split_lines(spark, folder, facts).where("start > 0").count() > 5
        got = files.line_numbers(files.records(files.lines(spark, folder, facts)), files.split_lines(spark, folder, facts)).collect()
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert {(r.file, r.line_no): r.id for r in got} == want
    assert {(r.file, r.line_no) for r in got if r.reason} == {k for k, v in want.items() if not v}


def test_encodings_in_one_plan(spark, tmp_path):
    name = "Фамилия Имя Отчество"
    for file, enc, text in [("c.csv", "cp1251", name), ("u8.csv", "utf-8", name), ("bom.csv", "utf-8-sig", name), ("le.csv", "utf-16-le", name + " ਊĊ"), ("be.csv", "utf-16-be", name), ("l1.csv", "latin-1", "Éléonore of a long plain name in other letters")]:
        (tmp_path / file).write_bytes(f"id,name\r\n5,{text}\r\n6,{text}".encode(enc))
    (tmp_path / "bad.csv").write_bytes(b"id,name\n5,\xff\xfe\xfa ok\n")
    folder = f"file://{tmp_path}"
    facts = files.report(spark, folder)
    rows = files.records(files.lines(spark, folder, facts)).where("reason is null")
    got = {(r.file, r.id): r.name for r in rows.collect()}
    assert {f: got[f, "5"] for f in ("c.csv", "u8.csv", "bom.csv", "be.csv", "l1.csv")} == {"c.csv": name, "u8.csv": name, "bom.csv": name, "be.csv": name, "l1.csv": "Éléonore of a long plain name in other letters"}
    assert got["le.csv", "5"] == got["le.csv", "6"] == name + " ਊĊ" and ("bad.csv", "5") in got
    assert files.text_lines(spark, folder, facts).count() == 13


def test_prefixes_read_no_more(spark, tmp_path):
    with open(tmp_path / "huge.csv", "wb") as f:
        f.write(b"id;name\n1;x\n" * 10_000)
        f.truncate(300 << 20)
    (tmp_path / "small.csv").write_bytes(b"id,name\n1,x\n")
    (tmp_path / "none.csv").write_bytes(b"")
    began = time.time()
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.bytes_read, bytes(r.prefix[:7])) for r in prefixes.read_prefixes(spark, f"file://{tmp_path}").collect()}
    assert got == {"huge.csv": (300 << 20, 65536, b"id;name"), "small.csv": (12, 12, b"id,name"), "none.csv": (0, 0, b"")}
    assert time.time() - began < 20

    class Stream:
        asked = 0

        def read(self, n):
            self.asked += min(n, 1000)
            return b"x" * min(n, 1000)

    stream = Stream()
    assert len(prefixes.head(stream, 65536)) == 65536 == stream.asked
    assert {r.file: (r.delimiter, r.has_header) for r in files.report(spark, f"file://{tmp_path}").where("file = 'huge.csv'").collect()} == {"huge.csv": (";", True)}


def test_a_first_part_of_a_header_only(spark, tmp_path):
    """As a writer leaves it whose first task had no rows: what a dataset is, its next parts tell."""
    for name, enc, value in (("c.csv", "cp1251", "ИмяФамилия ГородМосква"), ("l.csv", "latin-1", "Éléonore"), ("le.csv", "utf-16-le", "ИмяФамилия")):
        for k, rows in enumerate(("", f"\n5,{value}\n6,{value}\n", f"\n7,{value}")):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"part-{k}").write_bytes(f"id,full_name{rows}".encode(enc))
    (tmp_path / "d.csv").mkdir()
    for k in range(3):
        (tmp_path / "d.csv" / f"part-{k}").write_bytes(b"id,name\n" + b"1,x\n" * (20_000 if k == 1 else 0))
    folder = f"file://{tmp_path}"
    assert {r.path.rsplit("/", 2)[-1] for r in prefixes.read_prefixes(spark, folder).collect() if "/d.csv/" in r.path} == {"part-0", "part-1"}
    want = [("c.csv", "windows-1251", ["id", "full_name"]), ("d.csv", "utf-8", ["id", "name"]), ("l.csv", "iso-8859-1", ["id", "full_name"]), ("le.csv", "utf-16le", ["id", "full_name"])]
    facts = files.report(spark, folder)
    assert sorted((r.file, r.encoding, list(r.fields)) for r in facts.collect()) == want
    scanned = profile.file_prefixes(files.raw_lines(spark, folder)).select("file", profile.encoding(F.col("prefix")).alias("e"))
    assert {r.file: r.e for r in scanned.collect()} == {f: e for f, e, _ in want}
    rows = files.text_lines(spark, folder, facts).where("file <> 'd.csv'").collect()
    assert sorted((r.file, r.value) for r in rows) == sorted((f, f"{i},{v}") for f, v in (("c.csv", "ИмяФамилия ГородМосква"), ("l.csv", "Éléonore"), ("le.csv", "ИмяФамилия")) for i in (5, 6, 7))


def test_discovery_is_not_recursive(spark, tmp_path):
    for path in ("a.csv", "b.TXT", "x.standard.csv", "notes.md", "sub/c.csv", "d.csv/part-0.csv", "d.csv/part-1.csv", "sub/e.csv/part-0.csv"):
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text("id\n1\n")
    assert [(r.file, r.extension) for r in files.discover(spark, f"file://{tmp_path}").collect()] == [("a.csv", "csv"), ("b.TXT", "txt"), ("d.csv", "csv")]


def test_one_canonical_dataset_for_each_input(spark, tmp_path):
    rows = spark.createDataFrame([(f, str(i), "n", "", "", '{"a":"b,\\"c"}') for f in ("a.csv", "a.txt", "b c.csv") for i in range(2)], "file string, id string, name string, phone string, username string, extras string")
    files.write_canonical(spark, rows, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["a.standard.csv", "a.txt.standard.csv", "b c.standard.csv"]
    assert {(r.id, r.extras) for r in files.read_canonical(spark, f"file://{tmp_path}/out").collect()} == {("0", '{"a":"b,\\"c"}'), ("1", '{"a":"b,\\"c"}')}


def test_resume_of_grown_and_repeated_files(spark, tmp_path):
    tables = I.target(spark, f"file://{tmp_path}/t", 4)
    (tmp_path / "in").mkdir()
    at = tmp_path / "in" / "a.csv"
    counts = lambda: {k: tables.current()["counts"][k] for k in ("read", "inserts", "updates")}
    at.write_text("id,phone,username\n1,+15550000001,ann\n2,+15550000002,bob\n")
    assert I.ingest_files(tables, f"file://{tmp_path}/in") and counts() == dict(read=2, inserts=2, updates=0)
    with open(at, "a") as f:
        f.write("3,+15550000003,cid\n")
    assert I.ingest_files(tables, f"file://{tmp_path}/in") and counts() == dict(read=1, inserts=1, updates=0)
    assert not I.ingest_files(tables, f"file://{tmp_path}/in") and tables.current()["batch"] == 1
    at.write_text(at.read_text())  # delivered again
    (tmp_path / "in" / "b.csv").write_text("id,phone,username\n1,,new_ann\n")
    assert I.ingest_files(tables, f"file://{tmp_path}/in") and counts() == dict(read=1, inserts=0, updates=1)
    assert sorted((r.id, r.alias_b, r.n_rows) for r in tables.read("records").collect()) == [("1", "new_ann", 2), ("2", "bob", 1), ("3", "cid", 1)]
    assert {r.part: r.lines for r in tables.read("progress").collect()} == {"a.csv/a.csv": 4, "b.csv/b.csv": 2}


@pytest.mark.parametrize("name", ["x.csv"])
def test_a_folder_of_empty_files(spark, tmp_path, name):
    (tmp_path / name).write_bytes(b"")
    facts = files.report(spark, f"file://{tmp_path}")
    assert facts.count() == 0 and files.records(files.lines(spark, f"file://{tmp_path}", facts)).count() == 0
