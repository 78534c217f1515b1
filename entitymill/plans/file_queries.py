"""Queries over text files in several dialects, which they first write from the given tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import mapping, profile
from ..sources import files
from ..sources.shared import new_folder
from ..sources.views import raw_entities, table, usage_events

#: Header variants that the derived header rows take in turn.
HEADERS = [
    ["Telegram_ID", "First Name", "last_name", "Mobile", "NickName", "city"],
    ["user-id", "name", "phone", "username"],
    ["id", "phone", "username"],
    ["uid", "id", "tel", "foo bar"],
    ["12345", "abc", "def"],
    ["alpha", "12", "34", "56"],
    ["ID", "Name", "Phone", "Username", "Extras"],
    ["first", "fname", "login", "number", "user"],
]


def _write_samples(spark: SparkSession, d: str) -> str:
    """The same keyed rows as files of other delimiters, headers, encodings and formats."""
    at, raw = new_folder(spark, "files"), raw_entities(spark, d)
    plain = raw.select("source_file", F.col("id_raw").alias("id"), F.trim("name_raw").alias("name"), F.col("alias_a_raw").alias("phone"), F.col("alias_b_raw").alias("username"))
    rows = lambda s: plain.where(F.col("source_file") == s).drop("source_file")
    # blank fields stay empty: null and empty strings are both written as nothing
    save = lambda df, name, **o: df.write.options(**({"header": "true", "emptyValue": "", "nullValue": ""} | o)).csv(f"{at}/{name}")
    save(rows("0").toDF("Telegram_ID", "First Name", "Mobile", "NickName"), "semi.csv", sep=";")
    save(rows("1").toDF("id", "foo", "phone", "username"), "tab.txt", sep="\t")
    save(rows("2"), "pipe.txt", sep="|", header="false")
    cyrillic = rows("0").withColumn("name", F.concat(F.lit("ИмяФамилия ГородМосква "), F.col("name")))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    save(cyrillic.select("name", "id"), "cp1251.csv", encoding="windows-1251")
    save(rows("1").withColumn("name", F.concat(F.lit("Éléonore "), F.col("name"))), "latin1.csv", encoding="ISO-8859-1")
    save(cyrillic, "utf16.csv", encoding="UTF-16LE")
    raw.where("source_file = '0'").select(F.to_json(F.struct(F.col("id_raw").alias("telegram_id"), F.col("name_raw").alias("name"), F.col("alias_b_raw").alias("nick"))).alias("value")).write.text(f"{at}/recs.jsonl")
    rows("2").withColumn("extras", F.lit("{}")).write.option("header", "true").csv(f"{at}/x.standard.csv")
    return at


def _facts(spark: SparkSession, at: str) -> DataFrame:
    """What is known of each file, as a table that is written once and joined to lines wherever they are read."""
    files.report(spark, at).write.parquet(f"{at}-facts")
    return spark.read.parquet(f"{at}-facts")


def _headers(spark, d) -> DataFrame:
    choice = F.array(*(F.array(*map(F.lit, h)) for h in HEADERS))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.get(choice, (F.col("c_custkey") % len(HEADERS)).cast("int")).alias("fields"))


def source_discovery(spark, d):
    return files.discover(spark, _write_samples(spark, d))


def encoding_profile(spark, d):
    return files.file_prefixes(spark, _write_samples(spark, d)).select("file", profile.encoding(F.col("prefix")).alias("encoding"))


def transcode_scan(spark, d):
    at = _write_samples(spark, d)
    return files.text_lines(spark, at, _facts(spark, at))


def schema_report(spark, d):
    r = files.report(spark, _write_samples(spark, d))
    r = r.withColumn("extras", F.filter("fields", lambda f, i: F.get("roles", i) == "extras"))
    return r.select("file", "encoding", "delimiter", "has_header", "jsonl", *(F.array_join(c, ",").alias(c) for c in ("fields", "roles", "extras")))


def _converted(spark, d):
    """Records and rejects of the files that are neither JSON nor canonical already."""
    at = _write_samples(spark, d)
    facts = _facts(spark, at).where(~F.col("jsonl") & ~F.col("file").endswith(".standard.csv"))
    return at, files.records(files.lines(spark, at, facts), jsonl=False)


def delimited_scan(spark, d):
    return _converted(spark, d)[1].where("reason is null").select("file", *files.CANONICAL)


def file_rejects(spark, d):
    """Every skipped line with its file, line number, reason and text."""
    at = _write_samples(spark, d)
    facts = _facts(spark, at)
    rejects = files.records(files.lines(spark, at, facts)).where("reason is not null")
    # part names differ from run to run, and a number is that of a part
    return files.line_numbers(rejects, files.split_lines(spark, at, facts)).groupBy("file", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("line_no") < 1).alias("unplaced"), (F.count_distinct("part", "line_no") == F.count("*")).alias("unique"))


def canonical_sink(spark, d):
    path = new_folder(spark, "canonical")
    files.write_canonical(spark, _converted(spark, d)[1].where("reason is null").select("file", *files.CANONICAL), path)
    return files.read_canonical(spark, path)


def convert_or_pass(spark, d):
    at = _write_samples(spark, d)
    rows = files.records(files.lines(spark, at, _facts(spark, at)))
    return rows.where(F.col("reason").isNull() & F.col("id").rlike(C.ID)).select("file", *files.CANONICAL)


def format_probe(spark, d):
    ext = F.get(F.array(*map(F.lit, ["jsonl", "json", "txt", "csv", "xml"])), (F.col("doc_id") % 5).cast("int"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n {"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", ext.alias("ext"), profile.is_jsonl(ext, F.get(profile.first_lines(text, 1), 0)).alias("jsonl"))


def delimiter_profile(spark, d):
    return table(spark, d, "documents").select("doc_id", profile.first_lines(F.col("text")).alias("lines")).select("doc_id", profile.delimiter(F.col("lines")).alias("delimiter"))


def header_profile(spark, d):
    return _headers(spark, d).select("file", mapping.header_flag(F.col("fields")).alias("has_header"), F.size("fields").alias("n_fields"))


def header_role_map(spark, d):
    return mapping.header_roles(_headers(spark, d))


def header_layout_map(spark, d):
    return mapping.header_layout(_headers(spark, d))


def jsonl_scan(spark, d):
    value = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("bad "), "props")).when(F.col("event_id") % 10 == 1, F.lit("  ")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", value.alias("value")).where(C.trim("value") != "")
    parsed = rows.select("event_id", F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select("event_id", F.col("m").isNotNull().alias("parsed"), F.coalesce(F.try_element_at("m", F.lit("k")), F.lit("")).alias("k"))


def jsonl_record_map(spark, d):
    e = usage_events(spark, d)
    ids = [F.lit(n) for n in ("telegram_id", "userId", "User-ID", "id")]
    key = F.get(F.array(*ids), (F.col("event_id") % 4).cast("int"))
    value = F.concat(F.lit('{"'), key, F.lit('": '), F.col("user_id").cast("string"), F.lit(', "firstName": " A", "last_name": "'), F.col("k").cast("string"), F.lit('", "nick": "'), F.when(F.col("k") % 2 == 0, F.concat(F.lit("@Nick_"), F.col("k").cast("string"))).otherwise("no!"), F.lit('", "city": "x"}'))
    return mapping.map_records(e.select(F.col("event_id").alias("line_no"), value.alias("value"))).where("id is not null")
