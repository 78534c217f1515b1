"""Text files in unknown dialects: discovery, facts, lines with their places, records and rejects of one pass, canonical output.

A dataset is a folder of part files with the extension in the folder's name
(``a.csv/part-0.csv``), as distributed writers leave them; single files work
the same with their own name. What is known of a file is a row of a table (``report``),
and lines meet it by a join: no list of files is kept on the driver, and files of
all dialects are read in one plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import mapping, profile
from . import prefixes, shared

EXTENSIONS = ("csv", "txt", "jsonl", "json", "ndjson")
JAVA_NAMES = {"utf-8": "UTF-8", "utf-8-bom": "UTF-8", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "windows-1251": "windows-1251", "iso-8859-1": "ISO-8859-1"}
#: Encodings whose line end is not the byte of a line feed.
_WIDE = ("utf-16le", "utf-16be")
#: Longer lines are rejected.
MOST_BYTES = 16 << 20
CANONICAL = ["id", "name", "phone", "username", "extras"]
#: Splits of files whose line counts are sent to every task; more are joined.
MOST_SPLITS = 200_000
#: Names of files that a scan is told to keep to; where there are more, it opens all and their lines are told apart by the join.
MOST_NAMES = 1000


def _file(path: Column | str = "_metadata.file_path") -> Column:
    name = F.regexp_extract(path, r"/([^/]+)/(?:part-[^/]*)$", 1)
    return F.when(name != "", name).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))


def _depth(path: Column) -> Column:
    return F.size(F.split(F.regexp_replace(path, "^[A-Za-z0-9+.-]+:/*|/+$", ""), "/+"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct inputs right in a folder, in name order: known extensions, without files that are canonical already. No content is read, nor any subfolder that is no dataset."""
    path = F.col("_metadata.file_path")
    below = _depth(path) - _depth(F.lit(shared.qualified(spark, folder)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where((below == 1) | ((below == 2) & path.rlike("/part-[^/]*$"))).select(_file().alias("file")).distinct()
    ext = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    return files.withColumn("extension", ext).where(F.col("extension").isin(*EXTENSIONS) & ~F.lower("file").endswith(".standard.csv")).orderBy("file")


def raw_lines(spark: SparkSession, folder: str, encoding: str = "utf-8", only: list[str] | None = None) -> DataFrame:
    """``(file, part, start, value)``: raw bytes of each line, its part file and where its split begins; a split's lines come in order. With ``only``, of these files."""
    lines = _path_lines(spark, folder, encoding, only)
    return lines.select(_file("path").alias("file"), "part", "start", "value")


def _path_lines(spark: SparkSession, folder: str, encoding: str, only: list[str] | None) -> DataFrame:
    """``raw_lines`` with the path in place of the file, whose name no line's row works out again."""
    lines = spark.read.options(recursiveFileLookup="true", lineSep="\n", encoding=JAVA_NAMES[encoding]).text(folder)
    lines = lines if only is None else lines.where(_file().isin(*only))
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def file_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, prefix)``: the first 64 KiB of each dataset, as Latin-1: of its first part, and where that is short of the next ones; no more is read."""
    if not prefixes.known_store(folder):
        return profile.file_prefixes(raw_lines(spark, folder))
    found = prefixes.read_prefixes(spark, folder).where("size > 0")
    return profile.joined_prefixes(found.select(_file(F.col("path")).alias("file"), F.col("path").alias("part"), F.decode("prefix", "ISO-8859-1").alias("prefix")))


def report(spark: SparkSession, folder: str) -> DataFrame:
    """Encoding, delimiter, header flag, fields and their roles of every file, from its first lines; nothing is converted.

    The fields of a file of JSON records are the keys of those lines in order of name.
    """
    heads = file_prefixes(spark, folder).withColumn("encoding", profile.encoding(F.col("prefix")))
    _allow_charsets(spark)
    text = _decoded(F.encode("prefix", "ISO-8859-1"), F.col("encoding"))
    heads = heads.withColumn("lines", profile.first_lines(F.regexp_replace(text, "^﻿", ""), 100)).withColumn("delimiter", profile.delimiter(F.slice("lines", 1, 20)))
    heads = heads.withColumn("first", profile.split_fields(F.coalesce(F.get("lines", 0), F.lit("")), F.col("delimiter"))).withColumn("has_header", mapping.header_flag(F.col("first")))
    synthetic = F.transform(F.col("first"), lambda f, i: F.when(i == 0, F.lit("id")).otherwise(F.concat(F.lit("col_"), i.cast("string"))))
    heads = heads.withColumn("jsonl", profile.is_jsonl(F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1)), F.get("lines", 0)))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda v: F.coalesce(F.json_object_keys(v), F.array().cast("array<string>"))))))
    named = F.when(F.col("jsonl"), keys).when(F.col("has_header"), F.transform("first", C.trim)).otherwise(synthetic)
    heads = heads.select("file", "encoding", "delimiter", (F.col("has_header") & ~F.col("jsonl")).alias("has_header"), named.alias("fields"), "jsonl")
    return heads.withColumn("roles", F.when(F.col("jsonl"), mapping.roles(F.col("fields"), mapping.role_of_key)).otherwise(mapping.roles(F.col("fields"), mapping.role_of)))


def _allow_charsets(spark: SparkSession) -> None:
    """Lets ``decode`` know the Cyrillic encoding, and put U+FFFD for bytes that are no character."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def _decoded(value: Column, encoding: Column) -> Column:
    """Text of bytes, row by row, by the encoding that the row names."""
    out = F.make_valid_utf8(value.cast("string"))
    for name in _WIDE + ("windows-1251", "iso-8859-1"):
        out = F.when(encoding == name, F.decode(value, JAVA_NAMES[name])).otherwise(out)
    return out


_PLACED = pa.schema([("file", pa.string()), ("part", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("first", pa.bool_()), ("value", pa.binary())])


#: The dataset of a part file, as ``_file`` has it.
_PART = re.compile(r"/([^/]+)/part-[^/]*$")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the lines of each split as they stream by; ``first`` marks a part's first line that isn't blank."""
    now, count, begun = None, 0, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path, start = batch.column("path"), batch.column("start")
        changes = np.flatnonzero(np.asarray(pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])))) + 1 if n > 1 else np.zeros(0, np.int64)
        place, first, names = np.zeros(n, np.int64), np.zeros(n, bool), []
        for low, high in zip([0, *changes.tolist()], [*changes.tolist(), n]):
            if (k := (path[low].as_py(), start[low].as_py())) != now:
                now, count, begun = k, 0, k[1] != 0
            names.append(pa.repeat(found[1] if (found := _PART.search(k[0])) else k[0].rsplit("/", 1)[-1], high - low))
            place[low:high] = np.arange(count, count + high - low)
            count += high - low
            for i in range(low, high) if not begun else ():
                if batch.column("value")[i].as_py().strip(b" \t\r\n\x0b\x0c\x00"):
                    first[i], begun = True, True
                    break
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(names), batch.column("part"), start, pa.array(place), pa.array(first), batch.column("value")], schema=_PLACED)


def _readers(spark: SparkSession, folder: str, facts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Raw lines and the facts of the files whose lines they are: one reader for all byte encodings, one for each of two-byte characters that occurs."""
    present = {r.encoding for r in facts.select("encoding").distinct().collect()}  # six at most
    groups = [tuple(e for e in JAVA_NAMES if e not in _WIDE), *((e,) for e in _WIDE if e in present)]
    out = []
    for group in groups:
        own = facts.where(F.col("encoding").isin(*group))
        # few names are told to the scan, which then opens no other file
        names = [r.file for r in own.select("file").limit(MOST_NAMES + 1).collect()] if len(groups) > 1 else []
        only = names if 0 < len(names) <= MOST_NAMES else None
        out.append((_path_lines(spark, folder, group[-1] if group[0] in _WIDE else "utf-8", only), own.withColumnRenamed("file", "of")))
    return out


def lines(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    """Every line of the files in ``facts`` as text, with its place (file, part, start of its split, place in it) and its file's facts.

    Files are read once, as bytes; only where a file of two-byte characters is
    among them, whose lines end otherwise, the folder is read again for these.
    """
    _allow_charsets(spark)
    placed = [(raw.mapInArrow(_places, "file string, part string, start long, place long, first boolean, value binary"), own) for raw, own in _readers(spark, folder, facts)]
    rows = reduce(DataFrame.unionByName, (p.join(own, F.col("file") == F.col("of")).drop("of") for p, own in placed)).withColumn("bytes", F.octet_length("value"))
    # what is too long is never decoded
    text = F.when(F.col("bytes") <= MOST_BYTES, F.regexp_replace(_decoded(F.col("value"), F.col("encoding")), "^\ufeff|\r++$", ""))
    return mapping.settled(rows, *(c for c in rows.columns if c != "value"), text.alias("value"))


def split_lines(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    """``(file, part, start, n)``: lines of each split of the files in ``facts``; only counts are shuffled."""
    counted = (raw.groupBy("path", "part", "start").agg(F.count("*").alias("n")).select(_file("path").alias("file"), "part", "start", "n").join(own.select("of"), F.col("file") == F.col("of")).drop("of") for raw, own in _readers(spark, folder, facts))
    return reduce(DataFrame.unionByName, counted)


def text_lines(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    """``(file, value)``: data lines as UTF-8, without blank lines, headers and lines that are too long."""
    rows = lines(spark, folder, facts)
    return rows.where(F.col("value").isNotNull() & (C.trim("value") != "") & ~(F.col("has_header") & F.col("first"))).select("file", "value")


def records(rows: DataFrame, most_bytes: int = MOST_BYTES, jsonl: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` to canonical rows with ``reason`` (null: a record), and the place of each; blank lines and headers are neither.

    One pass makes both: ``where("reason is null")`` are the records, the others the rejects.
    ``jsonl`` is false where none of the lines is of a file of JSON; ``keep`` names other columns that the result has.
    """
    long = F.col("bytes") > most_bytes
    rows = rows.where(long | ((C.trim("value") != "") & ~(F.col("has_header") & F.col("first"))))
    value = F.when(~long, F.col("value"))
    split = F.when(F.col("jsonl"), F.array().cast("array<string>")).otherwise(F.transform(profile.split_fields(value, F.col("delimiter")), C.trim))
    place = ("file", "part", "start", "place", "bytes", "jsonl", "fields", "roles", *keep)
    # what only records need is worked out after all that tells whether a line is one
    rows = mapping.settled(rows, *place, long.alias("long"), F.col("value").alias("raw"), F.when(F.col("jsonl"), value).alias("value"), split.alias("f"))
    rows = mapping.map_records(rows, *place, "long", "raw", "f") if jsonl else rows.select(*place, "long", "raw", "f", *(F.lit(None).cast("string").alias(n) for n in CANONICAL))
    at = lambda role: F.coalesce(F.get("f", (F.array_position("roles", F.lit(role)) - 1).cast("int")), F.lit(""))
    first = F.when(F.array_contains("roles", F.lit("id")), at("id")).otherwise(F.coalesce(F.get("f", 0), F.lit("")))
    pairs = F.transform("fields", lambda name, i: F.struct(name.alias("k"), F.coalesce(F.get("f", i), F.lit("")).alias("v"), F.get("roles", i).alias("r")))
    pairs = F.filter(pairs, lambda p: (p.r == "extras") & (p.k != "") & (p.v != ""))
    # of a file without extras no line looks for them
    rows = rows.withColumn("pairs", F.when(F.array_contains("roles", F.lit("extras")), pairs).otherwise(F.array().cast("array<struct<k:string,v:string,r:string>>")))
    last = F.filter("pairs", lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.greatest(F.size("pairs"), F.lit(1))), lambda q: q.k == p.k))
    rows = rows.withColumn("pairs", F.array_sort(last))
    packed = F.when(F.size("pairs") > 0, F.to_json(F.map_from_arrays(F.col("pairs.k"), F.col("pairs.v")))).otherwise("{}")
    canonical = (F.size("fields") == len(CANONICAL)) & (F.transform("fields", lambda f: F.lower(f)) == F.array(*map(F.lit, CANONICAL)))
    flat = {
        "id": first,
        "name": C.combine_name(at("name"), at("lastname")),
        "phone": at("phone"),
        "username": F.when(canonical, at("username")).otherwise(F.regexp_replace(at("username"), "^@", "")),
        "extras": F.when(canonical, F.coalesce(F.nullif(F.get("f", 4), F.lit("")), F.lit("{}"))).otherwise(packed),
    }
    out = {n: F.when(F.col("jsonl"), F.coalesce(n, F.lit(""))).otherwise(flat[n]) for n in CANONICAL}
    reason = F.when(F.col("long"), "line too long").when(F.col("jsonl") & F.col("id").isNull(), "no record").when(~F.col("jsonl") & (first == ""), "missing id")
    return rows.select("file", "part", "start", "place", *keep, *(c.alias(n) for n, c in out.items()), reason.alias("reason"), F.when(reason.isNotNull(), F.col("raw")).alias("raw"))


def line_numbers(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``line_no``, from 1, to rows with a place: the lines of the splits before by ``split_lines``, and the place in the own split. No line moves."""
    before = Window.partitionBy("cf", "cp").orderBy("cs").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("file").alias("cf"), F.col("part").alias("cp"), F.col("start").alias("cs"), "n").withColumn("base", F.sum("n").over(before))
    counts = counts.where("base is not null").drop("n")  # a part's first split has nothing before it
    counts = counts.persist()  # else the lines would be counted once for their number and once for the join
    if counts.count() <= MOST_SPLITS:
        counts = F.broadcast(counts)
    joined = rows.join(counts, (F.col("file") == F.col("cf")) & (F.col("part") == F.col("cp")) & (F.col("start") == F.col("cs")), "left")
    return joined.withColumn("line_no", F.coalesce("base", F.lit(0)) + F.col("place") + 1).drop("cf", "cp", "cs", "base")


def write_canonical(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Canonical CSV, for each input ``x.csv`` a dataset ``x.standard.csv`` of one job (``x.csv.standard.csv`` where the short name is taken)."""
    rows.write.partitionBy("file").option("header", "true").option("escape", '"').mode("overwrite").csv(path)
    for folder in shared.names(spark, path):
        if folder.startswith("file="):
            name = shared.unescaped(spark, folder.removeprefix("file="))
            base = name.rsplit(".", 1)[0] if "." in name else name
            if not shared.rename(spark, f"{path}/{folder}", f"{path}/{base}.standard.csv"):
                shared.rename(spark, f"{path}/{folder}", f"{path}/{name}.standard.csv")


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """The canonical datasets of a folder, with ``file``, the name of each."""
    rows = spark.read.options(header="true", escape='"', recursiveFileLookup="true").schema(", ".join(f"{c} string" for c in CANONICAL)).csv(path)
    return rows.select(_file().alias("file"), *CANONICAL).na.fill("")
