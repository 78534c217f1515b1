"""What kind of file a text is: format, encoding, delimiter and header, from its first lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C

DELIMITERS = [",", ";", "|", "\t"]
PREFIX = 65536


def first_lines(text: Column, most: int = 20) -> Column:
    """The first ``most`` lines that aren't blank; only the head of the text that holds them is split."""
    blank = r"(?:[\s\p{Z}\p{Cc}&&[^\n]]*+\n)*+"
    text = F.regexp_extract(text, rf"\A(?:{blank}[^\n]*+(?:\n|\z)){{0,{most}}}+", 0)
    lines = F.transform(F.split(text, "\n"), lambda v: F.regexp_replace(v, "\r+$", ""))
    return F.slice(F.filter(lines, lambda v: C.trim(v) != ""), 1, most)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once; an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def delimiter_score(lines: Column, delimiter: str) -> Column:
    """10 * share of the most frequent count (the first to become so) + mean count; -1 if that count is 0."""
    counts = F.transform(lines, lambda v: F.length(v) - F.length(F.replace(v, F.lit(delimiter), F.lit(""))))

    def score(counts: Column) -> Column:
        running = F.transform(counts, lambda c, i: F.struct(F.size(F.filter(F.slice(counts, 1, i + 1), lambda x: x == c)).alias("freq"), (-i).alias("late"), c.alias("c")))
        n = F.size(counts)
        mean = F.aggregate(counts, F.lit(0), lambda a, x: a + x) / n
        return _let(F.array_max(running), lambda top: F.when((n == 0) | (top.c == 0), F.lit(-1.0)).otherwise(top.freq / n * 10 + mean))

    return _let(counts, score)


def delimiter(lines: Column) -> Column:
    """The candidate of the highest score, the earliest of equals; a comma where none has any."""
    scores = F.array(*(F.struct(delimiter_score(lines, d).alias("score"), F.lit(-i).alias("rank"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)))
    return F.when(F.size(lines) == 0, F.lit(",")).otherwise(F.array_max(scores).d)


def split_fields(line: Column, delimiter: Column) -> Column:
    """Fields of a line whose delimiter is one of the candidates. A quote opens or closes a quoted part anywhere in a field; a doubled one inside is a quote."""
    patterns = {d: f'{d}((?:[^"{d}]++|"(?:[^"]++|"")*+(?:"|\\z))*+)' for d in (",", ";", "\\|", "\\t")}
    regex = F.when(F.lit(False), F.lit(""))
    for d, p in zip(DELIMITERS, patterns.values()):
        regex = regex.when(delimiter == d, p)
    fields = F.regexp_extract_all(F.concat(delimiter, line), regex, F.lit(1))
    bare = lambda f: F.replace(F.regexp_replace(f, '"((?:[^"]++|"")*+)(?:"|\\z)', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(fields, lambda f: F.when(f.contains('"'), bare(f)).otherwise(f))


def is_jsonl(extension: Column, first_line: Column) -> Column:
    probe = C.trim(first_line).startswith("{")
    return F.when(extension.isin("jsonl", "ndjson"), True).when(extension.isin("json", "txt", "csv", ""), F.coalesce(probe, F.lit(False))).otherwise(False)


def encoding(prefix: Column) -> Column:
    """Encoding of a file from its first bytes as Latin-1 characters: marks, zero bytes, UTF-8, Cyrillic share, else Latin-1.

    The prefix may end inside a UTF-8 character, so up to three last bytes don't count against UTF-8.
    """
    head = F.substring(prefix, 1, 64)
    pairs = lambda odd: F.size(F.filter(F.sequence(F.lit(1 + odd), F.greatest(F.length(head), F.lit(1 + odd)), F.lit(2)), lambda i: F.substring(head, i, F.lit(1)) == "\x00"))
    raw = lambda p: F.is_valid_utf8(F.encode(p, "ISO-8859-1").cast("string"))
    n = F.length(prefix)
    whole = raw(prefix)
    for cut in (1, 2, 3):
        whole = whole | ((n >= PREFIX) & raw(F.substring(prefix, F.lit(1), n - cut)))
    cyrillic = F.regexp_count(prefix, F.lit("[À-ÿ¨¸]"))
    return (
        F.when(prefix.startswith("ï»¿"), "utf-8-bom")
        .when(prefix.startswith("ÿþ"), "utf-16le")
        .when(prefix.startswith("þÿ"), "utf-16be")
        .when((n >= 8) & (pairs(1) >= 8), "utf-16le")
        .when((n >= 8) & (pairs(0) >= 8), "utf-16be")
        .when(whole, "utf-8")
        .when(cyrillic > F.floor(n / 10), "windows-1251")
        .otherwise("iso-8859-1")
    )


def joined_prefixes(parts: DataFrame) -> DataFrame:
    """``parts(file, part, prefix)`` to ``(file, prefix)``: the first ``PREFIX`` characters of the parts one after the other.

    A first part may hold no more than a header, which tells neither encoding nor delimiter.
    """
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    kept = parts.withColumn("before", F.coalesce(F.sum(F.length("prefix")).over(before), F.lit(0))).where(F.col("before") < PREFIX)
    # a part may end without the end of its last line, in characters of one byte or of two
    p = F.col("prefix")
    end = F.when(p.endswith("\n") | p.endswith("\n\x00"), "").when(p.endswith("\x00"), "\n\x00").when(p.contains("\x00"), "\x00\n").otherwise("\n")
    last = F.max("part").over(Window.partitionBy("file"))
    kept = kept.withColumn("prefix", F.when((F.col("part") == last) | (F.length(p) >= PREFIX), p).otherwise(F.concat(p, end)))
    found = F.array_sort(F.collect_list(F.struct("part", "prefix")))
    return kept.groupBy("file").agg(found.alias("found")).select("file", F.substring(F.array_join("found.prefix", ""), 1, PREFIX).alias("prefix"))


def file_prefixes(raw_lines: DataFrame) -> DataFrame:
    """``raw_lines(file, part, start, value binary)`` to ``(file, prefix)``: the first ``PREFIX`` bytes of each file, as Latin-1.

    Lines stream through in order; of each part only the prefix is kept, so nothing else is shuffled.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, size = None, [], 0

        def out() -> pa.RecordBatch:
            rows = [(*now, b"\n".join(lines)[:PREFIX].decode("latin-1"))] if now else []
            return pa.RecordBatch.from_pylist([dict(zip(("file", "part", "prefix"), r)) for r in rows], pa.schema([(c, pa.string()) for c in ("file", "part", "prefix")]))

        for batch in batches:
            files, parts = batch.column("file"), batch.column("part")
            if size >= PREFIX and batch.num_rows and (files[0].as_py(), parts[0].as_py()) == now == (files[-1].as_py(), parts[-1].as_py()):
                continue  # deep inside a part
            for i, key in enumerate(zip(files.to_pylist(), parts.to_pylist())):
                if key != now:
                    if now:
                        yield out()
                    now, lines, size = key, [], 0
                if size < PREFIX:
                    line = batch.column("value")[i].as_py() or b""
                    lines.append(line)
                    size += len(line) + 1
        yield out()

    kept = raw_lines.where("start = 0").select("file", "part", "value").mapInArrow(heads, "file string, part string, prefix string")
    return joined_prefixes(kept)
