"""Row gates: cleaned records, rejects with a reason, and checks of texts, keys, paths, constraints and ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C

#: Fixed patterns: statement fragments that free text should not hold.
INJECTION_PATTERNS = [
    r"(?i)\bunion\s+all\s+select\b",
    r"(?i)\bunion\s+select\b",
    r"(?i)\bdrop\s+table\b",
    r"(?i)\binsert\s+into\b",
    r"(?i)\bdelete\s+from\b",
    r"(?i)\bupdate\s+\w+\s+set\b",
    r"(?i)\bor\s+1\s*=\s*1\b",
    r"(?i)\band\s+1\s*=\s*1\b",
    r"(?i)\bsleep\s*\(",
    r"(?i)\bbenchmark\s*\(",
    r"(?i)\bxp_cmdshell\b",
    r"(?i)\binformation_schema\b",
    r"(?i);\s*(drop|delete|insert|update|select)\b",
    r"--|/\*|\*/",
    r"(?i)'\s*(or|and)\s+",
]


#: Of each pattern, lower-case strings of which any match holds one.
INJECTION_NEEDS = [["union"], ["union"], ["drop"], ["insert"], ["delete"], ["update"], ["="], ["="], ["sleep"], ["benchmark"], ["xp_cmdshell"], ["information_schema"], [";"], ["--", "/*", "*/"], ["'"]]


def reason(column: str) -> Column:
    """Why a row with such an id is rejected; null where it isn't."""
    i = C.trim(column)
    return F.when(i == "", "missing id").when(~C.is_id(i), "invalid id")


def validate(raw: DataFrame, *keep: str) -> DataFrame:
    """Every row with its cleaned fields and ``reason`` (null where accepted), and the columns ``keep``: one projection, no shuffle."""
    i = C.trim("id_raw")
    extras = C.trim("extras_raw")
    return raw.select(
        "seq",
        "source_file",
        i.alias("id"),
        C.trim("name_raw").alias("name"),
        C.clean_alias_a("alias_a_raw").alias("alias_a"),
        C.clean_alias_b("alias_b_raw").alias("alias_b"),
        F.when(extras == "", "{}").otherwise(extras).alias("extras"),
        reason("id_raw").alias("reason"),
        "id_raw",
        *keep,
    )


def accepted(raw: DataFrame) -> DataFrame:
    return validate(raw).where("reason is null").drop("reason", "id_raw")


def rejects(raw: DataFrame) -> DataFrame:
    return validate(raw).where("reason is not null").select("source_file", F.col("seq").alias("line_no"), "reason", F.col("id_raw").alias("raw"))


def sanitize_text(df: DataFrame, column: str, most_bytes: int = 4096) -> DataFrame:
    """``clean`` text and ``reason`` of rejection, one of the two null."""
    # longer texts are refused unread; a column of its own, so the patterns below see only what may pass
    df = df.withColumn("_short", F.when(F.octet_length(column) <= most_bytes, F.col(column)))
    df = df.withColumn("_trimmed", C.trim("_short"))
    t, trimmed = F.col(column), F.col("_trimmed")
    out = F.regexp_replace(F.regexp_replace(trimmed, r"[\n\t\r]", " "), r"\p{Cf}", "")
    out = F.regexp_replace(C.trim(out), r"(?U)\s+", " ")
    control = trimmed.rlike(r"[\p{Cc}&&[^\n\t\r]]")
    reason = (
        F.when(t.isNull(), "is empty")
        .when(~F.is_valid_utf8(t), "invalid UTF-8")
        .when(t.contains("\x00"), "contains null bytes")
        .when(F.octet_length(t) > most_bytes, "exceeds size")
        .when(trimmed == "", "is empty")
        .when(control, "control characters")
        .when(out == "", "is empty")
    )
    return df.withColumn("reason", reason).withColumn("clean", F.when(F.col("reason").isNull(), out)).drop("_short", "_trimmed")


def injection_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows that match each pattern; the sums are partial in every task, so only one row a task is shuffled.

    A pattern is tried only on texts that hold the characters which any match of it has.
    """
    df = df.select(C.text(column).alias("t")).select("t", F.lower("t").alias("l"))
    holds = lambda words: reduce(Column.__or__, (F.col("l").contains(w) for w in words))
    hits = df.agg(*(F.sum(F.when(holds(words), F.col("t").rlike(p)).otherwise(F.lit(False)).cast("long")).alias(f"p{i}") for i, (p, words) in enumerate(zip(INJECTION_PATTERNS, INJECTION_NEEDS))))
    return hits.select(F.explode(F.array(*(F.struct(F.lit(i).alias("pattern"), F.coalesce(F.col(f"p{i}"), F.lit(0)).alias("matches")) for i in range(len(INJECTION_PATTERNS))))).alias("r")).select("r.pattern", "r.matches")


def key_reason(c: str, most_bytes: int = 511):
    k = F.col(c)
    return F.when(C.text(k) == "", "empty").when(F.octet_length(k) > most_bytes, "too long").when(k.contains("\x00"), "null byte").when(~F.is_valid_utf8(k), "invalid UTF-8").when(k.rlike(r"\p{Cc}"), "control characters")


def path_reason(c: str, roots: list[str]):
    p = F.regexp_replace(F.col(c), r"\\", "/")
    inside = F.lit(False)
    for root in roots:
        inside = inside | p.startswith(root)
    return F.when(C.text(c) == "", "empty").when(F.octet_length(c) > 4096, "too long").when(p.contains("\x00") | p.rlike("[\r\n]"), "line break").when(F.array_contains(F.split(p, "/"), ".."), "parent segment").when(~inside, "outside roots")


def count_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(rule, violations)`` for SQL conditions that every row should meet (null counts as met)."""
    sums = df.agg(*(F.coalesce(F.sum(F.expr(f"CASE WHEN NOT ({r}) THEN 1 ELSE 0 END")), F.lit(0)).cast("long").alias(n) for n, r in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("r")).select("r.rule", "r.violations")
