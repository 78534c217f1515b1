"""Columns of unknown files mapped to the canonical roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import clean as C
from . import jsontree

#: Header names (letters only, lower case) of each role.
ROLE_ALIASES = {
    "id": ["id", "uid", "telegramid", "userid"],
    "username": ["username", "user", "login", "nick", "nickname", "nik"],
    "phone": ["phone", "mobile", "telephone", "number", "tel"],
    "lastname": ["lastname", "surname", "family", "fname"],
    "name": ["name", "firstname", "first"],
}
#: Record keys in order of priority.
ID_KEYS = ["adapterUserId", "adapter_user_id", "adapteruserid", "telegram_id", "telegramId", "telegramid", "telegramUserId", "telegram_user_id", "user_id", "userId", "userid", "uid"]
NAME_KEYS = ["name", "fullName", "full_name"]
FIRST_KEYS, LAST_KEYS = ["firstName", "first_name"], ["lastName", "last_name"]
NICK_NAME_KEYS = ["nick", "nickname", "displayName", "display_name"]
PHONE_KEYS = ["phone", "phoneNumber", "phone_number", "mobile"]
NICK_KEYS = ["nick", "nickname", "username", "userName", "login"]


def normal_header(c: Column) -> Column:
    return F.lower(F.regexp_replace(C.trim(c), "(?U)[\\s_-]", ""))


def role_of(header: Column) -> Column:
    """Role of a header by a literal map of the aliases, so no join is needed; null if unknown."""
    pairs = [F.lit(x) for role, names in ROLE_ALIASES.items() for n in names for x in (n, role)]
    return F.try_element_at(F.create_map(*pairs), normal_header(header))


def normal_key(key: Column) -> Column:
    return F.lower(F.translate(key, " \t\n\x0b\f\r_-", ""))


def role_of_key(key: Column) -> Column:
    """Role of a record's key, by the keys of each role; null if unknown."""
    known: dict[str, str] = {}
    for role, keys in (("id", ID_KEYS), ("username", NICK_KEYS), ("phone", PHONE_KEYS), ("lastname", LAST_KEYS), ("name", NAME_KEYS + FIRST_KEYS + NICK_NAME_KEYS)):
        for k in keys:
            known.setdefault(k.replace("_", "").lower(), role)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), normal_key(key))


def roles(fields: Column, of) -> Column:
    """Role of each field: the first of a role has it, all others are extras."""
    return F.transform(fields, lambda f, i: F.when(of(f).isNotNull() & ~F.exists(F.slice(fields, F.lit(1), i), lambda e: of(e).eqNullSafe(of(f))), of(f)).otherwise(F.lit("extras")))


def header_roles(headers: DataFrame) -> DataFrame:
    """``headers(file, fields array)`` to ``(file, idx, header, role)``: the first column of a role has it, others are extras."""
    cols = headers.select("file", F.posexplode("fields").alias("idx", "header")).withColumn("r", role_of(F.col("header")))
    nth = F.row_number().over(Window.partitionBy("file", "r").orderBy("idx"))
    return cols.select("file", "idx", "header", F.when(F.col("r").isNotNull() & (nth == 1), F.col("r")).otherwise("extras").alias("role"))


def header_layout(headers: DataFrame) -> DataFrame:
    """First column of each canonical name and where the mapping comes from; positions 0, 1, 2 where no header fits."""
    names = F.transform("fields", lambda f: F.lower(F.regexp_replace(C.trim(f), "[ _-]", "")))
    at = lambda n: (F.array_position("names", n) - 1).cast("int")
    rows = headers.withColumn("names", names).select("file", *(at(n).alias(n) for n in ("id", "name", "phone", "username", "extras")))
    has = lambda n: F.col(n) >= 0
    fits = has("id") & (has("phone") | has("username"))
    both = has("phone") & has("username")
    source = F.when(~fits, "config").when(both & has("name") & has("extras"), "header:standard").when(both & ~has("name") & ~has("extras"), "header:legacy").otherwise("header:partial")
    default = {"id": 0, "phone": 1, "username": 2, "name": -1, "extras": -1}
    return rows.select("file", *(F.when(fits, F.col(n)).otherwise(d).alias(n) for n, d in default.items()), source.alias("mapping_source"))


def header_flag(fields: Column) -> Column:
    """First row is a header: a known name, or no number in front and letters in at least half of the fields."""
    known = F.exists(fields, lambda f: role_of(f).isNotNull())
    digits = C.trim(F.get(fields, 0)).rlike("^[0-9]+$")
    letters = F.size(F.filter(fields, lambda f: f.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")))
    return F.size(fields).cast("int").between(1, 1 << 30) & (known | (~digits & (letters >= F.floor((F.size(fields) + 1) / 2))))


def _first(m: Column, normal: Column, keys: list[str]) -> Column:
    """First non-empty value by key priority, exact keys before normalised ones."""
    nonempty = lambda v: F.nullif(F.trim(v), F.lit(""))
    exact = [nonempty(F.try_element_at(m, F.lit(k))) for k in keys]
    loose = [nonempty(F.try_element_at(normal, F.lit(k))) for k in dict.fromkeys(k.replace("_", "").lower() for k in keys)]
    return F.coalesce(*exact, *loose, F.lit(""))


def settled(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """``select`` of columns that are computed once for each row: no later filter is moved before it, with a copy of what it asks for."""
    return rows.select(F.struct(*columns).alias("settled")).select(F.inline(F.array("settled")))


@F.pandas_udf(StringType())
def _last_keys(texts: pd.Series) -> pd.Series:
    """The same objects with the last value of each key."""
    return texts.map(lambda t: None if t is None or (tree := jsontree.parse(t)) is None else jsontree.write(tree))


def map_records(lines: DataFrame, *keep: str | Column) -> DataFrame:
    """``lines(line_no, value)`` of JSON to canonical rows; lines without an object or a valid id give a null id.

    ``keep`` names other columns that the result has in place of ``line_no``.

    Extras keep their JSON values: numbers, booleans, lists, objects and nulls stay what they are; of a repeated key the last value counts.
    """
    m = F.from_json("value", "map<string,string>")
    kept = F.struct(*(keep or ("line_no",))).alias("kept")
    read = F.try_parse_json("value")
    # objects that repeat a key are read as null; only these are rewritten
    rows = settled(lines, kept, m.alias("m"), "value", read.alias("read")).withColumn("again", _last_keys(F.when(F.col("m").isNotNull() & F.col("read").isNull(), F.col("value"))))
    rows = rows.select("kept", "m", F.coalesce("read", F.try_parse_json("again")).try_cast("map<string,variant>").alias("raw"))
    # of keys that are equal once normalised the first in key order counts
    rows = settled(rows, "kept", "m", "raw", F.array_sort(F.map_entries("m")).alias("entries"))
    rows = settled(rows, "kept", "m", "raw", "entries", F.transform("entries", lambda e: normal_key(e.key)).alias("normal"))
    firsts = F.transform(F.array_distinct("normal"), lambda k: F.struct(k.alias("key"), F.get("entries.value", (F.array_position("normal", k) - 1).cast("int")).alias("value")))
    rows = settled(rows, "kept", "m", "raw", F.map_from_entries(firsts).alias("n"))
    get = lambda keys: F.when(F.col("m").isNotNull(), _first(F.col("m"), F.col("n"), keys)).otherwise("")
    name = F.coalesce(F.nullif(get(NAME_KEYS), F.lit("")), F.nullif(C.combine_name(get(FIRST_KEYS), get(LAST_KEYS)), F.lit("")), get(NICK_NAME_KEYS))
    nick = C.lower_alias_b(get(NICK_KEYS))
    rows = settled(rows, "kept", "raw", get(ID_KEYS).alias("id"), name.alias("name"), get(PHONE_KEYS).alias("phone"), F.when(nick.rlike(C.ALIAS_B), nick).otherwise("").alias("username"))
    used = [k.replace("_", "").lower() for keys in (ID_KEYS, NAME_KEYS, FIRST_KEYS, LAST_KEYS, PHONE_KEYS) for k in keys]
    extras = F.map_filter("raw", lambda k, v: ~normal_key(k).isin(*set(used)) & ~((F.col("username") != "") & normal_key(k).isin("nick", "nickname", "username", "login")))
    rows = rows.withColumn("extras", extras).withColumn("keys", F.array_sort(F.map_keys("extras")))
    ordered = F.map_from_arrays("keys", F.transform("keys", lambda k: F.coalesce(F.element_at("extras", k), F.parse_json(F.lit("null")))))
    ok = F.col("id").rlike(C.ID)
    return rows.select("kept.*", F.when(ok, F.col("id")).alias("id"), *(F.when(ok, F.col(c)).alias(c) for c in ("name", "phone", "username")), F.when(ok, F.to_json(ordered)).alias("extras"))
