"""Column expressions for keys, aliases, names and probes. Absent is the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = "^(0|[1-9][0-9]{0,31})$"
ALIAS_A = "^\\+?[0-9]{7,15}$"
ALIAS_B = "^[a-z_][a-z0-9_]{2,63}$"
#: Characters of Unicode white space.
SPACES = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trim(c: Column | str) -> Column:
    """Strips Unicode white space at both ends."""
    return F.trim(text(c), F.lit(SPACES))


def is_id(c: Column) -> Column:
    return c.rlike(ID)


def squeeze_alias_a(c: Column | str) -> Column:
    """Phone-shaped alias without white space, dashes and brackets."""
    return F.regexp_replace(trim(c), "(?U)[\\s()-]", "")


def clean_alias_a(c: Column | str) -> Column:
    """Squeezed alias with 7 to 15 digits, else empty."""
    a = squeeze_alias_a(c)
    return F.when(a.rlike(ALIAS_A), a).otherwise(F.lit(""))


def canonical_alias_a(c: Column | str) -> Column:
    """Digits only; empty where other characters or a wrong number of digits are found."""
    digits = F.regexp_replace(F.regexp_replace(trim(c), "^\\+", ""), "[-(). ]", "")
    return F.when(digits.rlike("^[0-9]{7,15}$"), digits).otherwise(F.lit(""))


def lower_alias_b(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(trim(c), "^@", ""))


def clean_alias_b(c: Column | str, most: int = 64) -> Column:
    """Handle-shaped alias; other characters are dropped if that makes it valid, else it is empty."""
    valid = f"^[a-z_][a-z0-9_]{{2,{most - 1}}}$"
    b = lower_alias_b(c)
    kept = F.regexp_replace(b, "[^a-z0-9_]", "")
    return F.when(b.rlike(valid), b).when(kept.rlike(valid), kept).otherwise(F.lit(""))


def combine_name(first: Column | str, last: Column | str) -> Column:
    return F.concat_ws(" ", F.nullif(trim(first), F.lit("")), F.nullif(trim(last), F.lit("")))


def route(c: Column | str) -> Column:
    """Kind of a probe: id, alias_a or alias_b."""
    t = trim(c)
    bare = F.regexp_replace(t, "(?U)[\\s()+-]", "")
    return F.when(t.rlike("^[0-9]+$"), "id").when(t.startswith("+") | bare.rlike("^[0-9]{7,}$"), "alias_a").otherwise("alias_b")


def probe_key(c: Column | str) -> Column:
    """The routed probe in the form of its index's keys; null where it is invalid."""
    t, a, b = trim(c), squeeze_alias_a(c), lower_alias_b(c)
    kind = route(c)
    return F.when((kind == "id") & t.rlike(ID), t).when((kind == "alias_a") & a.rlike(ALIAS_A), a).when((kind == "alias_b") & b.rlike(ALIAS_B), b)
