"""Keyed merges: ordered folds per key as aggregates, never as collected groups where an aggregate says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jsontree import Merged, write
from .ordered import ordered_reduce


def first_wins(rows: DataFrame) -> DataFrame:
    """The first row of each id by seq; min_by has a partial form, so hot ids shrink before the shuffle."""
    fields = [c for c in rows.columns if c not in ("id", "seq")]
    return rows.groupBy("id").agg(F.min(F.struct("seq", *fields)).alias("r")).select("id", "r.seq", *(f"r.{c}" for c in fields))


def upsert(rows: DataFrame) -> DataFrame:
    """Last non-empty value of each field by seq; a field never set is empty."""
    last = lambda c: F.coalesce(F.expr(f"max_by({c}, seq) FILTER (WHERE {c} <> '')"), F.lit("")).alias(c)
    return rows.groupBy("id").agg(last("name"), last("alias_a"), last("alias_b"), F.count("*").alias("n_rows"))


def merge_json(rows: DataFrame) -> DataFrame:
    """``rows(id, seq, extras)`` to ``(id, merged)``: the texts of each id merged in order of seq, see ``jsontree``."""
    return ordered_reduce(rows.select("id", "seq", "extras"), "id", ["seq"], "id string, merged string", Merged, lambda s, r: s.take(r.extras), lambda k, s: (k, s.text()))


def merge_json_keys(rows: DataFrame) -> DataFrame:
    """The merged object of each id as ``(id, key, merged)``, a row for each of its keys."""
    pairs = lambda k, s: [(k, key, write(value)) for key, value in (s.tree or {}).items()]
    return ordered_reduce(rows.select("id", "seq", "extras"), "id", ["seq"], "id string, key string, merged string", Merged, lambda s, r: s.take(r.extras), pairs)


def upsert_with_extras(rows: DataFrame, existing: DataFrame | None = None, tell_old: bool = False) -> DataFrame:
    """``upsert`` with merged extras, onto the ``existing`` records if there are any: one shuffle by id, one ordered pass.

    ``existing`` has the columns of the result; its rows come before all others. ``tell_old`` adds ``n_old``, the rows that an existing record had.
    """
    fields = ["name", "alias_a", "alias_b"]
    new = rows.select("id", F.col("seq").cast("long").alias("seq"), *fields, "extras", F.lit(1).cast("long").alias("n_rows"), F.lit(1).alias("late"))
    if existing is not None:
        new = existing.select("id", F.lit(None).cast("long").alias("seq"), *fields, "extras", F.col("n_rows").cast("long").alias("n_rows"), F.lit(0).alias("late")).unionByName(new)

    def step(state: list, r) -> list:
        for k, value in enumerate((r.name, r.alias_a, r.alias_b)):
            state[k] = value or state[k]
        state[3] += r.n_rows
        if r.late:
            state[4].take(r.extras)
        else:
            # most existing records meet no row: what they have is neither read nor written again
            state[4], state[5] = Merged(r.extras), r.n_rows
        return state

    schema = "id string, name string, alias_a string, alias_b string, n_rows long, extras string, n_old long"
    out = ordered_reduce(new, "id", ["late", "seq"], schema, lambda: ["", "", "", 0, Merged(), 0], step, lambda k, s: (k, *s[:4], s[4].text(), s[5]))
    return out if tell_old else out.drop("n_old")


def _carried(rows: DataFrame, alias: str, existing: DataFrame | None = None) -> DataFrame:
    """``(id, seq, alias)``: the alias that each row's id carries at that time, from ``existing(id, alias)`` on; rows without one are left out."""
    rows = rows.select("id", F.col("seq").cast("long").alias("seq"), F.nullif(F.col(alias), F.lit("")).alias("alias"))
    if existing is not None:
        rows = rows.unionByName(existing.select("id", F.lit(None).cast("long").alias("seq"), F.nullif(F.col(alias), F.lit("")).alias("alias")))
    run = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", "seq", F.last("alias", ignorenulls=True).over(run).alias("alias")).where("alias is not null")


def alias_writes(rows: DataFrame, alias: str, existing: DataFrame | None = None) -> DataFrame:
    """``(alias, id, seq)``: the last write of each alias by ``rows``, whose ids start from the ``existing`` records."""
    return last_writes(_carried(rows, alias, existing).where("seq is not null"))


def last_writes(writes: DataFrame) -> DataFrame:
    return writes.groupBy("alias").agg(F.max(F.struct("seq", "id")).alias("r")).select("alias", "r.id", "r.seq")


def alias_index(rows: DataFrame, alias: str) -> DataFrame:
    """alias to id, last writer wins; each row writes the alias its id carries at that time.

    ``is_current`` tells whether the id still has that alias at the end.
    """
    carried = _carried(rows, alias).withColumn("final", F.max_by("alias", "seq").over(Window.partitionBy("id")))
    return carried.groupBy("alias").agg(F.max(F.struct("seq", "id", "final")).alias("r")).select("alias", "r.id", (F.col("r.final") == F.col("alias")).alias("is_current"))


def with_current(index: DataFrame, records: DataFrame, alias: str) -> DataFrame:
    """A kept index ``(alias, id, seq)`` with ``is_current``, from the kept records."""
    final = records.select(F.col("id").alias("of"), F.col(alias).alias("final"))
    return index.join(final, F.col("id") == F.col("of"), "left").select("alias", "id", F.coalesce(F.col("final") == F.col("alias"), F.lit(False)).alias("is_current"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key in batch order."""
    fields = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *fields)).alias("r")).select(key, *(f"r.{c}" for c in fields))


def profile_upsert(existing: DataFrame, incoming: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """Insert, or on conflict take only ``updated`` columns from the incoming row; one shuffle join."""
    old, new = existing.alias("o"), incoming.alias("n")
    out = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in existing.columns:
        if c != key:
            out.append((F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in updated else F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*out)
