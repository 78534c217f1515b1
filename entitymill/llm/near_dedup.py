"""MinHash near-duplicate detection by fast similarity sketching.

Sketch: a text's set of word shingles fills ``BINS`` coordinates. In rounds
0..BINS-1 each element falls into one pseudo-random bin with a value that
grows with the round; in rounds BINS..2*BINS-1 every element visits bin
``round - BINS``. The smallest value stays. So each coordinate is filled for
any non-empty set, two sets agree in a coordinate with probability equal to
their similarity, and the estimate is concentrated like that of independent
coordinates, at a cost near |set| + BINS log BINS instead of |set| * BINS.

Candidates: ``BANDS`` bands of ``ROWS`` coordinates. A pair at similarity 0.8
misses all of them with probability (1 - 0.8^5)^36 = 6e-7. Only distinct sets
take part; copies inherit their class. No bucket emits all of its pairs:

1. each member of a bucket is paired with the bucket's hub (one consistent
   order picks it, so a group's buckets share a hub) and checked exactly;
2. components of these links are formed; a bucket of one component is done;
3. the documents of the other buckets are joined exactly on the rarest
   shingles of each (of two sets at similarity 0.8 or more one of the first
   size - ceil(0.8 size) + 1, in order of frequency, is in both), across
   components only, with the bound that the places of the shared shingle put on
   the intersection.

Before a pair's texts are read, its parity sketches are compared: each shingle
flips one of ``PARITY`` bits, so two sketches never differ in more bits than the
sets in elements, and a pair with too many differing bits is surely no link.
Every remaining pair is confirmed on the full shingle sets of both texts.
A set's node is the least (doc_id, text hash) of its rows, so different texts
under one id, or without an id, keep their own sets and links.
Null text is empty; empty texts are in no link; repeated rows share their
class; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .components import connected_components
from .textnum import U, Words, mix, shingles, sums_by

BINS, BANDS, ROWS = 320, 36, 5
PARITY = 1024
#: Nodes that are sent to every task, some 30 MB, and bits of the table that stands for more of them, as much.
MOST_NODES, BITS = 500_000, 1 << 25
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_NODE = "struct<id:long,t:long>"
_SCHEMA = f"node {_NODE}, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"
#: Stands for a missing id in a node, so that any id comes before it.
_NO_ID = (1 << 63) - 1


def sketch(doc: np.ndarray, element: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of n sets given as sorted (set, element) rows; empty sets stay unfilled."""
    out = np.full((n, bins), _EMPTY, U)
    flat = out.reshape(-1)
    has = np.bincount(doc, minlength=n) > 0
    d, e = doc, element
    for r in range(bins):
        h = mix(e ^ U((r * 0x9E3779B97F4A7C15 + 0x1F83D9AB) & 0xFFFFFFFFFFFFFFFF))
        at = d * bins + ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)
        np.minimum.at(flat, at, U(r << 32) | (h & U(0xFFFFFFFF)))
        open_ = has & (out == _EMPTY).any(axis=1)
        if not open_.any():
            return out
        keep = open_[d]
        if not keep.all():
            d, e = d[keep], e[keep]
    for b in range(bins):
        need = has & (out[:, b] == _EMPTY)
        if need.any():
            keep = need[d]
            h = mix(e[keep] ^ U(((bins + b) * 0x9E3779B97F4A7C15 + 0x1F83D9AB) & 0xFFFFFFFFFFFFFFFF))
            np.minimum.at(flat, d[keep] * bins + b, U((bins + b) << 32) | (h & U(0xFFFFFFFF)))
    return out


def _sketch_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                doc, sh = shingles(Words(part.column("text"), lower=True), k)
                n = part.num_rows
                size = np.bincount(doc, minlength=n)
                a, b = sums_by(doc, mix(sh + U(1)), n), sums_by(doc, mix(sh ^ U(0xA5A5A5A5A5A5A5A5)), n)
                s = sketch(doc, sh, n)
                bands = np.zeros((n, BANDS), U)
                for j in range(ROWS):
                    bands = mix(bands * U(0x9E3779B97F4A7C15) + s[:, j : BANDS * ROWS : ROWS] + np.arange(BANDS, dtype=U))
                flips = np.bincount(doc * PARITY + (mix(sh ^ U(0x3C3C3C3C)) % U(PARITY)).astype(np.int64), minlength=n * PARITY)
                bits = np.packbits((flips & 1).astype(np.uint8).reshape(n, PARITY), axis=1).view(np.int64)
                full = size > 0

                def rows(x: np.ndarray, full: np.ndarray = full) -> pa.Array:
                    x = np.ascontiguousarray(x[full]).view(np.int64)
                    off = np.concatenate([[0], np.cumsum(np.where(full, x.shape[1], 0))]).astype(np.int32)
                    return pa.ListArray.from_arrays(off, x.reshape(-1))

                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(size, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), rows(bands), rows(bits)],
                    names=["node", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    return run


def _exact(k: int, percent: int):
    """Keeps the pairs (a, b, text_a, text_b) with 100 * shared >= percent * united on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text_a", 1 << 20):
                for few in slices(part, "text_b", 1 << 20):
                    n = few.num_rows
                    (da, ha), (db, hb) = (shingles(Words(few.column(c), lower=True), k) for c in ("text_a", "text_b"))
                    doc, sh = np.concatenate([da, db]), np.concatenate([ha, hb])
                    order = np.lexsort((sh, doc))
                    doc, sh = doc[order], sh[order]
                    twice = (doc[1:] == doc[:-1]) & (sh[1:] == sh[:-1])
                    shared = np.bincount(doc[1:][twice], minlength=n)
                    united = np.bincount(doc, minlength=n) - shared
                    ok = pa.array((united > 0) & (100 * shared >= percent * united))
                    yield pa.RecordBatch.from_arrays([few.column("a").filter(ok), few.column("b").filter(ok)], names=["a", "b"])

    return run


def _all_shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                doc, sh = shingles(Words(part.column("text"), lower=True), k)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(doc)), pa.array(sh.view(np.int64))], names=["node", "s"])

    return run


def _met(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` that may be among ``nodes`` (distinct, written), and those that surely aren't; None where the first are exact.

    Up to ``MOST_NODES`` nodes are sent to every task. Of more nodes a table of ``BITS`` hashed bits is sent, at most
    ``BITS`` / 64 numbers, and only rows whose bit is set are shuffled to be joined.
    """
    if nodes.count() <= MOST_NODES:
        return rows.join(F.broadcast(nodes), "node", "left_semi"), None
    place = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(BITS))
    word, bit = F.floor(place / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bits = nodes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word", "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    maybe, never = (rows.where(c).drop("word", "bit", "bits") for c in (hit, ~hit))
    return maybe, never


def _only(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each of ``nodes`` that ``docs`` has."""
    met, others = _met(docs, nodes)
    return (met if others is None else met.join(nodes, "node", "left_semi")).dropDuplicates(["node"])


def _parted(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` among ``nodes``, and all others."""
    met, others = _met(rows, nodes)
    if others is None:
        return met, rows.join(F.broadcast(nodes), "node", "left_anti")
    return met.join(nodes, "node", "left_semi"), others.unionByName(met.join(nodes, "node", "left_anti"))


def _confirm(scratch: Scratch, name: str, pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Exact check; the texts of the pairs' nodes are read again, only those."""
    text = _only(docs, scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name))
    both = pairs.join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(k, percent), f"a {_NODE}, b {_NODE}")


def _near(x: str, y: str, percent: int):
    """Sizes and parity sketches allow the similarity p: elements apart <= (1 - p) / (1 + p) * sum of sizes."""
    apart = F.lit(0)
    for i in range(PARITY // 64):
        apart = apart + F.bit_count(F.col(f"{x}_bits")[i].bitwiseXOR(F.col(f"{y}_bits")[i]))
    a, b = F.col(f"{x}_size"), F.col(f"{y}_size")
    return ((100 + percent) * apart <= (100 - percent) * (a + b)) & (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _alike(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """The pairs that may be links by their sketches."""
    a, b = (one.select(F.col("node").alias(n), F.col("bits").alias(f"{n}_bits"), F.col("n_shingles").alias(f"{n}_size")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").where(_near("a", "b", percent)).select("a", "b")


def _nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``node``."""
    return docs.withColumn("node", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("t")))


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs(node, text)`` to ``(node, n_shingles, component)``, one row per input row; texts without words have no component."""
    scratch = Scratch(docs.sparkSession, "near")
    sk = scratch.put(docs.mapInArrow(_sketch_rows(k), _SCHEMA), "sketch")
    reps = scratch.put(sk.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("node").alias("rep")), "reps")
    rows = sk.join(reps.select(F.col("rep").alias("node")), "node", "left_semi").dropDuplicates(["node"])
    one = scratch.put(rows.select("node", "n_shingles", "bands", "bits"), "distinct")
    entries = one.select("node", F.explode("bands").alias("band"))
    buckets = scratch.put(entries.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("o"), "node")).alias("hub")).where("n > 1").select("band", F.col("hub.node").alias("hub")), "buckets")
    members = scratch.put(entries.join(buckets, "band"), "members")
    pairs = _alike(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), one, percent)
    links = scratch.put(_confirm(scratch, "star-nodes", scratch.put(pairs, "star"), docs, k, percent), "links")
    classes = scratch.put(connected_components(links, scratch, "first"), "classes")
    links = _rest(scratch, docs, one, members, classes, links, k, percent)
    if links is not None:
        classes = scratch.put(connected_components(links, scratch, "second"), "classes2")
    scratch.drop("members", "distinct", "buckets")
    whole = scratch.put(reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component")), "whole")
    out = sk.select("node", "n_shingles", "set_a", "set_b")
    linked = out.where("n_shingles > 0").join(whole, ["set_a", "set_b"]).select("node", "n_shingles", "component")
    return linked.unionByName(out.where("n_shingles = 0").select("node", "n_shingles", F.lit(None).cast(_NODE).alias("component")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Links join texts whose k-word shingle sets (A-Z lower-cased) have
    100 * intersection >= percent * union; a component's id is its smallest
    doc_id and that document is kept. Texts without words are kept, alone. Rows
    without an id take part; a component of such rows only has a null id, and
    of it the rows of one text are kept.
    """
    rows = _classes(_nodes(docs.select("doc_id", "text")).select("node", "text"), k, percent)
    doc_id, component = F.nullif(F.col("node.id"), F.lit(_NO_ID)), F.nullif(F.col("component.id"), F.lit(_NO_ID))
    kept = F.when(F.col("component").isNull(), True).when(component.isNull(), F.col("node") == F.col("component")).otherwise(doc_id.eqNullSafe(component))
    return rows.select(doc_id.alias("doc_id"), "n_shingles", F.when(F.col("component").isNull(), doc_id).otherwise(component).alias("component_id"), kept.alias("kept"))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one text of each component; of equal rows of an id and text one stays.

    Rows are told apart by id and text, so what an id's other texts are does not
    matter, nor whether there is an id. Texts without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    rows = _nodes(docs.select("doc_id", "text"))
    classes = scratch.put(_classes(rows.select("node", "text"), k, percent).select("node", "component"), "classes")
    # few nodes go and few are repeated, so rows meet these and no text is shuffled where they can be sent to every task
    gone = scratch.put(classes.where("component is not null and node <> component").select("node").distinct(), "gone")
    repeated = scratch.put(classes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "repeated")
    _, row = _parted(_nodes(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))).select("row", "node"), gone)
    again, once = _parted(row, repeated)
    return once.unionByName(again.dropDuplicates(["node"])).select("row.*")


def _rest(scratch: Scratch, docs: DataFrame, one: DataFrame, members: DataFrame, classes: DataFrame, links: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Step 3: all links with those between different components of a bucket; None if there is no such bucket."""
    of = classes.select("node", F.col("component").alias("c"))
    inside = scratch.put(members.join(of, "node", "left").withColumn("c", F.coalesce("c", "node")), "inside")
    mixed = inside.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.when(F.col("node") == F.col("hub"), F.col("c"))).alias("hc"), F.count("*").alias("n")).where("lo <> hi and n > 2")
    # written, so that the join is no part of the grouping's stage and a large bucket can be split
    mixed = scratch.put(mixed.select("band", "hc"), "mixed-bands")
    inside = scratch.put(inside.join(mixed, "band").where("node <> hub").select("node", "c").distinct(), "mixed")
    ids = scratch.put(inside.select("node").distinct(), "mixed-ids")
    if not ids.take(1):
        return None
    held = _only(docs, ids).mapInArrow(_all_shingles(k), f"node {_NODE}, s long")
    held = scratch.put(held, "held")
    common = scratch.put(held.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "common")
    # places count from a set's rarest shingle on; those that no other set has come first
    place = Window.partitionBy("node").orderBy("df", "s")
    prefix = held.join(common, "s", "left").select("node", "s", F.coalesce("df", F.lit(1)).alias("df")).withColumn("i", F.row_number().over(place))
    size = scratch.put(inside.groupBy("c").agg(F.approx_count_distinct("node").alias("members")), "sizes")
    facts = scratch.put(inside.join(one.select("node", F.col("n_shingles").alias("size")), "node").join(size, "c"), "facts")
    prefix = prefix.join(facts, "node").where(f"df > 1 and i <= size - ceil({percent} * size / 100D) + 1")
    prefix = scratch.put(prefix.select("s", F.col("node").alias("id"), "i", "size", "c", "members"), "prefix")
    heads = prefix.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("members", "c")).alias("head")).where("lo <> hi").select("s", F.col("head.c").alias("hc"))
    heads = scratch.put(heads, "heads")
    side = scratch.put(prefix.join(heads, "s").join(one.select(F.col("node").alias("id"), "bits"), "id"), "sides")
    x = side.where("c <> hc").select("s", *(F.col(n).alias(f"x_{n}") for n in ("id", "c", "i", "size", "bits")))
    y = side.select("s", "hc", *(F.col(n).alias(f"y_{n}") for n in ("id", "c", "i", "size", "bits")))
    # the most that the sets can share if this is the first shingle that both have; shared >= percent/100 * united, united = sizes - shared
    most = F.least(F.col("x_size") - F.col("x_i"), F.col("y_size") - F.col("y_i")) + 1
    enough = (100 + percent) * most >= percent * (F.col("x_size") + F.col("y_size"))
    apart = (F.col("x_c") != F.col("y_c")) & ((F.col("y_c") == F.col("hc")) | (F.col("x_id") < F.col("y_id")))
    pairs = x.join(y, (x.s == y.s) & apart & enough & _near("x", "y", percent)).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()
    more = _confirm(scratch, "rest-nodes", scratch.put(pairs, "rest"), docs, k, percent)
    return links.unionByName(more)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-copies among all documents: 4-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sets UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id
"""
