"""SimHash fingerprints with DataFrame functions only, and their search by permuted block tables.

Each text's terms (three lower-cased words in a row) vote with their weight on
64 signed bits. Votes are summed by an exploded grouping, two bits to a 64-bit
sum, with partial sums in each task. All fingerprints within a Hamming radius
are found by equality on every choice of blocks that must stay untouched.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

BITS, TERM = 64, 3
#: A term weighs this much if its middle word has more than three letters, else 1.
LONG_WEIGHT = 2
RADIUS, BLOCKS = 3, 6
ROWS_A_BUCKET, MOST_BUCKETS = 4000, 22_500


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _terms(words: Column) -> Column:
    """Array of (h, w): hash and weight of each term; a shorter text is one term, one without words none.

    ``words`` must be a column of its own: a lambda evaluates what it holds for each element.
    """
    at = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - TERM, F.lit(0))))
    return F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get(words, i + j) for j in range(TERM))).alias("h"), F.when(F.length(F.get(words, i + 1)) > 3, F.lit(LONG_WEIGHT)).otherwise(F.lit(1)).alias("w")))


def _votes() -> list[Column]:
    """Sums of weights by bit, bits k and k + 32 together, and the sum of all weights."""
    h, w = F.col("t.h"), F.col("t.w").cast("long")
    pair = lambda k: F.shiftright(h, k).bitwiseAND(F.lit(0x100000001))
    return [*(F.sum(pair(k) * w).alias(f"v{k}") for k in range(BITS // 2)), F.sum(w).alias("weight")]


def _fingerprint() -> Column:
    """Bit k is 1 where more than half of the weight voted for it; no terms give 0."""
    out = F.lit(0).cast("long")
    for k in range(BITS // 2):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{k}"), 32)
        for bit, votes in ((k, low), (k + 32, high)):
            out = out.bitwiseOR(F.when(2 * votes > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One 64-bit fingerprint for each distinct value of ``keys``, from all terms of its texts."""
    rows = texts.select(*keys, _words(F.col(text)).alias("words")).select(*keys, F.explode_outer(_terms(F.col("words"))).alias("t"))
    return rows.groupBy(*keys).agg(*_votes()).select(*keys, _fingerprint().alias("fp"))


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def neighbours(fingerprints: DataFrame, scratch: Scratch, radius: int = RADIUS, blocks: int = BLOCKS, rows: int = 256) -> DataFrame:
    """``(fp, n_near)``: for each distinct value of column ``fp`` the others that differ in 1 to ``radius`` bits, where there are any.

    With ``blocks`` blocks, ``radius`` changed bits leave ``blocks - radius`` of
    them equal, so each choice of that many is a table of its own: here 20
    tables with keys of 32 bits, which keep buckets short for billions of
    fingerprints. A bucket is cut by hash into pieces of about ``rows`` values,
    and each two pieces are compared as arrays in a row of their own, so a large
    bucket is the work of many tasks and no pair is ever a row. A pair counts in
    the first of its tables only.
    """
    one = fingerprints.select("fp").where("fp is not null").distinct()
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*(F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    keyed = one.select("fp", F.explode(tables).alias("t")).select("fp", "t.no", "t.key")
    sizes = scratch.put(keyed.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    inside = keyed.join(sizes, ["no", "key"]).withColumn("pieces", F.ceil(F.col("n") / rows).cast("int"))
    inside = inside.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    pieces = scratch.put(inside.groupBy("no", "key", "pieces", "piece").agg(F.collect_list("fp").alias("fps")), "pieces")
    whole = pieces.select("no", "key", F.col("fps").alias("a"), F.col("fps").alias("b"))
    many = pieces.where("pieces > 1")
    x = many.select("no", "key", F.col("fps").alias("a"), F.col("piece").alias("i"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("j")).where("i <> j")
    y = many.select(F.col("no").alias("yno"), F.col("key").alias("ykey"), F.col("piece").alias("yj"), F.col("fps").alias("b"))
    across = x.join(y, (F.col("no") == F.col("yno")) & (F.col("key") == F.col("ykey")) & (F.col("j") == F.col("yj"))).select("no", "key", "a", "b")
    # column of its own, as a lambda evaluates what it holds for each element
    both = whole.unionByName(across).withColumn("earlier", F.slice(F.array(*map(F.lit, signed)), F.lit(1), F.col("no")))

    def near(u: Column, v: Column) -> Column:
        apart = u.bitwiseXOR(v)
        return F.bit_count(apart).between(1, radius) & ~F.exists("earlier", lambda m: apart.bitwiseAND(m) == 0)

    found = both.select(F.explode(F.transform("a", lambda u: F.struct(u.alias("fp"), F.size(F.filter("b", lambda v: near(u, v))).alias("n")))).alias("f"))
    return found.select("f.fp", "f.n").where("n > 0").groupBy("fp").agg(F.sum("n").alias("n_near"))


def _bounds(docs: DataFrame) -> list[int]:
    """Ascending ids that cut the table into buckets of about ``ROWS_A_BUCKET`` rows, at most ``MOST_BUCKETS``."""
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // ROWS_A_BUCKET))
    if buckets == 1:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    return sorted(set(found or []))


def _bucket(bounds: list[int]) -> Column:
    """Number of bounds below or at the id, looked up in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    below = lambda arr: F.size(F.filter(arr, lambda b: b <= F.col("doc_id")))
    inner = F.array(*(F.array(*(F.lit(b).cast("long") for b in g)) for g in groups))
    at = below(heads)
    return F.when(F.col("doc_id").isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + below(F.get(inner, at - 1)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to fingerprints of each text and its edited text, one row per input row.

    The edited text replaces the last floor(n / 4) code points by the first as
    many (or all) of the next document in ascending (doc_id, text) order; the
    last document's next is the first. ``n_near`` counts other fingerprints of
    the table within ``RADIUS`` bits. Null text is empty; a text without words
    has fingerprint 0; rows with null ids come first; a single document is its
    own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("bucket", _bucket(_bounds(docs)))
    # at most MOST_BUCKETS rows: size and both ends of every bucket
    ends = sorted(docs.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("ids")).collect(), key=lambda r: r.bucket)
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = docs.withColumns({"no": F.row_number().over(order), "next_text": F.lead("text").over(order)}).where("next_text is not null").withColumns({"next_bucket": F.col("bucket"), "next_no": F.col("no") + 1})
    kind = "bucket int, n int, lo long, hi long, next_bucket int"
    seam = spark.createDataFrame([(r.bucket, r.n, None if r.ids < r.n else r.lo, r.hi, ends[(i + 1) % len(ends)].bucket) for i, r in enumerate(ends)], kind)
    seam = F.broadcast(seam)
    tails = docs.join(seam, "bucket").where(F.col("doc_id").eqNullSafe(F.col("hi"))).groupBy("bucket", "next_bucket", "n", "doc_id").agg(F.max("text").alias("text"))
    heads = docs.join(seam.select("bucket", "lo"), "bucket").where(F.col("doc_id").eqNullSafe(F.col("lo"))).groupBy("bucket").agg(F.min("text").alias("next_text")).withColumnRenamed("bucket", "next_bucket")
    last = tails.join(heads, "next_bucket").select("doc_id", "text", "bucket", F.col("n").alias("no"), "next_text", "next_bucket", F.lit(1).alias("next_no"))
    both = rows.select(last.columns).unionByName(last)
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.when(cut > 0, F.substring(F.col("next_text"), F.lit(1), cut)).otherwise(F.lit("")))
    both = both.select("doc_id", "bucket", "no", "next_bucket", "next_no", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["bucket", "no", "next_bucket", "next_no", "doc_id", "n_chars", "edited_sha256"]
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v")).select(*keys, "v.kind", "v.text")
    votes = scratch.put(simhash(both, [*keys, "kind"]), "votes")
    own = votes.where("kind = 0").drop("kind")
    other = votes.where("kind = 1").select(F.col("bucket").alias("eb"), F.col("no").alias("en"), F.col("fp").alias("edited_fp"))
    following = own.select(F.col("bucket").alias("nb"), F.col("no").alias("nn"), F.col("fp").alias("next_fp"))
    out = own.join(other, (F.col("bucket") == F.col("eb")) & (F.col("no") == F.col("en"))).join(following, (F.col("next_bucket") == F.col("nb")) & (F.col("next_no") == F.col("nn")))
    # written, so that this join is no part of the grouping's stage and a fingerprint of many copies can be split
    near = scratch.put(neighbours(own, scratch), "near").withColumnRenamed("fp", "near_fp")
    out = out.join(near, F.col("fp") == F.col("near_fp"), "left")
    text = lambda c: F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))
    return out.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
