"""Quality rules: word, symbol and repetition counts, and bands of n-gram perplexity.

The perplexity comes from a character trigram model per language with modified
Kneser-Ney smoothing. Spark counts the trigrams of all documents, in two halves
by a hash of the text (copies share a half), and apart from them those of the
reference texts: at least ``MIN_WORDS`` words, and at most one symbol in
``REFERENCE`` words. From the reference counts of each half it derives
continuation counts, discounts and back-off weights with groupings and joins.
Every trigram of a half gets its smoothed log-probability under the model of
the *other* half, so no text is judged by itself, and this table grows with the
corpus. Its most frequent rows, ``HOT`` of them at most, are broadcast as sorted
hash arrays (the hash is a bijection of the full key, so nothing is merged);
occurrences of the others go to their values by an equi-join on the key, in
which no key is frequent.

A document's score is the median of the mean log-perplexities of its blocks of
about ``BLOCK`` characters, so a passage in another language, a table of
numbers or a licence line decides nothing. A document outside the band of its
language is rejected: the median of all scores minus ``BAND_BELOW`` or plus
``BAND_ABOVE`` times their median absolute deviation, wider for short texts by
sqrt(1 + BLOCK / characters).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .textnum import _BYTE, U, Words, _power_tables, mix

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Words for each symbol that a text must have at least to be counted as reference text.
REFERENCE = 10
BLOCK = 128
#: Deviations from the language's median score beyond which a document goes: below, above.
BAND_BELOW, BAND_ABOVE = 12.0, 12.0
#: Least width of a side of the band, in nats a character; a narrower one would reject on noise.
LEAST_WIDTH = 0.15
#: Most trigrams that are broadcast (32 MB); any number of others is joined.
HOT = 1 << 21
TRI, BI, UNI, BACK2, BACK1, UNSEEN = range(1, 7)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text; null is empty."""
    w = Words(column)
    n, off = w.n, w.off
    zeros = np.zeros(1, np.int64)
    lead = (w.buf & 0xC0) != 0x80
    leads = np.concatenate([zeros, np.cumsum(lead)])
    chars = np.concatenate([zeros, np.cumsum(leads[w.end] - leads[w.start])])
    bounds = np.concatenate([w.first, [len(w.start)]])
    symbols = np.concatenate([zeros, np.cumsum(_SYMBOL[w.buf])])

    breaks = np.flatnonzero(w.buf == 10)
    full = off[:-1] < off[1:]
    start = np.unique(np.concatenate([off[:-1][full], breaks + 1]))
    start = start[start < len(w.buf)]
    end = np.minimum.reduce([off[np.searchsorted(off, start, "right")], np.concatenate([breaks, [len(w.buf)]])[np.searchsorted(breaks, start)]])
    spoken = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[spoken], end[spoken]
    powers, inverse = _power_tables(len(w.buf) + 1)
    sums = np.zeros(len(w.buf) + 1, U)
    np.cumsum(_BYTE[w.buf] * powers[: len(w.buf)], out=sums[1:])
    line = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))
    doc = np.searchsorted(off, start, "right") - 1
    order = np.lexsort((line, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (line[order][1:] == line[order][:-1])
    dup = np.bincount(doc[order][1:][same], minlength=n)

    h = w.hashes()
    many = np.maximum(w.count - WINDOW + 1, 0)
    wdoc = np.repeat(np.arange(n), many)
    at = w.first[wdoc] + (np.arange(len(wdoc)) - np.repeat(np.cumsum(many) - many, many))
    run = np.full(len(at), U(7))
    for j in range(WINDOW):
        run = mix(run * U(0x9E3779B97F4A7C15) + h[at + j]) if len(at) else run
    order = np.lexsort((run, wdoc))
    same = (wdoc[order][1:] == wdoc[order][:-1]) & (run[order][1:] == run[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.concatenate([zeros, np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return {
        "n_words": w.count,
        "word_chars": chars[bounds[1:]] - chars[bounds[:-1]],
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": covered[bounds[1:]] - covered[bounds[:-1]],
    }


def _language(name: str | None, half: int) -> int:
    """A 64-bit name of one half of a language's texts; null is a language of its own."""
    raw = (b"-" if name is None else b"=" + name.encode()) + bytes([half])
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys (21 bits a code point, 0 before a text's start), sizes in code points, and halves of the texts."""
    joined = [t or "" for t in text.to_pylist()]
    cp = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    half = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1 for t in joined), np.int64, len(joined))
    cp[(cp >= 9) & (cp <= 13)] = 32
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    y = np.zeros_like(cp)
    y[1:] = cp[:-1]
    y[first] = 0
    x = np.zeros_like(cp)
    x[1:] = y[:-1]
    x[first] = 0
    return (x << 42) | (y << 21) | cp, sizes, half


def _names(lang: pa.Array, half: np.ndarray) -> np.ndarray:
    names = lang.to_pylist()
    known = {v: (_language(v, 0), _language(v, 1)) for v in set(names)}
    return np.array([known[v][h] for v, h in zip(names, half.tolist())], np.int64)


def _reference(column: pa.Array) -> np.ndarray:
    """Which texts the models are counted from."""
    w = Words(column)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.buf])])
    return (w.count >= MIN_WORDS) & (REFERENCE * (symbols[w.off[1:]] - symbols[w.off[:-1]]) <= w.count)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by half of a language, in all and in reference texts, summed within the task as sorted arrays."""
    held: dict[int, list] = {}

    def merged(parts: list) -> list:
        key, n, ref = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(key, kind="stable")
        key, n, ref = key[order], n[order], ref[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return [(key[at], np.add.reduceat(n, at), np.add.reduceat(ref, at))]

    def out(lang: int, parts: list) -> pa.RecordBatch:
        key, n, ref = merged(parts)[0]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang)), pa.array(key), pa.array(n), pa.array(ref)], names=["lang", "key", "n", "ref"])

    for whole in batches:
        for part in slices(whole, "text", 1 << 20):
            key, sizes, half = _trigrams(part.column("text"))
            of, good = np.repeat(_names(part.column("lang"), half), sizes), np.repeat(_reference(part.column("text")), sizes)
            for lang in np.unique(of).tolist():
                own = of == lang
                found, at, n = np.unique(key[own], return_inverse=True, return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((found, n, np.bincount(at[good[own]], minlength=len(found))))
                if len(parts) > 24:
                    held[lang] = parts = merged(parts)
                    if len(parts[0][0]) > 1 << 19:  # a large alphabet: hand it on and start anew
                        yield out(lang, held.pop(lang))
    for lang, parts in held.items():
        yield out(lang, parts)


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts by language from the counts of counts; usual values where those are missing."""
    c = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    d = counts.groupBy("lang").agg(*c)
    whole = F.expr("n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0")

    def of(k: int):
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when(whole, F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), value))).otherwise(F.lit(0.5 * k)).alias(f"d{k}")

    return d.select("lang", of(1), of(2), of(3))


def _level(counts: DataFrame, context: str) -> tuple[DataFrame, DataFrame]:
    """Discounted share of each row (``p``) and the back-off weight of each context (``g``)."""
    d = counts.join(_discounts(counts), "lang").withColumn("d", F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end"))
    g = d.groupBy("lang", context).agg(F.sum("n").alias("total"), F.sum("d").alias("cut")).select("lang", context, "total", (F.col("cut") / F.col("total")).alias("g"))
    return d.join(g, ["lang", context]).withColumn("p", (F.col("n") - F.col("d")) / F.col("total")), g


def kneser_ney(counts: DataFrame, keep=lambda df, name: df) -> DataFrame:
    """``(lang, key, n)`` trigram counts to ``(kind, lang, key, n, v)`` natural logs of the smoothed model; ``n`` is a trigram's count.

    ``keep(df, name)`` may write a table that several later steps read.
    """
    low = 0x1FFFFF
    tri = keep(counts.groupBy("lang", "key").agg(F.sum("n").alias("n")).selectExpr("lang", "key", "n", "shiftright(key, 21) as xy", f"key & {low * (1 << 21) + low}L as yz"), "tri")
    bi = keep(tri.groupBy("lang", "yz").agg(F.count("*").alias("n")).selectExpr("lang", "yz", "n", "shiftright(yz, 21) as y", f"yz & {low}L as z"), "bi")
    uni = keep(bi.groupBy("lang", "z").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), "uni")
    p3, g3 = _level(tri, "xy")
    p2, g2 = _level(bi, "y")
    p1, g1 = _level(uni, "all")
    v = uni.groupBy("lang").agg((F.count("*") + 1).alias("size"))
    g1 = g1.join(v, "lang").select("lang", (F.col("g") / F.col("size")).alias("unseen"))
    g1, g2, g3 = keep(g1, "g1"), keep(g2, "g2"), keep(g3, "g3")
    p1 = keep(p1.join(g1, "lang").select("lang", "z", (F.col("p") + F.col("unseen")).alias("q1")), "p1")
    p2 = p2.select("lang", "yz", "y", "z", F.col("p")).join(g2.select("lang", "y", "g"), ["lang", "y"]).join(p1, ["lang", "z"]).select("lang", "yz", (F.col("p") + F.col("g") * F.col("q1")).alias("q2"))
    p2 = keep(p2, "p2")
    p3 = p3.select("lang", "key", "xy", "yz", "n", F.col("p")).join(g3.select("lang", "xy", "g"), ["lang", "xy"]).join(p2, ["lang", "yz"]).select("lang", "key", "n", (F.col("p") + F.col("g") * F.col("q2")).alias("q3"))
    parts = [(TRI, p3, "key", "q3"), (BI, p2, "yz", "q2"), (UNI, p1, "z", "q1"), (BACK2, g3, "xy", "g"), (BACK1, g2, "y", "g"), (UNSEEN, g1, "0L", "unseen")]
    rows = [df.selectExpr(f"{kind} as kind", "lang", f"cast({key} as long) as key", "n" if kind == TRI else "cast(null as long) as n", f"ln({value}) as v") for kind, df, key, value in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def held_out_values(counts: DataFrame, halves: DataFrame, keep=lambda df, name: df) -> DataFrame:
    """``(lang, key, n, v)``: each trigram of a half with its log-probability under the other half's model.

    ``counts(lang, key, n, ref)`` is summed; ``halves(lang, other)`` pairs the
    two halves of each language. A trigram, bigram or character that the model
    doesn't know is backed off; where the other half has no reference text, v is
    NaN and nothing is judged by it.
    """
    low = 0x1FFFFF
    model = keep(kneser_ney(counts.where("ref > 0").select("lang", "key", F.col("ref").alias("n")), keep), "model")
    rows = counts.join(halves, "lang").selectExpr("lang", "other", "key", "n", "shiftright(key, 21) as xy", f"key & {low * (1 << 21) + low}L as yz", f"shiftright(key, 21) & {low}L as y", f"key & {low}L as z", "0L as none")
    for kind, on in ((TRI, "key"), (BACK2, "xy"), (BI, "yz"), (BACK1, "y"), (UNI, "z"), (UNSEEN, "none")):
        one = model.where(F.col("kind") == kind).select(F.col("lang").alias("of"), F.col("key").alias("k"), F.col("v").alias(f"v{kind}"))
        rows = rows.join(one, (F.col("other") == F.col("of")) & (F.col(on) == F.col("k")), "left").drop("of", "k")
    v = lambda kind, *rest: F.coalesce(F.col(f"v{kind}"), *rest)
    value = v(TRI, v(BACK2, F.lit(0.0)) + v(BI, v(BACK1, F.lit(0.0)) + v(UNI, v(UNSEEN, F.lit(float("nan"))))))
    return rows.select("lang", "key", "n", value.alias("v"))


class Values:
    """Of each half of a language, the broadcast trigrams as a sorted array of hashes, an index of its first bits, and log-values."""

    def __init__(self, lang: np.ndarray, key: np.ndarray, v: np.ndarray):
        h = mix(key.view(U))
        order = np.lexsort((h, lang))
        lang, h, v = lang[order], h[order], v[order]
        names, first = np.unique(lang, return_index=True)
        self.of = {}
        for k, i, j in zip(names.tolist(), first, [*first[1:], len(lang)]):
            bits = max(int(j - i).bit_length(), 1)
            index = np.searchsorted(h[i:j] >> U(64 - bits), np.arange(1 << bits, dtype=U)).astype(np.int32)
            self.of[k] = U(64 - bits), index, np.append(h[i:j], U(0xFFFFFFFFFFFFFFFF)), np.append(v[i:j], 0.0)

    def get(self, lang: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and their values."""
        if lang not in self.of:
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        shift, index, held, v = self.of[lang]
        h = mix(keys.view(U))
        at = index[(h >> shift).astype(np.int64)]
        todo = np.flatnonzero(held[at] < h)  # hashes are even, so a few steps lead from the index to the place
        while len(todo):
            at[todo] += 1
            todo = todo[held[at[todo]] < h[todo]]
        return held[at] == h, v[at]


def _hot_from(values: DataFrame) -> int:
    """The least count of the broadcast trigrams, a power of two; 1 if all of them are."""
    sizes = values.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("m")).collect()  # 63 rows at most
    total, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r.bits):
        total += r.m
        if total > HOT:
            return least
        least = 1 << (r.bits - 1)
    return 1


def _score(values, carried: list[str]):
    """Carried columns, counts, and of each block its size and the sum of its broadcast trigrams; then its other trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Values = values.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            inside = whole.column("row")
            own = pa.RecordBatch.from_arrays([inside.field(i) for i in range(inside.type.num_fields)], names=[f.name for f in inside.type])
            texts = own.column("text").cast(pa.string())
            done = 0
            for part in slices(own, texts):
                n = part.num_rows
                text, done = texts.slice(done, n), done + n
                counts = rule_counts(text)
                key, sizes, half = _trigrams(text)
                langs = _names(part.column("lang").cast(pa.string()), half)
                of = np.repeat(langs, sizes)
                seen, logp = np.zeros(len(key), bool), np.zeros(len(key))
                for lang in np.unique(of).tolist():
                    at = np.flatnonzero(of == lang)
                    seen[at], logp[at] = m.get(lang, key[at])
                blocks = np.maximum((sizes + BLOCK // 2) // BLOCK, (sizes > 0).astype(np.int64))
                start = np.cumsum(blocks) - blocks
                place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                block = np.repeat(start, sizes) + place * np.repeat(blocks, sizes) // np.repeat(sizes, sizes)
                total = int(blocks.sum())
                size = np.bincount(block, minlength=total)
                hot = np.bincount(block, weights=np.where(seen, logp, 0.0), minlength=total)
                b, k = block[~seen], key[~seen]
                order = np.lexsort((k, b))
                b, k = b[order], k[order]
                first = np.flatnonzero(np.concatenate([[True] * min(len(b), 1), (b[1:] != b[:-1]) | (k[1:] != k[:-1])])) if len(b) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(b)))
                b, k = b[first], k[first]
                ends = np.append(start, total)
                by_block = pa.array(ends.astype(np.int32))
                by_cold = pa.array(np.searchsorted(b, ends).astype(np.int32))
                lists = [pa.ListArray.from_arrays(by_block, pa.array(a)) for a in (size, hot)]
                lists += [pa.ListArray.from_arrays(by_cold, pa.array(a)) for a in (b - np.repeat(start, np.diff(np.searchsorted(b, ends))), k, times)]
                held = pa.StructArray.from_arrays([part.column(c) for c in carried], fields=[part.schema.field(c) for c in carried])
                arrays = [held, pa.array(np.arange(row, row + n)), part.column("lang").cast(pa.string()), *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(sizes), pa.array(langs), *lists]
                row += n
                yield pa.RecordBatch.from_arrays(arrays, names=["own", "row", "lang", *COUNTS, "n_chars", "half", "sizes", "hot", "block", "key", "times"])

    return run


def _halves(docs: DataFrame) -> DataFrame:
    """Names of both halves of each language of the table, paired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(_language(v, h), _language(v, 1 - h)) for v in b.column("lang").to_pylist() for h in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["lang", "other"])

    return docs.select("lang").distinct().mapInArrow(run, "lang long, other long")


def judged(docs: DataFrame, carried: list[str]) -> DataFrame:
    """One row per input row: ``own`` (a struct of the ``carried`` columns), the five counts, ``base_failed``, ``kept`` and ``log_perplexity``.

    Documents pass through the scoring tasks as they are. They are shuffled only
    if the corpus has more than ``HOT`` distinct trigrams, to meet the sums of the rare ones.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "rules")
    plain = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = scratch.put(plain.mapInArrow(_count, "lang long, key long, n long, ref long"), "counted")
    counts = scratch.put(counts.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("ref").alias("ref")), "trigrams")
    scratch.drop("counted")
    values = scratch.put(held_out_values(counts, scratch.put(_halves(plain), "halves"), scratch.put), "values")
    least = _hot_from(values)
    hot = values.where(F.col("n") >= least).select("lang", "key", "v").toArrow()  # HOT rows at most
    hot = spark.sparkContext.broadcast(Values(*(hot.column(c).to_numpy() for c in ("lang", "key", "v"))))
    own = docs.select(*carried).schema.simpleString()
    schema = f"own {own}, row long, lang string, {', '.join(f'{c} long' for c in COUNTS)}, n_chars long, half long, sizes array<long>, hot array<double>, block array<long>, key array<long>, times array<long>"
    need = dict.fromkeys([*carried, "text", "lang"])
    # row numbers hold from here on, as the rows are written with them
    rows = scratch.put(docs.select(F.struct(*need).alias("row")).mapInArrow(_score(hot, carried), schema), "scores")
    sums = F.col("hot")
    if least > 1:
        rare = rows.select("row", F.col("half").alias("lang"), F.explode(F.arrays_zip("block", "key", "times")).alias("c")).select("row", "lang", "c.block", "c.key", "c.times")
        rare = rare.join(values.where(F.col("n") < least).select("lang", "key", "v"), ["lang", "key"]).groupBy("row", "block").agg(F.sum(F.col("times") * F.col("v")).alias("rest"))
        rare = scratch.put(rare.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("block", "rest"))).alias("rests")), "rare")  # as many entries as the document has blocks
        rows = rows.join(rare, "row", "left")
        sums = F.transform("hot", lambda s, i: s + F.coalesce(F.try_element_at("rests", i.cast("long")), F.lit(0.0)))
    means = F.array_sort(F.zip_with(sums, "sizes", lambda s, n: s / n))
    middle = F.round(-F.get(means, F.floor(F.size(means) / 2).cast("int")), 3)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select("own", "lang", *COUNTS, "n_chars", failed.alias("base_failed"), F.when(F.col("n_chars") > 0, F.nanvl(middle, F.lit(None).cast("double"))).alias("log_perplexity"))
    # scores have three decimals, so a language has few distinct ones and exact percentiles of their counts are small work
    seen = rows.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).groupBy("lang", "log_perplexity").agg(F.count("*").alias("n"))
    seen = scratch.put(seen, "seen")
    middle = seen.groupBy("lang").agg(F.expr("percentile(log_perplexity, 0.5, n)").alias("middle")).withColumnRenamed("lang", "band_lang")
    off = seen.join(middle, F.col("lang").eqNullSafe(F.col("band_lang"))).withColumn("away", F.abs(F.col("log_perplexity") - F.col("middle")))
    band = scratch.put(off.groupBy("band_lang").agg(F.first("middle").alias("middle"), F.expr("percentile(away, 0.5, n)").alias("away")), "bands")
    rows = rows.join(band, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    short = F.sqrt(1 + BLOCK / F.greatest(F.col("n_chars"), F.lit(1)))
    low, high = (F.greatest(F.lit(LEAST_WIDTH), k * F.col("away")) * short for k in (BAND_BELOW, BAND_ABOVE))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("middle") - low, F.col("middle") + high), F.lit(True))
    return rows.select("own", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity")


def quality_rules(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` to one row of counts and verdicts per input row.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words inside
    8-word windows that the text repeats. ``kept``: not base_failed, and the
    score inside the band of the language. ``log_perplexity`` is null where
    nothing can be judged (no characters, or no reference text in the other
    half of the language); such a document is kept if its base is. Null text is
    empty, null lang a language of its own; repeated rows get equal rows; an
    empty table gives an empty result; further columns are ignored.
    """
    rows = judged(docs, ["doc_id"])
    return rows.select("own.doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")


def passing_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps."""
    return judged(docs, docs.columns).where("kept").select("own.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
