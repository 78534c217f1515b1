"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

A shard holds the lists of some thousand documents. Documents of a shard are numbered, 256
numbers make a block, and a list has for each of its blocks the packed places and
counts, and besides them, readable without unpacking, what bounds the block's best
share of a score: the shortest document of each small count, and the largest count.

A search goes through the windows of a shard with the tenth best score so far as
its threshold. Lists in rising order of their largest share are non-essential as
long as their shares in sum stay under the threshold: no document of these alone
can do. The others are read. What they find is held against the block maxima of the
non-essential lists, and only blocks in which a candidate is left are unpacked.
A task carries its best on from shard to shard; the tasks' best are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .textnum import U, Words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Documents and postings of a shard at most (a single document may have more postings), documents of a block, blocks of a window.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, WINDOW = 1 << 14, 1 << 22, 256, 8
#: Pairs of an item and a term that one round of searches takes; more items take more rounds.
ROUND_TERMS = 1 << 18
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lengths are kept as one byte: the step of a scale of eighth octaves, rounded down.
_STEPS = np.unique(np.ceil(2 ** (np.arange(250) / 8)).astype(np.int64))
_NONE, _CLASSES, _WIDE = 255, 4, 255


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_share(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m."""
    return 25 + (75 * n * n_docs) // max(n_terms, 1)


class Vocabulary:
    """Terms of the items by hash; equal hash, length and first bytes make a term of a text one of them."""

    def __init__(self, terms: list[str]):
        words = Words(pa.array(terms, pa.string()), space=_APART)
        h = words.hashes()
        order = np.argsort(h)
        self.hash, self.number, self.size, self.head = h[order], order.astype(np.int64), (words.end - words.start)[order], _heads(words)[order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places among the words, and term numbers, of the words that are terms."""
        if not len(self.hash) or not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[at] == h) & (self.size[at] == words.end - words.start) & (self.head[at] == _heads(words)))
        return hit, self.number[at[hit]]


def _heads(words: Words) -> np.ndarray:
    """The first eight bytes of each word as a number."""
    padded = np.concatenate([words.buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(words.start), U)
    size = words.end - words.start
    for k in range(8):
        out |= np.where(size > k, padded[words.start + k], 0).astype(U) << U(8 * k)
    return out


class ShardBuilder:
    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths, self.terms, self.docs, self.counts = [], [], [], []
        self.size = 0

    def add(self, ids: list, words: Words, vocabulary: Vocabulary) -> None:
        at, term = vocabulary.find(words)
        key, tf = np.unique(term << 32 | words.doc[at], return_counts=True)
        self.terms.append(key >> 32)
        self.docs.append((key & 0xFFFFFFFF) + len(self.ids))
        self.counts.append(tf)
        self.lengths.append(words.count)
        self.ids += ids
        self.size += len(key)

    def row(self, shard: int) -> dict:
        """The shard packed; empties the builder."""
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n, term, doc, tf = join(self.lengths).astype(np.int64), join(self.terms), join(self.docs), join(self.counts)
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        block = doc // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(term)))
        of = np.repeat(np.arange(len(first)), size)
        bounds = np.full((len(first), _CLASSES + 1), _NONE, np.uint8)
        step = np.searchsorted(_STEPS, n[doc], "right") - 1
        for k in range(1, _CLASSES + 1):
            own = tf == k if k < _CLASSES else tf >= k
            np.minimum.at(bounds[:, k - 1], of[own], step[own].astype(np.uint8))
        most = np.maximum.reduceat(tf, first) if len(first) else np.zeros(0, np.int64)
        bounds[:, _CLASSES] = np.minimum(most, _WIDE)
        wide = most > 255
        data = bytearray()
        for b, (lo, k) in enumerate(zip(first.tolist(), size.tolist())):
            data += (doc[lo : lo + k] % BLOCK).astype(np.uint8).tobytes() + tf[lo : lo + k].astype("<u4" if wide[b] else np.uint8).tobytes()
        terms, blocks = np.unique(term[first], return_counts=True)
        df = np.unique(term, return_counts=True)[1] if len(term) else np.zeros(0, np.int64)
        row = {
            "shard": shard, "doc_ids": self.ids, "lengths": n.astype("<u4").tobytes(), "terms": terms.tolist(), "dfs": df.tolist(), "n_docs": int((n > 0).sum()), "n_terms": int(n.sum()),
            "list_blocks": blocks.astype("<i4").tobytes(), "block_no": block[first].astype("<u2").tobytes(), "block_size": size.astype("<u2").tobytes(), "wide": wide.astype(np.uint8).tobytes(), "bounds": bounds.tobytes(), "data": bytes(data),
        }
        self.__init__()
        return row


_INDEX = "shard long, doc_ids array<long>, lengths binary, terms array<int>, dfs array<int>, n_docs long, n_terms long, list_blocks binary, block_no binary, block_size binary, wide binary, bounds binary, data binary"
_INDEX_KIND = pa.schema([(n, {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}[k]) for n, k in (c.split() for c in _INDEX.split(", "))])


def _index(shared, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, builder, number = Vocabulary(shared.value), ShardBuilder(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for part in slices(whole, "text", rows=min(2048, shard_docs)):
                if builder.ids and (len(builder.ids) + part.num_rows > shard_docs or builder.size >= SHARD_POSTINGS):
                    yield pa.RecordBatch.from_pylist([builder.row(number)], _INDEX_KIND)
                    number += 1
                builder.add(part.column("doc_id").to_pylist(), Words(part.column("text"), lower=True, space=_APART), vocabulary)
        if builder.ids:
            yield pa.RecordBatch.from_pylist([builder.row(number)], _INDEX_KIND)

    return run


class Shard:
    """The lists of a shard; blocks are unpacked when asked for, and then kept."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids, self.terms = row["doc_ids"], {t: i for i, t in enumerate(row["terms"])}
        self.m = length_share(np.frombuffer(row["lengths"], "<u4").astype(np.int64), n_docs, n_terms)
        self.ends = np.cumsum(np.frombuffer(row["list_blocks"], "<i4"))
        self.no, self.size = np.frombuffer(row["block_no"], "<u2"), np.frombuffer(row["block_size"], "<u2").astype(np.int64)
        self.wide, self.data = np.frombuffer(row["wide"], np.uint8), row["data"]
        taken = self.size * np.where(self.wide > 0, 5, 2)
        self.at = np.cumsum(taken) - taken
        self.blocks = -(-len(self.ids) // BLOCK)
        b = np.frombuffer(row["bounds"], np.uint8).reshape(-1, _CLASSES + 1).astype(np.int64)
        self.most = np.zeros(len(b), np.int64)
        for k in range(_CLASSES):
            there = b[:, k] != _NONE
            tf = np.full(len(b), k + 1) if k < _CLASSES - 1 else b[:, _CLASSES]
            share = impact(tf, length_share(_STEPS[np.where(there, b[:, k], 0)], n_docs, n_terms))
            if k == _CLASSES - 1:
                share = np.where(tf == _WIDE, 1_000_000, share)  # beyond any share
            self.most = np.maximum(self.most, np.where(there, share, 0))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unpacked = 0

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Of each block, where the list's part lies (-1: nowhere) and its largest share."""
        i = self.terms.get(term)
        if i is None:
            return None
        own = slice(self.ends[i - 1] if i else 0, self.ends[i])
        where, most = np.full(self.blocks, -1, np.int64), np.zeros(self.blocks, np.int64)
        where[self.no[own]] = np.arange(own.start, own.stop)
        most[self.no[own]] = self.most[own]
        return where, most

    def unpack(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the documents of a block of a list, and their shares."""
        found = self.open.get(b)
        if found is None:
            self.unpacked += 1
            n, at = int(self.size[b]), int(self.at[b])
            doc = np.frombuffer(self.data, np.uint8, n, at).astype(np.int64) + int(self.no[b]) * BLOCK
            tf = np.frombuffer(self.data, "<u4" if self.wide[b] else np.uint8, n, at + n).astype(np.int64)
            found = self.open[b] = doc, impact(tf, self.m[doc])
        return found


class Best:
    """The best (score, doc_id), equal scores by the smaller id, a null id first."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    @property
    def least(self) -> int:
        """What a document must reach."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: list[int], ids: list[int | None]) -> None:
        self.rows = sorted(self.rows + [(-s, i is not None, i or 0) for s, i in zip(scores, ids)])[: self.top]


def search(shard: Shard, terms: list[tuple[int, int]], best: Best) -> None:
    """Adds the shard's best documents for ``terms``, pairs of a term and its weight, to ``best``."""
    lists = [(w, *found) for t, w in terms if w > 0 and (found := shard.list(t)) is not None]
    if not lists:
        return
    lists.sort(key=lambda x: x[0] * int(x[2].max()))
    # share[j, b]: the most that lists 0 to j give a document of block b
    share = np.cumsum(np.stack([w * most for w, _, most in lists]), axis=0)
    reach = np.cumsum([w * int(most.max()) for w, _, most in lists])
    score = np.zeros(WINDOW * BLOCK, np.int64)
    for start in range(0, shard.blocks, WINDOW):
        stop, base = min(start + WINDOW, shard.blocks), start * BLOCK
        live = start + np.flatnonzero(share[-1, start:stop] >= best.least)
        if not len(live):
            continue
        score[:] = 0
        essential = int(np.searchsorted(reach, best.least))  # lists before it can't reach the threshold alone

        def add(j: int, blocks: np.ndarray) -> None:
            w, where, _ = lists[j]
            for b in where[blocks].tolist():
                if b >= 0:
                    doc, part = shard.unpack(b)
                    score[doc - base] += w * part

        for j in range(essential, len(lists)):
            add(j, live)
        found = np.flatnonzero(score)
        for j in range(essential - 1, -1, -1):
            block = start + found // BLOCK
            found = found[score[found] + share[j, block] >= best.least]
            if not len(found):
                break
            add(j, np.unique(start + found // BLOCK))
        found = found[score[found] >= best.least]
        if len(found) > best.top:
            cut = np.partition(score[found], len(found) - best.top)[len(found) - best.top]
            found = found[score[found] >= cut]
        if len(found):
            best.add(score[found].tolist(), [shard.ids[base + k] for k in found.tolist()])


def _search(shared, n_docs: int, n_terms: int, top: int):
    kind = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [Best(top) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_terms)
                for (_, terms), b in zip(items, best):
                    search(shard, terms, b)
        out = [(item, i if known else None, -s) for (item, _), b in zip(items, best) for s, known, i in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], schema=kind)

    return run


def weight(n_docs: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, round_terms: int = ROUND_TERMS) -> DataFrame:
    """The ``top`` documents of ``docs(doc_id, text)`` with the highest score above 0 for each of ``items(item_id, text)``.

    Only terms that items ask for are indexed. The terms of a round go to every task; there are so many rounds, dealt by a
    hash of the item, that a round has about ``round_terms`` terms at most, whatever the number of items. Counts N, L and df are of all documents.

    A null or empty text, of either side, has no terms: such a document counts
    in nothing, such an item finds nothing. Repeated documents are documents of their
    own, a null id comes before others of its score; a repeated item counts once, and texts of one
    item_id are one item. Empty tables give an empty result. Other columns are not read.
    A long text is one entry with a large count, like any other.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked-search")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    asked = asked.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    asked = scratch.put(asked, "asked")
    rounds = -(-asked.count() // round_terms) or 1
    found = None
    for k in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).orderBy("item_id", "term").collect()  # about round_terms rows
        terms = sorted({r.term for r in own})
        shared = spark.sparkContext.broadcast(terms)
        index = scratch.put(docs.mapInArrow(_index(shared, shard_docs), _INDEX), f"index-{k}")
        shared.unpersist()
        n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
        df = {r.terms: r.df for r in counts.collect()}  # a row for a term of the round
        number = {t: i for i, t in enumerate(terms)}
        by_item: dict = {}
        for r in own:
            if (i := number[r.term]) in df:
                by_item.setdefault(r.item_id, []).append((i, r.times * weight(n_docs, df[i])))
        shared = spark.sparkContext.broadcast(list(by_item.items()))
        one = scratch.put(index.mapInArrow(_search(shared, n_docs, n_terms, top), "item_id long, doc_id long, score long"), f"best-{k}")
        scratch.drop(f"index-{k}")
        shared.unpersist()
        found = one if found is None else found.unionByName(one)
    # each task keeps its best rows of an item only before they are shuffled
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
sizes AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY rid),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
tf AS (SELECT rid, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nn),
scored AS (
  SELECT a.item_id, s.doc_id, s.rid, CAST(sum(a.times * df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * s.n * nn) // ll)))) AS BIGINT) AS score
  FROM asked a JOIN tf ON tf.term = a.term JOIN df ON df.term = a.term JOIN sizes s ON s.rid = tf.rid, total GROUP BY a.item_id, s.doc_id, s.rid),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10
"""
