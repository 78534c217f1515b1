"""Order-preserving packing of tokens into windows, by dynamic programming over cuts.

The documents of a partition follow each other as they come. Windows are cut
where a document or a sentence ends; the program minimises padding plus a price
for each cut inside a document. A window of L tokens is padded to the capacity,
unless L is a power of two. So the cost up to cut j is the least of cost[i] +
capacity - (at[j] - at[i]) over the cuts i of the last ``capacity`` tokens, which is a
minimum of cost[i] + at[i] in a sliding window: a monotone queue gives it in
constant time. Steps back of a power of two that meet a cut are tried besides.

Documents stream through. About ``SEGMENT`` tokens are solved at a time; the last
window is left open and goes on into the next segment, so memory is bounded
and nothing but the end of a partition is padded for want of text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

CAPACITY, LAST_ID = 4096, 2
#: Prices in tokens of padding: a cut at the end of a sentence, and one inside a sentence longer than a window.
SENTENCE_CUT, HARD_CUT = 24, 96
#: Tokens that are solved at once; a longer document counts as one step.
SEGMENT = 1 << 19
#: Words whose ids a worker remembers, about.
CACHE = 1_000_000
#: A letter before a mark: pre-tokens always part there, so a space changes no id.
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
_ENDS = re.compile(r"[.!?…]+[\"')\]]*(</w>)?\Z")


class WordIds:
    """Ids of texts by the ids of their words, with a bounded memory of words; one per worker and vocabulary.

    The tokenizer drops white space and no pre-token holds any, so a text's ids
    are those of its words one after the other.
    """

    _known: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.ends, self.digit = np.zeros(size, bool), np.zeros(size, bool)
        for word, i in vocabulary.items():
            self.ends[i] = bool(_ENDS.match(word))
            self.digit[i] = word.removesuffix("</w>").isdigit()
        self._keep([])

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _keep(self, words: list[str]) -> None:
        """Forgets all but these words."""
        known = [(w, self.ids[self.starts[p] : self.starts[p + 1]]) for w in words if (p := self.place.get(w)) is not None] if words else []
        self.place: dict[str, int] = {w: k for k, (w, _) in enumerate(known)}
        self.starts = np.concatenate([[0], np.cumsum([len(i) for _, i in known], dtype=np.int64)]).astype(np.int64)
        self.ids = np.concatenate([np.zeros(0, np.uint32), *(i for _, i in known)])

    def _learn(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        sizes = np.array(list(map(len, found)), np.int64)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.array(list(chain.from_iterable(found)), np.uint32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin and end; null is empty."""
        texts = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), _MARK, r"\1 \2"))
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        if len(self.place) > CACHE:
            self._keep(names)
        fresh = [w for w in names if w not in self.place]
        if fresh:
            self._learn(fresh)
        place = np.array(list(map(self.place.__getitem__, names)), np.int64)
        first, sizes = self.starts[place].astype(np.int32), np.diff(self.starts)[place].astype(np.int32)
        order = np.asarray(flat.indices)
        first, sizes = first[order], sizes[order]
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ids = self.ids[np.arange(total[-1], dtype=np.int32) + np.repeat(first - total[:-1].astype(np.int32), sizes)]
        return ids, total[np.asarray(words.offsets) - words.offsets[0].as_py()]


def sentence_ends(ids: np.ndarray, ends: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Places behind the marks that end a sentence; a mark between two digits, or in front of the last id, ends none."""
    at = np.flatnonzero(ends[ids[:-2]]) if len(ids) > 2 else np.zeros(0, np.int64)
    inside = (at > 0) & digit[ids[np.maximum(at - 1, 0)]] & digit[ids[np.minimum(at + 1, len(ids) - 1)]]
    return at[~inside] + 1


def best_cuts(at: np.ndarray, price: np.ndarray, capacity: int) -> list[int]:
    """Indices of the cuts of least cost, the last one included; ``at`` rises from a first cut at 0 by at most ``capacity`` a step."""
    n = len(at)
    places, prices = at.tolist(), price.tolist()
    exact: list[list[int]] = [[] for _ in range(n)]
    size = 1
    while size <= capacity:
        behind = np.searchsorted(at, at - size)
        hit = np.flatnonzero((at[behind] == at - size) & (at >= size))
        for j, i in zip(hit.tolist(), behind[hit].tolist()):
            exact[j].append(i)
        size *= 2
    cost, came = [0] * n, [0] * n
    queue: deque[int] = deque([0])  # cuts in reach, with rising cost + place
    for j in range(1, n):
        here = places[j]
        while places[queue[0]] < here - capacity:
            queue.popleft()
        i = queue[0]
        least = cost[i] + capacity - here + places[i]
        for k in exact[j]:
            if cost[k] < least:
                least, i = cost[k], k
        cost[j], came[j] = least + prices[j], i
        sum_ = cost[j] + here
        while queue and cost[queue[-1]] + places[queue[-1]] >= sum_:
            queue.pop()
        queue.append(j)
    out, j = [n - 1], n - 1
    while j:
        j = came[j]
        out.append(j)
    return out[::-1]


def padding(length: int, capacity: int) -> int:
    return 0 if length & (length - 1) == 0 else capacity - length


class _Run:
    """The open rest of a partition: slices of documents that are in no window yet."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.parts: list[tuple[int | None, int, int, np.ndarray, np.ndarray]] = []  # id, start, tokens of the document, ids, ends of sentences
        self.size = 0

    def add(self, doc: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        self.parts.append((doc, 0, len(ids), ids, ends))
        self.size += len(ids)

    def _cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where windows may be cut and their prices: ends of documents and sentences, and inside sentences longer than a window."""
        at, price, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, _, _, ids, ends in self.parts:
            own = np.concatenate([ends, [len(ids)]])
            cost = np.full(len(own), SENTENCE_CUT)
            cost[-1] = 0
            gaps = np.diff(own, prepend=0)
            for k in np.flatnonzero(gaps > self.capacity).tolist():
                start = own[k] - gaps[k]
                more = np.arange(start + self.capacity, own[k], self.capacity)
                at.append(base + more)
                price.append(np.full(len(more), HARD_CUT))
            at.append(base + own)
            price.append(cost)
            base += len(ids)
        at, price = np.concatenate(at), np.concatenate(price)
        order = np.argsort(at, kind="stable")
        return at[order], price[order]

    def solve(self, last: bool) -> list[tuple]:
        """Pieces (doc, start, length, crc, tokens, sequence, offset) of the windows; the last window stays open unless ``last``."""
        if not self.parts:
            return []
        at, price = self._cuts()
        cuts = at[best_cuts(at, price, self.capacity)].tolist()
        if not last:
            cuts.pop()
        out, k, done = [], 0, 0
        begin = 0  # place of part k, less what has been taken from it
        for left, right in zip(cuts, cuts[1:]):
            place = left
            while place < right:
                doc, start, total, ids, _ = self.parts[k]
                stop = min(right, begin + len(ids))
                piece = ids[place - begin : stop - begin]
                out.append((doc, start + place - begin, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, place - left))
                place = stop
                if stop == begin + len(ids):
                    begin, k = stop, k + 1
            self.sequence += 1
            done = right
        rest = self.parts[k:]
        if rest and done > begin:
            doc, start, total, ids, ends = rest[0]
            cut = done - begin
            rest[0] = (doc, start + cut, total, ids[cut:], ends[ends > cut] - cut)
        self.parts = rest
        self.size = sum(len(p[3]) for p in rest)
        return out


_KIND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(path: str, capacity: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, open_ = WordIds.of(path), _Run(capacity)
        base = TaskContext.get().partitionId() << 40

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * len(_KIND)
            return pa.RecordBatch.from_arrays([pa.array([base + v for v in c] if f.name == "sequence_id" else c, f.type) for c, f in zip(columns, _KIND)], schema=_KIND)

        for whole in batches:
            for part in slices(whole, "text", most=1 << 23, rows=8192):
                ids, bounds = words.encode(part.column("text"))
                for doc, low, high in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[low:high], np.uint32(LAST_ID))
                    open_.add(doc, own, sentence_ends(own, words.ends, words.digit))
                    if open_.size >= segment:
                        yield rows(open_.solve(False))
        yield rows(open_.solve(True))

    return run


def pack_windows(docs: DataFrame, path: str, capacity: int = CAPACITY, segment: int = SEGMENT) -> DataFrame:
    """``docs(doc_id, text)`` to one row per piece with its window, ``offset`` in it, and the checksum of its ids.

    ``path`` names a tokenizer's file, on every executor, whose pre-tokens hold no white space. Every document ends
    with the id 2. Each partition of the input is packed in its own order,
    without a shuffle; its number makes ``sequence_id`` unique. A null or empty text has the one id; rows
    with one id, or none, are packed as they come; an empty table gives an empty
    result; other columns are not read. A very long text is one step of its own.
    ``capacity`` is a power of two.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(path, capacity, segment), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op11_window_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack_windows(table(spark, sf_dir, "documents"), path)
