"""Byte-level BPE encoding and decoding with overlapping chunks for long texts.

A text of up to ``CHUNK`` code points is pre-tokenised and encoded as one row.
A longer one is cut into chunks that overlap by ``OVERLAP``; each chunk is
pre-tokenised by its own task, wherever its left edge happens to fall. Two
neighbours agree from the first pre-token boundary that both have in their
overlap, since the pattern looks only forward; from there on the right-hand
chunk takes over. A text whose neighbours share no boundary (one pre-token
longer than the overlap) is encoded whole. The pieces between these cuts are
encoded by rank, and decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table

CHUNK, OVERLAP = 65536, 1024
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Ranks with a bounded memory of the pieces seen; one per Python worker and vocabulary."""

    _known: dict[tuple[int, str], "Codec"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, tuple[int, str, bytes]] = {}

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> "Codec":
        key = id(ranks), pattern  # the codec holds the ranks, so the id stays theirs
        if key not in cls._known:
            cls._known.clear()
            cls._known[key] = cls(ranks, pattern)
        return cls._known[key]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or rank(piece[i : end[mid]]) != r:
                continue  # a merge has changed one of the two parts
            stop = end[mid]
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (s := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (s, i))
            if i and (s := rank(piece[(p := before[i]) : stop])) is not None:
                heapq.heappush(heap, (s, p))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def piece(self, p: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and their decoded bytes."""
        found = self.seen.get(p)
        if found is None:
            ids = self.encode_piece(p.encode())
            found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(self.seen) >= CACHE:
                self.seen.clear()
            if len(p) <= 64:
                self.seen[p] = found
        return found

    def encode(self, pieces) -> tuple[int, str, bytes]:
        found = [self.piece(p) for p in pieces]
        return sum(f[0] for f in found), " ".join([f[1] for f in found]), b"".join([f[2] for f in found])


def _whole(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)
        for whole in batches:
            for part in slices(whole, "text", 1 << 20):
                n, ids_sha, bytes_sha = [], [], []
                for text in part.column("text").to_pylist():
                    count, ids, raw = codec.encode(codec.pattern.findall(text or ""))
                    n.append(count)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    bytes_sha.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _boundaries(pattern: str):
    """Of each chunk, its pre-token boundaries in the overlaps with the chunks before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(pattern)
        for b in batches:
            heads, tails = [], []
            for i, text in zip(b.column("chunk").to_pylist(), b.column("piece").to_pylist()):
                at, head, tail = i * CHUNK, [], []
                for m in found.finditer(text):
                    s = m.start()
                    if i and s < OVERLAP:
                        head.append(at + s)
                    if s >= CHUNK:
                        tail.append(at + s)
                    if m.end() == len(text):
                        break  # the cut may have shortened this one; the boundary before it holds
                heads.append(head)
                tails.append(tail)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(heads, kind), pa.array(tails, kind)], names=["key", "chunk", "head", "tail"])

    return run


def _pieces(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)
        for b in batches:
            rows = []
            for i, text, start, stop in zip(*(b.column(c).to_pylist() for c in ("chunk", "piece", "cut", "next_cut"))):
                at = i * CHUNK
                pieces = []
                for m in codec.pattern.finditer(text, start - at):
                    if stop is not None and at + m.start() >= stop:
                        break
                    pieces.append(m.group())
                rows.append(codec.encode(pieces))
            n, ids, raw = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array([r.decode() for r in raw], pa.string())], names=["key", "chunk", "n", "ids", "raw"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per input row.

    Null and empty texts have no tokens and the digests of nothing; repeated
    rows give repeated rows; an empty table gives an empty result. The driver
    reads the ranks at ``path`` and broadcasts them (2 MB for 50,000).
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = docs.where(F.length("text") <= CHUNK)
    keyed = docs.where(F.length("text") > CHUNK).withColumn("key", F.sha2("text", 256))
    scratch = Scratch(spark, "bpe")
    long = scratch.put(keyed.groupBy("key").agg(F.first("text").alias("text")), "long")
    if not long.take(1):
        return short.mapInArrow(_whole(ranks, pattern), schema)
    cuts = F.expr(f"transform(sequence(0, (length(text) - 1) div {CHUNK}), i -> struct(cast(i as long) as chunk, substring(text, cast(i * {CHUNK} + 1 as int), {CHUNK + OVERLAP}) as piece))")
    chunks = scratch.put(long.select("key", F.explode(cuts).alias("c")).select("key", "c.chunk", "c.piece").repartition("key", "chunk"), "chunks")
    order = Window.partitionBy("key").orderBy("chunk")
    edges = chunks.mapInArrow(_boundaries(pattern), "key string, chunk long, head array<long>, tail array<long>")
    cut = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    edges = edges.withColumn("cut", cut).select("key", "chunk", "cut", F.lead("cut").over(order).alias("next_cut"))
    edges = scratch.put(edges, "edges")
    lost = edges.where("cut is null").select("key").distinct()
    split = chunks.join(edges, ["key", "chunk"]).join(lost, "key", "left_anti").select("key", "chunk", "piece", "cut", "next_cut").mapInArrow(_pieces(ranks, pattern), "key string, chunk long, n long, ids string, raw string")
    split = split.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk", "ids", "raw"))).alias("c"))
    split = split.select("key", "n_tokens", F.sha2(F.array_join(F.filter("c.ids", lambda s: s != ""), " "), 256).alias("ids_sha256"), F.sha2(F.array_join("c.raw", ""), 256).alias("decoded_sha256"))
    whole = long.join(lost, "key", "left_semi").select(F.col("key").alias("doc_id"), "text").mapInArrow(_whole(ranks, pattern), "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    # each distinct text is encoded once; its rows take its digests by a join, so no task holds the ids of all copies
    digests = scratch.put(split.select("key", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(whole.withColumnRenamed("doc_id", "key")), "digests")
    copies = keyed.select("doc_id", "key").join(digests, "key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return short.mapInArrow(_whole(ranks, pattern), schema).unionByName(copies)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
