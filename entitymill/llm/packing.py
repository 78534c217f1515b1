"""Best-fit packing of documents into training sequences under conflicts.

A document is cut into pieces of at most ``capacity`` words. Pieces are dealt
by a hash into shards of a bounded expected size, so sources and copies spread
evenly and hot ones are no single task's work. Within a shard, pieces go in
falling order of size. Open bins are ordered by the room that they have left
and carry bitmaps of the sources and duplicate clusters inside; the search
moves to the next larger room until it meets the tightest bin with neither the
piece's source nor its cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .textnum import U, Words, mix, sums_by

CAPACITY, SHARD_PIECES = 2048, 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, and a hash of its lower-cased word sequence that copies share."""
    for whole in batches:
        for part in slices(whole, "text"):
            w = Words(part.column("text"), lower=True)
            place = np.arange(len(w.doc)) - w.first[w.doc]
            same = sums_by(w.doc, mix(w.hashes() + mix(place.astype(U))), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(w.count, pa.int64()), pa.array(same.view(np.int64))], names=["doc_id", "source", "n_words", "cluster"])


class Bins:
    """Open bins by remaining room; ``rooms`` has a bit for each room that some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.count = capacity, 0, 0
        self.at: dict[int, dict[int, list[int]]] = {}  # room to source bitmap to bins
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, room that it had) of the tightest bin with room for the piece and no conflict, or of a new one."""
        s, c = 1 << source, 1 << cluster
        room = size
        while rest := self.rooms >> room:
            room += (rest & -rest).bit_length() - 1
            for sources, bins in self.at[room].items():
                if not sources & s:
                    for i, b in enumerate(bins):
                        if not self.clusters[b] & c:
                            del bins[i]
                            self._gone(room, sources)
                            self._open(b, room - size, sources | s, c)
                            return b, room
            room += 1
        b, self.count = self.count, self.count + 1
        self.clusters.append(0)
        self._open(b, self.capacity - size, s, c)
        return b, self.capacity

    def _gone(self, room: int, sources: int) -> None:
        if not self.at[room][sources]:
            del self.at[room][sources]
            if not self.at[room]:
                del self.at[room]
                self.rooms ^= 1 << room

    def _open(self, b: int, room: int, sources: int, cluster: int) -> None:
        self.clusters[b] |= cluster
        self.at.setdefault(room, {}).setdefault(sources, []).append(b)
        self.rooms |= 1 << room


def _pack(capacity: int):
    def run(shard: pa.Table) -> pa.Table:
        rows = shard.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sources: dict = {}
        clusters: dict = {}
        bins = Bins(capacity)
        found, start = [], []
        for size, source, cluster in zip(*(rows.column(c).to_pylist() for c in ("size", "source", "cluster"))):
            b, room = bins.put(size, sources.setdefault(source, len(sources)), clusters.setdefault(cluster, len(clusters)))
            found.append(b)
            start.append(capacity - room)
        return pa.table([rows.column("doc_id"), rows.column("piece"), rows.column("size"), rows.column("source"), rows.column("cluster"), rows.column("shard"), pa.array(found, pa.int64()), pa.array(start, pa.int64())], names=["doc_id", "piece", "n_words", "source", "cluster", "shard", "bin", "start"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, clusters: DataFrame | None = None) -> DataFrame:
    """``docs(doc_id, text, source)`` to one row per piece with its shard, bin and first word in the bin.

    No bin holds more than ``capacity`` words, two pieces of one source or two
    of one duplicate cluster. Clusters are of equal word sequences (A-Z
    lower-cased); ``clusters(doc_id, cluster long)``, unique by id, names others,
    such as components of near copies, for the documents that it lists. Every word is in one piece: piece p has the
    words from p * capacity on. A null or empty text is one piece of no words;
    null sources are one source; a repeated row is packed again, in another
    bin and perhaps another shard; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sizes = docs.mapInArrow(_sizes, "doc_id long, source string, n_words long, cluster long")
    if clusters is not None:
        named = clusters.select(F.col("doc_id").cast("long").alias("named_id"), F.col("cluster").cast("long").alias("named"))
        sizes = sizes.join(named, F.col("doc_id") == F.col("named_id"), "left").withColumn("cluster", F.coalesce("named", "cluster"))
    pieces = sizes.select("doc_id", "source", "cluster", F.posexplode(F.expr(f"transform(sequence(0L, greatest(n_words - 1, 0L) div {capacity}), p -> least({capacity}L, n_words - p * {capacity}))")).alias("piece", "size"))
    # the number is written with the row and deals repeated rows over shards
    pieces = scratch.put(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = -(-pieces.count() // shard_pieces) or 1
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "row"), F.lit(shards))).drop("row")
    return pieces.groupBy("shard").applyInArrow(_pack(capacity), "doc_id long, piece int, n_words long, source string, cluster long, shard long, bin long, start long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
