"""Supervised subword embeddings: a document classifier trained by numpy stochastic gradient descent.

A document is the average of learned vectors of its words and of their
character n-grams, both hashed into ``BUCKETS`` rows; a softmax over the two
classes follows. Training sees at most ``MAX_TRAIN`` labelled documents (those
of smallest hash of their id), of which the executors send only hashed feature
counts. Scoring covers every text whole: as averaging and the output layer are
linear, each bucket's contribution to the class margin is one number, so a
document costs one look-up per word and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, slices, table
from .textnum import _BYTE, U, Words, _power_tables, mix

BUCKETS = 1 << 16
GRAMS = (3, 4)
#: Passes over the training documents; few documents get more, so that training has LEAST_STEPS steps at least.
DIM, EPOCHS, RATE, LEAST_STEPS = 10, 8, 0.2, 15_000
MAX_TRAIN = 4000
THRESHOLD = 0.3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every word and every character n-gram inside a word.

    A word's n-grams are of bytes and start at a character. Further buckets
    count words that the text had before, words equal to the one before them,
    and the text's size in powers of two.
    """
    w = Words(column)
    h = w.hashes()
    docs, buckets = [w.doc], [h >> U(48)]
    powers, inverse = _power_tables(len(w.buf) + 1)
    sums = np.zeros(len(w.buf) + 1, U)
    np.cumsum(_BYTE[w.buf] * powers[: len(w.buf)], out=sums[1:])
    length = w.end - w.start
    inside = np.repeat(np.arange(len(w.start)), length)
    at = w.start[inside] + (np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length))
    lead = (w.buf[at] & 0xC0) != 0x80
    at, inside = at[lead], inside[lead]
    for n in GRAMS:
        ok = at + n <= w.end[inside]
        a = at[ok]
        gram = mix((sums[a + n] - sums[a]) * inverse[a] + U(n << 40))
        docs.append(w.doc[inside[ok]])
        buckets.append(gram >> U(48))
    # equal words of one text after the first: repetition is a feature like any other
    order = np.lexsort((h, w.doc))
    same = (w.doc[order][1:] == w.doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    docs.append(w.doc[order][1:][same])
    buckets.append(np.full(int(same.sum()), 1, U))
    next_ = (w.doc[1:] == w.doc[:-1]) & (h[1:] == h[:-1])
    docs.append(w.doc[1:][next_])
    buckets.append(np.full(int(next_.sum()), 2, U))
    # size of the text in powers of two, so that very short texts have a feature of their own
    docs.append(np.arange(w.n))
    buckets.append(U(16) + np.log2(w.count + 1).astype(U))
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "text"):
            doc, bucket = features(part.column("text"))
            key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
            bounds = np.searchsorted(key // BUCKETS, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.ListArray.from_arrays(bounds, pa.array((key % BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.float32)))],
                names=["doc_id", "label", "bucket", "n"],
            )


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Margin of class 1 over class 0 per bucket, and its offset, from bags of (bucket, count)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if not len(bags):
        return np.zeros(BUCKETS, np.float32), 0.0
    share = np.clip(np.bincount(labels, minlength=2) / len(labels), 0.05, 1)
    weight = np.where(labels == 1, 0.5 / share[1], 0.5 / share[0]).astype(np.float32)
    bags = [(b, (n / max(float(n.sum()), 1)).astype(np.float32)) for b, n in bags]
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(bags)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            bucket, value = bags[i]  # a bag has each bucket once
            own = vectors[bucket]
            hidden = value @ own
            logits = hidden @ out + bias
            grad = np.exp(logits - logits.max())
            grad /= grad.sum()
            grad[labels[i]] -= 1
            grad *= weight[i]
            vectors[bucket] = own - (rate * DIM * value)[:, None] * (out @ grad)
            out -= rate * hidden[:, None] * grad
            bias -= 0.1 * rate * grad
    margin = vectors @ (out[:, 1] - out[:, 0])
    # class weights moved the prior; a score is the share of label 1 among texts like it
    return margin, float(bias[1] - bias[0] + np.log(share[1] / share[0]))


def _scores(model, text: pa.Array) -> np.ndarray:
    margin, offset = model
    doc, bucket = features(text)
    n = np.bincount(doc, minlength=len(text))
    total = np.bincount(doc, weights=margin[bucket], minlength=len(text))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + offset, -30, 30)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(_scores(model.value, part.column("text")))], names=["doc_id", "score"])

    return run


def _pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, whole.column("text").cast(pa.string())):
                yield part.filter(pa.array(_scores(model.value, part.column("text").cast(pa.string())) >= THRESHOLD))

    return run


def classifier(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN):
    """A broadcast model from at most ``max_train`` rows of ``labels`` whose crc32(doc_id) mod 5 is not 0.

    Rows with a null id or label, and labels without a document, teach
    nothing; without any, every score is 0.5. Where an id repeats in either
    table, one of its rows is taken.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (F.expr("crc32(cast(doc_id as string))") % 5 != 0)).dropDuplicates(["doc_id"])
    chosen = few(chosen, F.xxhash64("doc_id"), max_train)
    # the bounded list of ids goes to the scan of the documents, so no text is shuffled
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    bags = taught.mapInArrow(_bags, "doc_id long, label int, bucket array<int>, n array<float>")
    # one text of each id, chosen before anything comes to the driver
    bags = bags.groupBy("doc_id").agg(F.min(F.struct("label", "bucket", "n")).alias("b")).select("doc_id", "b.*").toArrow()
    keep = np.argsort(bags.column("doc_id").to_numpy()).tolist()
    columns = [bags.column(c).combine_chunks() for c in ("bucket", "n")]
    y = bags.column("label").to_numpy()[keep] if keep else np.zeros(0, np.int64)
    pairs = [(columns[0][k].values.to_numpy(), columns[1][k].values.to_numpy()) for k in keep]
    model = train(pairs, y)
    del bags, columns, pairs
    pa.default_memory_pool().release_unused()
    return spark.sparkContext.broadcast(model)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, held_out, score, predicted)``, one row per input row.

    ``score`` is the probability of label 1, from the text alone; null text is
    empty and scored as such. An empty table gives an empty result.
    """
    model = classifier(docs, labels, label)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")
    return rows.select("doc_id", (F.expr("crc32(cast(doc_id as string))") % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is predicted 1: scored and kept in one pass, without a shuffle."""
    return docs.mapInArrow(_pass(classifier(docs, labels, label)), docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
