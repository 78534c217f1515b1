"""Ranked search against plain scoring of every document, and the bounds that let it skip."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("entitymill.llm")

from entitymill.llm import ranked_search as R  # noqa: E402
from entitymill.llm.textnum import Words  # noqa: E402

TERM = re.compile(R.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(terms_of(t))
    for item, query in asked.items():
        scores = []
        for doc, bag in bags:
            n = bag.total()
            score = 0
            for t, times in query.items():
                if bag[t]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(scores)[:top])]
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "naïve", "A1", "x" * 30, "x" * 31, "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " ._- "), (n + 3, "w0 " * 5000), (n + 4, "THE The the"), (n + 5, "same text"), (n + 5, "same text"), (n + 6, "same text"), (None, "same text")]


ITEMS = [(1, "w0 w1 W2 the"), (2, "w40 w41 w42 w0 w0"), (3, None), (4, "nowhere to be found"), (5, "same TEXT"), (6, ""), (7, "日本 naïve! Ünï ünï a1"), (8, "w5"), (8, "w6 w5"), (9, "w59 the w0 w3 w7 w11"), (9, "w59 the w0 w3 w7 w11"), (10, "x" * 30), (None, "w2 w3")]


@pytest.mark.parametrize("shard_docs, round_terms", [(1 << 14, 1 << 18), (300, 10), (7, 1 << 18)])
def test_search_equals_brute_force(spark, shard_docs, round_terms):
    docs = corpus(1500, 1)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in R.ranked(df, items, shard_docs=shard_docs, round_terms=round_terms).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(docs, ITEMS), key=key)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.withColumn("text", R.F.lit(None).cast("string")), items)):
        got = R.ranked(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    assert R.ranked(docs, items).collect() == [(1, 1, 1, 1000 * 0 + R.weight(1, 1) * (10**9 // (1000 + 8 * 100)))]


def shard_of(docs, vocabulary):
    builder = R.ShardBuilder()
    builder.add([i for i, _ in docs], Words(pa.array([t for _, t in docs], pa.string()), lower=True, space=R._APART), vocabulary)
    return builder.row(0)


def test_block_maxima_bound_every_share_and_spare_blocks():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["common"] * 30 + ["mid"] * 3, k=rng.randint(1, 300)) + ["rare"] * (i < 2500 and i % 90 == 0))) for i in range(4000)] + [(4000, "common " * 700)]
    words = ["common", "mid", "rare"]
    row = shard_of(docs, R.Vocabulary(words))
    n_docs, n_terms = row["n_docs"], row["n_terms"]
    shard = R.Shard(row, n_docs, n_terms)
    bags = [Counter(t.split()) for _, t in docs]
    for k, w in enumerate(words):
        where, most = shard.list(k)
        for b in range(shard.blocks):
            want = [(i, bags[i][w]) for i in range(b * R.BLOCK, min((b + 1) * R.BLOCK, len(docs))) if bags[i][w]]
            if not want:
                assert where[b] < 0 and most[b] == 0
                continue
            doc, part = shard.unpack(int(where[b]))
            assert doc.tolist() == [i for i, _ in want]
            assert part.tolist() == [(10**9 * tf) // (1000 * tf + 8 * (25 + 75 * bags[i].total() * n_docs // n_terms)) for i, tf in want]
            assert part.max() <= most[b]
    shard, best = R.Shard(row, n_docs, n_terms), R.Best(10)
    R.search(shard, [(0, 1), (2, 5000)], best)
    everything = sum(int((shard.list(k)[0] >= 0).sum()) for k in (0, 2))
    assert len(best.rows) == 10 and shard.unpacked < everything
    assert np.all(np.diff(R._STEPS) > 0)
