"""Hard cases of operators that were written before: hot groups, empty tables, long texts, columns with own names."""

import random
import time

import pytest

pytest.importorskip("entitymill.llm")

from entitymill.llm import chat_views, near_dedup, personal_data  # noqa: E402


def test_chat_views_of_hot_and_strange_conversations(spark):
    """Half of all turns in one conversation without turn numbers, or with one, lie in several blocks and still follow each other."""
    rng = random.Random(6)
    rows = [(1, None, rng.choice(["ann", "bob", "system", None]), f"{rng.random()}") for _ in range(400)]
    rows += [(2, 5, rng.choice(["ann", "bob"]), f"{i} x") for i in range(300)] + [(2, 5, "ann", "same")] * 20
    rows += [(c, t, "u", "y" * 20_000 if c == 3 else "ok") for c in range(3, 40) for t in range(3)]
    df = spark.createDataFrame([(*r, "a", True, 7, 0) for r in rows], "conv_id long, turn long, role string, text string, head string, own boolean, block int, start int").repartition(5)
    got = chat_views.perspectives(df).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        key = (r.conv_id, r.perspective)
        assert len(whole.setdefault(key, "")) == r.start and r.stop - r.start == len(r.rendered)
        whole[key] += r.rendered
    assert {k for k in whole if k[0] in (1, 2)} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (2, "bob")}

    def plain(conv, person):
        out = ""
        for _, role, text in sorted((str(t), "unknown" if r is None else r, x) for c, t, r, x in rows if c == conv):
            out += f"<|im_start|>{'assistant' if role == person else 'system' if role == 'system' else 'user name=' + role}\n{text}<|im_end|>\n"
        return out

    assert all(whole[k] == plain(*k) for k in whole if k[0] in (1, 2))
    empty = chat_views.perspectives(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["conv_id", "perspective", "turn", "role", "rendered", "start", "stop", "train_start", "train_stop"]


def test_personal_data_of_long_texts_and_own_names(spark):
    field = personal_data.Field({}).learn(["call +1 555 123 4567 now", "mail a@b.cd, c@d.ef", "4111 1111 1111 1111 or 10.0.0.1"] * 20)
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        spans = field.spans("a@b.cd, " * (n // 8))
        took.append(time.process_time() - began)
        assert [s for s in spans if s[0] == 0] == [(0, i, i + 6) for i in range(0, n, 8)]
    assert took[1] < 24 * took[0]  # eight times the text
    df = spark.createDataFrame([(1, "mail a@b.cd", "k", 1), (1, "mail a@b.cd", "k", 1), (None, None, "k", 1), (2, "", "k", 1)], "doc_id long, text string, spans string, n_email int")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in personal_data.find_personal_data(df).collect())
    assert got == [(0, 0, ""), (1, 1, "email:5:11"), (1, 1, "email:5:11"), (2, 0, "")]
    assert personal_data.find_personal_data(df.where("false")).count() == 0


def test_overlaps_are_those_of_a_plain_search():
    """Added spans touch no base span, whatever the base spans' ends."""
    rng = random.Random(9)
    field = personal_data.Field({}).learn(["call +1 555 123 4567 now", "mail a@b.cd"] * 10)
    field.segment = lambda text, start, end: [(3, a, a + rng.randint(6, 12)) for a in range(start, max(start, end - 12), 7)]
    for _ in range(60):
        text = " ".join(rng.choice(["+1 555 123 4567", "a@b.cd", "10.0.0.1", "4111 1111 1111 1111", "word", "123456 7890", "x@y"]) for _ in range(30))
        state = rng.getstate()
        got = field.spans(text)
        rng.setstate(state)
        base = personal_data.base_spans(text)
        want = [x for start, end in personal_data.islands(text) for x in field.segment(text, start, end) if not any(x[1] < b and a < x[2] for _, a, b in base)]
        assert got == sorted(base + want)


def test_near_duplicates_with_more_nodes_than_are_sent(spark, monkeypatch):
    """Where nodes are too many to be sent, hashed bits stand for them: links, components and kept rows stay the same."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(90)}" for _ in range(60)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.01 else "new" for w in rng.choice(base)) for _ in range(160)]
    rows = [(i % 150, t, f"s{i}") for i, t in enumerate(texts)] + [(3, texts[3], "s3")] * 3 + [(None, texts[5], "n"), (None, None, "n"), (900, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def both():
        classes = sorted(map(str, near_dedup.near_duplicates(df, k=4).collect()))
        return classes, sorted((r.doc_id or -1, r.text or "") for r in near_dedup.distinct_documents(df).collect())

    want = both()
    monkeypatch.setattr(near_dedup, "MOST_NODES", 2)
    monkeypatch.setattr(near_dedup, "BITS", 256)
    assert both() == want and len(want[1]) < len(rows)
