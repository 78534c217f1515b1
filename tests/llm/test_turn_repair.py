"""Repair of conversations against a search over all edits, with pieces cut as small as can be."""

import functools
import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("entitymill.llm")

from entitymill.llm import turn_repair  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, gone string"
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}


def cheapest(rows):
    """(cost, audit) of rows (initial, must go, truncated), by trying every edit."""

    @functools.lru_cache(None)
    def go(i, state, inserted):
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, ""))
        if i < len(rows):
            initial, must, late = rows[i]
            cost, rest = go(i + 1, state, 0)
            ways.append((3 + cost, "D" + rest))
            for kind, letter, price in [] if must else [(initial, "K", 0), ("u", "R", 2), ("a", "R", 2)]:
                if (kind, state) in STEP:
                    cost, rest = go(i + 1, STEP[kind, state], 0)
                    ways.append((price + late + cost, letter + rest))
        if inserted < 4:
            for kind in "ua":
                if (kind, state) in STEP:
                    cost, rest = go(i, STEP[kind, state], inserted + 1)
                    ways.append((2 + cost, "I" + rest))
        return min(ways, default=(10**9, ""))

    return go(0, 0, 0)


def repaired(rows):
    """All columns of one conversation; ``rows`` are (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, symbols = set(), [], []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(tuple(symbols))
    items, left = [], list(rows)
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else left.pop(0)[1:]
        if edit == "K":
            state = STEP[role[:1], state]
        elif edit in "RI":
            state = 3 if state == 2 else 2
            role = "user" if state == 2 else "assistant"
        if edit != "D":
            items.append(f"{role}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(items).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        kept = out.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        kept += [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def hard_cases():
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut off", "", None, " \t\n", "Same again?", "Ünï   ok. \n", "a.\n ", "x" * 3000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), roles[turn % 2] if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts), "clash"))
    # one conversation holds a third of all rows, at many turns, at one turn, and without a turn
    for conv, turn_of in ((100, lambda i: i), (101, lambda i: 7), (102, lambda i: None)):
        rows += [(conv, turn_of(i), roles[i % 2], f"{i % 90} {rng.choice(['yes.', 'no'])}", "clash") for i in range(150)]
    rows += [(103, 1, "user", "repeated.", "clash")] * 40
    rows += [(conv, 0, "user", "only row.", "clash") for conv in range(200, 240)]  # some are dropped: nothing is left
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_rows, partitions", [(65_536, None), (65_536, 9), (5, 3), (1, 40)])
def test_repair_equals_brute_force(spark, piece_rows, partitions):
    rows = hard_cases()
    df = turn_repair.damage(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(df, piece_rows, partitions=partitions).collect()}
    assert got == {conv: repaired(kept) for conv, kept in damaged(rows).items()}


def test_repair_of_nothing(spark):
    empty = turn_repair.repair(turn_repair.damage(spark.createDataFrame([], TURNS)))
    assert empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and empty.count() == 0
    gone = [r for r in ((i, 0, "user", "x.", "") for i in range(200)) if not damaged([r])[r[0]]]
    got = turn_repair.repair(turn_repair.damage(spark.createDataFrame(gone, TURNS))).collect()
    assert len(got) == len(gone) > 0 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_blocks_equal_single_rows():
    """Look-ups of blocks give the vectors that row after row gives, from every vector."""
    t, rng = turn_repair.tables(), random.Random(3)
    for v in range(len(t.vectors)):
        for _ in range(40):
            symbols = bytes(rng.randrange(turn_repair.SYMBOLS) for _ in range(rng.randint(0, 13)))
            at, total = v, 0
            for s in reversed(symbols):
                at, base = t.one[at][s]
                total += base
            edges, sums = turn_repair.back(symbols, v)
            assert (edges[-1], sums) == (at, total)


def test_long_conversation(spark):
    """A conversation of many pieces: its text is hashed as a stream, and the edits are those of a search."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}." + "y" * 200, "") for i in range(700)]
    df = turn_repair.damage(spark.createDataFrame(rows, TURNS))
    got = tuple(turn_repair.repair(df, 50, 4000, 6).first())[1:]
    assert got == repaired(damaged(rows)[1])
