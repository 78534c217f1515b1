"""Cheapest repair of damaged conversations to ``(system)? (user assistant)+``, by Four-Russians block tables.

A conversation is a string of symbols, one per row: the row may only be deleted,
or it has a role and may lack its end. A cost vector holds, for the four states of
the wanted pattern, the least cost of all that follows. Reduced by their
minimum, such vectors are few, and so is what a row makes of them. The
table gives the outcome of every run of ``BLOCK`` rows for every vector; a
conversation is read from its end by one look-up a block. Then each block is
opened, backward from the vector at its right edge, and the edits are chosen
forward, the ASCII-least of equally cheap ones first.

Rows are dealt out by ranges of (conversation, turn) and sorted, so a long
conversation lies over many tasks as pieces. A piece's look-ups from each
possible state behind it make a 4 x 4 table of costs; pieces are joined by these
tables alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

BLOCK = 4
#: A piece of a conversation has at most this many rows and bytes of text.
PIECE_ROWS, PIECE_BYTES = 65_536, 16 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
KINDS = "suao"  # initials of roles; o is any other
SYMBOLS = 1 + 2 * len(KINDS)
_NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
_FREE = (USER, USER, ASSISTANT, USER)  # the state after an item whose role may be chosen
NEVER = 1 << 40
END = (0, 4, 2, 0)  # nothing follows: what is missing is inserted
_LAST = ("", "II", "I", "")


def symbol(initial: str, must_go: bool, truncated: bool) -> int:
    return 0 if must_go else 1 + 2 * KINDS.find(initial if initial in "sua" and initial else "o") + truncated


def before_row(after: tuple[int, ...], row: int) -> tuple[list[int], list[tuple[str, int] | None]]:
    """Least costs of each state in front of a row, and the edits up to and with the row (state afterwards too)."""
    kind, late = KINDS[(row - 1) // 2] if row else "", (row - 1) % 2 if row else 0
    own = []
    for q in range(4):
        ways = [(3 + after[q], "D", q)]
        if row:
            to = _NEXT.get((kind, q))
            if to is not None:
                ways.append((late + after[to], "K", to))
            ways.append((2 + late + after[_FREE[q]], "R", _FREE[q]))
        own.append(min(ways))
    least = [w[0] for w in own]
    for q in (USER, ASSISTANT):
        least[q] = min(least[q], 2 + own[_FREE[q]][0])
    for q in (START, SYSTEM):
        least[q] = min(least[q], 2 + least[USER])
    edits: list[tuple[str, int] | None] = []
    for q in range(4):
        if least[q] >= NEVER:
            edits.append(None)
            continue
        letters, at = "", q
        # deletion is the least letter, then insertion
        while not (own[at][0] == least[at] and own[at][1] == "D") and 2 + least[_FREE[at]] == least[at]:
            letters, at = letters + "I", _FREE[at]
        edits.append((letters + own[at][1], own[at][2]))
    return [min(c, NEVER) for c in least], edits


class Tables:
    """All reduced cost vectors that occur, what one row and what ``BLOCK`` rows make of each."""

    def __init__(self):
        unit = [tuple(0 if q == k else NEVER for q in range(4)) for k in range(4)]
        self.vectors = [END, *unit]
        self.number = {v: i for i, v in enumerate(self.vectors)}
        self.one: list[list[tuple[int, int]]] = []
        self.edits: list[list[list[tuple[str, int] | None]]] = []
        for v in self.vectors:  # grows as new vectors are met
            outs, edits = [], []
            for row in range(SYMBOLS):
                costs, choice = before_row(v, row)
                base, reduced = self.reduce(costs)
                if reduced not in self.number:
                    self.number[reduced] = len(self.vectors)
                    self.vectors.append(reduced)
                outs.append((self.number[reduced], base))
                edits.append(choice)
            self.one.append(outs)
            self.edits.append(edits)
        # rows of a block are digits of its number, the first one the highest
        blocks = self.one
        for k in range(1, BLOCK):
            blocks = [self._longer(blocks[v], SYMBOLS**k) for v in range(len(self.vectors))]
        self.block = blocks

    def _longer(self, blocks: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        """Blocks with one more row in front: what the block makes of a vector, then what the row does."""
        out = []
        for row in range(SYMBOLS):
            for to, base in blocks[:size]:
                last, more = self.one[to][row]
                out.append((last, base + more))
        return out

    @staticmethod
    def reduce(costs) -> tuple[int, tuple[int, ...]]:
        base = min(costs)
        if base >= NEVER:
            return 0, (NEVER,) * 4
        return base, tuple(c - base if c < NEVER else NEVER for c in costs)


@functools.lru_cache(1)
def tables() -> Tables:
    return Tables()


def back(symbols: bytes, vector: int) -> tuple[list[int], int]:
    """Numbers of the vectors at the edges of blocks from the right, and what was taken off them in sum; blocks end with the last row."""
    t, edges, total = tables(), [vector], 0
    stop = len(symbols)
    while stop >= BLOCK:
        code = 0
        for s in symbols[stop - BLOCK : stop]:
            code = code * SYMBOLS + s
        vector, base = t.block[vector][code]
        total += base
        edges.append(vector)
        stop -= BLOCK
    for s in reversed(symbols[:stop]):
        vector, base = t.one[vector][s]
        total += base
    edges.append(vector)
    return edges, total


def trace(symbols: bytes, edges: list[int], state: int) -> tuple[str, int]:
    """Edits of the rows from ``state`` on, and the state behind them; each block is opened from its right edge."""
    t, out = tables(), []
    head = len(symbols) % BLOCK
    starts = ([0] if head else []) + list(range(head, len(symbols), BLOCK))
    for k, start in enumerate(starts):
        stop = start + (head if k == 0 and head else BLOCK)
        vector = edges[len(starts) - 1 - k]
        behind = []
        for s in reversed(symbols[start:stop]):
            behind.append(vector)
            vector = t.one[vector][s][0]
        for s, after in zip(symbols[start:stop], reversed(behind)):
            letters, state = t.edits[after][s][state]
            out.append(letters)
    return "".join(out), state


class Repaired:
    """The repaired conversation as one running hash: rows come in order, the edits say what becomes of each."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state = audit, 0, START
        self.hash, self.any = hashlib.sha256(), False

    def _item(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _free(self, text: str) -> None:
        self.state = _FREE[self.state]
        self._item("user" if self.state == USER else "assistant", text)

    def _inserts(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self._free("")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[role[:1], self.state]
            self._item(role, text)
        elif edit == "R":
            self._free(text)

    def done(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


_FACTS = "n_blank long, n_duplicate long, n_truncated long, n_illegal long, first_turn long, last_turn long, turns long, first string, last string"
_FACT_NAMES = [c.split()[0] for c in _FACTS.split(", ")]


def _joined(a: dict, b: dict) -> dict:
    """Facts of two neighbouring pieces as those of one."""
    out = {c: a[c] + b[c] for c in ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "turns")}
    out["n_illegal"] += a["last"] is not None and b["first"] is not None and a["last"] + b["first"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    for c in ("first_turn", "first"):
        out[c] = b[c] if a[c] is None else a[c]
    for c in ("last_turn", "last"):
        out[c] = a[c] if b[c] is None else b[c]
    return out


class _Piece:
    def __init__(self):
        self.facts = dict.fromkeys(_FACT_NAMES, 0) | dict.fromkeys(("first_turn", "last_turn", "first", "last"))
        self.symbols, self.rows, self.bytes = bytearray(), [], 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        f, initial = self.facts, role[:1]
        duplicate = duplicate and not blank
        truncated = truncated and not blank and not duplicate
        for name, found in (("n_blank", blank), ("n_duplicate", duplicate), ("n_truncated", truncated)):
            f[name] += found
        if f["last"] is not None:
            f["n_illegal"] += f["last"] + initial not in ("su", "ua", "au")
        f["first"], f["last"] = initial if f["first"] is None else f["first"], initial
        if turn is not None:
            f["turns"] += turn != f["last_turn"]
            f["first_turn"], f["last_turn"] = turn if f["first_turn"] is None else f["first_turn"], turn
        self.symbols.append(symbol(initial, blank or duplicate, truncated))
        self.rows.append((role, text))
        self.bytes += len(text)

    def costs(self) -> list[int]:
        """The 4 x 4 costs from each state in front to each state behind, by rows."""
        t, columns = tables(), []
        for to in range(4):
            edges, total = back(self.symbols, t.number[tuple(0 if q == to else NEVER for q in range(4))])
            columns.append([min(c + total, NEVER) for c in t.vectors[edges[-1]]])
        return [columns[to][q] for q in range(4) for to in range(4)]


def _solved(symbols: bytes) -> tuple[int, str]:
    t = tables()
    edges, total = back(symbols, t.number[END])
    audit, state = trace(symbols, edges, START)
    return total + t.vectors[edges[-1]][START], audit + _LAST[state]


_PIECE = "part int, piece int, whole boolean, " + _FACTS + ", costs array<long>, symbols binary, cost long, audit string, repaired_sha256 string"


def _schema(conv_type: pa.DataType, columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([("conv_id", conv_type), *((n, kinds[k]) for n, k in (c.split() for c in columns.split(", ")))])


def _pieces(most_rows: int, most_bytes: int):
    """Rows of a sorted partition to pieces; what lies wholly inside is solved at once, what may go on in another partition is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, piece, number, first, cut, before, kind, out = None, None, 0, True, False, None, None, []

        def close(last: bool) -> dict:
            whole = not (first or last or cut)
            row = {"conv_id": now, "part": part, "piece": number, "whole": whole, **piece.facts}
            if not whole:
                return row | {"costs": piece.costs(), "symbols": bytes(piece.symbols)}
            cost, audit = _solved(bytes(piece.symbols))
            repaired = Repaired(audit)
            for r in piece.rows:
                repaired.row(*r)
            return row | {"cost": cost, "audit": audit, "repaired_sha256": repaired.done()}

        for batch in batches:
            kind = kind or _schema(batch.schema.field("conv_id").type, _PIECE)
            for conv, turn, role, text, gone, later, blank, truncated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "later", "blank", "truncated"))):
                if piece is None or conv != now:
                    if piece is not None:
                        out.append(close(False))
                        number, first = number + 1, False
                    now, piece, cut, before = conv, _Piece(), False, None
                if gone:
                    continue
                if len(piece.rows) >= most_rows or piece.bytes >= most_bytes:
                    cut = True
                    out.append(close(False))
                    piece, number = _Piece(), number + 1
                piece.add(turn, role, text, blank, later or (turn, role, text) == before, truncated)
                before = turn, role, text
            yield pa.RecordBatch.from_pylist(out, kind)
            out = []
        if piece is not None:
            yield pa.RecordBatch.from_pylist([close(True)], kind)

    return run


def _chained(rows: list[dict]) -> list[tuple[int, ...]]:
    """Costs of what follows each piece of a conversation, not reduced; the first is that in front of all."""
    after, out = END, [END]
    for r in reversed(rows):
        after = tuple(min(NEVER, min(r["costs"][4 * q + to] + after[to] for to in range(4))) for q in range(4))
        out.append(after)
    return out[::-1]


def _behind(group: pa.Table) -> pa.Table:
    rows = group.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()
    after = _chained(rows)[1:]
    return pa.Table.from_pylist([{"part": r["part"], "piece": r["piece"], "behind": list(Tables.reduce(a)[1])} for r, a in zip(rows, after)], pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("behind", pa.list_(pa.int64()))]))


_WAYS = "part int, piece int, " + _FACTS + ", costs array<long>, edits array<string>, states array<int>"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of a piece from each state in front of it."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            edges, _ = back(r["symbols"], tables().number[tuple(r["behind"])])
            # where no way leads on from a state, no chain of pieces comes to it
            ways = [trace(r["symbols"], edges, q) if tables().vectors[edges[-1]][q] < NEVER else ("", q) for q in range(4)]
            out.append({c: r[c] for c in ("conv_id", "part", "piece", *_FACT_NAMES, "costs")} | {"edits": [w[0] for w in ways], "states": [w[1] for w in ways]})
        kind = _schema(batch.schema.field("conv_id").type, "part int, piece int, " + _FACTS + ", costs array<long>").append(pa.field("edits", pa.list_(pa.string()))).append(pa.field("states", pa.list_(pa.int32())))
        yield pa.RecordBatch.from_pylist(out, kind)


_SOLVED = _FACTS + ", cost long, audit string"


def _whole(group: pa.Table) -> pa.Table:
    rows = group.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()
    facts, letters, state = {c: rows[0][c] for c in _FACT_NAMES}, [], START
    for k, r in enumerate(rows):
        facts = _joined(facts, r) if k else facts
        letters.append(r["edits"][state])
        state = r["states"][state]
    row = facts | {"conv_id": rows[0]["conv_id"], "cost": _chained(rows)[0][START], "audit": "".join(letters) + _LAST[state]}
    return pa.Table.from_pylist([row], _schema(group.schema.field("conv_id").type, _SOLVED))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation stream by behind its edits; only the running hash is held."""
    head, repaired, kind = None, None, None
    for batch in batches:
        kind = kind or _schema(batch.schema.field("conv_id").type, _SOLVED + ", repaired_sha256 string")
        out, names = [], batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            r = dict(zip(names, values))
            if r["audit"] is not None:
                if head is not None:
                    out.append(head | {"repaired_sha256": repaired.done()})
                head, repaired = {c: r[c] for c in kind.names[:-1]}, Repaired(r["audit"])
            else:
                repaired.row(r["role"], r["text"])
        yield pa.RecordBatch.from_pylist(out, kind)
    if head is not None:
        yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": repaired.done()}], kind)


def damage(turns: DataFrame) -> DataFrame:
    """Rows after damage by ``crc32(conv_id:turn) % 20``; dropped rows stay, marked ``gone``, so that no conversation is lost."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("way", F.crc32(key) % 20)
    gone = F.col("way") == 0
    role = F.when(gone, "").when(F.col("way") == 4, "user").otherwise(F.col("role"))
    text = F.when(gone | (F.col("way") == 1), "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), gone.alias("gone"), F.when(F.col("way") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES, partitions: int | None = None) -> DataFrame:
    """``rows(conv_id, turn long, role, text, gone)`` to one row per conversation: faults, least cost, edits and hash of the repaired text.

    Rows go by (turn, role, text), nulls first; ``gone`` rows only name their
    conversation. Equal rows of one turn are repeats. A conversation of no
    rows has zeros, no edits and the hash of nothing; a null conv_id is one
    conversation; an empty table gives an empty result. Role initials are the
    first character as it is; an empty role has none and fits nothing.

    Texts are shuffled once, by ranges of (conversation, turn, role, start of the
    text), and what touches the edge of a partition once more, for its hash: SHA-256
    goes through a conversation's text in order, so that is one task's stream,
    with the edits and one batch in memory.
    """
    scratch = Scratch(rows.sparkSession, "turn-repair")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = rows.withColumns({"blank": blank, "truncated": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")})
    # role and text at more than one turn; of equal rows at one turn the sort makes neighbours
    digest = F.sha2(F.col("text"), 256)
    said = rows.where("not gone and not blank").groupBy("conv_id", "role", digest.alias("digest")).agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    said = scratch.put(said.where("least < most or (unnumbered and least is not null)"), "said").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least", "unnumbered")
    later = F.coalesce(F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
    marked = rows.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("d")), "left").withColumn("later", later).drop("c", "r", "d", "least", "unnumbered")
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 64)]
    dealt = marked.repartitionByRange(partitions, *keys) if partitions else marked.repartitionByRange(*keys)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, "
    pieces = scratch.put(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", "gone", "later", "blank", "truncated").mapInArrow(_pieces(piece_rows, piece_bytes), conv + _PIECE), "pieces")
    edge = pieces.where("not whole")
    behind = edge.drop("symbols").groupBy("conv_id").applyInArrow(_behind, "part int, piece int, behind array<long>")
    ways = edge.join(behind, ["part", "piece"]).mapInArrow(_ways, conv + _WAYS)
    solved = scratch.put(ways.groupBy("conv_id").applyInArrow(_whole, conv + _SOLVED), "edge")
    own = rows.where("not gone").select("conv_id", "turn", "role", "text").join(solved.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    stream = own.withColumn("row", F.lit(1)).unionByName(solved.withColumn("row", F.lit(0)), allowMissingColumns=True)
    edge = stream.repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "text").mapInArrow(_hashed, conv + _SOLVED + ", repaired_sha256 string")
    found = pieces.where("whole").select(edge.columns).unionByName(edge)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return found.select("conv_id", gaps.alias("gaps"), F.col("n_blank").alias("blank"), F.col("n_duplicate").alias("duplicate"), F.col("n_truncated").alias("truncated"), F.col("n_illegal").alias("illegal"), "cost", "audit", "repaired_sha256")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def _sql_way(cost: str, letter: str, text: str, rest: str) -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'r': {text} || {rest}.r}}"


def _sql_step() -> str:
    """One row in front of the best ways on from each state, as a list of four; inserts are settled from the right."""
    never = "{'c': 1000000, 'a': '', 'r': ''}"
    own = []
    for q in range(4):
        free = _FREE[q] + 1
        who = "'user'" if _FREE[q] == USER else "'assistant'"
        keep = " ".join(f"WHEN x.i = '{i}' THEN " + _sql_way("x.l", "K", "chr(10) || x.role || ':' || x.text", f"acc[{to + 1}]") for (i, at), to in _NEXT.items() if at == q)
        ways = [_sql_way("3", "D", "''", f"acc[{q + 1}]"), f"CASE WHEN x.must THEN {never} {keep} ELSE {never} END", f"CASE WHEN x.must THEN {never} ELSE " + _sql_way("2 + x.l", "R", f"chr(10) || {who} || ':' || x.text", f"acc[{free}]") + " END"]
        own.append("list_sort([" + ", ".join(ways) + "])[1]")
    filled = lambda b, q: _sql_way("2", "I", "chr(10) || '" + ("user" if _FREE[q] == USER else "assistant") + ":'", f"{b}[{_FREE[q] + 1}]")
    first = "[" + ", ".join("b[1]" if q == 0 else "b[2]" if q == 1 else f"list_sort([b[{q + 1}], {filled('b', q)}])[1]" for q in range(4)) + "]"
    second = "[" + ", ".join(f"list_sort([g[{q + 1}], {filled('g', q)}])[1]" if q < 2 else f"g[{q + 1}]" for q in range(4)) + "]"
    return f"list_transform(list_transform([[{', '.join(own)}]], lambda b: {first}), lambda g: {second})[1]"


_SQL_END = "[{'c': 0, 'a': '', 'r': ''}, {'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 2, 'a': 'I', 'r': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 'r': ''}]"


def crc_sql() -> str:
    """CRC-32 by bytes: DuckDB has no such function."""
    return "(list_reduce(list_transform(range(strlen(key)), lambda i: CAST(ascii(substr(key, i + 1, 1)) AS BIGINT)), lambda acc, x: list_reduce(range(8), lambda c, _k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, x)), 4294967295::BIGINT))"


OP13_SQL = rf"""
WITH keyed AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT *, xor({crc_sql()}, 4294967295) % 20 AS way FROM keyed),
rows AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE way <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM rows),
said AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM placed),
faulty AS (SELECT *, NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS truncated FROM said),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list({{'i': left(role, 1), 'role': role, 'text': text, 'must': blank OR duplicate, 'l': CAST(truncated AS INT)}} ORDER BY place DESC), lambda acc, x: {_sql_step()}, {_SQL_END})[1] AS best
  FROM faulty GROUP BY conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM convs c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""
