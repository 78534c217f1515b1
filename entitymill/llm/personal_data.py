"""Personal data: fixed patterns, and further spans by a semi-Markov conditional random field.

The four base patterns always count. The field segments the islands of a text
that hold digits or an at sign: a candidate segment of up to ``MOST_ATOMS``
atoms is scored by features of the whole span (digit and group counts, check
sum, at sign, separators, the characters around it, a cue word before it) and
dynamic programming over bounded segments picks the boundaries and types
together. A segment has at least six characters and at most ``MOST_CHARS``, and
an at sign or four digits; an island without an at sign has at least seven
digits, else it is no place for anything but what the base patterns find.
Weights are learned by gradient ascent on the likelihood of segmentations, from
at most ``MAX_TRAIN`` islands of as many documents, of under ``TRAIN_CHARS``
characters, whose base spans are the labels. Spans that overlap no base span are
added.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

KINDS = ("email", "ip", "card", "phone")
MOST_ATOMS = 24
#: The longest valid mail address has 254 characters.
MOST_CHARS = 254
MAX_TRAIN, TRAIN_CHARS, EPOCHS, RATE, RIDGE = 600, 20_000, 4, 0.3, 1e-3
#: Documents of smallest hash that are looked through for training documents.
LOOKED_THROUGH = 24_000
#: Added spans need this much more than the best segmentation without them (nats).
MARGIN = 2.0

_SEED = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: a later start would meet the same continuation
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD_END = re.compile(r"\s|\Z")
_TO_LAST_SPACE = re.compile(r"[\s\S]*\s")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_CUE = re.compile(r"([A-Za-z]+)[\s:=]*\Z")
_CUES = {"phone", "tel", "call", "fax", "mobile", "email", "mail", "ip", "host", "address", "card", "account", "visa", "pan"}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start, in code points."""
    out = []
    if not _SEED.search(text):
        return out
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words with digits or at signs, one or two blanks apart, that could hold personal data at all.

    Each character is read a fixed number of times, however long the words are.
    """
    start, stop = -1, 0
    m = _SEED.search(text)
    while m:
        before = _TO_LAST_SPACE.match(text, stop, m.start())
        word = before.end() if before else stop
        if start < 0 or word - stop > 2 or "\n" in text[stop:word]:
            if start >= 0 and _holds(text, start, stop):
                yield start, stop
            start = word
        stop = _WORD_END.search(text, m.end()).start()
        m = _SEED.search(text, stop)
    if start >= 0 and _holds(text, start, stop):
        yield start, stop


def _holds(text: str, start: int, stop: int) -> bool:
    part = text[start:stop]
    return "@" in part or sum(map(part.count, "0123456789")) >= 7


def _class(c: str) -> str:
    return "" if not c else "9" if "0" <= c <= "9" else "a" if c.isalnum() else "_" if c.isspace() else c if c in ".@+-(" else "s"


def span_features(span: str, before: str, after: str, cue: bool) -> tuple[str, ...]:
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    groups = re.findall(r"[0-9]+", span)
    letters = any(c.isalpha() for c in span)
    found = ["bias", f"digits{min(n, 20)}", f"before{_class(before)}", f"after{_class(after)}", f"first{_class(span[0])}", f"letters{letters}", f"ats{min(span.count('@'), 2)}", f"groups{min(len(groups), 6)}"]
    if cue:
        found.append("cue")
    if 13 <= n <= 19 and not letters:
        found.append(f"check{luhn(digits)}")
    if span.count("@") == 1:
        local, _, domain = span.partition("@")
        found += [f"dots{min(domain.count('.'), 2)}", f"domain{bool(_DOMAIN.fullmatch(domain))}", f"local{bool(_LOCAL.fullmatch(local))}"]
    if span.count(".") == 3 and not letters and len(groups) == 4:
        found.append(f"quad{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    strange = {c for c in span if not c.isalnum()} - set(" ().-+@_%")
    found += [f"strange{bool(strange)}", f"spaces{min(span.count(' '), 4)}", f"parens{min(span.count('('), 2)}{min(span.count(')'), 2)}", f"plus{span.startswith('+')}", f"inner_plus{'+' in span[1:]}"]
    return tuple(found)


class Field:
    """Weights by (kind, feature); scores of equal spans in equal surroundings are remembered, within a bound."""

    def __init__(self, weights: dict[tuple[int, str], float]):
        self.weights = weights
        self.seen: dict[tuple, list[tuple[int, float]]] = {}

    def candidates(self, text: str, start: int, end: int) -> tuple[list[int], Iterator[tuple[int, int, str, str, str, bool]]]:
        """Atom bounds of an island, and its candidate segments (first atom, atom after the last, span and surroundings), one at a time."""
        bounds = [start + m.start() for m in _ATOM.finditer(text[start:end])] + [end]
        m = _CUE.search(text[max(0, start - 24) : start])
        return bounds, self._segments(text, bounds, bool(m and m.group(1).lower() in _CUES))

    def _segments(self, text: str, bounds: list[int], cue: bool) -> Iterator[tuple[int, int, str, str, str, bool]]:
        n = len(bounds) - 1
        for i in range(n):
            head = text[bounds[i]]
            if not (head.isalnum() or head in "+("):
                continue
            for j in range(i + 1, min(n, i + MOST_ATOMS) + 1):
                if not text[bounds[j] - 1].isalnum() or bounds[j] - bounds[i] > MOST_CHARS:
                    continue
                span = text[bounds[i] : bounds[j]]
                if len(span) < 6 or ("@" not in span and sum(map(span.count, "0123456789")) < 4):
                    continue
                yield i, j, span, text[bounds[i] - 1] if bounds[i] else "", text[bounds[j]] if bounds[j] < len(text) else "", cue and i < 2

    def scores(self, span: str, before: str, after: str, cue: bool) -> list[float]:
        key = (span, _class(before), _class(after), cue)
        found = self.seen.get(key)
        if found is None:
            f = span_features(span, before, after, cue)
            found = [sum(self.weights.get((k, x), 0.0) for x in f) for k in range(len(KINDS))]
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[key] = found
        return found

    def segment(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """The best segmentation's personal segments; an atom outside of them scores 0."""
        bounds, found = self.candidates(text, start, end)
        n = len(bounds) - 1
        ending: dict[int, list] = {}
        for i, j, *around in found:
            s = self.scores(*around)
            k = max(range(len(KINDS)), key=s.__getitem__)
            if s[k] > MARGIN:
                ending.setdefault(j, []).append((i, k, s[k]))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, k, s in ending.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], n
        while j:
            if back[j]:
                i, k = back[j]
                out.append((k, bounds[i], bounds[j]))
                j = i
            else:
                j -= 1
        return out

    def learn(self, texts: list[str]) -> "Field":
        """Gradient ascent on the log-likelihood of the segmentations that the base spans give."""
        cases: list[tuple] = []
        names: dict[str, str] = {}  # one string object for each feature, however many spans have it
        for text in texts:
            if len(cases) >= MAX_TRAIN:
                break
            gold = {(s, e): k for k, s, e in reversed(base_spans(text))}
            for start, end in islands(text):
                if end - start > 400:
                    continue
                bounds, found = self.candidates(text, start, end)
                spans = [(i, j, tuple(names.setdefault(x, x) for x in span_features(*around))) for i, j, *around in found]
                segments = [(i, j, k, f) for i, j, f in spans for k in range(len(KINDS))]
                right = [gold.get((bounds[i], bounds[j])) == k for i, j, k, _ in segments]
                if sum(right) <= 12:
                    cases.append((len(bounds) - 1, segments, right))
        w = self.weights
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            for n, segments, right in cases[:MAX_TRAIN]:
                score = [sum(w.get((k, x), 0.0) for x in f) for _, _, k, f in segments]
                ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                by_end, by_start = {}, {}
                for q, (i, j, _, _) in enumerate(segments):
                    by_end.setdefault(j, []).append(q)
                    by_start.setdefault(i, []).append(q)
                for j in range(1, n + 1):
                    ahead[j] = _log_sum([ahead[j - 1], *(ahead[segments[q][0]] + score[q] for q in by_end.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    behind[i] = _log_sum([behind[i + 1], *(behind[segments[q][1]] + score[q] for q in by_start.get(i, ()))])
                step: Counter = Counter()
                for q, (i, j, k, f) in enumerate(segments):
                    gap = right[q] - math.exp(min(0.0, ahead[i] + score[q] + behind[j] - ahead[n]))
                    if abs(gap) > 1e-4:
                        for x in f:
                            step[k, x] += gap
                for key, g in step.items():
                    w[key] = (1 - RIDGE) * w.get(key, 0.0) + rate * g
        return self

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and the field's spans that touch none of them, by kind and start."""
        base = base_spans(text)
        if not _SEED.search(text):
            return base
        taken = sorted((s, e) for _, s, e in base)
        starts = [s for s, _ in taken]
        reach = list(accumulate((e for _, e in taken), max))  # the furthest end of a base span up to each
        added = []
        for start, end in islands(text):
            for k, s, e in self.segment(text, start, end):
                before = bisect_left(starts, e)
                if not before or reach[before - 1] <= s:
                    added.append((k, s, e))
        return sorted(base + added)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def trained_field(docs: DataFrame, max_train: int = MAX_TRAIN):
    """A broadcast field, taught by at most ``max_train`` documents that hold an at sign or a long number.

    They are sought among about ``LOOKED_THROUGH`` documents of smallest hash,
    so no task sorts more than these, whatever the size of the table.
    """
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    n = docs.count()
    if n > LOOKED_THROUGH:
        rows = rows.where(F.col("h") < F.lit(int(-(1 << 63) + (1 << 64) * LOOKED_THROUGH / n)))
    rows = rows.where(F.col("text").rlike("@|[0-9][0-9 .()-]{7}") & (F.length("text") < TRAIN_CHARS))
    rows = rows.groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(max_train)
    return docs.sparkSession.sparkContext.broadcast(Field({}).learn([r.text for r in rows.toLocalIterator()]).weights)


_fields: dict[int, Field] = {}


def _field(weights) -> Field:
    if id(weights) not in _fields:
        _fields.clear()
        _fields[id(weights)] = Field(weights)
    return _fields[id(weights)]


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _find(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(weights.value)
        for whole in batches:
            for part in slices(whole, "text", 1 << 20):
                counts, sha, every = [[] for _ in KINDS], [], []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    for k, c in enumerate(counts):
                        c.append(sum(b[0] == k for b in base))
                    sha.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                    every.append(_digest(field.spans(text or "")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to one row of counts and spans per input row.

    Null and empty texts have no spans; repeated rows give equal rows; an empty
    table gives an empty result; other columns are not read. The time for a text grows in
    proportion to its length. Taught are islands of at most 400 characters and 12 spans.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_find(trained_field(docs)), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _mask(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(weights.value)
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for part in slices(whole, "text", 1 << 20):
                texts = [t and masked(t, field.spans(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, whole.schema.field(at), pa.array(texts, whole.schema.field(at).type))

    return run


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the personal data of ``text`` replaced; texts without any are unchanged."""
    return docs.mapInArrow(_mask(trained_field(docs)), docs.schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
