"""One merge of JSON texts, for every operator that merges extras.

Texts are parsed to trees whose numbers keep their digits. Objects merge key by
key at every depth; equal values stay, of different ones the pair ``[old,new]`` is
kept. Of two texts, an empty one or ``{}`` gives way, and so does one that is no
object. A repeated key counts with its last value.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import lru_cache

_SURROGATE = re.compile("[\ud800-\udfff]")


class Number(str):
    """A number as it was written; equal to others of its value."""

    __slots__ = ()

    def value(self) -> Decimal:
        return Decimal(self)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def parse(text: str | None) -> dict | None:
    """The object that a text is, else None (also for what is nested too deep to be read)."""
    try:
        tree = _DECODER.decode(text or "")
    except (ValueError, RecursionError):
        return None
    return tree if isinstance(tree, dict) else None


def _scalar(value, canonical: bool) -> str:
    if isinstance(value, Number):
        if not canonical:
            return str(value)
        sign, digits, exponent = value.value().as_tuple()
        whole = "".join(map(str, digits))
        short = whole.rstrip("0")
        return f"{'-' * sign}{short.lstrip('0')}e{exponent + len(whole) - len(short)}" if short.strip("0") else "0"
    if isinstance(value, str):
        return json.dumps(_SURROGATE.sub("�", value), ensure_ascii=False)
    return "null" if value is None else "true" if value else "false"


def write(tree, canonical: bool = False) -> str:
    """Compact text with keys in order, without recursion; ``canonical`` also writes equal numbers alike."""
    out: list[str] = []
    todo: list = [tree]
    while todo:
        value = todo.pop()
        if isinstance(value, _Raw):
            out.append(value.text)
        elif isinstance(value, dict):
            todo.append(_Raw("}"))
            for k, key in enumerate(sorted(value, reverse=True)):
                todo += [value[key], _Raw(_scalar(str(key), False) + ":"), _Raw(",")]
            if value:
                todo.pop()  # no comma before the first key
            todo.append(_Raw("{"))
        elif isinstance(value, list):
            todo.append(_Raw("]"))
            for item in reversed(value):
                todo += [item, _Raw(",")]
            if value:
                todo.pop()
            todo.append(_Raw("["))
        else:
            out.append(_scalar(value, canonical))
    return "".join(out)


class _Raw:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def equal(a, b) -> bool:
    """Equal as JSON values: 1 and 1.0 are, 1 and true are not."""
    if isinstance(a, Number) and isinstance(b, Number):
        return a.value() == b.value()
    if isinstance(a, (list, dict)):
        return type(a) is type(b) and write(a, True) == write(b, True)
    return type(a) is type(b) and a == b


def merge_values(old, new):
    if isinstance(old, dict) and isinstance(new, dict):
        out = dict(old)
        todo = [(out, new)]
        while todo:
            into, more = todo.pop()
            for key, value in more.items():
                if key not in into:
                    into[key] = value
                elif isinstance(into[key], dict) and isinstance(value, dict):
                    into[key] = dict(into[key])
                    todo.append((into[key], value))
                else:
                    into[key] = value if equal(into[key], value) else [into[key], value]
        return out
    return new if equal(old, new) else [old, new]


#: Texts of at most so many characters are parsed once in a task's process as long as they come again; a merge changes no tree.
_SHORT = 256
_parse_short = lru_cache(maxsize=4096)(parse)
#: What every text has that holds a number or half of a surrogate pair (some others have it too).
_NOT_PLAIN = re.compile(r"[:\[,]\s*-?[0-9]|\\u[dD]")
#: Merges of at most so many plain texts are written by the standard encoder, which recurses; it writes them as ``write`` does.
_FEW = 500
_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


class Merged:
    """The merge of texts taken in order: a tree, or the last text that is no object while none was."""

    __slots__ = ("tree", "other", "written", "left")

    def __init__(self, written: str | None = None):
        """``written`` is an earlier merge's text: it is read only if another text comes."""
        self.tree, self.other, self.written, self.left = None, "", written, _FEW

    def take(self, text: str | None) -> "Merged":
        text = (text or "").strip()
        if text in ("", "{}"):
            return self
        if self.written is not None:
            earlier, self.written = self.written, None
            self.take(earlier)
        tree = _parse_short(text) if len(text) <= _SHORT else parse(text)
        if tree is not None:
            self.left = self.left - 1 if self.left and not _NOT_PLAIN.search(text) else 0
            self.tree = tree if self.tree is None else merge_values(self.tree, tree)
        elif self.tree is None:
            self.other = text
        return self

    def text(self) -> str:
        if self.written is not None:
            return self.written or "{}"
        if self.tree is None:
            return self.other or "{}"
        if self.left:
            try:
                return _ENCODER.encode(self.tree)
            except RecursionError:
                pass
        return write(self.tree)


def merge_texts(old: str | None, new: str | None) -> str:
    return Merged().take(old).take(new).text()
