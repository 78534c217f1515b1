"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of an
element's tag and class or id from the page's root. Over the m pages that have
a node, the entropy (to the base m) of its contents and of its presentation
(the sequence of its children) is its importance: what a site repeats on every
page has little. Few pages say little, so a node's entropy is shrunk towards
that of the same node over all hosts, and that towards 1, with the weight of
``SHRINK`` pages each; there is no least number of pages. Marks of purpose are
evidence on top: the importance of menus, headers, footers, sidebars, notices,
adverts, forms, scripts and comments is that of their branch times
``MARKED``, articles so marked included. A page keeps the blocks whose branch
has an importance of ``LOW`` or more; where it has an article, only those
inside, and of these it loses only what other pages of the host repeat word for
word at the same node. A page of which nothing would stay (a site of copies of
one page) is judged by the marks alone.

Spark groups (host, node, content) counts with partial sums, so a hot host is
no single task's work; the nodes of low importance come back to the pages by a
broadcast if there are at most ``MOST_BROADCAST`` of them, else by a join.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

SHRINK, LOW, MARKED = 3.5, 0.35, 0.3
MOST_BROADCAST = 200_000

# quotes count after an equals sign only; possessive, so each tag is read once
_ATTRIBUTES = r"""(?:[\s/]|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)?)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*>", re.S)
_NAME = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "noembed")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "option", "caption", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
_NO_TAGS = set("nav footer aside form button select input textarea script style noscript iframe template svg canvas object embed applet dialog menu head title datalist label audio video map".split())
_NO_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "note", "status"}
_NO_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended comment comments commentlist disqus respond reply replies discussion pagination pager toolbar masthead topbar banner skip".split()
)
_COMMENTS = set("comment comments commentlist disqus respond reply replies discussion".split())
#: Classes of an article or main part that name what it goes with or is about, not what it is.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|category|tag|type|format|status)-\S*", re.I)
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "td", "th", "body"}
_OUTSIDE_ONLY = {"header", "banner", "masthead"}


def _words(value: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


_marks: dict[tuple[str, str], tuple[str, bool, bool, bool, bool]] = {}


def marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """(label of the node, no importance, no importance outside an article, an article, comments) by tag and attributes."""
    key = (tag, attributes if len(attributes) < 200 else "")
    found = _marks.get(key)
    if found is None or key[1] != attributes:
        named = {m[0].lower(): m[1] or m[2] or m[3] for m in _NAME.findall(attributes)} if attributes.strip() else {}
        words = _words(named.get("class", "")) | _words(named.get("id", ""))
        role = named.get("role", "").lower()
        article = tag in ("article", "main") or role in ("main", "article") or named.get("itemprop", "") == "articleBody"
        outside = tag == "header" or bool(words & _OUTSIDE_ONLY)
        whole = tag == "main" or role == "main"
        purpose = _words(_ABOUT.sub("", named.get("class", ""))) | _words(_ABOUT.sub("", named.get("id", ""))) if article else words
        comment = not whole and bool(purpose & _COMMENTS)
        none = (not article and (tag in _NO_TAGS or role in _NO_ROLES)) or (not whole and bool(purpose & (_NO_WORDS - _OUTSIDE_ONLY))) or "hidden" in named or named.get("aria-hidden") == "true"
        found = (f"{tag}.{'.'.join(sorted(words))}", none, outside, article, comment)
        if len(_marks) > 20_000:
            _marks.clear()
        if key[1] == attributes:
            _marks[key] = found
    return found


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 1


def _node(up: int, label: str) -> int:
    """A stable 63-bit name of a node by its parent's name and its label; it stands for the whole path, however deep."""
    return _hash(up.to_bytes(8, "little") + label.encode("utf-8", "surrogatepass"))


class Block(NamedTuple):
    """A text run between block bounds: its node (which stands for the path from the root), the node's parent and label, and the marks."""

    node: int
    parent: int
    label: str
    text: str
    article: bool
    marked: bool


def blocks(page: str) -> list[Block]:
    """All blocks of a page in order, those in marked branches included; raw text of scripts, styles and titles is none."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool, bool, str]] = []  # tag, node, marked, article, comments, label
    open_: Counter = Counter()
    buffer: list[str] = []
    marked, article = False, False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(Block(stack[-1][1] if stack else 0, stack[-2][1] if len(stack) > 1 else 0, stack[-1][5] if stack else "", text, article, marked))
            buffer.clear()

    def close(to: int) -> None:
        nonlocal marked, article
        if any(e[0] in _BLOCK or e[2] for e in stack[to:]):
            flush()
        open_.subtract(e[0] for e in stack[to:])
        del stack[to:]
        marked, article = (stack[-1][2], stack[-1][3]) if stack else (False, False)

    at, size = 0, len(page)
    tags_end = page.rfind(">") + 1  # beyond it no tag can end
    while at < size:
        m = _TOKEN.search(page, at, tags_end) if at < tags_end else None
        stop = m.start() if m else page.find("<!--", at)
        stop = size if stop < 0 else stop
        if stop > at:
            text = page[at:stop]
            buffer.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if open_[tag] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            raw_stop = at
            at = end.end() if end else size
            if tag == "xmp":
                buffer.append(page[raw_stop : end.start() if end else size])
            continue
        label, none, outside, is_article, comment = marks(tag, m.group(3))
        same = _SAME.get(tag, ())
        if (tag in _CLOSES_P and open_["p"] > 0) or any(open_[t] > 0 for t in same):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same or (stack[k][0] == "p" and tag in _CLOSES_P):
                    close(k)
                    break
                if stack[k][0] in _HOLDS:
                    break
        if is_article and not none and marked and not any(e[3] or e[4] for e in stack):
            # an article does not stand in a menu or footer: that was never closed; among comments it is one
            close(next(k for k, e in enumerate(stack) if e[2]))
        here = article or is_article
        now = marked or none or (outside and not here)
        if tag in _BLOCK or now != marked:
            flush()
        if tag in _VOID or m.group(3).rstrip().endswith("/"):
            continue
        stack.append((tag, _node(stack[-1][1] if stack else 0, label), now, here, comment, label))
        open_[tag] += 1
        marked, article = now, here
    flush()
    return out


def _content(texts: list[str]) -> int:
    return _hash("\n".join(texts).encode("utf-8", "surrogatepass"))


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of contents and presentations by host and node."""
    schema = ["host", "node", "kind", "value", "n"]

    def out(held: Counter) -> pa.RecordBatch:
        rows = list(zip(*((*k, n) for k, n in held.items()))) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=schema)

    held: Counter = Counter()
    for whole in batches:
        for part in slices(whole, "html", 1 << 20):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                content: dict[int, list[str]] = {}
                children: dict[int, list[str]] = {}
                for b in blocks(page or ""):
                    content.setdefault(b.node, []).append(b.text)
                    children.setdefault(b.parent, []).append(b.label)
                for kind, parts in ((0, content), (1, children)):
                    for node, texts in parts.items():
                        held[host, node, kind, _content(texts)] += 1
            if len(held) > 100_000:
                yield out(held)
                held = Counter()
    yield out(held)


def importances(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(host, node, importance)`` of every node of the style tree, and the counts ``(host, node, kind, value, n)`` behind it."""
    counts = pages.select("host", "html").mapInArrow(_tree_rows, "host string, node long, kind int, value long, n long")
    # (host, node) groups are spread over their values first, so the contents of a hot host are summed by many tasks
    values = scratch.put(counts.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n")), "values")
    sums = values.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(F.expr("n * ln(n)")).alias("nlogn"))
    entropy = sums.select("host", "node", "m", F.expr("CASE WHEN m > 1 THEN (ln(m) - nlogn / m) / ln(m) ELSE 1D END").alias("h"))
    own = scratch.put(entropy.groupBy("host", "node").agg(F.max("h").alias("h"), (F.max("m") - 1).alias("w")), "entropies")
    whole = own.groupBy("node").agg(((F.sum(F.col("h") * F.col("w")) + SHRINK) / (F.sum("w") + SHRINK)).alias("prior"))
    whole = scratch.put(whole, "priors")
    return own.join(whole, "node").select("host", "node", ((F.col("h") * F.col("w") + SHRINK * F.col("prior")) / (F.col("w") + SHRINK)).alias("importance")), values


def low_nodes(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(host, node)`` of the nodes of low importance, and node ^ content of what their host repeats there."""
    found, values = importances(pages, scratch)
    low = scratch.put(found.where(F.col("importance") < LOW).select("host", "node"), "nodes")
    repeated = values.where("kind = 0 and n > 1").join(low, ["host", "node"]).select("host", F.expr("node ^ value").alias("node"))
    return low.unionByName(repeated)


def text_of(page: str, low: frozenset | set) -> str:
    """The page's kept blocks, one a line; ``low`` holds the nodes of low importance on its host.

    An importance is 1 at most, so a marked branch stays below ``LOW`` whatever
    its entropy.
    """
    found = [b for b in blocks(page) if not b.marked or MARKED >= LOW]
    if any(b.article for b in found):
        content: dict[int, list[str]] = {}
        for b in found if low else ():
            content.setdefault(b.node, []).append(b.text)
        gone = {node for node, texts in content.items() if node in low and node ^ _content(texts) in low}
        found = [b for b in found if b.article]
        kept = [b for b in found if b.node not in gone] if gone else found
    else:
        kept = [b for b in found if b.node not in low] if low else found
    return "\n".join(b.text for b in kept or found)


def _extract(low_by_host):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = low_by_host.value if low_by_host else {}
        for whole in batches:
            for part in slices(whole, "html", 1 << 20):
                joined = "low" in part.schema.names
                lows = part.column("low").to_pylist() if joined else [known.get(h, ()) for h in part.column("host").to_pylist()]
                texts = [text_of(p or "", set(n or ())) for p, n in zip(part.column("html").to_pylist(), lows)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to ``(page_id, url, text, n_chars)``, one row per input row.

    Null html is empty and gives empty text; a null url or one without a host
    belongs to the host ""; repeated rows give equal rows; an empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long"
    scratch = Scratch(spark, "html")
    low = scratch.put(low_nodes(pages, scratch), "low")
    if low.count() <= MOST_BROADCAST:
        by_host: dict[str, set[int]] = {}
        for r in low.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.node)
        return pages.mapInArrow(_extract(spark.sparkContext.broadcast(by_host)), schema)
    pages = pages.join(low.groupBy("host").agg(F.collect_set("node").alias("low")), "host", "left")
    return pages.mapInArrow(_extract(None), schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


#: The same rows for pages whose main text stands in a plain <article>, as those of the given table do.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1|br)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS lines FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(lines, lambda v: trim(regexp_replace(replace(replace(replace(v, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))), lambda v: v <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
