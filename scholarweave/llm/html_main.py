"""Main text of web pages as the best-scoring stretch of words and tags.

A page is a row of tokens, runs of words and tags. Words score above zero and tags below, by the kind of token; the stretch with the
largest sum (one linear scan) is the main text. The weights are log-odds of each kind being inside the content, counted
on labelled pages: those that mark their content themselves with ``<article>`` or ``<main>``, at most
``Settings.sample`` of them, chosen by a hash of the page id.

Nothing is thrown away before the scan but what is no text (scripts, styles, comments of the markup). Words in elements that are usually no article
(menus, footers, asides, forms, hidden elements, adverts, reader comments, and elements so named by a whole class, id or role) stay in the row
as kinds of their own, and so do the words outside the marks of a page that has marks; their weights are learned with all others and end below zero. They
are left out of the text if they lie within the stretch. Such an element that holds the content itself (an article, main part or main heading, or
more than half of the page's words) is a wrapper and does not count; an article in an article is a reader's comment.

Defined results: a null or empty page, or one without words of its own, has the text ''. Unclosed elements end with the element
around them; an unclosed excluded element also ends where an article, a main or a body part begins. Of equal
stretches the first and longest wins. Repeated rows are extracted each; further columns may be kept; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import add_columns

# attributes: a quoted value follows an equals sign; any other character is skipped up to the end of the tag
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)")
_MARK = re.compile(r"<(?:article|main)[\s>]", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msub msup q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("nav footer aside form button select option dialog menu object audio video canvas fieldset".split())
_FRAME = frozenset("html head body meta link".split())
_RESET = frozenset("article main body footer".split())
_MARKED = frozenset("article main".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation "
    "sidebar footer header masthead topbar comment comments disqus respond replies reply form newsletter subscribe signup login search share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar skip legal copyright complementary contentinfo".split()
)
_ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices comment comments disqus respond replies reply".split()
)
_PARTS = frozenset("nav navbar menu footer sidebar cookie ad ads advert sponsor banner newsletter breadcrumb share social login popup modal".split())
_REMARKS = re.compile(r"(?:comment|comments|disqus|reply|replies|respond)(?:[-_].*)?")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("li ul ol dl dt dd".split())
_TABLES = frozenset("table tr td th tbody thead tfoot".split())


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled pages that weights are counted on."""

    sample: int = 2_000
    least_word: float = 0.2
    least_tag: float = 0.02
    apart: float = -1.5
    most: float = 4.0


# words that a page with marks leaves outside of them
_OUTSIDE = "z-outside"


def _kind(name: str) -> str:
    if name in _HEADINGS:
        return "heading"
    if name in _LISTS:
        return "list"
    if name in _TABLES:
        return "table"
    if name in ("a", "p", "br", "div", "section", "blockquote", "pre", "img"):
        return name
    return "inline" if name in _INLINE else "other"


# kinds of element that may wrap a whole page; the others never do
_WRAPPERS = frozenset("form hidden named part".split())


def _zone(name: str, attributes: str, in_content: bool, has_marks: bool) -> str | None:
    """The kind of an element that is usually no article, or None."""
    if name in _NEVER or (name == "header" and not in_content):
        return "form" if name in ("form", "fieldset") else "never"
    if name in _MARKED or name in ("body", "html"):
        return None
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and _NOT_SHOWN.search(value)):
            return "hidden"
        if key in ("class", "id", "role"):
            names = value.split()
            if any(_REMARKS.fullmatch(x) for x in names):
                return "remark"
            # inside the content only what is named for it
            if (_ADVERTS if in_content else _NAMES).intersection(names):
                return "named"
            if not in_content and not has_marks and _PARTS.intersection(re.split(r"[^a-z0-9]+", value)):
                return "part"
    return None


class _Element:
    """An open element that is usually no article, with what it holds."""

    def __init__(self, kind: str, outer: _Element | None, words: int, cores: int):
        self.kind, self.outer, self.words, self.cores = kind, outer, -words, -cores
        self.own: _Element | None = None  # itself or the nearest around it that is no wrapper

    def close(self, words: int, cores: int) -> None:
        self.words += words
        self.cores += cores


def tokens(page: str) -> tuple[list[tuple[str, str | None, int]], list[bool]]:
    """(kind, text or None for a tag, block) of each token, and whether the page marks it as content.

    A text token is a run of text between tags, scored by its number of words. Kinds of words begin with ``w``, those in elements that are usually no article with ``z``.
    """
    rows: list[tuple[str, str | None, int, bool, _Element | None]] = []
    stack: list[tuple[str, _Element | None]] = []  # open elements, and what each opens
    depths: dict[str, list[int]] = {}  # of the open elements by name
    zones: list[_Element] = []
    zone: _Element | None = None
    marked = links = headings = lists = articles = words = cores = block = last = 0
    has_marks = _MARK.search(page) is not None

    def text_until(end: int) -> None:
        nonlocal words
        if end <= last:
            return
        text = page[last:end]
        if text.isspace():
            rows.append(("blank", " ", block, marked > 0, zone))
        else:
            words += len(text.split())
            rows.append(("w-link" if links else "w-heading" if headings else "w-list" if lists else "w", html.unescape(text), block, marked > 0, zone))

    def leave(depth: int) -> None:
        nonlocal marked, links, headings, lists, articles, zone
        while len(stack) > depth:
            name, opened = stack.pop()
            depths[name].pop()
            if opened is not None:
                opened.close(words, cores)
                zone = opened.outer
            marked -= name in _MARKED
            articles -= name == "article"
            links -= name == "a"
            headings -= name in _HEADINGS
            lists -= name in _LISTS

    for m in _TOKEN.finditer(page):
        text_until(m.start())
        last = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            block += name != "br"
        if m["close"]:
            if name not in _MARKED and name not in _FRAME:
                rows.append(("/" + _kind(name), None, block, marked > 0, zone))
            if depths.get(name):
                leave(depths[name][-1])
            continue
        if zone is not None and zone.kind == "never" and name in _RESET:
            leave(next(i for i, (_, opened) in enumerate(stack) if opened is not None and opened.kind == "never"))
        kind = "remark" if name == "article" and articles else _zone(name, m["attributes"], marked > 0, has_marks)
        if kind is None:
            cores += name in _MARKED or name == "h1"
        if name == "br":
            rows.append(("br", " ", block, marked > 0, zone))
        elif name not in _MARKED and name not in _FRAME:
            rows.append((_kind(name), None, block, marked > 0, zone))
        if name in _VOID or m["attributes"].rstrip().endswith("/"):
            continue
        if (name == "p" or name in _HEADINGS) and depths.get("p"):  # these end an open paragraph
            depth = depths["p"][-1]
            if len(stack) - depth < 64 and all(x in _INLINE or x == "p" for x, _ in stack[depth:]):
                leave(depth)
        opened = None
        if kind is not None:
            opened = zone = _Element(kind, zone, words, cores)
            zones.append(opened)
            if rows and rows[-1][1] is None:
                rows[-1] = (*rows[-1][:4], zone)
        depths.setdefault(name, []).append(len(stack))
        stack.append((name, opened))
        marked += name in _MARKED
        articles += name == "article"
        links += name == "a"
        headings += name in _HEADINGS
        lists += name in _LISTS
    text_until(len(page))
    leave(0)
    for z in zones:  # outer ones come first
        wraps = z.kind in _WRAPPERS and (z.cores > 0 or 2 * z.words > words)
        z.own = (z.outer.own if z.outer else None) if wraps else z
    out, inside, before = [], [], None
    for kind, text, at, own, z in rows:
        real = z.own if z else None
        if real is not None and text is None:
            if real is before:
                continue
            kind = "excluded"  # one tag stands for all of such an element
        elif real is not None and kind[0] == "w":
            kind = f"z-{real.kind}"
        before = real
        out.append((kind, text, at))
        inside.append(own and not (real is not None and real.kind == "remark"))
    return out, inside


def _amount(kind: str, text: str | None) -> int:
    return len(text.split()) if kind[0] in "wz" and text else 1


def weights(counts: dict[tuple[str, bool], int], settings: Settings = Settings()) -> dict[str, float]:
    """Log-odds of each kind from its counts inside and outside, kept above zero for words and below for tags and for words of elements that are usually no article."""
    out = {_OUTSIDE: -settings.most}
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 1) / (counts.get((kind, False), 0) + 1))
        out[kind] = min(settings.most, max(settings.least_word, odds)) if kind[0] == "w" else max(-settings.most, min(-settings.least_tag if kind[0] != "z" else settings.apart, odds))
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First token and token after the last of the stretch with the largest sum above zero."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def extract(page: str | None, weight: dict[str, float], settings: Settings = Settings()) -> str:
    if not page:
        return ""
    found, inside = tokens(page)
    if any(inside):
        found = [(_OUTSIDE if kind[0] == "w" and not own else kind, text, block) for (kind, text, block), own in zip(found, inside, strict=True)]
    default = {"w": max(settings.least_word, weight.get("w", 1.0)), "z": settings.apart}
    scores = [0.0 if k == "blank" else weight.get(k, default.get(k[0], -1.0)) * _amount(k, t) for k, t, _ in found]
    a, b = best_stretch(scores)
    blocks: list[str] = []
    pieces: list[str] = []
    current = None
    for kind, text, block in found[a:b]:
        if text is None or kind[0] == "z":
            continue
        if block != current:
            blocks.append("".join(pieces))
            pieces, current = [], block
        pieces.append(text)
    blocks.append("".join(pieces))
    return " ".join(x for x in (" ".join(t.split()) for t in blocks) if x)


def train(pages: DataFrame, settings: Settings = Settings()) -> dict[str, float]:
    """Weights from pages that mark their content."""
    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # bounded by the limit: small enough to ship
    chosen = F.broadcast(marked.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(settings.sample).distinct())

    def run(batches):
        for batch in batches:
            counts: dict[tuple[str, bool], int] = {}
            for page in batch.column(0).to_pylist():
                found, inside = tokens(page or "")
                for (kind, text, _), own in zip(found, inside, strict=True):
                    counts[kind, own] = counts.get((kind, own), 0) + _amount(kind, text)
            keys = sorted(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    rows = pages.select("page_id", "html").join(chosen, "page_id").select("html").mapInArrow(run, "kind string, inside boolean, n bigint")
    counted = rows.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()  # one row for each kind of token
    return weights({(r["kind"], r["inside"]): r["n"] for r in counted}, settings)


def main_text(pages: DataFrame, weight: dict[str, float], keep: list[str], settings: Settings = Settings()) -> DataFrame:
    """``keep`` columns of each page with ``text`` and ``n_chars``."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [extract(page, weight, settings) for page in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(np.array([len(t) for t in texts], dtype=np.int64))}

    return add_columns(pages, work, "text string, n_chars bigint", keep, ["html"])
