"""Main text of web pages: a classifier's costs and the nearness of blocks, separated by a minimum cut.

A page is cut into blocks of text.  A logistic classifier, fitted here, gives
each block the cost of calling it content and the cost of calling it
boilerplate; these are its capacities to the two terminals.  Blocks that
follow each other, and blocks that stand close in the element tree, are tied
by edges.  The minimum cut is the cheapest labelling.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .min_cut import min_cut
from .words import frugal

# ---- blocks ----------------------------------------------------------------

# Fixed values of HTML: elements inside a line of text, without content, whose content is no text, and those that end an open one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big blink br cite code data del dfn em embed font i img ins kbd label mark nobr output picture q rb rp rt rtc ruby s samp "
    "small source span strike strong sub sup time track tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SILENT = RAW | frozenset("noscript template svg math select button object canvas audio video datalist".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: A tag with its attributes; quoted values may hold ``>``.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

NAV, HEAD, FOOT, SIDE, AD, NOTE, FORM, TALK, GOOD, INSIDE = (1 << i for i in range(10))
AGAINST = NAV | HEAD | FOOT | SIDE | AD | NOTE | FORM | TALK
#: What the name of an element says.
TAGS = {"nav": NAV, "menu": NAV, "header": HEAD, "footer": FOOT, "aside": SIDE, "form": FORM, "fieldset": FORM, "dialog": NOTE, "article": INSIDE, "main": INSIDE}
#: What a word in an element's class, id or role says.
WORDS = {
    word: hint
    for hint, names in (
        (NAV, "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sitemap toolbar topbar tabs"),
        (HEAD, "header masthead"),
        (FOOT, "footer copyright colophon contentinfo"),
        (SIDE, "sidebar aside complementary rail related recommended recommendations widget widgets share sharing social trending popular tags"),
        (AD, "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted adsense banner"),
        (NOTE, "cookie cookies consent gdpr notice notices alert popup modal overlay toast newsletter subscribe paywall disclaimer dialog alertdialog"),
        (FORM, "form login signin signup search searchbox register"),
        (TALK, "comment comments commentlist disqus replies reply respond responses discussion"),
        (GOOD, "article articlebody content entry post story maincontent text"),
    )
    for word in names.split()
}


@functools.lru_cache(4096)
def _said(tag: str, attributes: str) -> int:
    """Hints of one element by itself."""
    found = TAGS.get(tag, 0)
    if attributes:
        for _, value in NAMED.findall(attributes):
            for word in re.findall("[a-z]+", CAMEL.sub(" ", value).lower()):
                found |= WORDS.get(word, INSIDE if word == "main" and tag != "body" else 0)
        if HIDDEN.search(attributes):
            found |= NOTE
    if tag in ("body", "html"):
        return 0
    if tag in ("article", "main"):  # names like has-sidebar tell of the page
        return found & (INSIDE | AD | TALK | GOOD)
    return found


def _inherited(above: int, tag: str, own: int) -> int:
    """Hints of an element from those of its parent and its own.

    What wrappers around the first article say doesn't count inside it,
    unless they hold navigation or readers' comments; the heading of an
    article belongs to it.
    """
    if own & INSIDE and not above & INSIDE:
        above &= NAV | TALK
    if above & INSIDE:
        own &= ~HEAD
    return above | own


@dataclass(slots=True)
class Block:
    """A run of text: where it stands, what is said of it, and how much of it is link text."""

    text: str
    parent: int
    tag: str
    hints: int
    linked: float


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and the parent of each element; element 0 is the page."""
    parents, hints, tags = [0], [0], ["html"]
    stack = [0]
    out: list[Block] = []
    parts: list[str] = []
    linked = all_ = 0
    link = False

    def close() -> None:
        nonlocal linked, all_
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = stack[-1]
                out.append(Block(text, at, tags[at], hints[at], linked / max(all_, 1)))
            parts.clear()
            linked = all_ = 0

    def say(text: str) -> None:
        nonlocal linked, all_
        if text:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            n = len(text.strip())
            all_ += n
            if link:
                linked += n

    at, end, lower = 0, len(page), page.lower()
    if len(lower) != end:  # a few letters grow; then names of ends are found as they are written
        lower = page
    while at < end:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            stop = page.find("-->", start + 4) + 2 if page.startswith("<!--", start) else page.find(">", start)
            if stop < 2:
                break
            at = stop + 1
            continue
        tagged = TAG.match(page, start)
        if tagged is None:
            if not re.match(r"/?[a-zA-Z]", page[start + 1 : start + 3]):
                say("<")
                at = start + 1
                continue
            stop = page.find(">", start)  # an open quotation mark
            if stop < 0:
                break
            found = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", page[start : stop + 1])
            closing, tag, attributes, at = found[1], found[2].lower(), "", stop + 1
        else:
            closing, tag, attributes, at = tagged[1], tagged[2].lower(), tagged[3], tagged.end()
        if tag in INLINE:
            if tag == "a":
                link = not closing
            elif tag == "br":
                say(" ")
            continue
        if not closing and tag in SILENT:
            stop = lower.find(f"</{tag}", at)
            if stop < 0:
                if tag in RAW:
                    break
                continue
            stop = page.find(">", stop)
            if stop < 0:
                break
            at = stop + 1
            continue
        close()
        link = False
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == tag:
                    del stack[i:]
                    break
            continue
        while len(stack) > 1 and (tags[stack[-1]] == "p" or tags[stack[-1]] in ENDS.get(tag, ())):
            stack.pop()
        above = stack[-1]
        stack.append(len(parents))
        parents.append(above)
        tags.append(tag)
        hints.append(_inherited(hints[above], tag, _said(tag, attributes.strip())))
    close()
    return out, parents


# ---- classifier ------------------------------------------------------------

FEATURES = ("bias", "words", "linked", "ends", "heading", "paragraph", "item", "first", "nav", "head", "foot", "side", "ad", "note", "form", "talk", "good", "inside")
#: Where the fit begins and what it is drawn to.
PRIOR = np.array([-2.0, 4.0, -4.0, 0.6, 0.3, 0.8, -0.5, 0.0, -6.0, -6.0, -6.0, -6.0, -7.0, -6.0, -6.0, -7.0, 1.0, 6.0])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
N_TEXT = FEATURES.index("nav")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block; what is said for it counts only if nothing is said against it."""
    rows = []
    for i, b in enumerate(found):
        against = b.hints & AGAINST
        rows.append(
            (
                1.0, min(math.log1p(b.text.count(" ") + 1) / 5, 1.5), b.linked, b.text[-1] in ".!?…:\"”»。", b.tag in HEADINGS, b.tag in ("p", "pre", "blockquote"), b.tag in ("li", "dt", "dd"), i == 0,
                *(bool(against & hint) for hint in (NAV, HEAD, FOOT, SIDE, AD, NOTE, FORM, TALK)), bool(b.hints & GOOD) and not against, bool(b.hints & INSIDE) and not against,
            )
        )
    return np.array(rows, float).reshape(-1, len(FEATURES))


@frugal
def _learning_rows(batches):
    """Features and label of at most 200 blocks of each page: 0 where anything is said against a block, 1 where an article holds it."""
    for batch in batches:
        rows, labels = [], []
        for page in batch.column("html").to_pylist():
            found, _ = blocks(page)
            x = features(found)
            against = x[:, N_TEXT:-2].any(axis=1)
            known = np.flatnonzero(against | (x[:, -1] > 0))
            known = known[:: max(1, -(-len(known) // 200))]
            rows += x[known].tolist()
            labels += (~against[known]).astype(int).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["x", "y"])


def weights(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression drawn to PRIOR, by Newton's method.

    Each row counts twice, as it is and without what names say, so that the
    text alone is learned too, for pages whose names say nothing.  Both labels
    weigh the same.
    """
    if not len(y):
        return PRIOR
    bare = x.copy()
    bare[:, N_TEXT:] = 0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y]).astype(float)
    share = y.mean()
    c = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(y) * min(len(y), 500)
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (c * (p - y)) + 4 * (w - PRIOR)
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 4 * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, sample: int = 2000) -> np.ndarray:
    """The classifier's weights, from at most ``sample`` different pages.

    There are no labels of blocks: those that elements like ``nav``,
    ``footer`` or ``article`` and usual names mark are the examples.  Pages
    are chosen by a hash of their html; without examples the weights are PRIOR.
    """
    rows = pages.select("html").where("html <> ''")
    n = rows.count()
    if not n:
        return PRIOR
    share = min(1.0, 1.5 * sample / n)
    h = F.xxhash64("html")
    near = rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("h", h)
    near = near.dropDuplicates(["h"]).orderBy("h").limit(sample).select("html")
    found = near.repartition(8).mapInArrow(_learning_rows, "x array<double>, y int").toPandas()
    return weights(np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["y"].to_numpy(int))


# ---- labels ----------------------------------------------------------------

#: Capacities are whole numbers: costs times this.
UNIT = 100
#: Ties of blocks that follow each other, in one element or in elements side by side, or elsewhere; and of a block to the last one under the same parent of its element, if others stand between.
NEXT, ACROSS, COUSIN = 60, 15, 20
SUREST = 8.0


def ties(found: list[Block], parents: list[int]) -> list[tuple[int, int, int]]:
    """Edges ``a, b, capacity`` between blocks that are near each other."""
    out, last = [], {}
    for i, b in enumerate(found):
        up = parents[b.parent]
        if i:
            before = found[i - 1].parent
            out.append((i - 1, i, NEXT if before == b.parent or parents[before] == up else ACROSS))
        for element in {b.parent, up}:
            if last.get(element, i - 1) != i - 1:
                out.append((last[element], i, COUSIN))
            last[element] = i
    return out


def label(found: list[Block], parents: list[int], w: np.ndarray) -> tuple[np.ndarray, list[bool]]:
    """Each block's probability of being content by the classifier alone, and whether the cut keeps it."""
    if not found:
        return np.zeros(0), []
    score = np.clip(features(found) @ w, -SUREST, SUREST)
    # cost of boilerplate minus cost of content: -log(1-p) + log(p)
    return 1 / (1 + np.exp(-score)), min_cut(np.rint(score * UNIT).astype(int).tolist(), ties(found, parents))


def main_text(page: str | None, w: np.ndarray) -> tuple[str, int, int]:
    """Text of the kept blocks, joined by newlines; how many blocks there are and how many are kept."""
    found, parents = blocks(page or "")
    _, kept = label(found, parents, w)
    return "\n".join(b.text for b, k in zip(found, kept) if k), len(found), sum(kept)


def _texts(w: np.ndarray):
    @frugal
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_text(page, w) for page in batch.column("html").to_pylist()]
            text, n, kept = zip(*rows) if rows else ((), (), ())
            own = [pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *own], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return run


def extract_text(pages: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` of every row; ``w`` are weights of ``fit``, fitted on ``pages`` if left out.

    Character references are decoded, white space inside a block is one
    space, blocks are joined by a newline in page order.  Scripts, styles,
    comments and controls are no text.  Null, empty and contentless pages have
    the empty text.  Rows are judged one by one, so equal rows, null or equal
    ids and other columns make no difference; an empty table gives no rows.
    Pages are read whole; time and memory grow with a page's own length.
    """
    w = fit(pages) if w is None else w
    kinds = pages.select("page_id", "url").schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return pages.select("page_id", "url", "html").mapInArrow(_texts(w), f"{out}, text string, n_chars long, n_blocks long, n_kept long")
