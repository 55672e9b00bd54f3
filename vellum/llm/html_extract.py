"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A tolerant parser builds the tree of block elements (inline markup only adds to
its block's text and link counts).  Trees score every block by its tag, depth,
subtree and own text, link and tag density, attribute tokens, sibling statistics
and what it lies in.  Attribute tokens are hashed words of class, id, role and the
like; what each says of its block is learned as smoothed log-odds.  Decoding gives
each block one of three states: container (undecided, its children may be anything),
content (its children may be content or dropped) and dropped (so is all below it);
the best assignment over the whole tree is found by dynamic programming, so no chosen
block lies in a dropped one.

Both are trained here, on pages written by ``html_pages`` with known main text: many
kinds of site, with and without telling tags and class names; token odds on one half
of the pages, trees on the other.  No row of the input is used for training.

Defined results: a null or empty page, and a page with no content block, has the
empty text; markup that never ends is text up to the end of the page or, for
comments and raw-text elements, dropped; elements deeper than ``DEPTH`` count as
children of the element at that depth; equal rows give equal rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import boosting

DEPTH = 256

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements whose content is no text of the page; they end with their parent at the latest.
UNSEEN = FOREIGN | frozenset("template select button option object".split())
BLOCK = frozenset("html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
#: A start tag ends an open element of these kinds, up to the nearest of the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}
P_SCOPE = frozenset("td th table caption button html body".split())

# Possessive, and no name or bare attribute runs over a "<": a page of unfinished tags is read in linear time.
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)([^<>\"']*+(?:\"[^\"]*+\"[^<>\"']*+|'[^']*+'[^<>\"']*+)*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?/][^<>]*+>", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?:[\s=>]|$)", re.I)


class Block:
    __slots__ = ("attrs", "depth", "hidden", "kids", "links", "own", "parent", "pieces", "tag", "tags")

    def __init__(self, tag: str, attrs: str, parent: int, depth: int):
        self.tag, self.attrs, self.parent, self.depth = tag, attrs, parent, depth
        self.pieces: list = []  # text, or the index of a child block, in page order
        self.kids: list[int] = []
        self.own = self.links = self.tags = 0
        self.hidden = False


def parse(page: str) -> list[Block]:
    """Blocks in page order; the first is the root."""
    blocks = [Block("#root", "", -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: tag and the block that their text goes to
    anchors = 0
    at, n = 0, len(page)
    search = _TAG.search
    lower = None

    def text(raw: str) -> None:
        if raw and stack[-1][1] >= 0:
            b = blocks[stack[-1][1]]
            b.pieces.append(raw)
            size = len(raw) - raw.count(" ")
            b.own += size
            if anchors:
                b.links += size

    def close(to: int) -> None:
        nonlocal anchors
        anchors -= sum(t == "a" for t, _ in stack[to:])
        del stack[to:]

    while at < n:
        m = search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if tag == "p" and not any(t == "p" for t, _ in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and tag not in UNSEEN and stack[k][0] in BLOCK:
                    break  # inline markup ends no block
            continue
        attrs = m[3] or m[6] or ""
        if attrs.endswith("/") and (tag in FOREIGN or any(t in FOREIGN for t, _ in stack)):
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower()
            end = lower.find("</" + tag, at)
            stop = page.find(">", end) if end >= 0 else -1
            at = n if stop < 0 else stop + 1
            continue
        if tag in BLOCK:  # ends a drawing or formula that was not closed
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ("foreignobject", "annotation-xml"):
                    break
                if stack[k][0] in FOREIGN:
                    close(k)
                    break
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in P_SCOPE:
                    break
        if tag in ENDS:
            ended, scope = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in ended:
                    close(k)
                    if tag not in ("tr",):
                        break
        here = -1 if tag in UNSEEN else stack[-1][1]  # -1: nowhere
        if tag not in BLOCK and here >= 0:
            blocks[here].tags += 1
            if tag == "br":
                blocks[here].pieces.append(" ")
        if tag in VOID:
            continue
        if tag == "a":
            for k in range(len(stack) - 1, 0, -1):  # links do not nest
                if stack[k][0] == "a":
                    del stack[k]
                    anchors -= 1
                    break
                if stack[k][0] in BLOCK:
                    break
            anchors += 1
        if tag in BLOCK and here >= 0 and len(stack) < DEPTH:
            new = Block(tag, attrs, here, blocks[here].depth + 1)
            new.hidden = bool(attrs) and bool(_STYLE_HIDDEN.search(attrs))
            blocks.append(new)
            blocks[here].kids.append(len(blocks) - 1)
            blocks[here].pieces.append(len(blocks) - 1)
            stack.append((tag, len(blocks) - 1))
        elif len(stack) < 4 * DEPTH:
            stack.append((tag, here))
        elif tag == "a":
            anchors -= 1
    return blocks


# --- features ---------------------------------------------------------------------

TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "table", "td", "pre", "blockquote", "figure", "body", "#root")
WIDTH = len(TAGS) + 23
#: Buckets of hashed attribute tokens.
TOKENS = 1 << 12


@functools.lru_cache(100_000)
def tokens_of(attrs: str) -> tuple[int, ...]:
    """Buckets of the distinct words that an element's telling attributes hold."""
    words = {w.lower() for m in _ATTR.finditer(attrs) for w in _WORD.findall(m[1] or m[2] or m[3] or "")}
    return tuple(sorted({zlib.crc32(w.encode()) % TOKENS for w in words}))


@dataclass
class Model:
    trees: boosting.Trees
    odds: np.ndarray  # log-odds of a block being content, by token bucket


_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_SELDOM = frozenset(("nav", "aside", "footer", "form", "menu", "dialog"))


def features(blocks: list[Block], odds: np.ndarray) -> np.ndarray:
    n = len(blocks)
    total = [b.own for b in blocks]
    links = [b.links for b in blocks]
    tags = [b.tags + 1 for b in blocks]
    paragraphs = [0] * n
    for i in range(n - 1, 0, -1):
        b = blocks[i]
        p = b.parent
        total[p] += total[i]
        links[p] += links[i]
        tags[p] += tags[i]
        paragraphs[p] += (b.tag == "p") + paragraphs[i]
    place = [0.0] * n
    alike = [1] * n  # siblings of the same tag
    for b in blocks:
        kids = b.kids
        if len(kids) > 1:
            last = len(kids) - 1
            same: dict[str, int] = {}
            for k, c in enumerate(kids):
                place[c] = k / last
                tag = blocks[c].tag
                same[tag] = same.get(tag, 0) + 1
            for c in kids:
                alike[c] = same[blocks[c].tag]
    page = max(1, total[0])
    above = [(0.0, 0.0, 0, 0)] * n  # worst and best token odds, within article or main, within what is seldom content
    table = odds.tolist()
    rows = []
    for i, b in enumerate(blocks):
        own = [table[k] for k in tokens_of(b.attrs)] if b.attrs else []
        worst, best = min(own, default=0.0), max(own, default=0.0)
        p = b.parent if i else 0
        w0, b0, a0, s0 = above[p] if i else above[0]
        tag = b.tag
        above[i] = lies = (min(w0, worst), max(b0, best), a0 or tag == "article" or tag == "main", s0 or tag in _SELDOM)
        t, tp = total[i], total[p]
        rows.append(
            (b.depth, t, b.own, links[i] / (t or 1), tags[i] / (t or 1), t / page, t / (tp or 1), len(blocks[p].kids) if i else 1, place[i], len(b.kids), paragraphs[i], worst, best, *lies, paragraphs[p] if i else 0, links[p] / (tp or 1) if i else 0, i / n, b.hidden, b.attrs != "", alike[i])
        )
    k = len(TAGS)
    x = np.zeros((n, WIDTH))
    x[:, k:] = rows
    x[:, k + 1 : k + 3] = np.log1p(x[:, k + 1 : k + 3])
    at = np.array([_TAG_AT.get(b.tag, -1) for b in blocks])
    known = np.flatnonzero(at >= 0)
    x[known, at[known]] = 1
    return x


# --- decoding ---------------------------------------------------------------------


CONTAINER, CONTENT, DROPPED = 0, 1, 2


def values(blocks: list[Block], logits: np.ndarray) -> list[tuple[float, float, float]]:
    """What each state of each block is worth by itself: a block speaks for its own text, and for its subtree by a block's worth."""
    out = []
    for b, z in zip(blocks, np.clip(logits, -8.0, 8.0).tolist(), strict=True):
        z = -8.0 if b.hidden else z
        v = z * (1 + b.own / 50.0)
        out.append((-z * b.own / 50.0 - 0.5, v, -v))
    return out


def states(blocks: list[Block], logits: np.ndarray) -> list[int]:
    """The best assignment of container, content and dropped along the tree: below containers anything, below content no container, below dropped only dropped."""
    n = len(blocks)
    cont, inside, out = (list(x) for x in zip(*values(blocks, logits), strict=True))
    for i in range(n - 1, 0, -1):
        p = blocks[i].parent
        inside[p] += max(inside[i], out[i])
        out[p] += out[i]
        cont[p] += max(cont[i], inside[i], out[i])
    state = [CONTAINER] * n
    for i in range(n):
        above = state[blocks[i].parent] if i else CONTAINER
        if above == DROPPED:
            state[i] = DROPPED
        elif above == CONTENT or cont[i] < max(inside[i], out[i]):
            state[i] = CONTENT if inside[i] >= out[i] else DROPPED
    return state


def decode(blocks: list[Block], logits: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    return [s == CONTENT for s in states(blocks, logits)]


def render(blocks: list[Block], chosen: list[bool]) -> str:
    """Text of the chosen blocks, one line for each run of text between block boundaries."""
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            line = " ".join(unescape("".join(run)).split())
            if line:
                lines.append(line)
            run.clear()

    todo: list = [(0, 0)]
    while todo:
        i, k = todo.pop()
        b = blocks[i]
        while k < len(b.pieces):
            piece = b.pieces[k]
            k += 1
            if isinstance(piece, int):
                flush()
                todo.append((i, k))
                todo.append((piece, 0))
                break
            if chosen[i]:
                run.append(piece)
        else:
            flush()
    return "\n".join(lines)


@functools.cache
def model(pages: int = 1000, seed: int = 5) -> Model:
    """Trained on generated pages; the same for the same arguments."""
    from .html_pages import make

    parsed = [parse(make(seed, i)[0]) for i in range(pages)]
    marked = [(blocks, _truth(blocks)) for blocks in parsed]
    odds = _learned(marked[: pages // 2])
    xs, ys = [], []
    for blocks, marks in marked[pages // 2 :]:
        keep = np.array([m is not None for m in marks])
        xs.append(features(blocks, odds)[keep])
        ys.append(np.array([m > 0.9 for m in marks if m is not None], float))
    return Model(boosting.fit(np.concatenate(xs), np.concatenate(ys)), odds)


def _learned(marked: list[tuple[list[Block], list[float | None]]]) -> np.ndarray:
    """Smoothed log-odds of each token bucket, of blocks that are nearly all main text or nearly all not."""
    good, bad = np.zeros(TOKENS), np.zeros(TOKENS)
    total = [1, 1]
    for blocks, marks in marked:
        for b, m in zip(blocks, marks, strict=True):
            if m is not None and not 0.1 < m < 0.9:
                total[m < 0.5] += 1
                (good if m > 0.5 else bad)[list(tokens_of(b.attrs))] += 1
    share = total[0] / sum(total)
    return np.log((good + 3 * share) / (bad + 3 * (1 - share))) - np.log(share / (1 - share))


def _truth(blocks: list[Block]) -> list[float | None]:
    """The share of a block's words that are main text, which the generator marks by a control character before each word; None without text."""
    good = [sum(p.count("\x01") for p in b.pieces if isinstance(p, str)) for b in blocks]
    words = [sum(len(p.split()) for p in b.pieces if isinstance(p, str)) for b in blocks]
    for i in range(len(blocks) - 1, 0, -1):
        good[blocks[i].parent] += good[i]
        words[blocks[i].parent] += words[i]
    return [g / w if w else None for g, w in zip(good, words, strict=True)]


def extract_batch(pages: list[str], trained: Model) -> list[str]:
    parsed = [parse(p) for p in pages]
    z = trained.trees.logits(np.concatenate([features(b, trained.odds) for b in parsed])) if parsed else np.empty(0)
    out, at = [], 0
    for blocks in parsed:
        out.append(render(blocks, decode(blocks, z[at : at + len(blocks)])))
        at += len(blocks)
    return out


_ADDED = ("text", "n_chars")


def _extract(batches, trained: Model, html: str, drop_html: bool):
    for batch in batches:
        column = pc.fill_null(batch.column(html).cast(pa.large_string()), "")
        texts: list[str] = []
        for a in range(0, len(column), 64):
            texts += extract_batch(column[a : a + 64].to_pylist(), trained)
        kept = [(c, batch.column(c)) for c in batch.schema.names if c not in _ADDED and not (drop_html and c == html)]
        kept += [("text", pa.array(texts, pa.string())), ("n_chars", pa.array([len(t) for t in texts], pa.int64()))]
        yield pa.RecordBatch.from_arrays([v for _, v in kept], names=[c for c, _ in kept])


def extract(pages: DataFrame, html: str = "html", drop_html: bool = False, trained: Model | None = None) -> DataFrame:
    """The input's columns with text and n_chars (code points); no shuffle."""
    kept = [f for f in pages.schema if f.name not in _ADDED and not (drop_html and f.name == html)]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInArrow(functools.partial(_extract, trained=trained or model(), html=html, drop_html=drop_html), schema)
