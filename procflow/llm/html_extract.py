"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks, stretches of text between block-level tags, each with its open ancestors. A
two-label chain (main text or not) scores ancestor tags, class and id tokens, and text features of each block and
the step from one block to the next; training maximises the likelihood of labelled pages, and Viterbi decodes.
Labelled pages come from a bounded sample of the pages themselves: where a page marks its article, the blocks in
it are main text. Where no page of the table does, labels are told from where texts stand and how long they run.
Each such page is also laid out anew in other common ways (other containers, sidebars, notices,
forms, reader comments) with its labels known, so that the chain learns more layouts than one site's.
"""

from __future__ import annotations

import html as entities
import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm.common import smallest_hashes

#: Pages that the chain is trained on, at most; chosen by hash of page_id among all that mark their article.
FIT_PAGES = 120
#: Longer pages are trained on in runs of this many blocks.
RUN = 200
STEPS = 100
RIDGE = 0.01

#: Tags that end a block; tags without an end; tags whose content is no text (fixed values of HTML).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "select")
#: An opening tag ends these open ones without their closing tag (fixed values of HTML).
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The search for them stops here (fixed values of HTML).
SCOPE = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr",), "th": ("tr",), "dt": ("dl",), "dd": ("dl",)}

#: Deeper tags stand beside each other, as in browsers.
MAX_DEPTH = 512

#: A tag in the usual form, after its "<". No part runs past the next "<" or ">", so a failure costs no more than that.
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/><"'=]*)((?:\s+[^\s"'<>/=]++(?:\s*=\s*(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?)*+)\s*(/?)>""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_GAP, _WORD, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
#: The end tags of raw elements, up to their name.
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_NAMED = frozenset(("class", "id", "role"))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Inside an article these hold something else again.
_OUT = frozenset("nav aside footer form header menu dialog fieldset".split())


@dataclass
class Block:
    text: str
    tag: str  # the innermost block-level tag
    above: frozenset[str]  # block-level ancestor tags
    names: frozenset[str]  # class, id and role tokens of the ancestors
    linked: int  # code points inside links
    main: bool = False  # in an article, and in nothing of _OUT inside it


@dataclass
class _Open:
    """An open tag, with what holds for everything in it."""

    name: str
    block: str
    above: frozenset[str]
    names: frozenset[str]
    link: bool
    main: bool


_PAGE = _Open("", "", frozenset(), frozenset(), False, False)


class _Reader:
    """Tags of a page, from left to right; every part of the page is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def tag(self, at: int) -> tuple[str, bool, bool, list[str], int] | None:
        """Name, whether it is an end tag, whether it closes itself, the values of class, id and role, and where it
        ends, for the tag whose "<" is at ``at``; None if the page ends in it."""
        m = _TAG.match(self.page, at + 1)
        if m:
            values = [a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3]) if a[1].lower() in _NAMED] if m[3] else []
            return m[2].lower(), bool(m[1]), bool(m[4]), values, m.end()
        return self._odd_tag(at)

    def _odd_tag(self, at: int) -> tuple[str, bool, bool, list[str], int] | None:
        """As HTML reads any tag: a quote opens a value right after "=" only, and runs to its like. A quote without
        its like is a letter."""
        page = self.page
        m = _NAME.match(page, at + 1)
        name, i, values, slash = m[1].lower(), m.end(), [], False
        while True:
            gap = _GAP.match(page, i)
            slash = gap[0].endswith("/")
            i = gap.end()
            if i >= len(page):
                return None
            if page[i] == ">":
                return name, page[at + 1] == "/", slash, values, i + 1
            word = _WORD.match(page, i)
            i = word.end()
            equals = _EQUALS.match(page, i)
            if not equals:
                continue
            i = equals.end()
            quote = page[i : i + 1]
            if quote in self.last and quote and i < self.last[quote]:
                end = page.find(quote, i + 1)
                value, i = page[i + 1 : end], end + 1
            else:
                bare = _BARE.match(page, i)
                value, i = bare[0], bare.end()
            if word[0].lower() in _NAMED:
                values.append(value)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a whole page, in order, white space collapsed; empty ones are left out.

    Time goes by the length of the page, whatever is malformed in it. A tag that the page breaks off in is dropped.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = 0
    beyond: dict[str, int] = {}  # open tags deeper than MAX_DEPTH, whose end tags close nothing else
    endless: set[str] = set()  # raw elements of which no end tag follows
    reader = _Reader(page)

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else _PAGE
            out.append(Block(text, top.block, top.above, top.names, min(linked, len(text)), top.main))
        parts.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        t = entities.unescape(raw)
        parts.append(t)
        if stack and stack[-1].link:
            linked += len(t)

    def opened(tag: str, values: list[str]) -> None:
        top = stack[-1] if stack else _PAGE
        above, names = top.above, top.names
        if tag in BLOCKS and tag not in above:
            above = above | {tag}
        own = {x.lower() for v in values for x in _PART.findall(v)}
        if not own <= names:
            names = names | own
        main = tag == "article" or (top.main and tag not in _OUT)
        stack.append(_Open(tag, tag if tag in BLOCKS else top.block, above, names, top.link or tag == "a", main))

    at = 0
    while True:
        i = page.find("<", at)
        if i < 0:
            said(page[at:])
            break
        following = page[i + 1 : i + 3]
        if following[:1] in ("!", "?"):
            said(page[at:i])
            if page.startswith("!--", i + 1):
                end = page.find("-->", i + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith("![CDATA[", i + 1):
                end = page.find("]]>", i + 9)
                said(page[i + 9 : end if end >= 0 else len(page)])
                at = end + 3 if end >= 0 else len(page)
            else:
                end = page.find(">", i)
                at = end + 1 if end >= 0 else len(page)
            continue
        letter = following[1:2] if following[:1] == "/" else following[:1]
        if not (letter.isascii() and letter.isalpha()):  # no tag
            said(page[at : i + 1])
            at = i + 1
            continue
        said(page[at:i])
        found = reader.tag(i)
        if not found:
            break
        tag, is_end, is_closed, values, at = found
        if tag in _RAW_END and not is_end:
            if not is_closed and tag not in endless:
                m = _RAW_END[tag].search(page, at)
                end = page.find(">", m.end()) if m else -1
                if end >= 0:
                    at = end + 1
                elif tag in ("script", "style"):
                    at = len(page)
                else:  # without an end tag only the tag itself is dropped
                    endless.add(tag)
            continue
        if is_end:
            if tag in BLOCKS:
                close()
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == tag), -1)
            if depth >= 0 and (tag in BLOCKS or not any(t.name in BLOCKS for t in stack[depth:])):
                del stack[depth:]
                beyond.clear()
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            close()
            ends = IMPLIED.get(tag, frozenset())
            if tag not in ("td", "th", "tr", "li", "dt", "dd", "option"):
                ends = ends | {"p"}
            scope = SCOPE.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k].name
                if t in ends:
                    del stack[k:]
                    beyond.clear()
                    break
                if t in BLOCKS and (t in scope or tag not in IMPLIED or tag == "p"):
                    break
        if tag not in VOID and not is_closed:
            if len(stack) < MAX_DEPTH:
                opened(tag, values)
            else:
                beyond[tag] = beyond.get(tag, 0) + 1
    close()
    return out


def around(b: Block) -> list[str]:
    """Features of where a block stands; many blocks of a page share them."""
    return ["bias", f"tag={b.tag}"] + [f"in={t}" for t in sorted(b.above)] + [f"name={t}" for t in sorted(b.names)]


#: Words of notices, in any case.
_SAID = {
    "copyright": ("©", "(c)", "copyright", "all rights reserved"),
    "notice": ("cookie", "subscribe", "sign up", "log in", "advert", "sponsored", "newsletter"),
}


def own(b: Block, first: bool, last: bool) -> list[str]:
    """Features of a block's own text and place."""
    n = len(b.text)
    f = [f"length={min(8, int(math.log2(n + 1)))}", f"links={round(4 * b.linked / n)}", f"stops={min(3, sum(b.text.count(c) for c in '.!?。'))}"]
    if b.text.count(" ") < 3:
        f.append("short")
    low = b.text.lower()
    for name, words in _SAID.items():
        for word in words:
            if word in low:
                f.append(name)
                break
    return f + ["first"] * first + ["last"] * last


def features(b: Block, first: bool, last: bool) -> list[str]:
    return around(b) + own(b, first, last)


class Chain:
    """Two labels, one weight for each feature and label 1, and four for the steps between labels."""

    def __init__(self, weights: dict[str, float], step: np.ndarray):
        self.weights, self.step = weights, step

    def potentials(self, bs: list[Block]) -> np.ndarray:
        """What speaks for each label at each block; for label 0 nothing does."""
        w, places, out = self.weights, {}, []
        for i, b in enumerate(bs):
            place = (b.tag, b.above, b.names)
            if place not in places:
                places[place] = sum(w.get(f, 0.0) for f in around(b))
            out.append((0.0, places[place] + sum(w.get(f, 0.0) for f in own(b, i == 0, i == len(bs) - 1))))
        return np.array(out)

    def decode(self, bs: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi); of two equal ways the one through label 0."""
        if not bs:
            return []
        s = self.potentials(bs)[:, 1].tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        best0, best1, back = 0.0, s[0], []
        for x in s[1:]:
            to0, to1 = best1 + s10 > best0 + s00, best1 + s11 > best0 + s01
            back.append((int(to0), int(to1)))
            best0, best1 = (best1 + s10 if to0 else best0 + s00), (best1 + s11 if to1 else best0 + s01) + x
        y = [int(best1 > best0)]
        for b in reversed(back):
            y.append(b[y[-1]])
        return y[::-1]


class Likelihood:
    """The log-likelihood of labelled runs of blocks under a chain, less a ridge, and its gradient."""

    def __init__(self, pages: list[tuple[list[Block], list[int]]], ridge: float = RIDGE):
        self.names: dict[str, int] = {}
        self.ridge = ridge
        ids, rows, labels = [], [], []
        for bs, y in pages:
            for i in range(0, len(bs), RUN):
                for k in range(i, min(i + RUN, len(bs))):
                    f = [self.names.setdefault(x, len(self.names)) for x in features(bs[k], k == 0, k == len(bs) - 1)]
                    ids += f
                    rows += [(len(labels), k - i)] * len(f)
                labels.append(y[i : i + RUN])
        # all runs at once, padded to the longest
        self.width = max(map(len, labels))
        self.ids, self.row = np.array(ids, dtype=int), np.array(rows, dtype=int) @ np.array([self.width, 1])
        self.n = np.array([len(x) for x in labels], dtype=int)
        self.y = np.zeros((len(labels), self.width))
        for k, x in enumerate(labels):
            self.y[k, : len(x)] = x
        self.real = np.arange(self.width)[None, :] < self.n[:, None]
        pair = self.real[:, 1:]
        self.seen = np.array([[(pair & (self.y[:, :-1] == i) & (self.y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)

    def __call__(self, w: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The value, and its gradients by weights and steps (forward and backward sums)."""
        s = np.zeros((len(self.n), self.width, 2))
        s[:, :, 1] = np.bincount(self.row, w[self.ids], s[:, :, 1].size).reshape(len(self.n), self.width)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for i in range(1, self.width):
            a[:, i] = np.logaddexp(a[:, i - 1, :1] + step[0], a[:, i - 1, 1:] + step[1]) + s[:, i]
        for i in range(self.width - 2, -1, -1):
            x = s[:, i + 1] + b[:, i + 1]
            b[:, i] = np.where(self.real[:, i + 1, None], np.logaddexp(x[:, :1] + step[:, 0], x[:, 1:] + step[:, 1]), 0.0)
        end = a[np.arange(len(self.n)), self.n - 1]
        z = np.logaddexp(end[:, 0], end[:, 1])
        p = np.where(self.real, np.exp(np.minimum(a[:, :, 1] + b[:, :, 1] - z[:, None], 0.0)), 0.0)
        q = np.exp(np.minimum(a[:, :-1, :, None] + step + (s + b)[:, 1:, None, :] - z[:, None, None, None], 0.0)) * self.real[:, 1:, None, None]
        value = (s[:, :, 1] * self.y).sum() + (self.seen * step).sum() - z.sum() - self.ridge / 2 * ((w * w).sum() + (step * step).sum())
        gw = np.bincount(self.ids, (self.y - p).ravel()[self.row], len(w)) - self.ridge * w
        return float(value), gw, self.seen - q.sum(axis=(0, 1)) - self.ridge * step


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, ridge: float = RIDGE) -> Chain:
    """Maximise the ridge-penalised log-likelihood by gradient steps of adapted size."""
    f = Likelihood(pages, ridge)
    w, step = np.zeros(len(f.names)), np.zeros((2, 2))
    m, v = np.zeros(len(f.names) + 4), np.zeros(len(f.names) + 4)
    for it in range(1, steps + 1):
        _, gw, gs = f(w, step)
        g = np.concatenate([gw, gs.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.15 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
        w, step = w + d[:-4], step + d[-4:].reshape(2, 2)
    return Chain({k: float(w[i]) for k, i in f.names.items()}, step)


#: Names of containers in common layouts (fixed values): of main text, and of what surrounds it.
MAIN = ('article', 'main', 'div class="post-content"', 'div id="content"', 'div class="article-body"', 'section class="entry-content"', 'div class="story main-text"', 'div role="main"')
AROUND = (
    'nav', 'header', 'footer', 'aside', 'form', 'menu', 'div class="ad"', 'div class="advert banner"', 'div class="ads sponsored"', 'div class="promo"', 'div id="sidebar"', 'div class="sidebar widget"', 'div class="related links"', 'div class="menu navigation"',
    'div class="nav-bar"', 'div class="breadcrumb"', 'div class="cookie-notice"', 'div class="notice"', 'div class="consent popup"', 'div class="newsletter subscribe"', 'div class="share social"', 'div id="footer"', 'div id="header"', 'div class="login form"',
    'section class="comments"', 'div id="comments"', 'div class="comment"', 'section class="reader-comments"', 'div class="comment-list responses"', 'ol class="commentlist"', 'div class="pagination pager"', 'div class="tags meta"', 'dialog', 'fieldset',
)


def _marked(bs: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article: inside it, and not in what surrounds."""
    return [int(b.main) for b in bs] if any("article" in b.above for b in bs) else None


#: Class and id words of what surrounds the main text.
_SURROUND = frozenset(x.lower() for box in AROUND for v in re.findall(r'"(.*?)"', box) for x in _PART.findall(v))
#: A block without a full stop counts against a run of sentences like so many code points of them.
STRAY = 40


def weak_labels(bs: list[Block]) -> list[int]:
    """Labels of a page that marks no article: the run of blocks with most text in unlinked sentences, headings
    before it and in it included, without what stands in links or in containers that surround main text. Where some
    of the page is in ``<main>`` or in a container so named, only that counts."""
    outside = [bool(b.above & (_OUT | {"head"})) or 2 * b.linked > len(b.text) for b in bs]
    named = [o or bool(b.names & _SURROUND) for o, b in zip(outside, bs)]
    outside = outside if all(named) else named  # a name that holds for the whole page tells nothing
    home = ["main" in b.above or "main" in b.names for b in bs]
    if any(h and not o for h, o in zip(home, outside)):
        outside = [o or not h for h, o in zip(home, outside)]
    best, run, start, span = 0, 0, 0, (0, 0)
    for i, (b, o) in enumerate(zip(bs, outside)):
        if o:
            gain = -len(b.text) - STRAY
        elif b.tag in _HEADINGS:
            gain = 1
        else:
            gain = len(b.text) if any(c in b.text for c in ".!?。") else -STRAY
        if run <= 0:
            run, start = 0, i
        run += gain
        if run > best:
            best, span = run, (start, i + 1)
    return [int(span[0] <= i < span[1] and not o) for i, o in enumerate(outside)]


def layouts(bs: list[Block], y: list[int], seed: int) -> Iterator[tuple[list[Block], list[int]]]:
    """The page's texts in other layouts, with their labels."""
    rng = np.random.default_rng(seed)
    good, bad = [b.text for b, k in zip(bs, y) if k], [b.text for b, k in zip(bs, y) if not k] or ["Home"]
    if not good:
        return
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    wrap = lambda box, inner: f"<{box}>{inner}</{box.split()[0]}>"

    def side(box: str, long: bool) -> str:
        texts = [str(rng.choice(good)) if long else str(rng.choice(bad)) for _ in range(int(rng.integers(1, 4)))]
        return wrap(box, "".join(f"<p>\x01{esc(t)}</p>" for t in texts) if long or rng.random() < 0.5 else "<ul>" + "".join(f'<li><a href="#">\x01{esc(t)}</a></li>' for t in texts) + "</ul>")

    for box in rng.permutation(len(MAIN))[:3]:
        pick = rng.permutation(len(AROUND))[:8]
        parts = [side(AROUND[k], "comment" in AROUND[k] or "response" in AROUND[k] or rng.random() < 0.3) for k in pick]
        body = [f"<{t}>{esc(x)}</{t}>" for i, x in enumerate(good[:12]) for t in (["h1"] if i == 0 else [str(rng.choice(["p", "p", "p", "h2", "li", "blockquote", "td", "pre"]))])]
        for k in rng.integers(len(AROUND), size=3):  # something foreign inside the main text
            body.insert(int(rng.integers(0, len(body) + 1)), side(AROUND[int(k)], "comment" in AROUND[int(k)] or bool(rng.random() < 0.3)))
        page = "<html><body>" + wrap("div class=\"page wrapper\"", "".join(parts[:4]) + wrap(MAIN[box], "".join(body)) + "".join(parts[4:])) + "</body></html>"
        found = blocks(page)
        labels = [0 if "\x01" in b.text else 1 for b in found]
        for b in found:
            b.text = b.text.replace("\x01", "") or "-"
        yield found, labels


def _labelled(page: str | None) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page that the chain can be trained on."""
    bs = blocks(page)
    y = _marked(bs)
    return (bs, y) if y and any(y) else None


def _labelled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([_labelled(t.as_py()) is not None for t in b.column(1)], pa.bool_()))


def labelled_pages(pages: DataFrame, limit: int = FIT_PAGES) -> list[tuple[int, str]]:
    """``(page_id, html)`` of the ``limit`` page_ids of the smallest hashes, among all pages that mark their article
    and can be trained on. Only those pages' html leaves the executors.

    Whether a page can be trained on shows when it is parsed. So the pages that name the tag are parsed from the
    smallest hashes upwards, in shares that grow until enough are found or all were looked at.
    """
    marked = pages.where(F.col("page_id").isNotNull() & F.contains(F.lower("html"), F.lit("<article"))).select("page_id", "html")
    h = F.pmod(F.xxhash64("page_id"), F.lit(1 << 40))
    share = min(1.0, 2 * limit / max(marked.count(), 1))
    while True:
        some = marked.where(h < int((1 << 40) * share)) if share < 1 else marked
        ids = some.mapInArrow(_labelled_rows, some.schema).select("page_id").distinct().orderBy(h, "page_id").limit(limit).collect()
        if len(ids) >= limit or share >= 1:
            break
        share = min(1.0, 8 * share)
    if not ids:
        return []
    rows = marked.where(F.col("page_id").isin([r["page_id"] for r in ids])).mapInArrow(_labelled_rows, marked.schema)
    return sorted(map(tuple, rows.groupBy("page_id").agg(F.min("html")).collect()))


def unmarked_pages(pages: DataFrame, limit: int = FIT_PAGES) -> list[tuple[int, str]]:
    """``(page_id, html)`` of the ``limit`` page_ids of the smallest hashes, whatever the pages mark."""
    some = pages.where(F.col("page_id").isNotNull() & (F.length("html") > 0)).select("page_id", "html")
    ids = smallest_hashes(some.select("page_id").distinct(), "page_id", limit).collect()
    rows = some.where(F.col("page_id").isin([r["page_id"] for r in ids])) if ids else some.limit(0)
    return sorted(map(tuple, rows.groupBy("page_id").agg(F.min("html")).collect()))


def fit(pages: DataFrame, limit: int = FIT_PAGES) -> Chain:
    """Train on at most ``limit`` pages that mark their article; where none does, on as many with weak labels; where
    those have no sentences either, on placeholder text."""
    data = []
    for page_id, page in labelled_pages(pages, limit):
        bs, y = _labelled(page)
        data += [(bs, y), *layouts(bs, y, page_id % (1 << 32))]
    if not data:  # no page of the table is marked
        warnings.warn("no page marks an article: the chain is trained on weak labels and common layouts", stacklevel=2)
        for page_id, page in unmarked_pages(pages, limit):
            bs = blocks(page)
            y = weak_labels(bs)
            if any(y):
                data += [(bs, y), *layouts(bs, y, page_id % (1 << 32))]
    if not data:  # nor has any a sentence
        for k in range(8):
            bs = [Block(t, "p", frozenset(("p",)), frozenset(), 0) for t in ("A heading", "Some words make a sentence, and it ends here.", "Another one follows.")]
            data += list(layouts(bs, [1, 1, 1], k))
    return train(data)


def main_text(chain: Chain, page: str | None) -> str:
    bs = blocks(page)
    return "\n\n".join(b.text for b, y in zip(bs, chain.decode(bs)) if y)


def extract(pages: DataFrame, limit: int = FIT_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html, ...)``.

    Null and empty pages give an empty text. Every row is judged by itself from its whole page; repeated rows
    give repeated results, and nothing is shuffled.
    """
    handle = pages.sparkSession.sparkContext.broadcast(fit(pages, limit))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(handle.value, t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
