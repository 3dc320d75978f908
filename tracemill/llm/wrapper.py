"""Main text of HTML pages by wrapper induction over all pages of a host.

1. Every page becomes a block tree: containers, and text blocks as leaves. Its skeleton (depth, hash and size
   of each node, some bytes a node) is stored, once for equal pages of a host.
2. REFERENCES distinct pages of each host, drawn by hash, are the candidates of its wrapper. Every distinct
   page of the host is aligned with them by simple tree matching (the largest order-preserving mapping between
   trees with equal roots), and votes for the blocks to which a block with the same text is mapped. Votes are
   summed by task, then by host. Blocks with the votes of half the pages that have their container are constant:
   the template; within article and main, where a line may be the writer's own, it takes the votes of SURE of them.
   Pages that share SAME of their text with a reference are either near copies of its article or short pages full of
   the host's template, so their votes on it are counted apart: they decide only about containers that too few other
   pages have, then agree with those, and say nothing about article and main if there is no other page.
3. Every page is aligned with its host's wrapper. Blocks mapped to a constant block of the same text are
   template, wherever they stand; the other, varying slots are content. A later check takes out slots in
   navigation, notices, adverts, forms, page headers and footers, sidebars and comments, by element and class.

The evidence is that of the whole host: it depends neither on how pages are dealt to tasks nor on their order.
Html is moved at most once, by the join of step 3, and not at all while the wrappers are small enough for
Spark to broadcast them; Spark splits hot hosts of that join. A host's wrapper is at most REFERENCES pages.

Defined results: null or empty html gives an empty text; a host with fewer than LEAST distinct pages has no
wrapper: its pages' slots are those of article and main where these hold most of the text; a constant block
that none of the references has stays (a block on a share p of the pages is missed with (1 - p) ** REFERENCES);
exact copies count as one page as evidence; where all pages of a host share SAME of their text and none has an article or
main element, what they share is template; null urls share one host; an empty table gives no rows; repeated
rows are answered each; other columns are ignored; an element without end tag ends with its parent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Generator, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bound_batches, derive, dropped, pieces, stored

#: Pages of a host that its wrapper is made of; distinct pages that a host must have.
REFERENCES, LEAST = 6, 4
#: Share of equal text from which the votes of two pages on each other are counted apart.
SAME = 0.8
#: Percentage of the votes that makes a block constant, elsewhere and within article and main.
MOST, SURE = 50, 90

# HTML element names by role.
RAW = {"script", "style", "template", "title", "textarea", "iframe", "noembed", "xmp"}
HIDDEN = {"select", "datalist", "button", "option"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEAF_LIKE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr"}
#: Elements that hold the page or the article: their names do not speak against them.
WHOLE = {"html", "body", "main", "article"}
OUTSIDE = {"nav", "aside", "footer", "form", "dialog", "menu", "fieldset"}
OUTSIDE_NAMES = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "banner", "cookie", "cookies", "consent", "notice", "comment", "comments", "discussion", "share", "sharing", "social", "related", "recommended", "promo", "popup", "modal", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "pagination", "pager", "login", "signup", "widget", "disqus", "toolbar", "alert", "gdpr", "skip", "contentinfo", "complementary", "search", "replies", "reviews"}
#: Names of page headers: they do not count inside an article, whose own header is content.
HEADER_NAMES = {"header", "masthead", "topbar"}
#: Names that an article may give to its own parts: they do not count inside one.
SUBJECT_NAMES = {"alert", "comment", "discussion", "menu", "notice", "replies", "reviews", "search", "skip", "social"}
#: Names of readers' comments, and what such and other names are lengthened with: comment-list, related-posts, share-bar.
READER_NAMES = {"comment", "comments", "discussion", "replies"}
FILLERS = {"area", "bar", "block", "box", "buttons", "container", "form", "items", "links", "list", "note", "panel", "post", "posts", "section", "thread", "wrapper"}
#: Text elements, whose ids are made from their texts.
TEXTS = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
#: A name with one of these parts speaks about the page, not about the element.
ABOUT_NAMES = {"has", "with", "no", "is", "without", "free", "layout", "page", "enabled", "open"}

MAIN = 1 << 31
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r">|=[ \t\r\n\f]*([\"'])")
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def named_outside(tag: str, found: list[tuple[str, str]], main: bool) -> bool:
    """Whether classes, id or role, as (attribute, names), mark an element that is no content.

    Inside article and main only names count all of whose parts are such names, or such names and FILLERS;
    elsewhere each part of any name. Ids of headings and paragraphs never do, nor, in an article, ids of one name that
    may be its subject.
    """
    for attribute, names in found:
        if attribute == "id" and tag in TEXTS:
            continue
        for name in names.split():
            parts = set(_PARTS.split(name)) - {""}
            if main:
                own = parts - FILLERS
                if own and own <= OUTSIDE_NAMES and (not own <= SUBJECT_NAMES or (own != parts and own <= READER_NAMES)):
                    if attribute != "id" or own & (READER_NAMES - SUBJECT_NAMES) or own != parts:
                        return True
            elif not parts.isdisjoint(OUTSIDE_NAMES | HEADER_NAMES) and parts.isdisjoint(ABOUT_NAMES):
                return True
    return False


# -- pages as trees ----------------------------------------------------------------------------------


class Page:
    """A block tree in page order: depth and label of each node; text blocks have the label None."""

    def __init__(self) -> None:
        self.depths: list[int] = []
        self.labels: list[str | None] = []
        self.texts: list[str] = []
        self.outside: list[bool] = []
        self.main: list[bool] = []

    def skeleton(self) -> bytes:
        """count u32, then depths u32, hashes u64 and sizes u32 (0: a container), the highest bit set in article and main."""
        from xxhash import xxh64_intdigest

        text = zip(self.texts, self.main, strict=True)
        made = [(xxh64_intdigest(label), 0) if label is not None else (xxh64_intdigest((t := next(text))[0]), min(len(t[0]), MAIN - 1) | MAIN * t[1]) for label in self.labels]
        codes, sizes = np.array([m[0] for m in made], "<u8"), np.array([m[1] for m in made], "<u4")
        return np.array([len(made)], "<u4").tobytes() + np.array(self.depths, "<u4").tobytes() + codes.tobytes() + sizes.tobytes()


class _Tags:
    """The tags of a page in one pass: every search that has failed once is not made again."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        i = self.html.find(what, at)
        if i < 0:
            self.missing.add(what)
        return i

    def end(self, at: int) -> int:
        """Where the tag that began before ``at`` ends (after its ``>``), -1 for nowhere."""
        if self.find(">", at) < 0:
            return -1
        while m := _STOP.search(self.html, at):
            if m.group(1) is None:
                return m.end()
            close = self.find(m.group(1), m.end())
            if close < 0:  # a quote without its partner ends nothing
                return self.find(">", m.end()) + 1 or -1
            at = close + 1
        return -1

    def raw_end(self, tag: str, at: int, parents: list[str]) -> int:
        """Where the text of a raw element ends (after its end tag, or before that of a parent)."""
        for own, after in ((tag, True), *((p, False) for p in reversed(parents))):
            key = f"</{own}"
            if key in self.missing:
                continue
            m = re.compile(rf"</{own}(?=[\s/>])[^>]*>?", re.I).search(self.html, at)
            if m:
                return m.end() if after else m.start()
            self.missing.add(key)
        return len(self.html)


def parse(html: str) -> Page:
    page, tags = Page(), _Tags(html)
    stack: list[tuple[str, bool, bool]] = [("#root", False, False)]  # tag, outside, main
    pending: list[str] = []
    hidden: list = []  # tag of a hidden inline element, how often it is open, depth of its block

    def flush() -> None:
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            pending.clear()
            if text:
                page.depths.append(len(stack))
                page.labels.append(None)
                page.texts.append(text)
                page.outside.append(stack[-1][1])
                page.main.append(stack[-1][2])

    def shown(a: int, b: int) -> None:
        if not hidden and b > a:
            pending.append(html[a:b])

    at, end = 0, len(html)
    while at < end:
        lt = tags.find("<", at)
        if lt < 0:
            shown(at, end)
            break
        shown(at, lt)
        if html.startswith("<!--", lt):
            close = lt + 4 if html.startswith("<!-->", lt) else tags.find("-->", lt + 4)
            at = html.find(">", close) + 1 if close >= 0 else end
            continue
        m = _TAG.match(html, lt)
        if m is None:
            close = tags.find(">", lt) if html.startswith(("<!", "<?", "</"), lt) else -1
            if close < 0:
                shown(lt, lt + 1)
            at = close + 1 if close >= 0 else lt + 1
            continue
        at = tags.end(m.end())
        if at < 0:
            shown(lt, end)
            break
        closing, tag, rest = m.group(1), m.group(2).lower(), html[m.end() : at - 1]
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                at = tags.raw_end(tag, at, [t for t, _, _ in stack[1:]])
            shown(lt, lt)
            if tag not in ("title", "script", "style") and not hidden:
                pending.append(" ")
            continue
        if hidden and tag == hidden[0] and not rest.endswith("/"):
            hidden[1] += -1 if closing else 1
            if not hidden[1]:
                hidden.clear()
                pending.append(" ")
            continue
        if tag == "br":
            if not hidden:
                pending.append(" ")
            continue
        if tag not in BLOCK:
            if tag == "head" and closing:
                pending.clear()
            elif not closing and not hidden and tag not in VOID and not rest.endswith("/"):
                main = stack[-1][2]
                if tag in HIDDEN or (rest and named_outside(tag, _names(rest), main)):
                    hidden[:] = [tag, 1, len(stack)]
                    pending.append(" ")
            continue
        if closing:
            level = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if hidden and 0 < level < hidden[2]:
                hidden.clear()
            if not hidden:
                flush()
                if level:
                    del stack[level:]
            continue
        if hidden:
            continue
        flush()
        if tag == "hr":
            continue
        while stack[-1][0] == "p" or (stack[-1][0] == tag and tag in LEAF_LIKE):  # ends that may be left out
            stack.pop()
        found = _names(rest) if rest else []
        _, outside, main = stack[-1]
        main = main or tag in ("article", "main")
        outside = outside or tag in OUTSIDE or (tag == "header" and not main) or (tag not in WHOLE and bool(found) and named_outside(tag, found, main))
        page.depths.append(len(stack))
        page.labels.append(f"{tag} {' '.join(names for _, names in found)}")
        stack.append((tag, outside, main))
    flush()
    return page


def _names(rest: str) -> list[tuple[str, str]]:
    return [(k.lower(), (a or b or c).lower()) for k, a, b, c in _NAMES.findall(rest)]


class Tree:
    """A skeleton with children and the range of text blocks of each node; node 0 is the root."""

    def __init__(self, skeleton: bytes):
        n = int(np.frombuffer(skeleton, "<u4", 1)[0])
        depths = np.frombuffer(skeleton, "<u4", n, 4).tolist()
        self.codes = [0, *np.frombuffer(skeleton, "<u8", n, 4 + 4 * n).tolist()]
        self.sizes = [0, *np.frombuffer(skeleton, "<u4", n, 4 + 12 * n).tolist()]
        self.children: list[list[int]] = [[] for _ in range(n + 1)]
        self.leaves = [i for i, s in enumerate(self.sizes) if s]
        self.first, self.last = [0] * (n + 1), [0] * (n + 1)  # text blocks of the node: [first, last)
        place = [0] * (n + 1)  # hash of the labels from the root down to the node's container
        path, leaf = [0], 0
        for i, d in enumerate(depths, 1):
            while len(path) > d:
                self.last[path.pop()] = leaf
            self.children[path[-1]].append(i)
            place[i] = hash((place[path[-1]], self.codes[path[-1]]))
            self.first[i] = leaf
            leaf += self.sizes[i] > 0
            path.append(i)
        for i in path:
            self.last[i] = leaf
        self.texts = [self.codes[i] for i in self.leaves]
        self.chars = [self.sizes[i] % MAIN for i in self.leaves]
        self.main = np.array([self.sizes[i] >= MAIN for i in self.leaves], bool)
        self.places = [place[i] for i in self.leaves]


# -- simple tree matching ----------------------------------------------------------------------------

TEXT = -1  # label of every text block
#: What two text blocks of one text count beyond their node: constant blocks hold an alignment, wherever they stand in a list.
EQUAL = 100


class Matching:
    """Simple tree matching of two trees, of which texts outside ``common`` equal nothing.

    A mapping counts its nodes, and EQUAL for two text blocks of one text. Subtrees are told apart by
    signature: labels, and texts in ``common``; each pair of signatures is solved once, so lists of many alike
    items cost one solution. A subtree with one text block has a shape as well, its signature without the
    text; two such subtrees are compared by shape and text, whole rows at a time. No recursion: deep trees
    wait on a stack of their own. Tables are kept as every k-th row, and the rows between are made again.
    """

    def __init__(self, a: Tree, b: Tree, common: set[int]):
        self.trees, self.common = (a, b), common
        self.known: dict[tuple, int] = {}
        self.label: list[int] = []
        self.kids: list[tuple[int, ...]] = []
        self.shape: list[int] = []  # of subtrees with one text block, else the signature itself
        self.text: list[int] = []  # that block's text, 0 if it is not common
        self.single: list[bool] = []
        self.full: list[int] = []  # size of the mapping onto itself
        self.best: dict[tuple[int, int], int] = {}
        self.signs = tuple(self._signatures(t) for t in self.trees)

    def _intern(self, label: int, kids: tuple[int, ...], text: int) -> int:
        key = label, kids, text
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.label)
            self.label.append(label)
            self.kids.append(kids)
            single = label == TEXT or (len(kids) == 1 and self.single[kids[0]])
            self.single.append(single)
            self.text.append(text if label == TEXT else self.text[kids[0]] if single else 0)
            self.full.append(1 + EQUAL * (label == TEXT and text != 0) + sum(self.full[k] for k in kids))
            self.shape.append(found)
            if self.text[found]:
                self.shape[found] = self._intern(TEXT, (), 0) if label == TEXT else self._intern(label, (self.shape[kids[0]],), 0)
        return found

    def _signatures(self, t: Tree) -> list[int]:
        out = [0] * len(t.codes)
        for i in range(len(out) - 1, -1, -1):
            if t.sizes[i]:
                out[i] = self._intern(TEXT, (), t.codes[i] if t.codes[i] in self.common else 0)
            else:
                out[i] = self._intern(t.codes[i], tuple(out[k] for k in t.children[i]), 0)
        return out

    def _pair(self, a: int, b: int) -> int | None:
        """The size of the mapping, None where it is yet to be solved."""
        if a == b:
            return self.full[a]
        if self.label[a] != self.label[b]:
            return 0
        if self.label[a] == TEXT:
            return 1
        if self.single[a] and self.single[b]:
            x, y = self.shape[a], self.shape[b]
            if x == y:
                return self.full[x] + EQUAL * (self.text[a] == self.text[b] != 0)
            a, b = x, y
        return self.best.get((a, b))

    def _middle(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int]:
        """How many equal subtrees stand at both heads and tails: mapping these onto each other is best."""
        head, short = 0, min(len(x), len(y))
        while head < short and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < short - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, tail

    def _solve(self, a: int, b: int) -> Generator[tuple[int, int], None, None]:
        """Store the mapping's size; yields the pairs that must be solved before."""
        if self.single[a] and self.single[b]:
            a, b = self.shape[a], self.shape[b]
        x, y = self.kids[a], self.kids[b]
        head, tail = self._middle(x, y)
        total = 1 + sum(self.full[k] for k in (*x[:head], *x[len(x) - tail :]))
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if x and y:
            yield from self._needed(x, y)
            total += int(self._table(x, y)[-1][-1])
        self.best[a, b] = total

    def _needed(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        ways = lambda signs: ({self.shape[s] if self.single[s] else s for s in signs}, set(signs))
        (sx, fx), (sy, fy) = ways(x), ways(y)
        by: dict[int, list[int]] = {}
        for k in fy:
            by.setdefault(self.label[k], []).append(k)
        for p in fx:
            for q in by.get(self.label[p], ()):
                if not (self.single[p] and self.single[q]) and self._pair(p, q) is None:
                    yield p, q
        for p in sx:
            for q in sy:
                if self.single[p] and self.single[q] and self._pair(p, q) is None:
                    yield p, q

    def size(self, a: int, b: int) -> int:
        """Of the mapping of two signatures."""
        if (known := self._pair(a, b)) is not None:
            return known
        waiting = [self._solve(a, b)]
        while waiting:
            todo = next(waiting[-1], None)
            if todo is None:
                waiting.pop()
            elif self._pair(*todo) is None:
                waiting.append(self._solve(*todo))
        return self._pair(a, b) or 0

    def _rows(self, x: tuple[int, ...], y: tuple[int, ...]):
        """i -> sizes of the mappings of x[i] with every one of y."""
        single = np.array([self.single[k] for k in y])
        text = np.array([self.text[k] for k in y], np.uint64)
        shape = np.array([self.shape[k] for k in y], np.int64)
        shapes, at = np.unique(shape[single], return_inverse=True)
        others = {k: np.flatnonzero(np.array(y) == k) for k in {k for k in y if not self.single[k]}}
        cached: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            p = x[i]
            base = cached.get(self.shape[p]) if self.single[p] else cached.get(p)
            if base is None:
                base = np.zeros(len(y), np.int64)
                if self.single[p]:
                    base[single] = np.array([self._pair(self.shape[p], int(s)) for s in shapes], np.int64)[at] if len(shapes) else 0
                    cached[self.shape[p]] = base
                else:
                    for k in set(y):
                        base[np.array(y) == k] = self._pair(p, k)
                    cached[p] = base
            if not self.single[p]:
                return base
            out = base + EQUAL * ((shape == self.shape[p]) & (text == self.text[p])) if self.text[p] else base
            if others:
                out = out.copy()
                for k, places in others.items():
                    out[places] = self._pair(p, k)
            return out

        return row

    def _table(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[np.ndarray]:
        """Every k-th row of the table of best mappings of the heads of x and y, and the last row."""
        row, step = self._rows(x, y), max(1, math.isqrt(len(x)))
        above, kept = np.zeros(len(y) + 1, np.int64), []
        for i in range(len(x)):
            if i % step == 0:
                kept.append(above)
            above = _next_row(above, row(i))
        return [*kept, above]

    def _mapped(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        """Places of x and y in a best mapping, from the end."""
        kept, row, step = self._table(x, y), self._rows(x, y), max(1, math.isqrt(len(x)))
        i, j = len(x), len(y)
        while i and j:
            start = (i - 1) // step * step
            rows = [kept[start // step]]
            for k in range(start, i):
                rows.append(_next_row(rows[-1], row(k)))
            while i > start and j:
                here = rows[i - start]
                if here[j] == rows[i - start - 1][j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    yield i - 1, j - 1
                    i, j = i - 1, j - 1

    def equal_blocks(self) -> list[tuple[int, int]]:
        """Numbers of the text blocks of one text that the mapping joins."""
        a, b = self.trees
        has = tuple(np.concatenate(([0], np.cumsum([c in self.common for c in t.texts]))).tolist() for t in (a, b))
        inside = lambda side, i: has[side][self.trees[side].last[i]] > has[side][self.trees[side].first[i]]
        out, stack = [], [(0, 0)]
        while stack:
            p, q = stack.pop()
            if not inside(0, p) or not inside(1, q):
                continue
            s, t = self.signs[0][p], self.signs[1][q]
            if s == t:
                both = zip(range(a.first[p], a.last[p] if not a.sizes[p] else a.first[p] + 1), range(b.first[q], b.last[q] if not b.sizes[q] else b.first[q] + 1), strict=True)
                out.extend((m, n) for m, n in both if a.texts[m] in self.common)
                continue
            if self.label[s] != self.label[t] or self.label[s] == TEXT:
                continue
            self.size(s, t)
            left, right = a.children[p], b.children[q]
            x, y = self.kids[s], self.kids[t]
            head, tail = self._middle(x, y)
            stack.extend(zip(left[:head], right[:head], strict=True))
            stack.extend(zip(left[len(x) - tail :], right[len(y) - tail :], strict=True))
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            if x and y:
                for todo in self._needed(x, y):  # a chain's own pairs may not have been asked for
                    self.size(*todo)
                stack.extend((left[head + i], right[head + j]) for i, j in self._mapped(x, y))
        return out


def _next_row(above: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + sizes), out=out[1:])
    return out


def constant_votes(reference: Tree, page: Tree) -> tuple[list[int], bool]:
    """The reference's text blocks that the page has as well, and whether the two share SAME of their text."""
    common = set(reference.texts) & set(page.texts)
    if not common:
        return [], False
    shared = lambda t: sum(n for c, n in zip(t.texts, t.chars, strict=True) if c in common)
    near = all(shared(t) >= SAME * sum(t.chars) for t in (reference, page))
    return [m for m, _ in Matching(reference, page, common).equal_blocks()], near


def is_constant(main: Column, could: Column, n: Column, could_near: Column, n_near: Column) -> Column:
    """Whether votes make a block template: could pages have its container and n the block, of which the near ones count apart."""
    share = F.when(main, SURE).otherwise(MOST)
    enough = lambda n, could: n * 100 >= could * share
    far = (n >= LEAST - 1) & enough(n, could)
    few = (n == could) & (n + n_near >= LEAST - 1) & enough(n_near, could_near)
    none = ~main & (n_near >= LEAST - 1) & enough(n_near, could_near)
    return F.when(could >= LEAST - 1, far).when(could > 0, few).otherwise(none)


def template_blocks(wrapper: list[tuple[Tree, set[int]]], page: Tree) -> set[int]:
    """The page's text blocks that are mapped to a constant block of its text."""
    out: set[int] = set()
    for tree, constant in wrapper:
        common = {tree.texts[i] for i in constant} & set(page.texts)
        if common:
            out.update(n for m, n in Matching(tree, page, common).equal_blocks() if m in constant)
    return out


def main_text(page: Page, template: set[int] | None) -> str:
    """The content slots, one line each.

    Without a wrapper (None) the blocks of article and main are the content where they hold most of the text.
    """
    slots = [i for i, o in enumerate(page.outside) if not o and i not in (template or ())]
    if template is None:
        inside = [i for i in slots if page.main[i]]
        if 2 * sum(len(page.texts[i]) for i in inside) > sum(len(page.texts[i]) for i in slots):
            slots = inside
    return "\n".join(page.texts[i] for i in slots)


# -- on Spark ----------------------------------------------------------------------------------------


def _skeletons(rows: DataFrame) -> DataFrame:
    """(host, key, skeleton) of the pages, once for equal pages of a host."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            from xxhash import xxh64_intdigest

            made = [parse(h or "").skeleton() for h in batch.column("html").to_pylist()]
            return {"key": np.array([xxh64_intdigest(s) for s in made], np.uint64).view(np.int64), "skeleton": made}

        return work

    found = derive(rows.select("host", "html"), make, "key long, skeleton binary", ["host"])
    return stored(found.dropDuplicates(["host", "key"]), "skeletons")


def _votes(pages: DataFrame, references: DataFrame) -> DataFrame:
    """(host, key, block, main, could, n, could_near, n_near): pages of the host that have the container of a block of the
    reference ``key``, and those among them that have the block; pages that share SAME with the reference apart."""
    joined = pages.join(references, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, trees = None, []

        def told() -> Iterator[pa.RecordBatch]:
            for key, tree, could, n in trees:
                k = [np.array([c.get(p, 0) for p in tree.places], np.int64) for c in could]
                at = np.flatnonzero(k[0] + k[1])
                if len(at):
                    made = [pa.array([host] * len(at), pa.string()), pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(tree.main[at]), *[pa.array(x[at]) for x in (k[0], n[0], k[1], n[1])]]
                    yield pa.RecordBatch.from_arrays(made, names=["host", "key", "block", "main", "could", "n", "could_near", "n_near"])

        for b in pieces(batches):
            for own, key, skeleton, references in zip(*(b.column(c) for c in ("host", "key", "skeleton", "references")), strict=True):
                if (name := own.as_py()) != host:
                    yield from told()
                    made = ((r["key"], Tree(r["skeleton"])) for r in references.as_py())
                    host, trees = name, [(k, t, ({}, {}), np.zeros((2, len(t.texts)), np.int64)) for k, t in made]
                page = Tree(skeleton.as_py())
                places = set(page.places)
                for ref, tree, could, n in trees:
                    if ref != key.as_py():
                        votes, near = constant_votes(tree, page)
                        for p in places:
                            could[near][p] = could[near].get(p, 0) + 1
                        n[int(near), votes] += 1
        yield from told()

    votes = bound_batches(joined).mapInArrow(run, "host string, key long, block int, main boolean, could long, n long, could_near long, n_near long")
    return votes.groupBy("host", "key", "block", "main").agg(*[F.sum(c).alias(c) for c in ("could", "n", "could_near", "n_near")])


def induce(rows: DataFrame) -> DataFrame:
    """(host, wrapper) of the hosts with enough distinct pages; wrapper: references that have constant blocks, with these."""
    pages = _skeletons(rows)
    draws = [F.xxhash64("key", F.lit(k)) for k in range(REFERENCES)]
    least = pages.groupBy("host").agg(F.count("*").alias("n"), *[F.min(d).alias(f"d{k}") for k, d in enumerate(draws)]).filter(F.col("n") >= LEAST)
    drawn = pages.join(least, "host").filter(F.greatest(*[d == F.col(f"d{k}") for k, d in enumerate(draws)])).select("host", "key", "skeleton")
    drawn = stored(drawn, "references")  # at most REFERENCES a host
    references = drawn.groupBy("host").agg(F.collect_list(F.struct("key", "skeleton")).alias("references"))
    constant = _votes(pages, references).filter(is_constant(*map(F.col, ("main", "could", "n", "could_near", "n_near"))))
    constant = constant.groupBy("host", "key").agg(F.sort_array(F.collect_list("block")).alias("constant"))
    parts = drawn.join(constant, ["host", "key"], "left")
    own = F.when(F.col("constant").isNotNull(), F.struct("skeleton", "constant"))
    out = stored(parts.groupBy("host").agg(F.collect_list(own).alias("wrapper")), "wrappers")  # leaves out nulls
    dropped(pages, drawn)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (text blocks of the page that are template)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    joined = rows.join(induce(rows), "host", "left")

    def make():
        known: dict[str, list | None] = {}

        def work(batch: pa.RecordBatch) -> dict:
            texts, found = [], []
            for html, host, wrapper in zip(*(batch.column(c) for c in ("html", "host", "wrapper")), strict=True):
                name = host.as_py()
                if name not in known:
                    if len(known) > 100:
                        known.clear()
                    known[name] = [(Tree(w["skeleton"]), set(w["constant"])) for w in wrapper.as_py()] if wrapper.is_valid else None
                page = parse(html.as_py() or "")
                template = None if known[name] is None else template_blocks(known[name], Tree(page.skeleton())) if known[name] else set()
                texts.append(main_text(page, template))
                found.append(len(template or ()))
            return {"text": texts, "n_chars": [len(t) for t in texts], "n_template": found}

        return work

    return derive(joined, make, "text string, n_chars long, n_template long", ["page_id", "url"])
