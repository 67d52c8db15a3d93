"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf path of block elements. Per path the
lengths and the punctuation of its nodes are aggregated (text outside links over the number of nodes, and
punctuation marks over the number of nodes). Both ratios are smoothed over the nodes in page order and
fused. The fused ratio, times the factors of structure, is a node's score; nodes whose score
reaches a quarter of the page's mean score are the main text. Factors of structure:

    - elements of menus, footers, sidebars and the like, by tag or role, and what is hidden: 0; so are forms, unless they hold half of the
      page's text with few controls, and buttons, unless they stand in a sentence
    - elements that name themselves by class or id as something else (menu, advert, comments, ...): next to nothing, unless
      they hold most of the page's text; words that also occur in names of content (search, legal, ..., or promoted before
      another noun): a half, unless the whole name is made of such words
    - blocks of text that are links in the most part: a twentieth, headings excepted, and paragraphs of an article with words besides
    - where there are article elements (else main elements) with text: a twentieth outside those that have a fifth of the
      largest one's weight, or whose text is as dense and seldom a link
    - inside those, else inside the deepest element that holds nine tenths of the score, half the page's mean is
      added before the factors, so that short blocks among long ones stay

Blocks are joined by one space; white space inside a block becomes one space; character references
are decoded. Nothing is cut. Reading a page takes time in proportion to its length, however deep its elements and however
broken its tags.

Defined results: a null, empty or text-free page gives an empty text and 0 characters; broken markup is read as
browsers read it as far as implied and missing end tags go; a tag without an end is text; an unclosed script or
comment ends with the page. Rows are read on their own, so repeated rows, null keys, extra columns and empty tables
need nothing special.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Fixed values of HTML: elements without content, with raw content, those that end an open p, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg math title object noframes noembed xmp canvas audio video".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the value's first part is ended by the key, not past the second part.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_TAGS = frozenset("nav footer aside menu".split())
#: Something else or not by what they hold.
FORM_TAGS = frozenset("form fieldset dialog".split())
#: Blocks of running text, in which a button may be a word.
PROSE = frozenset("p li dd td blockquote figcaption h1 h2 h3 h4 h5 h6".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion promotions cookie cookies consent gdpr "
    "popup modal overlay paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer masthead topbar "
    "comment comments commentlist disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login widget widgets toolbar pagination pager tagcloud".split()
)
#: Words that name content as well; and those that only name a container.
DOUBTFUL_WORDS = frozenset("search register form notice notices notification notifications alert reply discussion responses legal copyright disclaimer".split())
MODIFIERS = frozenset("promo promoted promotion promotions sponsored banner rail modal overlay popup related recommended recommendations share sharing social respond replies widget widgets consent subscribe".split())
CONTAINER_WORDS = frozenset(
    "area bar block body box btn button container content div field group holder inner input item items list main outer panel row section site top bottom left right wrap wrapper page "
    "post posts article articles story stories link links news icon icons text title heading slot unit zone region module component view card cards products product videos video reading more feed stack rich".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
#: Characters of a block of running text.
RUNNING = 160
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r">|=\s*[\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in sorted(RAW)}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…。，；：！？、]")


class Scanner:
    """Finds the ends of tags; a page is run over once, but for one tag with unmatched quotes."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True
        self.last_quote = {q: html.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place of the > that ends a tag begun before ``at``; -1 without one. Quoted values may hold one."""
        if at > self.last:
            return -1
        if self.quotes:
            found = _QUOTE.search(self.html, at)
            while found and found[0] != ">":
                q = found[0][-1]
                close = self.html.find(q, found.end()) if found.end() <= self.last_quote[q] else -1
                found = _QUOTE.search(self.html, close + 1) if close >= 0 else None
            if found:
                return found.start()
            self.quotes = False  # a quote is missing: from here on they mean nothing
        return self.html.find(">", at)


class Page:
    """Elements (parent, tag, named, path) and text nodes (element, text, in a link) of a page.

    named of an element: 1 if its name is doubtful, 2 if it is something else by its name, else 0.
    out: it is something else by tag, role, style or what it holds, or lies in such; header: it lies in a header outside a heading.
    controls: input fields and buttons right in the element.
    A text node of None is a block boundary.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.named, self.out, self.header, self.path, self.controls = [-1], ["#"], [0], [False], [False], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, str | None, bool]] = []
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # places of the open elements in the stack, by tag
        self.blocks = [0]  # those that are not inline
        scanner, link, at, n, since = Scanner(html), False, 0, len(html), 0

        def text(upto: int) -> None:
            if upto > since:
                self.nodes.append((self.stack[-1], html[since:upto], link))

        while at < n:
            start = html.find("<", at)
            if start < 0:
                break
            if html.startswith("<!--", start):
                text(start)
                end = html.find("-->", start + 4)
                since = at = end + 3 if end >= 0 else n
                continue
            found = _NAME.match(html, start + 1)
            if not found:
                end = html.find(">", start + 1) if html[start + 1 : start + 2] in ("!", "?", "/") and start < scanner.last else -1
                if end < 0:
                    at = start + 1
                    continue
                text(start)
                since = at = end + 1
                continue
            end = scanner.end(found.end())
            if end < 0:
                at = start + 1
                continue
            text(start)
            since = at = end + 1
            name = found[2].lower()
            if found[1]:
                if name == "a":
                    link = False
                places = self.open.get(name)
                if places and not (name in INLINE and self.blocks[-1] > places[-1]):
                    self._pop(places[-1])
                    if name not in INLINE:
                        link = False
                if name not in INLINE:
                    self.nodes.append((self.stack[-1], None, False))
                continue
            attributes = html[found.end() : end]
            if name in ("input", "select", "textarea", "button") and "hidden" not in attributes.lower():
                self.controls[self.stack[-1]] += 1
            if name in RAW:
                if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
                    end = _RAW_END[name].search(html, at)
                    since = at = end.end() if end else n
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.nodes.append((self.stack[-1], None, False))
                continue
            out, named = self._kind(name, attributes)
            if name in INLINE and not out and not named and name != "button":
                if name == "a":
                    link = True
                continue
            if name not in INLINE:
                self.nodes.append((self.stack[-1], None, False))
                link = False
                if name in ENDS_P:
                    self._end("p", "table td th caption button")
                if name in IMPLIED:
                    self._end(*IMPLIED[name])
            above = self.stack[-1]
            self.open.setdefault(name, []).append(len(self.stack))
            if name not in INLINE:
                self.blocks.append(len(self.stack))
            self.stack.append(len(self.tag))
            self.parent.append(above)
            self.tag.append(name)
            self.named.append(named)
            self.controls.append(0)
            self.out.append(self.out[above] or out)
            self.header.append(name not in HEADINGS and (self.header[above] or name == "header"))
            self.path.append(self.paths.setdefault((self.path[above], name), len(self.paths) + 1))
        text(n)
        self._settle()

    def _settle(self) -> None:
        """What forms and buttons are.

        A form is content if it holds at least half of the page's text, and a hundred characters for each of its controls. A
        button is a word of its block if the block has twice as much text besides its buttons.
        """
        if not any(x in FORM_TAGS or x == "button" for x in self.tag):
            return
        size = np.zeros(len(self.tag))
        for e, t, _ in self.nodes:
            if t is not None and not self.out[e] and not self.header[e]:
                size[e] += len(t.strip())
        mass, controls = self.masses(size), self.masses(np.asarray(self.controls))
        block, pressed = list(range(len(self.tag))), [0.0] * len(self.tag)
        for k in range(1, len(self.tag)):
            above = block[self.parent[k]]
            if self.tag[k] in INLINE:
                block[k] = above
            if self.tag[k] == "button":
                pressed[above] += mass[k]
        for k in range(1, len(self.tag)):
            held = block[k]
            if self.tag[k] in FORM_TAGS:
                own = mass[k] < mass[0] / 2 or mass[k] < 100 * controls[k]
            else:
                own = self.tag[k] == "button" and (self.tag[held] not in PROSE or mass[held] < 3 * pressed[held])
            self.out[k] = self.out[k] or own or self.out[self.parent[k]]

    def _pop(self, place: int) -> None:
        """Closes the elements from a place of the stack on."""
        while len(self.stack) > place:
            self.open[self.tag[self.stack.pop()]].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def _end(self, names: str, barriers: str) -> None:
        barrier = max((self.open[x][-1] for x in barriers.split() if self.open.get(x)), default=0)
        places = (p[k] for x in names.split() if (p := self.open.get(x)) and (k := bisect_right(p, barrier)) < len(p))
        first = min(places, default=0)
        if first:
            self._pop(first)

    def _kind(self, name: str, attributes: str) -> tuple[bool, int]:
        """Whether the element is something else by tag, role or style, and what its name says."""
        if name in OTHER_TAGS or (name == "header" and not self.open.get("article") and not self.open.get("main")):
            return True, 0
        named = 0
        if not attributes or name in ("html", "body", "article", "main"):
            return False, 0
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                for token in value.split():
                    words = {w.lower() for w in _WORD.findall(token)}
                    other = words & OTHER_WORDS
                    if other and other <= MODIFIERS and words - OTHER_WORDS - DOUBTFUL_WORDS - CONTAINER_WORDS:
                        named = max(named, 1)  # promoted-study: the noun is another
                    elif other or (words & DOUBTFUL_WORDS and words <= DOUBTFUL_WORDS | CONTAINER_WORDS):
                        named = 2
                    elif words & DOUBTFUL_WORDS:
                        named = max(named, 1)
            if key == "role" and value.lower() in OTHER_ROLES or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                return True, named
        return False, named

    def masses(self, own: np.ndarray) -> list[float]:
        """Sums over each element and all below it; an element comes after its parent."""
        found = own.tolist()
        for k in range(len(found) - 1, 0, -1):
            found[self.parent[k]] += found[k]
        return found

    def down(self, own: list, join: Callable) -> list:
        """Each element's value joined with that of its parent, from the root down."""
        for k in range(1, len(own)):
            own[k] = join(own[self.parent[k]], own[k])
        return own


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.asarray([0.1, 0.2, 0.4, 0.2, 0.1])
    weight = np.convolve(np.ones(len(x)), kernel, "full")[2 : len(x) + 2]
    return np.convolve(x, kernel, "full")[2 : len(x) + 2] / weight


def content_nodes(page: Page) -> list[int]:
    """Indices of the text nodes of the main text: those whose score reaches a quarter of the page's mean."""
    text = [k for k, (e, t, _) in enumerate(page.nodes) if t is not None and not page.out[e] and not page.header[e] and not t.isspace()]
    if not text:
        return []
    elements = len(page.tag)
    element = np.asarray([page.nodes[k][0] for k in text])
    link = np.asarray([page.nodes[k][2] for k in text])
    size = np.asarray([len(page.nodes[k][1].strip()) for k in text], float)
    free = np.where(link, 0, size)
    marks = np.asarray([0 if page.nodes[k][2] else len(_MARKS.findall(page.nodes[k][1])) for k in text], float)
    # the ratios of paths, smoothed and fused
    _, where = np.unique(np.asarray(page.path)[element], return_inverse=True)
    count = np.bincount(where)
    length, point = _smooth((np.bincount(where, free) / count)[where]), _smooth((np.bincount(where, marks) / count)[where])
    fused = length * (1 + point)
    # the factors of structure
    mass = page.masses(np.bincount(element, size, elements))
    named = [1.0, 0.5, 0.001]
    factor = [1.0 if not k else named[k] if k == 1 else max(named[k], (m / mass[0]) ** 8) for k, m in zip(page.named, mass, strict=True)]
    factor = np.asarray(page.down(factor, lambda above, own: above * own))[element]
    linked, free_of = np.bincount(element, size - free, elements), np.bincount(element, free, elements)
    heading = np.asarray([x in HEADINGS for x in page.tag])
    whole = factor
    factor = np.where((linked > free_of)[element] & ~heading[element], factor / 20, factor)
    inside = np.zeros(len(text), bool)
    for name in ("article", "main"):
        # weight without what is named as something else
        weight = page.masses(np.bincount(element, size * factor, elements))
        own = [w if t == name else 0.0 for w, t in zip(weight, page.tag, strict=True)]
        most = max(own)
        if most:
            # another one counts if it has a fifth of the weight, or text as dense and few links
            held, free_in, dense = (page.masses(np.bincount(element, x, elements)) for x in (size, free, size * free))
            first = own.index(most)
            least = min(dense[first] / held[first], RUNNING) / 4
            alike = [w > 0 and free_in[k] >= 0.75 * held[k] and dense[k] >= least * held[k] for k, w in enumerate(own)]
            kept = page.down([w >= most / 5 or x for w, x in zip(own, alike, strict=True)], lambda above, own: above or own)
            inside = np.asarray(kept)[element]
            # a paragraph with words besides its link is text
            words = np.bincount(element, [not x and any(map(str.isalnum, page.nodes[k][1])) for k, x in zip(text, link, strict=True)], elements)
            prose = (words > 0) & np.asarray([x in ("p", "dd", "blockquote") for x in page.tag])
            factor = np.where(inside & prose[element], whole, factor)
            factor = np.where(inside, factor, factor / 20)
            break
    value = fused * factor
    mean = np.average(value, weights=free * factor + 1e-9 * factor + 1e-30)
    if not inside.any():
        # the deepest element with nearly all of the score
        held = page.masses(np.bincount(element, np.where(value >= mean / 4, size * factor, 0), elements))
        top = max(k for k in range(elements) if held[k] >= 0.9 * held[0])
        inside = np.asarray(page.down([k == top for k in range(elements)], lambda above, own: above or own))[element]
    score = value + np.where(inside, 0.5 * mean * factor / max(factor[inside].max(initial=0), 1e-30), 0)
    return [k for k, x in zip(text, score, strict=True) if x >= mean / 4]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    keep = set(content_nodes(page))
    parts = []
    for k, (_, text, _) in enumerate(page.nodes):
        if text is None:
            parts.append(" ")
        elif k in keep or text.isspace():
            parts.append(text)
        else:
            parts.append(" ")
    # references are decoded after the nodes are put together: one may be cut by an inline element
    return " ".join(unescape("".join(parts)).split())


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
