"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its elements. Boosted trees give each block element the odds
that it holds article text, from its tag, its attribute tokens, those of its ancestors, its
depth, its subtree's density of text, links and tags, and its siblings. Decoding is
hierarchical: over each tree the labelling of greatest total odds is found under the rule that
a dropped element drops all beneath it, so no element is kept inside a dropped one. The
trees are fitted on pages drawn from a page grammar (``sample_pages`` of them), whose article
nodes are known.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.boosting import BoostedTrees
from fieldweave.llm.packing import slices

#: Bytes of pages handled at once (a longer page by itself), which bounds a worker's memory.
PAGE_BYTES = 2 << 20

#: HTML element names by their role in parsing.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no part of the page's text: it is not shown, or is a form's.
RAW = set("script style template iframe textarea title".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption button label".split()
)
CLOSES_P = BLOCK - set("html body noscript button label option optgroup td th tr tbody thead tfoot caption legend select".split())
#: An opening tag closes these elements, up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = {"table", "td", "th", "button", "body", "html"}
TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table blockquote pre figure dl button".split()
#: Words in class, id and role attributes, by what they tell.
TOKENS = {
    "article": "article content post entry main body story text page blog prose copy richtext markdown".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip links".split(),
    "header": "header masthead banner topbar logo branding brand hero site".split(),
    "footer": "footer copyright colophon legal bottom contentinfo imprint".split(),
    "side": "sidebar aside widget related recommended recommendations trending popular more rail complementary teaser promo".split(),
    "advert": "ad ads advert advertisement advertising sponsor sponsored adsense promoted outbrain taboola dfp adbox".split(),
    "comment": "comment comments reply replies disqus discussion respond thread feedback reader readers commentlist".split(),
    "form": "form newsletter subscribe signup login search subscription register poll contact".split(),
    "notice": "notice cookie cookies consent alert popup modal gdpr overlay warning message dialog alertdialog paywall toast banner".split(),
    "share": "share social sharing follow tags tag meta byline author date".split(),
}
_GROUP_OF: dict[str, set[int]] = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words:
        _GROUP_OF.setdefault(_w, set()).add(_k)
_NEGATIVE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select"}
_TELLING = {"article", "main", *_NEGATIVE_TAGS}
_TAG_AT = {t: k for k, t in enumerate(TAGS)}

#: Parts of markup; none backtracks. Quotes hold a value only after an equals sign.
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+")
_NUMBER = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{7,}));?")
_ATTR = re.compile(r"\b(class|id|role|hidden|style|itemprop|aria-label|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_HEADING = re.compile("h[1-6]$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def markup(source: str):
    """(start, end, name, closing, attributes) of the tags of a page, and of comments and declarations, whose name is empty. Time is linear in the page.

    A comment that does not end goes on to the end of the page. Where a tag's quotes would leave it open to
    the end of the page, quotes count no more from there on; what no ``>`` follows is text.
    """
    at, n, quotes, last = 0, len(source), True, source.rfind(">")
    while (at := source.find("<", at)) >= 0:
        closing = source.startswith("/", at + 1)
        name = _NAME.match(source, at + 1 + closing)
        if name is None:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                end = n if end < 0 else end + 3
            elif source.startswith("<![CDATA[", at):
                end = source.find("]]>", at + 9)
                end = n if end < 0 else end + 3
            elif source[at + 1 : at + 2] in ("!", "?", "/") and at < last:
                end = source.find(">", at) + 1
            else:
                at += 1
                continue
            at = yield at, end, "", False, ""
            continue
        if at > last:
            return
        end = _REST.match(source, name.end()).end() if quotes else n
        if end >= n:
            quotes = False
            end = source.find(">", name.end())
            if end < 0:
                return
        at = yield at, end + 1, name[0].lower(), closing, source[name.end() : end]


def unescape(text: str) -> str:
    """The text with its character references decoded; numbers beyond Unicode give the replacement character, however long they are."""
    if "&" not in text:
        return text
    return html.unescape(_NUMBER.sub("\ufffd", text) if "&#" in text else text)


class Page:
    """Elements of a page in order, with their parents, and its text runs with the element each lies in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.depth = ["html"], [-1], [""], [0]
        #: (element, text); None as text is a break between blocks.
        self.runs: list[tuple[int, str | None]] = []
        # Open elements, where in the stack each name stands, and where blocks do: closing looks nothing up by walking.
        self.stack, self.where, self.blocks = [0], {"html": [0]}, []
        at, n, unended = 0, len(source), set()
        tags, resume = markup(source), None
        while True:
            try:
                start, end, name, closing, attrs = tags.send(resume)
            except StopIteration:
                break
            resume = end
            if start > at:
                self._text(source[at:start])
            at = end
            if not name or name == "head":
                continue
            if closing:
                self._close(name)
            elif name in RAW:
                if not attrs.endswith("/") and name not in unended:
                    ended = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?+", re.I).search(source, at)
                    if ended:
                        at = resume = ended.end()
                    elif name in ("script", "style"):
                        at = resume = n
                    else:
                        # Left open, it would take the rest of the page with it.
                        unended.add(name)
            elif name in ("html", "body") and self.where.get(name):
                continue
            else:
                self._start(name, attrs)
        if at < n:
            self._text(source[at:])

    def _text(self, text: str) -> None:
        self.runs.append((self.stack[-1], unescape(text)))

    def _start(self, name: str, attrs: str) -> None:
        if name in CLOSES_P:
            self._imply({"p"}, SCOPE)
            top = self.tag[self.stack[-1]]
            if _HEADING.match(name) and _HEADING.match(top):
                self._cut(len(self.stack) - 1)
        if name in IMPLIED:
            self._imply(*IMPLIED[name])
        if name in ("br", "hr"):
            self.runs.append((self.stack[-1], None))
        elif name == "input":
            self._open(name, attrs)
            self._cut(len(self.stack) - 1)
        elif name not in VOID:
            self._open(name, attrs)

    def _open(self, name: str, attrs: str) -> None:
        parent = self.stack[-1]
        self.tag.append(name)
        self.parent.append(parent)
        self.attrs.append(attrs)
        self.depth.append(self.depth[parent] + 1)
        if name in BLOCK:
            self.runs.append((parent, None))
            self.blocks.append(len(self.stack))
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def _cut(self, height: int) -> None:
        """Close what stands in the stack from ``height`` on."""
        while len(self.stack) > height:
            self.where[self.tag[self.stack.pop()]].pop()
        while self.blocks and self.blocks[-1] >= height:
            self.blocks.pop()

    def _close(self, name: str) -> None:
        """An end tag closes the nearest element of its name; one of inline text closes none beyond a block."""
        k = (self.where.get(name) or [0])[-1]
        if k and (name in BLOCK or not self.blocks or self.blocks[-1] < k):
            if name in BLOCK:
                self.runs.append((self.stack[k], None))
            self._cut(k)

    def _imply(self, names: set[str], boundary: set[str]) -> None:
        """Close the nearest element of ``names`` unless one of ``boundary`` stands nearer."""
        k, b = (max((self.where[x][-1] for x in some if self.where.get(x)), default=0) for some in (names, boundary - names))
        if k > b:
            self._cut(k)


def attribute_groups(attrs: str) -> tuple[list[int], bool, bool]:
    """Counts of telling words by group; whether the element is hidden; whether it has any such attribute."""
    counts, hidden, any_ = [0] * len(TOKENS), False, False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value == "true":
            hidden = True
        if key == "style":
            continue
        any_ = True
        for word in _WORD.findall(_CAMEL.sub(" ", value).lower()):
            for k in _GROUP_OF.get(word, ()):
                counts[k] += 1
    return counts, hidden, any_


def node_features(page: Page) -> np.ndarray:
    """One row for each element of a page, in order; an element's subtree is the rows that follow it."""
    tags, parent, n = page.tag, page.parent, len(page.tag)
    in_link, sizes, children, p_children, order = [False] * n, [1] * n, [0] * n, [0] * n, [0] * n
    groups, hidden = np.zeros((n, len(TOKENS)), np.float32), np.zeros(n, np.float32)
    # What the elements above say: a row for each distinct sum of it, shared by all elements beneath.
    kinds, above_of = [np.zeros(len(TOKENS) + 3, np.float32)], [0] * n
    own_kind, item = [0] * n, [False] * n
    for i in range(n):
        tag, q = tags[i], parent[i]
        in_link[i] = tag == "a" or (i > 0 and in_link[q])
        above_of[i] = own_kind[q] if i else 0
        own_kind[i] = above_of[i]
        if i:
            order[i] = children[q]
            children[q] += 1
            p_children[q] += tag == "p"
            item[i] = item[q] or tag == "li"
        if page.attrs[i]:
            counts, hides, _ = attribute_groups(page.attrs[i])
            groups[i], hidden[i] = counts, hides
        if page.attrs[i] or tag in _TELLING:
            row = kinds[above_of[i]].copy()
            row[: len(TOKENS)] = np.maximum(row[: len(TOKENS)], groups[i])
            row[len(TOKENS) :] = np.maximum(row[len(TOKENS) :], (tag in ("article", "main"), tag in _NEGATIVE_TAGS, hidden[i]))
            own_kind[i] = len(kinds)
            kinds.append(row)
    above = np.column_stack([np.array(kinds)[above_of], item])
    for i in range(n - 1, 0, -1):
        sizes[parent[i]] += sizes[i]
    node, length, spaces, stops, blank = (np.array(c, np.int64) for c in zip(*((k, len(t), t.count(" ") + 1, t.count(".") + t.count(","), t.isspace()) for k, t in page.runs if t is not None))) if any(t is not None for _, t in page.runs) else [np.zeros(0, np.int64)] * 5
    position = np.cumsum(length) - length
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, node, position)
    first = first.tolist()
    for i in range(n - 1, 0, -1):
        first[parent[i]] = min(first[parent[i]], first[i])
    last = max(1, int(length.sum()))
    first = np.minimum(np.array(first), last) / last
    told = length * (blank == 0)
    of_node = lambda x: np.bincount(node, x, n)
    link, para = np.array(in_link)[node], np.array([t == "p" for t in tags])[node]
    fields = [t in ("input", "button", "select", "textarea") for t in tags]
    # Characters, words, link characters, signs, elements, inputs, paragraph characters; article or main tags, negative tags, article words.
    own = np.column_stack([of_node(told), of_node(spaces * (blank == 0)), of_node(told * link), of_node(stops * (blank == 0)), np.ones(n), fields, of_node(told * para), [t in ("article", "main") for t in tags], [t in _NEGATIVE_TAGS for t in tags], groups[:, 0] > 0]).astype(float)
    upto = np.concatenate([np.zeros((1, own.shape[1])), own.cumsum(0)])
    total = upto[np.arange(n) + np.array(sizes)] - upto[:-1]
    tag_row = np.zeros((n, len(TAGS)), np.float32)
    known = np.array([_TAG_AT.get(t, -1) for t in tags])
    tag_row[np.flatnonzero(known >= 0), known[known >= 0]] = 1
    chars, up = np.maximum(total[:, 0], 1), np.maximum(np.array(parent), 0)
    children, p_children, order = np.array(children), np.array(p_children), np.array(order)
    return np.column_stack([
        np.array(page.depth), np.log1p(total[:, 0]), total[:, 0] / max(1.0, total[0, 0]), total[:, 0] / np.maximum(total[up, 0], 1), np.log1p(total[:, 1]),
        total[:, 2] / chars, total[:, 3] / chars, total[:, 4] / chars, np.log1p(total[:, 5]), total[:, 6] / chars, np.log1p(own[:, 0]),
        children, p_children, order, children[up], p_children[up], order / np.maximum(children[up], 1), first,
        hidden, total[:, 7:10], groups, above, tag_row,
    ]).astype(np.float32)


def decided(page: Page) -> list[bool]:
    """Elements that are classified: blocks, and others that say something by their attributes."""
    return [t in BLOCK or t == "input" or bool(a and attribute_groups(a)[2]) for t, a in zip(page.tag, page.attrs)]


def keep_nodes(page: Page, odds: np.ndarray) -> list[bool]:
    """The labelling of greatest total log odds in which whatever lies in a dropped element is dropped."""
    n = len(page.tag)
    take, chosen = odds.copy(), decided(page)
    take[[not c for c in chosen]] = 0.0
    best = take.copy()
    # Gain of keeping over dropping the whole subtree: an element's odds and all gains beneath that pay.
    for i in range(n - 1, 0, -1):
        if best[i] > 0 or not chosen[i]:
            best[page.parent[i]] += max(best[i], 0.0)
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and (best[i] > 0 or not chosen[i])
    return kept


def kept_text(page: Page, kept: list[bool]) -> str:
    return " ".join("".join((" " if text is None else text) if kept[node] else " " for node, text in page.runs).split())


# Training pages ------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _vocabulary(size: int = 4000) -> list[str]:
    r = random.Random(size)
    return ["".join(r.choices(("ka", "lo", "mi", "ren", "tu", "sa", "ver", "no", "é", "und"), k=r.randint(1, 4))) for _ in range(size)]


def _words(r: random.Random, low: int, high: int, full: bool = True) -> str:
    n = r.randint(low, high)
    words = r.choices(_vocabulary(), k=n)
    if full:
        words = [w + sign for w, sign in zip(words, r.choices(("", ".", ",", ";"), (88, 6, 3, 3), k=n))]
    return " ".join(words).capitalize() + "." * full


def _element(r, tag, classes, inner, ids=0.2) -> str:
    attrs = ""
    if classes and r.random() < 0.85:
        name = r.choice(classes)
        if r.random() < 0.3:
            name += r.choice((" clearfix", " box", "-wrapper", "-inner", " col-3", "_block"))
        attrs = f' {"id" if r.random() < ids else "class"}="{name}"'
    return f"<{tag}{attrs}>{inner}</{tag}>"


def _links(r, low=2, high=9) -> str:
    items = [f'<a href="/{k}">{_words(r, 1, 3, False)}</a>' for k in range(r.randint(low, high))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.8 else " ".join(items)


def _plain(r, low=1, high=25) -> str:
    text = _words(r, low, high)
    return text if r.random() < 0.5 else f"<p>{text}</p>"


def _boilerplate(r: random.Random, kind: str) -> str:
    if kind == "menu":
        return _element(r, r.choice(("nav", "nav", "div", "ul")), TOKENS["menu"], _links(r))
    if kind == "header":
        return _element(r, r.choice(("header", "header", "div")), TOKENS["header"], r.choice(("", f"<h1>{_words(r, 1, 4, False)}</h1>")) + r.choice((_links(r), _plain(r, 1, 12))))
    if kind == "footer":
        return _element(r, r.choice(("footer", "footer", "div")), TOKENS["footer"], "&copy; example &middot; " * (r.random() < 0.6) + r.choice((_plain(r, 2, 30), _links(r))))
    if kind == "side":
        body = "".join(f"<h3>{_words(r, 1, 4, False)}</h3>" + r.choice((_links(r), _plain(r, 3, 60))) for _ in range(r.randint(1, 3)))
        return _element(r, r.choice(("aside", "aside", "div", "section")), TOKENS["side"], body)
    if kind == "advert":
        return _element(r, r.choice(("div", "div", "aside", "section", "p")), TOKENS["advert"], _words(r, 1, 30) if r.random() < 0.7 else f'<a href="/x">{_words(r, 1, 12)}</a>', 0.1)
    if kind == "form":
        return _element(r, r.choice(("form", "form", "div")), TOKENS["form"], f"<label>{_words(r, 1, 6)}</label><input name=q><button>{_words(r, 1, 2, False)}</button>" + _plain(r, 1, 12) * (r.random() < 0.4))
    if kind == "notice":
        return _element(r, r.choice(("div", "div", "section", "aside", "p", "noscript")), TOKENS["notice"], _plain(r, 3, 40) if r.random() < 0.6 else _words(r, 3, 30) + f"<button>{_words(r, 1, 2, False)}</button>")
    if kind == "share":
        return _element(r, "div", TOKENS["share"][:5], _links(r, 2, 5))
    each = "".join(_element(r, r.choice(("div", "li", "article", "section", "p")), ["comment", "comment-body", "reply"], r.choice((_words(r, 2, 60), f"<p>{_words(r, 2, 60)}</p>"))) for _ in range(r.randint(1, 5)))
    return _element(r, r.choice(("section", "div", "div", "ol", "ul", "aside")), TOKENS["comment"], f"<h3>{_words(r, 1, 3, False)}</h3>" * (r.random() < 0.5) + each)


KINDS = ("menu", "header", "footer", "side", "advert", "form", "notice", "share", "comment")
#: Marks article text in training pages; no other text holds it.
_MARK = ""


def training_page(r: random.Random) -> str:
    """A page of the grammar; article blocks begin with a mark."""
    blocks = [f"<h1>{_MARK}{_words(r, 2, 12, False)}</h1>"] if r.random() < 0.75 else []
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
        text = _MARK + _words(r, 1, r.choice((4, 20, 60, 250)))
        kind = r.random()
        if kind < 0.68:
            blocks.append(f"<p>{text}" + "</p>" * (r.random() < 0.8))
        elif kind < 0.74:
            blocks.append(f"<p><b>{text}<br>")
        elif kind < 0.80:
            blocks.append("<ul>" + "".join(f"<li>{_MARK}{_words(r, 1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.86:
            blocks.append(f"<h2>{_MARK}{_words(r, 1, 8, False)}</h2>")
        elif kind < 0.90:
            blocks.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.94:
            blocks.append(f"<table><tr><td>{text}</td><td>{_MARK}{_words(r, 1, 4, False)}</td></tr></table>")
        elif kind < 0.97:
            blocks.append(f"<pre>{text}</pre>")
        else:
            blocks.append(f"<div>{text}</div>")
        if r.random() < 0.07:
            blocks.append(_boilerplate(r, r.choice(("advert", "share", "side", "form", "notice", "advert"))))
    if r.random() < 0.2:
        blocks.append(_boilerplate(r, r.choice(("comment", "comment", "share", "footer"))))
    if r.random() < 0.1:
        blocks.insert(0, _boilerplate(r, r.choice(("header", "share", "menu"))))
    body = "".join(blocks)
    style = r.random()
    if style < 0.55:
        body = _element(r, "article", TOKENS["article"][:4] if r.random() < 0.4 else [], body)
    elif style < 0.7:
        body = _element(r, "main", [], body)
    elif style < 0.9:
        body = _element(r, r.choice(("div", "section")), TOKENS["article"], body)
    if r.random() < 0.3:
        body = _element(r, r.choice(("div", "main", "section")), ["container", "wrapper", "page", "content"], body)
    before = [_boilerplate(r, r.choice(("menu", "header", "advert", "notice", "form", "side", "menu", "advert"))) for _ in range(r.randint(0, 4))]
    after = [_boilerplate(r, r.choice(("footer", "side", "comment", "share", "advert", "form", "notice", "footer"))) for _ in range(r.randint(0, 4))]
    whole = "".join(before) + body + "".join(after)
    if r.random() < 0.25:
        whole = f'<div class="{r.choice(("page", "wrapper", "container", "site", "layout"))}">{whole}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8, False)}</title></head><body>{whole}" + "</body></html>" * (r.random() < 0.9)


@lru_cache(maxsize=2)
def train(sample_pages: int = 1500, seed: int = 7) -> BoostedTrees:
    r, xs, ys = random.Random(seed), [], []
    for _ in range(sample_pages):
        page = Page(training_page(r))
        label = np.zeros(len(page.tag))
        for node, text in page.runs:
            if text and _MARK in text:
                label[node] = 1
        page.runs = [(i, t and t.replace(_MARK, "")) for i, t in page.runs]
        for i in range(len(label) - 1, 0, -1):
            label[page.parent[i]] = max(label[page.parent[i]], label[i])
        chosen = np.array(decided(page))
        xs.append(node_features(page)[chosen])
        ys.append(label[chosen])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract_texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    features = [node_features(p) for p in pages]
    if not pages:
        return []
    odds = np.split(model.score(np.concatenate(features)), np.cumsum([len(f) for f in features])[:-1])
    return [kept_text(p, keep_nodes(p, o)) for p, o in zip(pages, odds)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = 1500) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty sources give an empty text, as does a page without an article. Character references are
    decoded, white space within a block becomes one space, and blocks follow each other in page
    order, one space apart. Repeated rows and null ids are kept as they come; other columns are ignored.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(sample_pages))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2, PAGE_BYTES):
                texts = extract_texts(batch.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
