"""A tolerant, linear-time reader of HTML into block nodes and text leaves, with features of each."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

# A quote opens a value only after "=", as in the standard; one that never closes is an ordinary character.
_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)>)""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements by their part in the HTML standard.
_RAW = {"script", "style", "title", "textarea", "template", "iframe", "noembed", "noframes"}
_MEDIA = {"svg", "canvas", "audio", "video"}
_HIDDEN = {"select", "option", "button", "datalist", "optgroup", *_MEDIA}
_VOID = {"input", "meta", "link", "img", "hr", "base", "area", "col", "embed", "source", "track", "wbr"}
BLOCKS = ("#text", "html", "body", "head", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "li", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "nav", "header", "footer", "aside", "form", "fieldset", "figure", "figcaption", "blockquote", "pre", "address", "details", "summary", "center", "hgroup", "caption", "menu", "dialog", "search", "legend")
_INDEX = {t: i for i, t in enumerate(BLOCKS)}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

#: Groups of attribute tokens; a node has a bit for each group that its class, id or role names.
GROUPS = {
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs crumbs toc tabs pagination pager topbar",
    "header": "header head masthead branding logo tagline hero site",
    "footer": "footer foot bottom colophon copyright legal contentinfo",
    "side": "sidebar side aside rail widget widgets complementary right left",
    "ad": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted commercial dfp",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay toast privacy disclaimer message paywall",
    "form": "form search subscribe newsletter signup login register contact input",
    "comment": "comment comments commentlist respond reply replies discussion disqus thread reader feedback response responses",
    "share": "share sharing social buttons tweet facebook twitter follow tools",
    "related": "related recommended recommendations more also popular trending latest teaser teasers next previous",
    "content": "content article articles post story entry text body main page copy prose",
    "meta": "meta byline author date time tags tag category categories info published timestamp",
}
_TOKENS = {w: 1 << i for i, words in enumerate(GROUPS.values()) for w in words.split()}


class Page:
    """Parallel lists, one entry per node; a parent comes before its children. texts holds the leaves' blocks."""

    __slots__ = ("chars", "depth", "link", "mask", "parent", "tag", "texts")

    def __init__(self) -> None:
        self.tag: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.mask: list[int] = []
        self.link: list[int] = []
        self.texts: dict[int, str] = {}


def _mask(attrs: str) -> int:
    bits = 0
    for m in _ATTR.finditer(attrs):
        for w in _WORD.findall(m[2]):
            bits |= _TOKENS.get(w.lower(), 0)
    return bits


def parse(html: str) -> Page:
    page = Page()
    tag, parent, depth, mask, link, texts = page.tag, page.parent, page.depth, page.mask, page.link, page.texts
    stack: list[int] = []
    open_count = dict.fromkeys(BLOCKS, 0)
    run: list[str] = []
    run_link = in_link = 0
    hidden: list[str] = []  # open elements without text of their own; the next block ends them
    hidden_count: dict[str, int] = {}
    closers: dict[str, int] = {}

    def closed(name: str) -> bool:
        """Whether an end tag of that name is still to come."""
        if name not in closers:
            closers[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}[\s/>]", html, re.I)), default=-1)
        return closers[name] >= at
    at, size = 0, len(html)

    def add(name: str, bits: int) -> int:
        tag.append(_INDEX[name])
        parent.append(stack[-1] if stack else -1)
        depth.append(len(stack))
        mask.append(bits)
        link.append(0)
        return len(tag) - 1

    def flush() -> None:
        nonlocal run_link
        if run:
            text = "".join(run)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                node = add("#text", 0)
                texts[node] = text
                link[node] = run_link
            run.clear()
        run_link = 0

    def pop() -> None:
        open_count[BLOCKS[tag[stack.pop()]]] -= 1

    last = html.rfind(">") + 1
    while at < size:
        # no tag ends past the last >, but a comment may reach the end
        m = _TOKEN.search(html, at) if at < last or html.find("<!", at) >= 0 else None
        if m is None:
            break
        name = m[2]
        if m.start() > at and not hidden:
            run.append(html[at:m.start()])
            if in_link:
                run_link += m.start() - at
        at = m.end()
        if name is None:
            continue
        name = name.lower()
        closing = m[1] == "/"
        if name in _RAW:
            if not closing and not m[3].endswith("/"):
                end = closed(name) and re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                stop = html.find(">", end.start()) if end else -1
                if stop >= 0:
                    at = stop + 1
                elif name in ("script", "style"):  # never shown: the rest is code
                    at = size
                # any other without an end hides nothing
                if name == "title" and not hidden:
                    flush()
            continue
        if name in _HIDDEN:
            if closing:
                if name in hidden_count and hidden_count[name]:
                    while True:
                        gone = hidden.pop()
                        hidden_count[gone] -= 1
                        if gone == name:
                            break
            elif not m[3].endswith("/") and (name not in _MEDIA or closed(name)):
                hidden.append(name)
                hidden_count[name] = hidden_count.get(name, 0) + 1
            continue
        if name not in _INDEX:
            if name == "br":
                run.append(" ")
            elif name == "hr":
                flush()
            elif name == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        hidden.clear()
        hidden_count.clear()
        in_link = 0
        if closing:
            if open_count[name]:
                while BLOCKS[tag[stack[-1]]] != name:
                    pop()
                pop()
            continue
        if stack and BLOCKS[tag[stack[-1]]] == "p":
            pop()
        if name in _CLOSES:
            shut, until = _CLOSES[name]
            if any(open_count[t] for t in shut):
                reach = len(stack) - 1
                while reach >= 0 and BLOCKS[tag[stack[reach]]] not in shut and BLOCKS[tag[stack[reach]]] not in until:
                    reach -= 1
                if reach >= 0 and BLOCKS[tag[stack[reach]]] in shut:
                    while reach > 0 and BLOCKS[tag[stack[reach - 1]]] in shut and BLOCKS[tag[stack[reach - 1]]] not in until:
                        reach -= 1
                    while len(stack) > reach:
                        pop()
        node = add(name, _mask(m[3]) if m[3] else 0)
        stack.append(node)
        open_count[name] += 1
    if at < size and not hidden:
        run.append(html[at:])
    flush()
    return page


_COARSE = ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "figure", "blockquote", "table", "body")
_TAG_GROUP = np.zeros((len(BLOCKS), len(_COARSE) + 4), np.float32)
for _i, _t in enumerate(BLOCKS):
    if _t in _COARSE:
        _TAG_GROUP[_i, _COARSE.index(_t)] = 1
    _TAG_GROUP[_i, len(_COARSE):] = (_t[0] == "h" and _t[1:].isdigit(), _t in ("ul", "ol", "dl", "menu"), _t in ("li", "dt", "dd"), _t in ("td", "th", "tr", "tbody"))
_ABOVE = [_INDEX[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table", "p", "blockquote", "figure")]
_PUNCT = re.compile(r"[.!?,;:]")

FEATURES = _TAG_GROUP.shape[1] * 2 + 2 * len(GROUPS) + len(_ABOVE) + 16


def features(page: Page) -> np.ndarray:
    """Per node: its tag and its parent's, attribute groups of itself and of what is above, subtree density, depth, siblings."""
    n = len(page.tag)
    out = np.zeros((n, FEATURES), np.float32)
    if not n:
        return out
    tag, parent, mask = page.tag, page.parent, page.mask
    chars, links, words, marks, leaves, nodes, kids = ([0] * n for _ in range(7))
    above, above_tag, order, same = [0] * n, [0] * n, [0] * n, [0] * n
    bit = {t: 1 << i for i, t in enumerate(_ABOVE)}
    last: dict[int, int] = {}
    before, seen = [0] * n, 0
    for i in range(n):
        p = parent[i]
        if p >= 0:
            above[i] = above[p] | mask[p]
            above_tag[i] = above_tag[p] | bit.get(tag[p], 0)
            order[i] = kids[p]
            kids[p] += 1
            if last.get(p) == tag[i]:
                same[i] = 1
            last[p] = tag[i]
        before[i] = seen
        text = page.texts.get(i)
        if text is not None:
            chars[i], links[i], words[i], marks[i], leaves[i] = len(text), min(page.link[i], len(text)), text.count(" ") + 1, len(_PUNCT.findall(text)), 1
            seen += len(text)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if p >= 0:
            chars[p] += chars[i]
            links[p] += links[i]
            words[p] += words[i]
            marks[p] += marks[i]
            leaves[p] += leaves[i]
            nodes[p] += nodes[i] + 1
    t, par = np.array(tag), np.array(parent)
    c, lk, w, mk, lv, nd = (np.array(x, np.float32) for x in (chars, links, words, marks, leaves, nodes))
    total = max(1, seen)
    g = _TAG_GROUP.shape[1]
    out[:, :g] = _TAG_GROUP[t]
    has = par >= 0
    out[has, g:2 * g] = _TAG_GROUP[t[par[has]]]
    at = 2 * g
    for value in (mask, above):
        out[:, at:at + len(GROUPS)] = np.array(value)[:, None] >> np.arange(len(GROUPS)) & 1
        at += len(GROUPS)
    out[:, at:at + len(_ABOVE)] = np.array(above_tag)[:, None] >> np.arange(len(_ABOVE)) & 1
    at += len(_ABOVE)
    up = np.where(has, par, 0)
    siblings = np.where(has, np.array(kids, np.float32)[up], 1)
    numbers = (
        np.log1p(c), lk / np.maximum(c, 1), c / np.maximum(w, 1), mk / np.maximum(w, 1), np.log1p(lv), np.log1p(nd), c / total,
        np.array(page.depth), np.log1p(siblings), np.array(order) / np.maximum(siblings, 1), np.array(same), np.array(before) / total,
        np.log1p(np.where(has, c[up], c)), np.where(has, lk[up] / np.maximum(c[up], 1), 0), np.where(has, mk[up] / np.maximum(w[up], 1), 0), c / np.maximum(lv, 1),
    )
    out[:, at:at + len(numbers)] = np.stack(numbers, 1)
    return out
