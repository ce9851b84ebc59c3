"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, prepare
from gridloom.llm.forest import Boosted, boost

#: Elements whose content is no markup, or never shown as text; they run to their end tag.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
#: Elements that are left out up to their own end tag; one that has none ends where the next block begins or ends.
LEFT_OUT = ("svg", "object", "select", "button")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line of text: they are no nodes of their own.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An element, and the open ones that its start tag ends, up to the nearest of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BLOCKS = (CLOSES_P | ENDS.keys() | set("tbody thead tfoot caption body html".split())) - {"option"}
#: A tag, which ends at ``>``, before the next tag, or with the page. Quotes count behind ``=`` alone, and span a ``>``
#: only if what follows the closing one may follow a value. All repetition is possessive: a place is read once or twice.
TOKEN = re.compile(
    r"<(?:(/?)([A-Za-z][^\s/><]*+)"
    r"((?:[^=><]++|<(?![A-Za-z/!?])|=\s*+(?>\"[^\"]*+\"(?=[\s/>])|\"[^\">]*+\"|'[^']*+'(?=[\s/>])|'[^'>]*+'|))*+)(?:>|(?=<)|\Z)"
    r"|[!?])"
)
_RAW_MARK = re.compile(rf"<(/?)({'|'.join(RAW)})(?=[\s/>])", re.I)
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
#: A slash that ends a tag and is no part of an attribute's bare value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*+:\s*+none|aria-hidden\s*+=\s*+[\"']?true", re.I)

#: Attribute tokens that speak for or against main text, by group.
GROUPS = {
    "main": "article body content entry main post story text prose read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc topbar toolbar tabs pager pagination",
    "edge": "header masthead banner footer foot colophon copyright legal site logo branding",
    "side": "sidebar side aside rail widget widgets related recommended more popular trending recent tags tag",
    "sell": "ad ads advert advertisement advertising sponsor sponsored promo promotion offer affiliate",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay toast warning disclaimer newsletter paywall",
    "talk": "comment comments reply replies discussion respond disqus thread review reviews",
    "form": "form search login signup signin subscribe subscription share social follow contact input",
}
_GROUP_OF = {word: i for i, words in enumerate(GROUPS.values()) for word in words.split()}
#: Kinds of elements that the trees see as one flag each.
KINDS = ({"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"},
         {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "dialog"}, {"article", "main"},
         {"table", "tbody", "tr", "td", "th"}, {"figure", "figcaption"}, {"html", "body", "div", "section"})


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "links", "marked", "place")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        #: Own text as strings, with child nodes between them, in page order.
        self.parts: list[str | Node] = []
        self.links = 0
        self.marked = False
        #: Siblings before this one.
        self.place = 0


class Tag(NamedTuple):
    """A tag, or with an empty name a comment; ``end`` lies behind its raw content."""

    start: int
    end: int
    name: str
    closing: bool
    attrs: str


class _RawEnds:
    """Where elements of ``RAW`` end; the page is searched for their tags once."""

    def __init__(self, page: str):
        self.page = page
        self.opened: dict[str, list[int]] = {name: [] for name in RAW}
        self.closed: dict[str, list[int]] = {name: [] for name in RAW}
        for m in _RAW_MARK.finditer(page):
            (self.closed if m[1] else self.opened)[m[2].lower()].append(m.start())

    def of(self, name: str, at: int, closed: bool) -> int:
        """The place behind the element whose start tag ends ``at``.

        A tag that closes itself has no content unless an end tag comes before the next element of
        its name. Without an end tag scripts and styles run to the next block, others are empty.
        """
        ends, opens = self.closed[name], self.opened[name]
        k = bisect_left(ends, at)
        if k == len(ends):
            if closed or name not in ("script", "style"):
                return at
            block = _BLOCK.search(self.page, at)
            return block.start() if block else len(self.page)
        if closed:
            j = bisect_left(opens, at)
            if j < len(opens) and opens[j] < ends[k]:
                return at
        return self.page.find(">", ends[k]) + 1 or len(self.page)


def tags_of(page: str) -> list[Tag]:
    """Tags and comments of a page in order, in time proportional to its length.

    A comment that never ends, and any other ``<!`` or ``<?``, ends at the next ``>``; without one it is text.
    """
    out: list[Tag] = []
    raw: _RawEnds | None = None
    last_comment, last_end = page.rfind("-->"), page.rfind(">")
    at = 0
    while m := TOKEN.search(page, at):
        start, at = m.span()
        if m[2] is None:
            if page.startswith("<!--", start) and start + 2 <= last_comment:
                at = page.find("-->", start + 2) + 3
            elif at <= last_end:
                at = page.find(">", at) + 1
            else:
                continue
            out.append(Tag(start, at, "", False, ""))
            continue
        name = m[2].lower()
        if not m[1] and name in RAW:
            if raw is None:
                raw = _RawEnds(page)
            at = raw.of(name, at, _CLOSED.search(m[3]) is not None)
        out.append(Tag(start, at, name, bool(m[1]), m[3]))
    return out


def left_out(tags: list[Tag]) -> dict[int, tuple[int, int]]:
    """For each start tag of ``LEFT_OUT``, by number: the tag and the place to go on from."""
    out: dict[int, tuple[int, int]] = {}
    limits: dict[int, tuple[int, int]] = {}
    opened: dict[str, list[int]] = {name: [] for name in LEFT_OUT}
    unclosed: list[int] = []
    for i, tag in enumerate(tags):
        stack = opened.get(tag.name)
        if stack is None:
            continue
        if tag.closing:
            if stack:
                out[stack.pop()] = (i + 1, tag.end)
            continue
        closed = _CLOSED.search(tag.attrs) is not None
        if closed and tag.name == "svg":
            out[i] = (i + 1, tag.end)
            continue
        if stack and tag.name in ("select", "button"):
            # These don't nest: the next one ends what is open.
            limits.setdefault(stack[-1], (i, tag.start))
            unclosed.append(stack.pop())
        if closed:
            limits[i] = (i + 1, tag.end)
        stack.append(i)
    unclosed += (i for stack in opened.values() for i in stack)
    if unclosed:
        blocks = [i for i, tag in enumerate(tags) if tag.name in BLOCKS]
        for i in unclosed:
            k = bisect_left(blocks, i)
            end = (blocks[k], tags[blocks[k]].start) if k < len(blocks) else (i + 1, tags[i].end)
            out[i] = min(end, limits.get(i, end), key=lambda e: e[1])
    return out


def parse(page: str) -> list[Node]:
    """Block elements of a page in document order, the root first; tolerates what is left open or crossed."""
    root = Node("html", "", None)
    nodes, stack = [root], [root]
    open_tags: Counter[str] = Counter()
    linked = False

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(piece)
            if linked:
                stack[-1].links += len(piece.strip())

    def close(k: int) -> None:
        for node in stack[k:]:
            open_tags[node.tag] -= 1
        del stack[k:]

    tags = tags_of(page)
    skips = left_out(tags) if any(tag.name in LEFT_OUT for tag in tags) else {}
    at = i = 0
    while i < len(tags):
        tag = tags[i]
        text(page[at : tag.start])
        at = tag.end
        name = tag.name
        i += 1
        if not name:
            continue
        if tag.closing:
            if name in INLINE:
                linked = linked and name != "a"
            elif open_tags[name]:
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                close(k)
                linked = False
            continue
        if name in INLINE:
            if name in ("br", "mtr", "mtd"):
                stack[-1].parts.append(" ")
            linked = linked or name == "a"
            continue
        if name in LEFT_OUT:
            i, at = skips[i - 1]
            continue
        if name in VOID or name in RAW or name == "head":
            stack[-1].parts.append(" ")
            continue
        if name == "html" or name == "body" and open_tags["body"]:
            target = root if name == "html" else next(n for n in stack if n.tag == "body")
            target.attrs += tag.attrs
            continue
        if name in CLOSES_P and open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "table", "div", "section", "article", "li"):
                    break
        if name in ENDS:
            ended, bounds = ENDS[name]
            if any(open_tags[x] for x in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in bounds:
                        break
                    if stack[k].tag in ended:
                        close(k)
                        break
        linked = False
        node = Node(name, tag.attrs, stack[-1])
        node.place = len(stack[-1].children)
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        nodes.append(node)
        if not _CLOSED.search(tag.attrs):
            stack.append(node)
            open_tags[name] += 1
    text(page[at:])
    return nodes


def _hints(node: Node) -> list[int]:
    out = [0] * len(GROUPS)
    if node.attrs:
        for m in ATTRIBUTE.finditer(node.attrs):
            for word in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()):
                k = _GROUP_OF.get(word)
                if k is not None:
                    out[k] = 1
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: its kind, place, subtree, attribute tokens and siblings."""
    n = len(nodes)
    at = {id(node): i for i, node in enumerate(nodes)}
    own, links, below, commas, paragraphs = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    depth, hints, over = [0] * n, [], []
    kinds = []
    for i, node in enumerate(nodes):
        piece = "".join(p for p in node.parts if isinstance(p, str)).strip()
        own[i], links[i] = len(piece), node.links
        commas[i] = piece.count(",") + piece.count(".")
        paragraphs[i] = int(node.tag == "p" and len(piece) > 40)
        kind = [int(node.tag in k) for k in KINDS]
        kinds.append(kind)
        h = _hints(node)
        hints.append(h)
        if node.parent is None:
            over.append([0] * (len(h) + len(kind)))
        else:
            up = at[id(node.parent)]
            depth[i] = depth[up] + 1
            over.append([a | b for a, b in zip(over[up], hints[up] + kinds[up])])
    whole = own[:]
    whole_links = links[:]
    for i in range(n - 1, 0, -1):
        up = at[id(nodes[i].parent)]
        for x in (whole, whole_links, below, commas, paragraphs):
            x[up] += x[i]
    total = max(whole[0], 1)
    rows = []
    alike = [Counter(x.tag for x in node.children) for node in nodes]
    for i, node in enumerate(nodes):
        if node.parent is None:
            siblings, place, share, same = 1, 0.0, 1.0, 1
        else:
            up = at[id(node.parent)]
            siblings = len(node.parent.children)
            place = node.place / siblings
            share = whole[i] / max(whole[up], 1)
            same = alike[up][node.tag]
        rows.append(
            (
                depth[i],
                np.log1p(own[i]),
                np.log1p(whole[i]),
                whole[i] / total,
                whole_links[i] / max(whole[i], 1),
                whole[i] / below[i],
                np.log1p(below[i]),
                commas[i] / max(whole[i], 1),
                np.log1p(paragraphs[i]),
                np.log1p(siblings),
                np.log1p(same),
                place,
                share,
                float(bool(node.attrs and HIDDEN.search(node.attrs))),
                *hints[i],
                *over[i],
                *kinds[i],
            )
        )
    return np.array(rows, np.float64)


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which each chosen node's ancestors are chosen too.

    ``odds`` are log-odds of each node alone. From the leaves up, a node is worth its own odds and
    what its children are worth when that is above nothing; a node left out takes its subtree along.
    """
    worth = odds.astype(float).tolist()
    at = {id(node): i for i, node in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[at[id(nodes[i].parent)]] += worth[i]
    chosen = [False] * len(nodes)
    for i, node in enumerate(nodes):
        chosen[i] = worth[i] > 0 and (node.parent is None or chosen[at[id(node.parent)]])
    return chosen


def text_of(nodes: list[Node], chosen: list[bool]) -> str:
    """Blocks of the chosen nodes' own text in page order, joined by one space."""
    taken = {id(node) for node, yes in zip(nodes, chosen) if yes}
    blocks: list[str] = []

    def walk(root: Node) -> None:
        run: list[str] = []
        todo: list = [iter(root.parts)]
        while todo:
            part = next(todo[-1], None)
            if isinstance(part, str):
                run.append(part)
                continue
            if run:
                blocks.append(html.unescape("".join(run)))
                run.clear()
            if part is None:
                todo.pop()
            elif id(part) in taken:
                todo.append(iter(part.parts))

    if chosen and chosen[0]:
        walk(nodes[0])
    return " ".join(" ".join(blocks).split())


# Training pages, made by rule from a seed: what is main text is known by construction.

_SYLLABLES = "the an er on re ti ing ou en st la de mi ver sch co que des pa lo ba ra nu fi".split()


def _maker(rng: random.Random):
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(a, b)))
    item = lambda: f"<li><a href='/{word()}'>{words(1, 4)}</a></li>"
    items = lambda a, b: "".join(item() for _ in range(rng.randint(a, b)))

    def attr(*choices: str) -> str:
        kind = rng.choice(["class", "id", "role", ""])
        value = rng.choice(choices)
        return f' {kind}="{value}"' if kind else ""

    def prose() -> str:
        size = rng.choice([(1, 6), (8, 30), (20, 120), (60, 250)])
        body = words(*size)
        if rng.random() < 0.25:
            body = f"{words(2, 8)} <a href='#'>{words(1, 5)}</a> {body}"
        if rng.random() < 0.2:
            body = f"<b>{body}" + rng.choice(["</b>", "<br>", ""])
        return body

    def block() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p data-main>{prose()}" + rng.choice(["</p>", "</p>", ""])
        if kind < 0.8:
            return f"<h2 data-main>{words(1, 8)}</h2>"
        if kind < 0.86:
            return "<ul data-main>" + "".join(f"<li data-main>{prose()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote data-main><p data-main>{prose()}</p></blockquote>"
        if kind < 0.93:
            return f"<div data-main>{prose()}</div>"
        if kind < 0.95:
            return f"<table data-main><tr data-main><td data-main>{words(1, 6)}</td><td data-main>{words(1, 6)}</td></tr></table>"
        if kind < 0.97:
            return f"<pre data-main>{words(4, 30)}</pre>"
        return rng.choice([advert, share, promo])()

    def advert() -> str:
        return f"<{(t := rng.choice(['div', 'aside', 'section']))}{rng.choice([' class=', ' id='])}'{rng.choice(['ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo-box', 'advertisement'])}'>{rng.choice([words(3, 30), '<p>' + words(3, 30) + '</p>'])}</{t}>"

    def share() -> str:
        return f"<div class='{rng.choice(['share', 'social-links', 'share-buttons', 'follow'])}'>{words(1, 3)} <ul>{items(2, 5)}</ul></div>"

    def promo() -> str:
        return f"<div class='{rng.choice(['related', 'newsletter', 'subscribe', 'more-stories', 'recommended'])}'><h3>{words(1, 4)}</h3>{rng.choice(['<ul>' + items(2, 6) + '</ul>', '<p>' + words(5, 25) + '</p>'])}</div>"

    def menu() -> str:
        body = f"<ul>{items(3, 12)}</ul>"
        if rng.random() < 0.65:
            return f"<nav{attr('', 'navbar', 'main-nav')}>{body}</nav>"
        return f"<div{rng.choice([' class=', ' id='])}'{rng.choice(['nav', 'menu', 'navigation', 'top-menu', 'breadcrumbs'])}'>{rng.choice([body, words(1, 3) + ' &gt; ' + words(1, 3)])}</div>"

    def head() -> str:
        body = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<div class='logo'>{words(1, 3)}</div>", f"<p>{words(2, 12)}</p>", words(1, 8)])
        body += menu() if rng.random() < 0.5 else ""
        if rng.random() < 0.7:
            return f"<header{attr('', 'site-header', 'masthead')}>{body}</header>"
        return f"<div{rng.choice([' class=', ' id='])}'{rng.choice(['header', 'site-header', 'masthead', 'top-banner'])}'>{body}</div>"

    def foot() -> str:
        body = rng.choice([f"&copy; {word()}.com &middot; {words(2, 12)}", f"<p>{words(3, 20)}</p>", f"<ul>{items(2, 8)}</ul><p>&copy; {words(2, 6)}</p>"])
        if rng.random() < 0.7:
            return f"<footer{attr('', 'site-footer')}>{body}</footer>"
        return f"<div{rng.choice([' class=', ' id='])}'{rng.choice(['footer', 'site-footer', 'copyright', 'legal'])}'>{body}</div>"

    def side() -> str:
        body = f"<h3>{words(1, 4)}</h3>" + rng.choice([f"<ul>{items(3, 10)}</ul>", f"<p>{words(5, 60)}</p>", advert()])
        if rng.random() < 0.6:
            return f"<aside{attr('', 'sidebar', 'related')}>{body}</aside>"
        return f"<div{rng.choice([' class=', ' id='])}'{rng.choice(['sidebar', 'side', 'right-rail', 'widget', 'widgets'])}'>{body}</div>"

    def notice() -> str:
        return f"<div{rng.choice([' class=', ' id='])}'{rng.choice(['cookie', 'cookie-banner', 'consent', 'notice', 'popup', 'alert', 'gdpr-notice'])}'>{rng.choice(['<p>' + words(5, 40) + '</p>', words(5, 40)])}{rng.choice(['', '<button>OK</button>'])}</div>"

    def form() -> str:
        body = f"<label>{words(1, 4)}</label><input name='q'><p>{words(2, 12)}</p><button>{word()}</button>"
        return f"<form{attr('', 'search', 'login', 'subscribe')}>{body}</form>"

    def comments() -> str:
        one = lambda: rng.choice(
            [f"<div class='comment'><p>{prose()}</p></div>", f"<li class='comment'>{prose()}</li>", f"<article class='comment'><p>{prose()}</p></article>", f"<p>{prose()}</p>"]
        )
        body = f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 8)))
        tag = rng.choice(["section", "div", "ol", "aside"])
        return f"<{tag}{rng.choice([' class=', ' id='])}'{rng.choice(['comments', 'comment-list', 'discussion', 'replies', 'respond', 'reader-comments'])}'>{body}</{tag}>"

    def page() -> str:
        title = words(3, 12)
        h1 = f"<h1 data-main>{title}</h1>" if rng.random() < 0.85 else ""
        core = h1 + "".join(block() for _ in range(rng.choice([1, 2, 4, 8, 16, 30])))
        if rng.random() < 0.12:
            core += comments()
        opening, closing = rng.choice(
            [("<article data-main>", "</article>")] * 4
            + [("<main data-main>", "</main>"), ("<main data-main><article data-main>", "</article></main>")]
            + [(f"<div data-main class='{c}'>", "</div>") for c in ("content", "post", "entry-content", "article-body", "main", "story", "wrapper", "col-8")]
            + [("<section data-main>", "</section>"), ("<div data-main id='content'><div data-main>", "</div></div>"), ("", "")]
        )
        core = opening + core + closing
        before = [f() for f, p in ((head, 0.6), (menu, 0.7), (advert, 0.5), (notice, 0.35), (form, 0.2), (side, 0.15)) if rng.random() < p]
        after = [f() for f, p in ((comments, 0.35), (promo, 0.25), (side, 0.35), (form, 0.25), (advert, 0.3), (notice, 0.15), (share, 0.2), (foot, 0.85)) if rng.random() < p]
        if rng.random() < 0.6:
            rng.shuffle(before)
        body = "".join(before) + core + "".join(after)
        if rng.random() < 0.25:
            body = f"<div data-main class='{rng.choice(['page', 'container', 'wrap', 'site'])}'>{body}</div>"
        end = rng.choice(["</body></html>", "</body></html>", ""])
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}{end}"

    return page


def training_pages(n: int = 400, seed: int = 3) -> list[str]:
    """Pages whose main nodes carry the attribute ``data-main``."""
    rng = random.Random(seed)
    page = _maker(rng)
    return [page() for _ in range(n)]


def train(pages: list[str] | None = None, rounds: int = 40) -> Boosted:
    """Boosted trees on nodes of labelled pages; ancestors of main nodes are main."""
    rows, labels = [], []
    for page in training_pages() if pages is None else pages:
        nodes = parse(page)
        for node in nodes:
            if "data-main" in node.attrs:
                up: Node | None = node
                while up is not None and not up.marked:
                    up.marked = True
                    up = up.parent
        rows.append(features(nodes))
        labels += [float(node.marked) for node in nodes]
    return boost(np.concatenate(rows), np.array(labels), rounds=rounds)


@cache
def default_model() -> Boosted:
    """The trees of the made-up pages; they depend on no data, so a driver trains them once."""
    return train()


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main text of each page."""
    out: list[str] = []
    for at in range(0, len(pages), 64):
        trees = [parse(page) for page in pages[at : at + 64]]
        if not trees:
            break
        tables = [features(nodes) for nodes in trees]
        odds = model.predict(np.concatenate(tables))
        ends = np.cumsum([len(t) for t in tables])
        for nodes, part in zip(trees, np.split(odds, ends[:-1])):
            out.append(text_of(nodes, decode(nodes, part)))
    return out


def extract_main_text(
    pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col, url_col, text, n_chars``, a row for each row of ``pages``.

    Each block element is a node; trees trained here give its log-odds of holding main text, and the
    decoding along the tree never takes a node whose ancestor is left out. Null and empty pages, and
    such without main text, give an empty text. Character references are decoded, white space within
    and between blocks is one space. Repeated rows are extracted apiece; an empty table gives an
    empty one; other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(default_model() if model is None else model)

    @F.arrow_udf("string")
    def main_text(page: pa.Array) -> pa.Array:
        return pa.array(extract([x or "" for x in page.to_pylist()], sent.value), pa.string())

    found = pages.select(column(id_col).alias(id_col), column(url_col).alias(url_col), main_text.asNondeterministic()(column(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
