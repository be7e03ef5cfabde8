"""Main text of web pages by a tree-structured graphical model (operator 1).

The block elements of a page are the nodes of a tree, each content or not.  A
node's own potential comes from its element, the words of its class, id and
role, the words of a short text, the amount, links and punctuation of its text,
its share of the page's and of its parent's, and its place; a potential between
parent and child comes from how often labelled pages go from one to the other.
Sum-product messages, once upward and once downward, give each node's marginal,
and the text of nodes with a marginal of one half or more is kept.

Both potentials are trained in numpy from labelled pages: layouts that are laid
out here, with labels, from fixed kinds of content and of everything around it.
In a part of them the marks of elements are absent or say nothing, content
stands in the body itself, or is nested or split, so that text, links and place
must tell as well.

A block of text ends where a block element starts or ends.  Pages may be cut
off anywhere and hold unclosed or stray tags.

Defined results: null html has an empty text, and so has a page without
content; repeated rows get equal results; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by kind.
BLOCKS = set("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre article section main header footer nav aside form fieldset figure figcaption address details summary dialog menu center hr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template title textarea xmp iframe svg math object select option button canvas audio video datalist".split())
RAW = set("script style title textarea xmp iframe noscript".split())
#: An open element of the value is closed by the start of the key.
CLOSES = {**{t: {"p"} for t in BLOCKS - {"html", "body"}}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: ... but not beyond these.
SCOPES = set("table ul ol dl div article section main header footer nav aside form body html td th blockquote".split())

#: A tag; one whose quotes do not close ends at the next >.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']++|"[^"]*"|'[^']*')*+)(>|\Z)|([^>]*)(>|\Z))|<[!?][^>]*(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_LONG_WORD = re.compile(r"[^\W\d_]{5,}|©")
#: A text of so many characters at most is looked at word by word.
SHORT = 160
_SENTENCE = re.compile(r"[.!?…:][\"'”»)]*\s*$")


@dataclass
class Node:
    tag: str
    parent: int
    marks: tuple[str, ...]
    before: int  # characters of text in front of it
    texts: list[int] = field(default_factory=list)  # places of its blocks
    own: int = 0
    own_links: int = 0
    sentences: int = 0
    all: int = 0  # with all nodes below it
    all_links: int = 0
    all_blocks: int = 0
    words: tuple[str, ...] = ()  # of its text, if that is short
    under: tuple[str, ...] = ()  # marks of the nearest element around it that has any


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # node and text, in page order


class _Open:
    """The open elements, with the node that holds what is in each; every look-up is by the element's own list of places."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.scopes: list[int] = [0]
        self.links = self.unseen = 0

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN
        self.stack.append((tag, node))

    def close(self, k: int) -> None:
        """The element at place k and all behind it."""
        for tag, _ in reversed(self.stack[k:]):
            self.places[tag].pop()
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
        del self.stack[k:]
        while self.scopes[-1] >= k:
            self.scopes.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost element of that name, or 0."""
        return (self.places.get(tag) or [0])[-1]

    def end(self, tag: str) -> int:
        """The place that an end tag closes, or 0: an inline element does not reach beyond its block."""
        k = self.last(tag)
        return k if tag in BLOCKS or k > self.scopes[-1] else 0

    def give_way(self, ends: set[str]) -> None:
        """What the start of a block closes: the named elements, up to the next scope."""
        while (k := max(map(self.last, ends))) and self.scopes[-1] <= k:
            self.close(k)


def parse(page: str) -> Page:
    nodes, blocks = [Node("html", -1, (), 0)], []
    opened = _Open()
    held: list[str] = []
    linked = told = 0

    def flush() -> None:
        nonlocal linked, told
        if held:
            text = " ".join("".join(held).split())
            if text:
                node = nodes[opened.stack[-1][1]]
                node.texts.append(len(blocks))
                node.own += len(text)
                node.own_links += min(linked, len(text))
                node.sentences += bool(_SENTENCE.search(text))
                if len(text) <= SHORT:
                    node.words += tuple(w for w in _LONG_WORD.findall(text.lower()))
                told += len(text)
                blocks.append((opened.stack[-1][1], text))
            held.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not opened.unseen:
            if "&" in text:
                text = html.unescape(text)
            held.append(text)
            if opened.links:
                linked += len(text)

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        m = _TAG.match(page, start)
        if not m:
            say("<")
            at = start + 1
            continue
        at = m.end()
        if not m[2] or not (m[4] or m[6]):  # a comment, a declaration, or a tag that the end of the page cuts off
            continue
        tag, rest = m[2].lower(), m[3] if m[3] is not None else m[5]
        if m[1]:
            if k := opened.end(tag):
                if tag in BLOCKS:
                    flush()
                opened.close(k)
            continue
        if tag == "br":
            say(" ")
        if tag in BLOCKS:
            flush()
            if ends := CLOSES.get(tag):
                opened.give_way(ends)
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
            continue
        if tag in ("html", "body") and len(nodes) > 1 and len(opened.places.get(tag, ())) > (tag == "html"):
            continue
        node = opened.stack[-1][1]
        if tag in BLOCKS and not opened.unseen:
            marks = tuple(w for x in _MARKS.findall(rest) for w in _TOKEN.findall(x.lower())) if rest else ()
            nodes.append(Node(tag, node, marks, told, under=nodes[node].marks or nodes[node].under))
            node = len(nodes) - 1
        opened.push(tag, node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            opened.close(len(opened.stack) - 1)
    flush()
    for node in reversed(nodes):
        node.all += node.own
        node.all_links += node.own_links
        node.all_blocks += len(node.texts)
        if node.parent >= 0:
            up = nodes[node.parent]
            up.all += node.all
            up.all_links += node.all_links
            up.all_blocks += node.all_blocks
    return Page(nodes, blocks)


_SIZES = (1, 25, 80, 200)
_SHARES = (0.02, 0.1, 0.3, 0.6, 0.9)
_LENGTHS = (15, 40, 90, 200)


def _bands(page: Page) -> list[tuple[int, ...]]:
    """Of every node: text, blocks, sentences, links, length, share of page and parent, place, what is behind it, and its siblings of the same name."""
    nodes = page.nodes
    own, every, links, blocks, sentences, before, parent = np.array([(x.own, x.all, x.all_links, x.all_blocks, x.sentences, x.before, max(x.parent, 0)) for x in nodes], float).T
    parent = parent.astype(int)
    total = max(1.0, every[0])
    names = {}
    kind = np.array([names.setdefault((x.parent, x.tag), len(names)) for x in nodes])
    alike = np.bincount(kind)[kind]
    band = lambda x, edges: np.searchsorted(edges, x, "right").tolist()
    return list(zip(
        band(own, _SIZES), np.minimum(blocks, 3).astype(int).tolist(), np.minimum(sentences, 2).astype(int).tolist(), band(links / np.maximum(1, every), (0.01, 0.2, 0.5, 0.9)),
        band(every / np.maximum(1, blocks), _LENGTHS), band(every / total, _SHARES), band(every / np.maximum(1, every[parent]), _SHARES),
        band(before / total, (0.001, 0.05, 0.5, 0.9)), band((total - before - every) / total, (0.001, 0.05, 0.5)), band(alike, (2, 3, 6)),
    ))


def _shape(tag: str, parent: str, marked: bool, bands: tuple[int, ...]) -> list[str]:
    text, blocks, sentences, links, length, share, of_parent, place, behind, alike = bands
    return [
        f"share {share} {blocks}", f"tag {tag} {text}", f"in {parent}", f"tag {tag} in {parent}", f"marked {marked} {tag}", f"text {text} {sentences}", f"links {links} {blocks}", f"share {share}", f"length {length}", f"links {links} length {length}",
        f"of parent {of_parent}", f"place {place}", f"behind {behind}", f"alike {alike} {tag}", f"sentences {sentences} length {length} links {links > 0}", f"behind {behind} sentences {sentences}", f"place {place} links {links > 1}",
    ]


def _told(x: Node) -> set[str]:
    """What a node's marks and words, and the marks around it, say."""
    return {*(f"mark {w}" for w in x.marks), *(f"word {w}" for w in x.words), *(f"under {w}" for w in x.under)}


def features(page: Page) -> list[list[str]]:
    """Of every node."""
    return [
        [*_shape(x.tag, page.nodes[x.parent].tag if x.parent >= 0 else "", bool(x.marks), bands), *_told(x)]
        for x, bands in zip(page.nodes, _bands(page))
    ]


#: Parents' and children's states meet in these kinds of children.
_KIND = {**dict.fromkeys("nav footer header aside form menu".split(), "around"), **dict.fromkeys("article main".split(), "article"), **dict.fromkeys("div section table ul ol dl".split(), "group")}


def kind_of(node: Node) -> str:
    return _KIND.get(node.tag, "text") + (" marked" if node.marks else "")


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    moves: dict[str, tuple[tuple[float, float], tuple[float, float]]]  # by kind: [parent's state][child's state]
    shapes: dict[tuple, float] = field(default_factory=dict)  # sums of weights that were made before

    def potential(self, x: Node, parent: str, bands: tuple[int, ...]) -> float:
        key = (x.tag, parent, bool(x.marks), bands)
        z = self.shapes.get(key)
        if z is None:
            if len(self.shapes) > 200_000:
                self.shapes.clear()
            z = self.shapes[key] = self.bias + sum([self.weights.get(f, 0.0) for f in _shape(*key)])
        if x.marks or x.words or x.under:
            z += sum([self.weights.get(f, 0.0) for f in _told(x)])
        return 1 / (1 + math.exp(-max(-20.0, min(20.0, z))))

    def marginals(self, page: Page) -> list[float]:
        nodes = page.nodes
        own, up, down = [], [(1.0, 1.0)] * len(nodes), [(1.0, 1.0)] * len(nodes)
        for x, bands in zip(nodes, _bands(page)):
            p = self.potential(x, nodes[x.parent].tag if x.parent >= 0 else "", bands)
            own.append((1 - p, p))
        moves = [self.moves.get(kind_of(x)) or ((0.5, 0.5), (0.5, 0.5)) for x in nodes]
        gathered = list(own)  # own potential times the messages of children
        for k in range(len(nodes) - 1, 0, -1):
            (g0, g1), (a, b) = gathered[k], moves[k]
            m0, m1 = a[0] * g0 + a[1] * g1, b[0] * g0 + b[1] * g1
            s = m0 + m1
            up[k] = (m0 / s, m1 / s)
            h = gathered[nodes[k].parent]
            h0, h1 = h[0] * up[k][0], h[1] * up[k][1]
            s = h0 + h1
            gathered[nodes[k].parent] = (h0 / s, h1 / s)
        out = [0.0] * len(nodes)
        for k, x in enumerate(nodes):
            if x.parent >= 0:
                p, (a, b) = x.parent, moves[k]
                # all that the parent knows, but for what this child told it
                q0, q1 = gathered[p][0] * down[p][0] / max(up[k][0], 1e-300), gathered[p][1] * down[p][1] / max(up[k][1], 1e-300)
                d0, d1 = a[0] * q0 + b[0] * q1, a[1] * q0 + b[1] * q1
                s = d0 + d1
                down[k] = (d0 / s, d1 / s)
            b0, b1 = gathered[k][0] * down[k][0], gathered[k][1] * down[k][1]
            out[k] = b1 / (b0 + b1)
        return out

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        parsed = parse(page)
        keep = self.marginals(parsed)
        return "\n".join([text for node, text in parsed.blocks if keep[node] >= 0.5])


# ---- labelled pages ----

# How pages mark what is content and what is around it.
_CONTENT = ['<article>', '<main>', '<div class="content">', '<div id="content">', '<div class="post">', '<div class="article-body">', '<section class="entry-content">', '<div id="main-text">', '<div class="story">', '<article class="post hentry">', '<td class="content">', '<div role="main">', '<article class="article">', '<div class="post-content">', '<div class="body-text">']
_AROUND = {
    "menu": ['<nav>', '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<nav class="navbar">', '<div class="breadcrumb">', '<div class="topbar">', '<div role="navigation">', '<div class="pagination">', '<ol class="breadcrumbs">', '<div class="tabs">'],
    "head": ['<header>', '<div id="header">', '<div class="site-header">', '<header class="masthead">', '<div class="logo">', '<div class="banner">', '<div role="banner">'],
    "foot": ['<footer>', '<div id="footer">', '<div class="footer">', '<div class="copyright">', '<footer class="site-footer">', '<div class="legal">', '<div role="contentinfo">'],
    "side": ['<aside>', '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="related">', '<div class="recommended">', '<div class="trending">', '<div class="tags">', '<div class="author-bio">', '<div role="complementary">'],
    "notice": ['<div class="cookie">', '<div class="notice">', '<div id="cookie-consent">', '<div class="alert">', '<div class="popup">', '<div class="modal">', '<div class="gdpr">', '<p class="notice">', '<div class="disclaimer">', '<div role="alert">', '<div class="message">', '<div class="warning">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div id="ad-top">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div class="sponsor">', '<p class="ad">'],
    "form": ['<form>', '<form class="search">', '<div class="newsletter">', '<div class="subscribe">', '<form id="login">', '<div class="signup">', '<div class="share">', '<div class="social">', '<div role="search">', '<div class="contact-form">'],
    "comments": ['<ul class="comments">', '<ul id="comments">', '<ol class="comment-list">', '<ul class="comment-thread">', '<div class="comments">', '<section id="comments">', '<div id="respond">', '<div class="comment-list">', '<ol class="commentlist">', '<div class="comment">', '<div class="replies">', '<section class="reader-comments">', '<div class="discussion">', '<div id="disqus-thread">', '<section class="comments">'],
}


# What pages say around their content.
_SAID = {
    "menu": ["Home", "About us", "Contact", "Products", "Archive", "Services"],
    "head": ["Welcome", "Search", "Menu", "Language"],
    "foot": ["Copyright 2024", "© 2023", "All rights reserved.", "Terms of service", "Privacy policy", "Imprint", "Powered by"],
    "side": ["Related articles", "Read more", "Popular posts", "Categories", "Recent posts", "About the author"],
    "notice": ["We use cookies to improve this website.", "Accept all cookies", "Please enable JavaScript.", "Your browser is outdated.", "Cookie settings"],
    "advert": ["Advertisement", "Sponsored", "Special offer", "Order today"],
    "form": ["Subscribe to our newsletter", "Enter your email address", "Password", "Log in", "Sign up", "Share this article", "Follow us on"],
    "comments": ["Comments", "Leave a comment", "Reply", "Responses", "says:"],
}
#: Marks that tell nothing.
_NEUTRAL = "row col box wrap inner outer left right block item module grid cell panel unit card".split()
_SYLLABLES = [a + b for a in "b c d f g h l m n p r s t v br st tr".split() for b in "a e i o u é en ar".split()]


def _close(tag: str) -> str:
    return f"</{re.match('<([a-z]+)', tag)[1]}>"


def labelled_pages(n: int, seed: int = 5, content_marks: list[str] = _CONTENT, around_marks: dict[str, list[str]] = _AROUND) -> Iterator[tuple[str, set[str]]]:
    """Pages, and for each the texts that are content; all texts of a page differ.

    Two pages in five have marks that say nothing, or none; one in five has no
    container at all, and some have two, or one within another.
    """
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    number = 0

    def words(low: int, high: int, end: str = ".") -> str:
        nonlocal number
        number += 1
        made = ["".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high)))]
        return f"{' '.join(made).capitalize()} {number}{end}"

    def inline(text: str) -> str:
        if chance(0.2):
            a, _, b = text.partition(" ")
            return f'<{(t := pick(["b", "em", "a", "span"]))}>{a}</{t}> {b}' if b else text
        return text

    def dull(names: list[str]) -> str:
        r = rng.random()
        mark = "" if r < 0.4 else f' class="{pick(_NEUTRAL)}"' if r < 0.7 else f' class="{pick(_SYLLABLES)}{pick(_SYLLABLES)}-{int(rng.integers(99))}"' if r < 0.9 else f' id="{pick(_SYLLABLES)}{pick(_SYLLABLES)}"'
        return f"<{pick(names)}{mark}>"

    def around(kind: str, marked: bool) -> str:
        tag = pick(around_marks[kind]) if marked else dull(["ul", "div"] if kind == "menu" else ["div", "div", "p", "section"])
        nonlocal number
        said = not marked or chance(0.4)  # an unmarked one shows by its words, links or fields

        def short(low: int = 1, high: int = 4) -> str:
            nonlocal number
            number += 1
            return f"{pick(_SAID[kind])} {number}" if said and chance(0.7) else words(low, high, "")

        link = lambda t: f"<a href=/x>{t}</a>"
        if kind == "menu" or tag.startswith(("<ul", "<ol")) or kind == "side" and (not marked or chance(0.6)):
            if kind == "comments":
                body = "".join(pick(["<li>{}</li>", "<li><p>{}</p></li>", '<li class="comment"><p>{}</p></li>', "<li><b>Name</b> {}</li>", "<li><div>{}</div></li>"]).format(words(2, 30)) for _ in range(int(rng.integers(1, 6))))
            else:
                items = [link(short() + "." * int(chance(0.1))) for _ in range(int(rng.integers(1, 9)))]
                body = "".join(f"<li>{x}</li>" for x in items) if tag.startswith(("<ul", "<ol")) or chance(0.7) else pick([" ", " | ", " - "]).join(items)
                if body.startswith("<li") and not tag.startswith(("<ul", "<ol")):
                    body = (f"<h3>{short()}</h3>" if kind == "side" and chance(0.6) else "") + f"<ul>{body}</ul>"
        elif kind == "comments":
            body = (f"<h3>{short()}</h3>" if said or chance(0.5) else "") + "".join(pick(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<div>{}</div>", '<article class="comment"><p>{}</p></article>'] if marked else ["<p>{}</p>", "<div>{}</div>"]).format(words(4, 60)) for _ in range(int(rng.integers(1, 5))))
        elif kind == "form":
            body = f'<label>{short()}</label><input name="q"><p>{short(3, 12)}</p><button>ok</button>'
        elif not marked:
            body = pick(["{}", "<p>{}</p>", "<span>{}</span>"]).format(". ".join(f"{pick(_SAID[kind])} {(number := number + 1)}" for _ in range(int(rng.integers(1, 4)))) if not tag.startswith("<p") else f"{pick(_SAID[kind])} {(number := number + 1)}")
            if tag.startswith("<p"):
                body = re.sub("</?p>", "", body)
            if kind == "foot" and chance(0.3):
                body = f"© {words(1, 3, '')} · {words(2, 20)}"
        else:
            text = words(2, 40) if kind in ("notice", "advert", "side", "foot") else words(1, 8, "")
            if kind == "foot" and chance(0.3):
                text = f"© {words(1, 3, '')} · {text}"
            body = pick(["{}", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>"]).format(f"{short()} {text}" if said else text)
        return tag + body + _close(tag)

    for _ in range(n):
        content: set[str] = set()
        plain, marked, loose = chance(0.25), chance(0.6), chance(0.1)
        alone = chance(0.25)  # nothing stands around it

        def block(low: int = 1, high: int = 90) -> str:
            text = words(low, high)
            content.add(text)
            return inline(text)

        brief = chance(0.15)  # a short article, with as much around it as any other

        def parts(inside: bool) -> list[str]:
            out = [f"<h1>{block(1, 12)}</h1>"] if chance(0.5 if brief else 0.8) else []
            if out and chance(0.25) and inside:
                out[0] = f"<header>{out[0]}</header>"
            if brief or chance(0.9):
                out.append(f"<p>{block(3, 15) if brief else block(8, 90)}</p>")
            for _ in range(0 if brief else int(rng.integers(0, 9))):
                r = rng.random()
                if r < 0.7:
                    out.append(f"<p>{block()}{pick(['</p>', '</p>', ''])}")
                elif r < 0.78:
                    out.append(f"<h2>{block(1, 8)}</h2>")
                elif r < 0.86:
                    out.append("<ul>" + "".join(f"<li>{block(1, 15)}</li>" for _ in range(3)) + "</ul>")
                elif r < 0.9:
                    out.append(f"<blockquote><p>{block()}</p></blockquote>")
                elif r < 0.94:
                    out.append("<table><tr>" + "".join(f"<td>{block(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
                else:
                    out.append(f"<div>{block()}</div>")
            for kind in ("advert", "form", "comments", "notice", "side"):
                if inside and chance(0.5 if brief and kind == "comments" else 0.12):
                    out.insert(len(out) if kind == "comments" else int(rng.integers(0, len(out) + 1)), around(kind, True))
            return out

        if loose:  # text without any element, or a few paragraphs and nothing else
            some = block(1, 3 if chance(0.6) else 90) if chance(0.5) else "".join(f"<p>{block(1, 3 if chance(0.3) else 60)}</p>" for _ in range(int(rng.integers(1, 4))))
            yield pick(["{}", "{}", "<body>{}", "<html><body>{}</body></html>"]).format(some), content
            continue
        containers = []
        for _ in range(2 if chance(0.08) else 1):
            some = parts(marked)
            if plain:
                containers.append("".join(some))
                continue
            if chance(0.15):  # in sections of its own
                cut = int(rng.integers(0, len(some) + 1))
                some = [f"{(t := dull(['div', 'section']))}{''.join(x)}{_close(t)}" for x in (some[:cut], some[cut:]) if x]
            tag = pick(content_marks) if marked else dull(["div", "div", "section", "article"])
            inner = tag + "".join(some) + _close(tag)
            if chance(0.08):
                inner = f"{(t := dull(['div']))}{inner}</div>"
            containers.append(f"<table><tr>{inner}</tr></table>" if tag.startswith("<td") else inner)
        if chance(0.1):  # a table lays the page out, with the menu in a cell
            links = [f"<a href=/x>{words(1, 3, '')}</a>" for _ in range(int(rng.integers(2, 9)))]
            menu = pick([" ".join(links), " | ".join(links), "<br>".join(links), "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"])
            cells = [f"{dull(['td'])}{menu}</td>", f"{dull(['td'])}{''.join(containers)}</td>"]
            containers = [f"<table><tr>{''.join(cells if chance(0.8) else cells[::-1])}</tr></table>"]
        silent = not marked or plain
        before = [around(k, not silent or chance(0.3)) for k in ("head", "menu", "notice", "advert", "form") if chance(0.45) and not alone and not (silent and k == "head")]
        after = [around(k, not silent or k == "comments" or chance(0.3)) for k in ("comments", "side", "advert", "foot", "form", "menu") if chance(0.45) and not alone]
        body = "".join([*before, *containers, *after])
        for _ in range(0 if plain else int(rng.integers(0, 3))):
            body = f'<div class="{pick(["page", "wrapper", "container", "site", "row", "layout"])}">{body}</div>'
        yield f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>", content


def train(n: int = 2000, seed: int = 5, rounds: int = 200, rate: float = 0.1, decay: float = 2e-4, pages: Iterator[tuple[str, set[str]]] | None = None) -> Model:
    """Potentials from n labelled pages."""
    rows, states, moves, held = [], [], Counter(), Counter()
    for page, content in pages or labelled_pages(n, seed):
        parsed = parse(page)
        kept = {node for node, text in parsed.blocks if text in content}
        state = [0] * len(parsed.nodes)
        empty = [not x.texts for x in parsed.nodes]
        # a node without text of its own is content if all nodes with text below it are, but for notices and the like between them
        total, good = [0] * len(state), [0] * len(state)
        for k in range(len(state) - 1, -1, -1):
            total[k] += len(parsed.nodes[k].texts)
            good[k] += len(parsed.nodes[k].texts) * (k in kept)
            if k:
                total[parsed.nodes[k].parent] += total[k]
                good[parsed.nodes[k].parent] += good[k]
        seen = features(parsed)
        for k, x in enumerate(parsed.nodes):
            first = x.tag in ("article", "main") or bool({"content", "post", "entry", "story", "article", "main", "body"} & set(x.marks))
            state[k] = int(k in kept or empty[k] and good[k] > 0 and (good[k] == total[k] or first and good[k] * 2 >= total[k]))
            rows.append(seen[k])
            held.update(set(seen[k]))
            states.append(state[k])
            if x.parent >= 0:
                moves[kind_of(x), state[x.parent], state[k]] += 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in held.items() if c >= 10))}
    rows = [[names[f] for f in r if f in names] for r in rows]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.array([c for r in rows for c in r])
    y = np.array(states, float)
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(1, rounds + 1):
        z = b + np.bincount(at, w[columns], len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(columns, e[at], len(names)) + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    # an own potential must not repeat what the moves say: the share of content is taken out of it
    share = y.mean()
    kinds = {k for k, _, _ in moves}
    table = {}
    for kind in kinds:
        lines = []
        for s in (0, 1):
            c = [moves[kind, s, t] + 1.0 for t in (0, 1)]
            lines.append((c[0] / sum(c), c[1] / sum(c)))
        table[kind] = tuple(lines)
    return Model({f: float(w[i]) for f, i in names.items()}, float(b - math.log(share / (1 - share))), table)


@functools.cache
def trained() -> Model:
    """The model of the default settings, once in a process."""
    return train()


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [held.value.text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(make, "page_id long, url string, text string")
