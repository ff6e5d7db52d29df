"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is read into leaf blocks: the text between block-level tags, with the path
of open elements above it. Features are the ancestors' tag names and the words of
their class, id and role attributes, and figures of the text (length, links,
marks). The labels are main and other; transitions are learned; decoding is
Viterbi. Training pages are composed from templates whose parts are labelled, in
``training_pages``; no text of a page reaches the features, so the words
that fill them do not matter.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import kept, prepare

#: What may end a start tag, or open a quoted value in it.
TAG_STOP = re.compile(r">|=\s*+([\"'])")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|["']?([^\s"'>]++))""")
NAME = re.compile(r"[a-z]+")
HASHES = 1 << 13

#: HTML element kinds.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose text is left out while they are open; their end tags may be missing.
HIDDEN = frozenset("noscript template svg select option button object canvas".split())
#: An element that the start of a key's element closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: How training pages place their article and its surroundings.
LAYOUTS = ("article", "main", "div", "table", "nested", "sections", "blog", "plain", "bare")
#: Deeper elements are borne but not named in paths.
DEEPEST = 512
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def tags(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, tag in lower case, attributes, kind) in page order, kind being ``open``,
    ``close``, ``self`` for a start tag that ends in a slash, or ``end`` for the last text.

    One pass: no place is looked at twice. Comments, declarations and what raw elements
    (scripts, styles, titles) hold are left out; a raw element without end tag goes to the page's end, a
    title or text field without one to the next tag, and a tag without an end is left out. A quoted value without a
    closing quote, or one that closes in the midst of another tag, ends at the first ``>``.
    """
    at, text, last = 0, 0, {q: html.rfind(q) for q in ("'", '"')}
    absent: set[str] = set()
    foreign = 0  # drawings and formulas that are open: only there a raw element ends with its slash
    before: list[str] = []

    def said(upto):
        before.append(html[text:upto])
        out = "".join(before)
        before.clear()
        return out

    while True:
        i = html.find("<", at)
        if i < 0:
            yield said(len(html)), "", "", "end"
            return
        after = html[i + 1 : i + 2]
        closing = after == "/"
        name = TAG_NAME.match(html, i + 1 + closing)
        if name is None:
            if html.startswith("<!--", i):
                end = i + 5 if html.startswith(">", i + 4) else i + 6 if html.startswith("->", i + 4) else html.find("-->", i + 4) + 3
                end = end if end > 2 else len(html)
            elif after in ("!", "?") or closing and i + 2 < len(html):
                end = html.find(">", i) + 1 or len(html)
            else:
                at = i + 1
                continue
            before.append(html[text:i])
            at = text = end
            continue
        k = name.end()
        while True:
            stop = TAG_STOP.search(html, k)
            if stop is None:  # no tag can end any more
                before.append(html[text:i])
                text = len(html)
                yield said(text), "", "", "end"
                return
            if stop[1] is None:
                end = stop.end()
                break
            quote = stop.end() - 1
            if quote >= last[stop[1]]:
                k = quote + 1
                continue
            k = html.index(stop[1], quote + 1) + 1
            if html[k : k + 1] not in ("", ">", "/", " ", "\n", "\t", "\r", "\f"):
                inner = html.find(">", quote, k)
                if 0 <= inner < html.find("<", quote, k):
                    end = inner + 1
                    break
        tag, attributes = name[0].lower(), html[name.end() : end - 1]
        slash = attributes.endswith("/")
        words = said(i)
        at = text = end
        yield words, tag, attributes, "close" if closing else "self" if slash else "open"
        if tag in ("svg", "math"):
            foreign = max(0, foreign - 1) if closing else foreign + (not slash)
        elif tag in ENDS_P:
            foreign = 0
        if tag in RAW and not closing and not (slash and foreign):
            close = None if tag in absent else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if close:
                at = text = close.start()
            elif tag in ("title", "textarea"):
                absent.add(tag)
                at = text = html.find("<", at) if html.find("<", at) >= 0 else len(html)
            else:
                at = text = len(html)


class _Leaves:
    """Leaf blocks of one page as its tags come."""

    def __init__(self):
        self.out: list[tuple[str, list[str], int]] = []
        self.stack: list[tuple[str, str]] = []
        self.open: Counter = Counter()
        # open hidden elements: place on the stack, what was there before them, whether
        # a block-level tag has shown their text, which goes if their end tag comes
        self.hidden: list[list] = []
        self.parts: list[str] = []
        self.linked = 0
        self.link: int | None = None  # elements open where the link that is open began
        self.path: list[str] | None = None

    def push(self, tag, words):
        self.stack.append((tag, words))
        self.open[tag] += 1
        if len(self.stack) <= DEEPEST:
            self.path = None

    def cut(self, place):
        for tag, _ in self.stack[place:]:
            self.open[tag] -= 1
        del self.stack[place:]
        if place < DEEPEST:
            self.path = None
        if self.link is not None and place < self.link:
            self.link = None

    def block(self, parts, linked, upto=None):
        text = " ".join("".join(parts).split())
        if text:
            if upto is not None:
                path = [s[1] for s in self.stack[: min(upto, DEEPEST)] if s[1]]
            else:
                if self.path is None:
                    self.path = [s[1] for s in self.stack[:DEEPEST] if s[1]]
                path = self.path
            self.out.append((text, path, linked))

    def end_block(self):
        first = len(self.hidden)
        while first and not self.hidden[first - 1][-1]:
            first -= 1
        for h in self.hidden[first:]:
            if h[2]:
                self.block(h[2], h[3], h[0])
            h[-1] = True
        if self.parts:
            self.block(self.parts, self.linked)
            self.parts = []
        self.linked = 0

    def hide(self, tag):
        self.hidden.append([len(self.stack), len(self.out), self.parts, self.linked, self.link, False])
        self.push(tag, "")
        self.parts, self.linked = [], 0

    def leave(self, k):
        """Back to what was before the hidden element number k."""
        place, blocks, self.parts, self.linked, link, _ = self.hidden[k]
        self.cut(place)
        self.link = link
        del self.out[blocks:], self.hidden[k:]

    def add(self, text):
        if text and (not self.hidden or self.hidden[-1][-1]):
            text = unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.link is not None:
                self.linked += len(text)

    def close(self, tag):
        if tag == "a":
            self.link = None
        if tag in INLINE:
            return
        if tag in HIDDEN and self.open[tag]:
            k = next((k for k in range(len(self.hidden) - 1, -1, -1) if self.stack[self.hidden[k][0]][0] == tag), None)
            if k is not None:
                self.leave(k)
                return
        self.end_block()
        if self.open[tag]:
            place = len(self.stack) - 1
            while self.stack[place][0] != tag:
                place -= 1
            self.cut(place)
        while self.hidden and self.hidden[-1][0] >= len(self.stack):
            self.hidden.pop()

    def start(self, tag, attributes, slash):
        top = self.stack[-1][0] if self.stack else None
        if tag in ("button", "option", "optgroup") and top == ("option" if tag == "optgroup" else tag) and self.hidden and self.hidden[-1][0] == len(self.stack) - 1:
            if self.hidden[-1][-1]:
                self.cut(len(self.stack) - 1)
                self.hidden.pop()
            else:
                self.leave(len(self.hidden) - 1)
        if tag in HIDDEN:
            if not slash:
                self.hide(tag)
            return
        if tag in INLINE:
            if tag == "a":
                self.link = len(self.stack)
            return
        self.end_block()
        if tag in VOID:
            return
        if tag in CLOSES or tag in ENDS_P:
            place = len(self.stack)
            while place and (self.stack[place - 1][0] in CLOSES.get(tag, ()) or (tag in ENDS_P and self.stack[place - 1][0] == "p")):
                place -= 1
            if place < len(self.stack):
                self.cut(place)
        words = [f"<{tag}>"]
        if attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    words += NAME.findall((a or b or c).lower())
        self.push(tag, " ".join(words))


def blocks_of(html: str | None) -> list[tuple[str, list[str], int]]:
    """(text, path, characters in links) of each leaf block, in page order.

    The path holds an element's tag and its attribute words, outermost first.
    Scripts, styles, comments, titles, form fields and other elements that show no
    running text are left out. Character references are decoded, white
    space becomes one space; unclosed and stray tags are borne. Of a hidden element that is
    never closed only the text before the next block-level tag is left out. Time is linear in the page.
    """
    if not html:
        return []
    page = _Leaves()
    for text, tag, attributes, kind in tags(html):
        page.add(text)
        if kind == "close":
            if tag not in RAW:
                page.close(tag)
        elif tag and tag not in RAW:
            page.start(tag, attributes, kind == "self")
    page.end_block()
    return page.out


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h >> 7) % HASHES


def path_features(path: tuple[str, ...]) -> list[int]:
    """Ancestors' tags and attribute words, and the two elements nearest the text; text outside of all elements is marked."""
    found = {"path:" + w for p in path for w in p.split(" ")} or {"outside"}
    found |= {"leaf:" + w for p in path[-1:] for w in p.split(" ")}
    found |= {"up:" + w for p in path[-2:-1] for w in p.split(" ")}
    return sorted({_hash(f) for f in found})


def text_features(text: str, linked: int, place: int, total: int) -> list[int]:
    n = len(text)
    share = linked / n
    marks = sum(map(text.count, ".,;"))
    names = (
        f"size:{min(7, n.bit_length() - 2)}",
        f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"marks:{min(4, 40 * marks // n)}",
        f"stop:{text[-1] in '.!?'}",
        f"sign:{'©' in text}",
        f"bar:{text.count('|') * 30 > n}",
        f"both:{min(3, n.bit_length() // 3)}:{share > 0.5}",
        f"first:{place == 0}",
        f"last:{place == total - 1}",
    )
    return [_hash(x) for x in names]


class BlockModel:
    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        self._paths: dict[tuple, np.ndarray] = {}
        self._texts: dict[tuple, np.ndarray] = {}

    @classmethod
    def fit(cls, pages: int = 1000, seed: int = 17, layouts: tuple = LAYOUTS) -> BlockModel:
        features, owners, labels = [], [], []
        for html, marks in training_pages(pages, seed, layouts):
            blocks = blocks_of(html)
            if len(blocks) != len(marks):
                raise ValueError("a training page's labels must match its blocks")
            ids = [path_features(tuple(p)) + text_features(t, k, i, len(blocks)) for i, (t, p, k) in enumerate(blocks)]
            features.append(np.concatenate([np.array(i, np.int64) for i in ids]))
            owners.append(np.repeat(np.arange(len(ids)), [len(i) for i in ids]))
            labels.append(np.array(marks))
        return cls(*crf.train(features, owners, labels, HASHES, 2, steps=300, batch=16, l2=1e-4, seed=seed))

    def scores(self, blocks) -> np.ndarray:
        out = np.empty((len(blocks), 2))
        for i, (text, path, linked) in enumerate(blocks):
            key = tuple(path)
            known = self._paths.get(key)
            if known is None:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                known = self._paths[key] = self.weights[path_features(key)].sum(0)
            out[i] = known + self.weights[text_features(text, linked, i, len(blocks))].sum(0)
        return out

    def main_text(self, html: str | None) -> str:
        blocks = blocks_of(html)
        if not blocks:
            return ""
        labels = crf.viterbi(self.scores(blocks), self.transitions)
        return " ".join(b[0] for b, k in zip(blocks, labels) if k == 1)

    def main_texts(self, pages: list[str | None]) -> list[str]:
        """``main_text`` of many pages, decoded in padded batches."""
        blocks = [blocks_of(h) for h in pages]
        out = [""] * len(pages)
        order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
        for at in range(0, len(order), 256):
            group = order[at : at + 256]
            lengths = np.array([len(blocks[i]) for i in group])
            scores = np.zeros((int(lengths.max()), len(group), 2))
            for b, i in enumerate(group):
                scores[: lengths[b], b] = self.scores(blocks[i])
            labels = crf.viterbi_batch(scores, lengths, self.transitions)
            for b, i in enumerate(group):
                out[i] = " ".join(x[0] for x, k in zip(blocks[i], labels[: lengths[b], b]) if k == 1)
        return out


#: Words that name parts of pages in class and id attributes.
PART_WORDS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu".split(),
    "header": "header masthead banner topbar branding siteheader logo".split(),
    "footer": "footer bottom copyright colophon sitefooter legal".split(),
    "aside": "sidebar aside related widget rail secondary recommended popular".split(),
    "notice": "notice cookie consent gdpr alert message popup modal overlay".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adbox".split(),
    "form": "form search subscribe newsletter signup login contact".split(),
    "comments": "comments comment discussion responses replies disqus reader".split(),
    "share": "share social sharing follow tags meta byline pagination pager".split(),
    "main": "article content post entry story main body text".split(),
}


def training_pages(pages: int, seed: int, layouts: tuple = LAYOUTS) -> Iterator[tuple[str, list[int]]]:
    """Labelled pages: html and, for each leaf block, 1 for main text, else 0."""
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    letters = rng.integers(0, 12, (2000, 10))
    pool = ["".join("etaoinshrdlu"[k] for k in row[:n]) for row, n in zip(letters, rng.integers(1, 11, 2000))]
    pool = np.array([w + m for w, m in zip(pool, np.resize([",", ".", "", "", "", "", "", "!!", "%%%"], 2000))])

    def prose(low, high, stop=True):
        words = pool[rng.integers(0, len(pool), int(rng.integers(low, high)))].tolist()
        words[-1] = words[-1].rstrip(",.!%")
        return " ".join(words).capitalize() + (pick([".", ".", ".", "", "!"]) if stop else "")

    def attribute(kind, often=0.7):
        if rng.random() > often:
            return ""
        name = pick(PART_WORDS[kind])
        if rng.random() < 0.3:
            name += pick(["-", "_", " "]) + pick(["wrap", "box", "inner", "list", "item", "area", "block"])
        return f' {pick(["class", "id"])}="{name}"'

    def links(n):
        return [f'<li><a href="/{i}">{prose(1, 4, False)}</a></li>' for i in range(n)]

    def part(kind):
        """An other part, as (html, blocks)."""
        if kind == "nav":
            n = int(rng.integers(2, 9))
            if rng.random() < 0.2:
                return f"<div{attribute('nav', 1)}>" + " | ".join(f'<a href="#">{prose(1, 3, False)}</a>' for _ in range(n)) + "</div>", 1
            tag = pick(["nav", "nav", "div"])
            return f"<{tag}{attribute('nav', 0.5 if tag == 'nav' else 1)}><ul>" + "".join(links(n)) + f"</ul></{tag}>", n
        if kind == "header":
            return f"<header{attribute('header', 0.5)}><h2>{prose(1, 5, False)}</h2><p>{prose(3, 9)}</p></header>", 2
        if kind == "footer":
            tag = pick(["footer", "footer", "div"])
            extra = f"<p>{prose(3, 25)}</p>" if rng.random() < 0.5 else ""
            return f"<{tag}{attribute('footer', 0.4 if tag == 'footer' else 1)}>{pick(['&copy; ', '', '© '])}{prose(3, 20)}{extra}</{tag}>", 1 + bool(extra)
        if kind == "aside":
            tag = pick(["aside", "aside", "div", "section"])
            n = int(rng.integers(1, 6))
            return f"<{tag}{attribute('aside', 0.5 if tag == 'aside' else 1)}><h3>{prose(1, 4, False)}</h3><ul>" + "".join(links(n)) + f"</ul><p>{prose(5, 40)}</p></{tag}>", n + 2
        if kind == "notice":
            return f"<div{attribute('notice', 1)}>{pick(['<p>', ''])}{prose(5, 40)}</div>", 1
        if kind == "ad":
            tag = pick(["div", "div", "section", "aside"])
            return f"<{tag}{attribute('ad', 1)}>{pick(['<p>', ''])}{prose(2, 40)}</{tag}>", 1
        if kind == "form":
            return f"<form{attribute('form', 0.5)}><p>{prose(2, 12)}</p><input name=q><button>{prose(1, 2, False)}</button></form>", 1
        if kind == "share":
            return f"<div{attribute('share', 1)}>" + prose(1, 6, False) + "</div>", 1
        n, title = int(rng.integers(1, 5)), pick(["h2", "h3", "h3", "h4"])
        if rng.random() < 0.4:  # a list of remarks, some with answers inside
            items, count = "", 0
            for _ in range(n):
                by = f"<div{attribute('comments', 0.5)}>{prose(1, 5, False)}</div>" if rng.random() < 0.4 else ""
                below = f"<ul{attribute('comments', 0.4)}><li><p>{prose(2, 30)}</p></li></ul>" if rng.random() < 0.25 else ""
                items += f"<li{attribute('comments', 0.5)}>{by}<p>{prose(1, 60)}</p>{below}</li>"
                count += 1 + bool(by) + bool(below)
            kind = pick(["ol", "ul"])
            outer = pick(["div", "div", "section"])
            return f"<{outer}{attribute('comments', 1)}><{title}>{prose(1, 5, False)}</{title}><{kind}{attribute('comments', 0.5)}>{items}</{kind}></{outer}>", count + 1
        inner = "".join(f'<div class="{pick(["comment", "reply", "comment-body"])}"><p>{prose(3, 60)}</p></div>' for _ in range(n))
        tag = pick(["section", "div", "ol"])
        return f"<{tag}{attribute('comments', 1)}><{title}>{prose(1, 4, False)}</{title}>{inner}</{tag}>", n + 1

    def article():
        """Main text, some of it interrupted by other parts."""
        html, marks = [], []
        if rng.random() < 0.9:
            title = f"<h1>{prose(2, 14, False)}</h1>"
            html.append(title if rng.random() < 0.85 else f"<header{attribute('main', 0.8)}>{title}</header>")
            marks.append(1)
        inside = rng.random() < 0.25  # its paragraphs are in sections of their own
        html.append("<section>" * inside)
        for _ in range(int(rng.integers(1, 14))):
            if inside and rng.random() < 0.2:
                html.append(f"</section><section{attribute('main', 0.2)}>")
            what = rng.random()
            if what < 0.62:
                html.append(f"<p>{prose(1, 90)}" + pick(["</p>", "</p>", "</p>", ""]))
                marks.append(1)
            elif what < 0.67:
                html.append(f"<p><b>{prose(1, 60)}<br>")
                marks.append(1)
            elif what < 0.72:
                html.append(f"<h2>{prose(1, 8, False)}</h2>")
                marks.append(1)
            elif what < 0.77:
                n = int(rng.integers(1, 5))
                html.append("<ul>" + "".join(f"<li>{prose(2, 25)}</li>" for _ in range(n)) + "</ul>")
                marks += [1] * n
            elif what < 0.81:
                html.append(f"<blockquote>{prose(4, 50)}</blockquote>")
                marks.append(1)
            elif what < 0.84:
                html.append(f"<table><tr><td>{prose(1, 6, False)}</td><td>{prose(1, 6, False)}</td></tr></table>")
                marks += [1, 1]
            else:
                inner, n = part(pick(["ad", "aside", "share", "form", "notice"]))
                html.append(inner)
                marks += [0] * n
                html.append(f"<p>{prose(1, 30)}</p>")
                marks.append(1)
        html.append("</section>" * inside)
        if rng.random() < 0.2:
            html.append(f"<footer{attribute('share', 0.6)}>{prose(1, 8, False)}</footer>")
            marks.append(0)
        if rng.random() < 0.25:
            inner, n = part("comments")
            html.append(inner)
            marks += [0] * n
        return "".join(html), marks

    def text():
        """Main text without elements of its own, in lines."""
        n = int(rng.integers(1, 6))
        return "<br>".join(prose(1, 90) for _ in range(n)), [1] * n

    def others(kinds):
        html, marks = [], []
        for kind, often in kinds:
            if rng.random() < often:
                inner, n = part(kind)
                html.append(inner)
                marks += [0] * n
        return "".join(html), marks

    for _ in range(pages):
        layout = pick(layouts)
        if layout in ("plain", "bare"):  # no element says what is what
            body, marks = article() if layout == "plain" else text()
            if rng.random() < 0.3:
                inner, n = part("footer")
                body, marks = body + inner, marks + [0] * n
            if rng.random() < 0.3:
                inner, n = part("nav")
                body, marks = inner + body, [0] * n + marks
            head = pick(["", f"<html><head><title>{prose(2, 9, False)}</title></head>", "<!DOCTYPE html>"])
            yield (head + "<body>" + body + pick(["</body></html>", ""]) if layout == "plain" or rng.random() < 0.5 else body), marks
            continue
        before, marks = others((("notice", 0.3), ("header", 0.4), ("nav", 0.8), ("form", 0.2), ("ad", 0.5), ("aside", 0.2)))
        inner, own = article()
        after, rest = others((("share", 0.3), ("comments", 0.4), ("aside", 0.4), ("ad", 0.3), ("form", 0.2), ("footer", 0.9), ("notice", 0.2)))
        marks = marks + own + rest
        if layout == "blog":
            body = f'<div id="page">{before}<main id="primary"><article class="post hentry {pick(["", "type-post", "status-publish"])}"><div class="entry-content">{inner}</div></article></main>{after}</div>'
        elif layout == "article":
            body = f"{before}<article{attribute('main', 0.3)}>{inner}</article>{after}"
        elif layout == "main":
            body = f"{before}<main{attribute('main', 0.3)}><div{attribute('main', 0.7)}>{inner}</div></main>{after}"
        elif layout == "div":
            body = f"{before}<div{attribute('main', 1)}>{inner}</div>{after}"
        elif layout == "table":
            body = f'<table width="100%"><tr><td valign="top">{before}</td><td{attribute("main", 0.8)}>{inner}</td><td{attribute("aside", 0.3)}>{after}</td></tr></table>'
        elif layout == "nested":
            body = f'<div id="page"><div class="wrap">{before}<div class="content-area"><main id="site-main"><div{attribute("main", 1)}><div{attribute("main", 0.6)}>{inner}</div></div></main></div>{after}</div></div>'
        else:
            body = f"<div id=wrapper>{before}<section{attribute('main', 0.9)}>{inner}</section>{after}</div>"
        head = f'<!DOCTYPE html><html><head><title>{prose(2, 9, False)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        yield head + "<body>" + body + pick(["</body></html>", ""]), marks


@lru_cache(1)
def default_model() -> BlockModel:
    """The model fitted on the training pages, once in a process."""
    return BlockModel.fit()


def extract(pages: DataFrame, html: str = "html", model: BlockModel | None = None) -> DataFrame:
    """Add text, the main text, and n_chars, its code points, to every row.

    Null and empty pages and pages without main text give an empty text. Pages are read whole and
    judged each by itself, so repeated rows agree. Columns called text
    or n_chars are replaced.
    """
    spark = pages.sparkSession
    prepare(spark)
    model = model or default_model()
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((model.weights, model.transitions))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = kept(key, lambda: BlockModel(*sent.value))
        for series in batches:
            yield pd.Series(own.main_texts(series.tolist()), dtype=object)

    others = [c for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(*others, F.pandas_udf(run, "string")(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", "n_chars")
