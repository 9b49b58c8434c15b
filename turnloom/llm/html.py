"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed, in one pass, into its block elements and those inline elements that have a
class, id, role or other name; scripts, styles, comments, controls and hidden elements never give
text.  Every node gets features of its subtree (text, links, tags, density), of its class, id
and role tokens, of its depth, its ancestors and its siblings.  Boosted trees give the odds that
it belongs to the article.  Decoding takes, of all labellings in which a dropped node drops
all below it, the most likely one: a node is kept, with the best choice for each child, or
dropped with its whole subtree.

The trees are trained on pages that ``training_pages`` makes, with a fixed seed, from common
layouts (semantic elements or plain ones with telling class names, deep or flat, with menus,
notices, adverts, forms, sidebars, reader comments, inline adverts and unclosed elements).

Defined cases: a null or empty html gives an empty text.  An element that is never closed ends
with its parent, a control where the next block begins; an svg, iframe, noscript or template without
an end is none; an unclosed comment, script, style, textarea or title ends with the page; of a tag that
is never closed, and after one whose quotes do not match, quotes mean nothing.  Time is linear in
the page, so very long ones need no cut.  Repeated rows each give a row, null ids and addresses
stay.  Further columns are dropped.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches
from .trees import Boosted

#: Elements whose content is no markup, those that never give text, and inline ones that may be nodes.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DARK = frozenset("noscript template svg iframe select button datalist".split())
CONTROLS = frozenset("select button datalist".split())
INLINE = frozenset("span a b i u em strong small font ins del mark label cite q code kbd sup sub time abbr big s".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"""[>"']""")
_PLAIN = re.compile(r"[<>]")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that make a block, those that end at the next of their kind, and telling names.
BLOCKS = frozenset(
    "html body div section article main nav aside header footer form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address fieldset details summary dialog center hgroup menu".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
AWAY_TAGS = frozenset("nav aside footer header form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
TEXT_TAGS = frozenset("p blockquote pre".split())
LIST_TAGS = frozenset("ul ol li dl dt dd".split())
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_NAMES = frozenset("article content post entry story main text body page single prose copy reading".split())
AWAY_NAMES = frozenset(
    "nav navigation navbar menu header masthead topbar footer foot bottom sidebar aside side widget widgets rail cookie cookies consent gdpr banner notice alert "
    "ad ads advert adverts advertisement sponsor sponsored promo promoted dfp comment comments reply replies respond disqus discussion form login signup search "
    "subscribe subscription newsletter share sharing social related recommended recommendations more trending popular breadcrumb breadcrumbs crumbs pagination pager "
    "modal popup overlay copyright legal toolbar tags taglist meta byline skip hidden".split()
)
BUCKETS = 24
#: Words and signs of page furniture; they count in short blocks only, as articles use them too.
CUE_WORDS = frozenset(
    "cookie cookies consent accept privacy policy terms imprint impressum datenschutz kontakt contact copyright rights reserved subscribe newsletter login register signup sign log "
    "share tweet facebook twitter whatsapp instagram reddit pinterest comments comment reply advertisement sponsored promoted menu home search skip previous next read related "
    "mentions légales confidentialité accepter acepto aceptar privacidad aviso contacto akzeptieren agb".split()
)
CUE_SIGNS = "©®"
CUE_MOST, CUE_TRIM = 30, ".,:;!?()[]\"'"


class Tags:
    """The tags of a page in one pass: (start, end, name, closing, attributes); name is "" for comments and the like.  Where
    something is found next, or that it is not, is kept, so nothing is looked for twice."""

    def __init__(self, html: str):
        self.html, self.quotes = html, True
        self.lower = html.lower() if html.isascii() else "".join(c.lower() if c.isascii() else c for c in html)
        self.next: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """The next place of what (in lower case); -1 if there is none."""
        known = self.next.get(what, 0)
        if 0 <= known < at or what not in self.next:
            known = self.next[what] = self.lower.find(what, at)
        return known

    def closes(self, name: str, at: int) -> bool:
        return self.find(f"</{name}", at) >= 0

    def end(self, at: int) -> int:
        """Where the tag ends that goes on at a place; -1 if it does not."""
        i = at
        while self.quotes and (m := _STOP.search(self.html, i)):
            if m[0] == ">":
                return m.end()
            close = self.find(m[0], m.end())
            i = close + 1 if close >= 0 else m.end()  # a quote without an end is none
        self.quotes = False
        m = _PLAIN.search(self.html, at)
        return m.end() if m and m[0] == ">" else -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        html, at = self.html, 0
        after = lambda what, i: end + len(what) if (end := self.find(what, i)) >= 0 else len(html)
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = after("-->", at + 4)
                yield at, end, "", False, ""
            elif html[at + 1 : at + 2] in ("!", "?"):
                end = after(">", at)
                yield at, end, "", False, ""
            else:
                closing = html[at + 1 : at + 2] == "/"
                m = _NAME.match(html, at + 1 + closing)
                end = self.end(m.end()) if m else -1
                if end < 0:
                    at += 1
                    continue
                name, attrs = m[0].lower(), html[m.end() : end - 1]
                if name in RAW and not closing and not attrs.endswith("/"):
                    close = self.find(f"</{name}", end)
                    end = len(html) if close < 0 else after(">", close)
                    name = ""
                yield at, end, name, closing, attrs
            at = end


class Page:
    """Nodes in page order and the text blocks: for each the block's node and the pieces (node, text) in it."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names, self.depth = ["#"], [-1], [()], [0]
        self.inputs, self.links, self.link_chars = [0], [0], [0]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        stack, block, held, anchor, at, head = [0], [0], [], False, 0, False
        open_: dict[str, int] = {}
        dark = [False]  # by node
        loose: set[int] = set()

        def flush():
            if any(s and not s.isspace() for _, s in held):
                self.blocks.append((block[-1], held.copy()))
            held.clear()

        def pop():
            node = stack.pop()
            open_[self.tag[node]] -= 1
            if block[-1] == node:
                block.pop()

        def text(s: str):
            if s and not head and not dark[stack[-1]]:
                held.append((stack[-1], s))
                if anchor:
                    self.link_chars[stack[-1]] += len(s)

        tags = Tags(html)
        for start, end, name, closing, attrs in tags:
            if start > at:
                s = html[at:start]
                text(unescape(s) if "&" in s else s)
            at = end
            if not name:
                continue
            if name == "head":
                head = not closing
                continue
            names = tuple(x.lower() for a in _ATTR.finditer(attrs) for x in _PART.findall(a[2] or a[3] or a[4] or "")) if attrs else ()
            hidden = bool(attrs) and _HIDDEN.search(attrs) is not None
            if name == "a":
                anchor = not closing
                self.links[stack[-1]] += anchor
            elif name in ("br", "hr"):
                flush()
            elif name in ("input", "label"):
                self.inputs[stack[-1]] += not closing
            is_block = name in BLOCKS
            if is_block:
                head = False
                flush()
                anchor = False
            if closing:
                if open_.get(name):
                    while self.tag[stack[-1]] != name:
                        pop()
                    pop()
                continue
            closed = name not in DARK or tags.closes(name, end)
            is_dark = name in DARK and (closed or name in CONTROLS)
            if not (is_block or is_dark or (name in INLINE and (names or hidden))) or (attrs.endswith("/") and not is_block):
                continue
            if is_block:
                # inline elements, and controls without an end, end where a block begins
                while stack[-1] != block[-1] and (self.tag[stack[-1]] not in DARK or stack[-1] in loose):
                    pop()
                if self.tag[stack[-1]] == "p":
                    pop()
                for tag in CLOSES.get(name, ()):
                    if self.tag[stack[-1]] == tag:
                        pop()
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.names.append(names)
            self.inputs.append(0)
            self.links.append(0)
            self.link_chars.append(0)
            dark.append(dark[stack[-1]] or hidden or is_dark)
            open_[name] = open_.get(name, 0) + 1
            if not closed:
                loose.add(len(self.tag) - 1)
            stack.append(len(self.tag) - 1)
            if is_block:
                block.append(stack[-1])
        if at < len(html):
            s = html[at:]
            cut = s.rfind("<")  # an element cut off at the end of the page is no text
            s = s[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!][^>]*\Z", s[cut:]) else s
            text(unescape(s) if "&" in s else s)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, stops, words, cues = [0] * n, [0] * n, [0] * n, [0] * n
        first = [-1] * n
        total = 0
        for node, raw in (piece for _, pieces in self.blocks for piece in pieces):
            n_words = len(parts := raw.split())
            size = sum(map(len, parts)) + max(n_words - 1, 0)
            own[node] += size
            stops[node] += raw.count(".") + raw.count(",")
            words[node] += n_words
            if n_words <= CUE_MOST:
                cues[node] += sum(w.lower().strip(CUE_TRIM) in CUE_WORDS or w[0] in CUE_SIGNS for w in parts)
            if first[node] < 0 and size:
                first[node] = total
            total += size
        all_, link, links, stop, kids, inside, inputs, paras = own[:], self.link_chars[:], self.links[:], stops[:], [0] * n, [1] * n, self.inputs[:], [int(t in TEXT_TAGS) for t in self.tag]
        cue, most, said = cues[:], own[:], words[:]
        child: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            all_[p] += all_[i]
            link[p] += link[i]
            links[p] += links[i]
            stop[p] += stop[i]
            cue[p] += cue[i]
            said[p] += said[i]
            most[p] = max(most[p], most[i])
            inside[p] += inside[i]
            inputs[p] += inputs[i]
            paras[p] += paras[i]
            kids[p] += 1
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
        for i in range(1, n):
            child[self.parent[i]].append(i)
        place, before, after = [0] * n, [0] * n, [0] * n
        for c in child:
            for j, i in enumerate(c):
                place[i] = j
                before[i] = all_[c[j - 1]] if j else 0
                after[i] = all_[c[j + 1]] if j + 1 < len(c) else 0
        up_main, up_away, up_tag, up_main_tag = [0] * n, [0] * n, [0] * n, [0] * n
        largest = max(range(n), key=own.__getitem__)
        near = [0] * n  # how many parents of the largest text a node is from below it
        up = self.parent[largest]
        steps = 1
        while up >= 0:
            near[up] = steps
            up, steps = self.parent[up], steps + 1
        rows = np.zeros((n, 41 + BUCKETS))
        for i in range(n):
            tag, names, p = self.tag[i], self.names[i], self.parent[i]
            main = sum(x in MAIN_NAMES for x in names)
            away = sum(x in AWAY_NAMES for x in names)
            if p >= 0:
                up_main[i], up_away[i], up_tag[i], up_main_tag[i] = up_main[p], up_away[p], up_tag[p], up_main_tag[p]
            row = rows[i]
            row[:41] = (
                self.depth[i], own[i], all_[i], link[i] / (all_[i] + 1), links[i], inside[i], 100 * inside[i] / (all_[i] + 1), kids[i], place[i], kids[p] if p >= 0 else 0,
                all_[i] / (all_[p] + 1) if p >= 0 else 1, all_[i] / (total + 1), paras[i], 100 * stop[i] / (all_[i] + 1), inputs[i], words[i],
                before[i], after[i], max(first[i], 0) / (total + 1),
                tag in AWAY_TAGS, tag in MAIN_TAGS, tag in TEXT_TAGS, tag in HEADS, tag in LIST_TAGS, tag in TABLE_TAGS, tag == "footer", tag == "header",
                main, away, up_main[i], up_away[i], up_tag[i], up_main_tag[i], len(names),
                cue[i], cue[i] / (said[i] + 1), said[i], most[i], near[p] if p >= 0 else 0, i > largest, tag in ("h1", "h2"),
            )
            for x in names:
                row[41 + crc32(x.encode()) % BUCKETS] = 1
            up_main[i] += main
            up_away[i] += away
            up_tag[i] += tag in AWAY_TAGS
            up_main_tag[i] += tag in MAIN_TAGS
        return rows

    def decoded(self, odds: np.ndarray) -> list[bool]:
        """Which nodes are kept, given the log-odds of each."""
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        keep, drop = yes.tolist(), no.tolist()
        for i in range(n - 1, 0, -1):
            keep[self.parent[i]] += max(keep[i], drop[i])
            drop[self.parent[i]] += drop[i]
        kept = [False] * n
        for i in range(n):
            kept[i] = (i == 0 or kept[self.parent[i]]) and (i == 0 or keep[i] >= drop[i])
        return kept

    def text(self, odds: np.ndarray) -> str:
        return self.of_nodes(self.decoded(odds))

    def of_nodes(self, kept: list[bool]) -> str:
        """The text of the nodes kept: white space inside a block as one space, blocks joined by one."""
        blocks = (" ".join("".join(s for node, s in pieces if kept[node]).split()) for block, pieces in self.blocks if kept[block])
        return " ".join(b for b in blocks if b)


# --- training pages ------------------------------------------------------------------------


def _sentence(r: random.Random, n: int) -> str:
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    return " ".join(word() for _ in range(n)).capitalize() + r.choice(".....!?")


_SYLLABLES = "ta ri no ve lo ka me su di pa er an in re on é ü ñ st ch".split()


def _paragraph(r: random.Random) -> str:
    x = " ".join(_sentence(r, r.randint(3, 18)) for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9))))
    y = r.random()
    if y > 0.93:  # articles speak of such things too
        x += " " + r.choice(("We use cookies in the kitchen, and accept that.", "He had to sign the terms and read the policy.", "Contact with the copyright office was lost.", "Her comment: share what you read.", "They search the home for a reply."))
    if y < 0.06:  # an advert inside the line; data-x marks it
        x += f' <span class="{r.choice(("ad-inline", "sponsored", "promo", "share-link", "advert"))}" data-x="1">{_sentence(r, r.randint(2, 6))}</span>'
    elif y < 0.14:
        x += f' <{(t := r.choice(("em", "span", "strong", "code")))} class="{r.choice(("term", "name", "highlight", "quote", "lead"))}">{_sentence(r, r.randint(1, 5))}</{t}> ' + _sentence(r, 4)
    return x + r.choice(("", "", "", " &amp; ", " #1 &gt; 2", " + - = / | ~"))


def _links(r: random.Random, n: int, wrap: str = "li") -> str:
    return "".join(f'<{wrap}><a href="/{i}">{_sentence(r, r.randint(1, 4))[:-1]}</a></{wrap}>' for i in range(n))


#: Short furniture in the words that sites use; {} is filled with words of the page's own tongue.
_SHORT = {
    "notice": ("We use cookies to {}. Accept", "Accept all cookies?", "This site uses cookies.", "By going on you consent to cookies. OK", "Wir verwenden Cookies. Akzeptieren", "Nous utilisons des cookies. Accepter"),
    "legal": ("&copy; 2020 {}", "© {} 2023. All rights reserved.", "Copyright 2019 {}", "Impressum | Datenschutz", "Imprint · Privacy · Contact", "Terms of use | Privacy policy", "Mentions légales | Contact", "Aviso legal · Privacidad"),
    "header": ("{}", "{}", "The {}", "{} | {}", "Menu", "Home » {}"),
    "share": ("Share on Facebook", "Share: Twitter · WhatsApp", "Tweet this", "Share this {}"),
    "form": ("Subscribe to our newsletter", "Sign up for {}", "Log in or register", "Search"),
    "comments": ("3 comments", "Leave a reply", "No comments", "12 Comments on {}"),
    "ad": ("Advertisement", "Sponsored: {}", "Promoted by {}"),
    "related": ("Read next: {}", "Related: {}", "Previous: {}", "More from {}"),
}


def _made_name(r: random.Random) -> str:
    """A class or id as tools make it, or one that says nothing; articles and furniture have them alike."""
    made = "".join(r.choice("abcdefghijkmnprstuvwxyz") for _ in range(r.randint(1, 3)))
    return r.choice((f' class="css-{r.randint(1, 999)}"', f' class="sc-{made}"', f' class="{made}-{r.randint(1, 99)}"', f' class="{made}{made[::-1]}"', f' id="{made}{r.randint(1, 9)}"', ' class="box"', ' class="row"', ' class="page"'))


def _short_part(r: random.Random) -> str:
    """Short furniture without a telling name: bare, or with names made by a tool; some is like any short text but for its place."""
    kind = r.choice(list(_SHORT))
    words = r.choice(_SHORT[kind])
    while "{}" in words:
        words = words.replace("{}", _sentence(r, r.randint(1, 3))[:-1], 1)
    if r.random() < 0.25:
        words = f'<a href="/x">{words}</a>'
    name = _made_name(r) if r.random() < 0.7 else ""
    tag = "header" if kind == "header" and words[:1].isupper() and "|" not in words and words != "Menu" else r.choice({"header": ("header", "div", "p"), "legal": ("footer", "div", "p", "p"), "form": ("form", "div", "p")}.get(kind, ("div", "p", "section", "div")))
    inner = words if tag == "p" or r.random() < 0.5 else f"<{(t := r.choice(('p', 'span', 'div')))}>{words}</{t}>"
    return f'<{tag}{name} data-x="1">{inner}</{tag}>'


def _hidden_names(r: random.Random, part: str) -> str:
    """A part with its telling name replaced by one that says nothing, or left out."""
    return re.sub(r' (?:class|id)="[^"]*" data-x', (_made_name(r) if r.random() < 0.7 else "") + " data-x", part, count=1)


def _aside_part(r: random.Random) -> str:
    y = r.random()
    return _short_part(r) if y < 0.18 else _hidden_names(r, _named_part(r)) if y < 0.3 else _named_part(r)


def _named_part(r: random.Random) -> str:
    """One thing that is not the article; data-x marks it for the labels."""
    kind = r.choice("nav header footer side notice ad form comments related share crumbs legal".split())
    names = {
        "nav": ("nav", "main-menu", "navbar", "menu top", "site-navigation"), "header": ("header", "site-header", "masthead", "top-bar"), "footer": ("footer", "site-footer", "page-foot", "bottom"),
        "side": ("sidebar", "side rail", "widget-area", "aside"), "notice": ("cookie-notice", "consent banner", "alert", "notice", "gdpr-overlay"), "ad": ("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"),
        "form": ("newsletter", "search-form", "subscribe", "login", "signup"), "comments": ("comments", "comment-list", "discussion", "replies", "disqus_thread"), "related": ("related", "more-stories", "recommended", "popular"),
        "share": ("share", "social", "sharing-bar"), "crumbs": ("breadcrumbs", "crumbs", "pagination"), "legal": ("copyright", "legal", "meta"),
    }[kind]
    tags = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div"), "form": ("form", "div"), "comments": ("section", "div"), "related": ("aside", "section", "div")}.get(kind, ("div", "section"))
    tag = r.choice(tags)
    plain = tag in ("nav", "footer", "header", "aside", "form") and r.random() < 0.5
    attr = "" if plain else f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'
    if kind in ("nav", "related", "share", "crumbs", "header"):
        body = _links(r, r.randint(2, 9), r.choice(("li", "span", "div")))
        body = f"<ul>{body}</ul>" if tag != "ul" and "<li" in body else body
        if kind in ("related", "header") and r.random() < 0.6:
            body = f"<h3>{_sentence(r, 3)}</h3>" + body + (f"<p>{_sentence(r, 8)}</p>" if r.random() < 0.5 else "")
    elif kind == "form":
        body = f"<p>{_sentence(r, r.randint(3, 12))}</p><label>{_sentence(r, 2)}</label><input type=text><input type=submit value=go>"
    elif kind == "comments":
        body = "<h3>" + _sentence(r, 2) + "</h3>" + "".join(f'<{r.choice(("div", "li", "article"))} class="comment"><p>{_paragraph(r)}</p>' + "</div>" for _ in range(r.randint(1, 6)))
        if r.random() < 0.3:
            body += "<form><input type=text></form>"
    else:
        body = "".join(r.choice((f"<p>{_paragraph(r)}</p>", _sentence(r, r.randint(3, 14)), f"<div>{_sentence(r, 6)}</div>")) for _ in range(r.choice((1, 1, 2, 3))))
        if kind in ("footer", "legal") and r.random() < 0.6:
            body = r.choice(("&copy; ", "Copyright ", "&#169; 2020 ", "All rights reserved. ")) + _sentence(r, r.randint(1, 3)) + body
        body += _links(r, r.randint(0, 5), "span") if kind in ("footer", "side") else ""
    return f'<{tag}{attr} data-x="1">{body}</{tag}>'


def _article(r: random.Random) -> str:
    parts = []
    for _ in range(r.choice((0, 1, 2, 3, 5, 8, 14, 25))):
        x = r.random()
        if x < 0.68:
            p = _paragraph(r)
            parts.append(r.choice((f"<p>{p}</p>", f"<p>{p}</p>", f"<p{_made_name(r) if r.random() < 0.3 else ''}>{p}</p>", f"<p>{p}", f"<p><i>{_sentence(r, 3)}</i><br>{p}</p>", f"<p><strong>{p}", f"<div>{p}</div>", f'<p>{_sentence(r, 4)} <a href="/x">{_sentence(r, 3)}</a> {p}</p>')))
        elif x < 0.76:
            parts.append(f"<h2>{_sentence(r, 4)}</h2>")
        elif x < 0.82:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r, r.randint(2, 9))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif x < 0.87:
            parts.append(f"<blockquote><p>{_paragraph(r)}</p></blockquote>")
        elif x < 0.91:
            parts.append(f"<pre>{_sentence(r, 9)}\n{_sentence(r, 5)}</pre>")
        elif x < 0.95:
            parts.append("<table>" + "".join(f"<tr><td>{_sentence(r, 2)}</td><td>{_sentence(r, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif x < 0.965:  # license lines and lines with bars inside an article are its own
            parts.append(f"<p>{r.choice(('All rights reserved.', 'Copyright ' + _sentence(r, 3), _sentence(r, 6) + ' All rights reserved. ' + _sentence(r, 5), ' | '.join(_sentence(r, 1)[:-1] for _ in range(r.randint(3, 12)))))}</p>")
        elif x < 0.98:
            parts.append(f"<figure><img src=a.png><figcaption>{_sentence(r, 7)}</figcaption></figure>")
        else:
            parts.append(_aside_part(r))
    title = f"<h1>{_sentence(r, r.randint(2, 9))}</h1>" if r.random() < 0.85 or not parts else ""
    open_, close = r.choice((
        ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"),
        (f"<div{_made_name(r)}>", "</div>"), (f"<div{_made_name(r)}>", "</div>"), (f"<section{_made_name(r)}>", "</section>"), ("<div>", "</div>"), ("<td>", "</td>"), ('<div class="post-body">', "</div>"), ('<div class="entry"><div class="text">', "</div></div>"), ('<section class="story">', "</section>"), ("<div>", "</div>"), ('<article class="post"><header>' + title + "</header>", "</article>"),
    ))
    return open_ + ("" if "<header>" in open_ else title) + "".join(parts) + close


def training_pages(n: int, seed: int = 11) -> Iterator[str]:
    """Pages in which data-x marks what is not the article."""
    r = random.Random(seed)
    for _ in range(n):
        body = "".join(_aside_part(r) for _ in range(r.choice((0, 1, 2, 2, 3, 4)))) + _article(r) + "".join(_aside_part(r) for _ in range(r.choice((0, 1, 1, 2, 3))))
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f'<div{r.choice(("", " class=wrapper", " id=page", " class=container"))}>{body}</div>'
        end = r.choice(("</body></html>", "</body></html>", ""))
        yield f'<!DOCTYPE html><html lang="en"><head><title>{_sentence(r, 4)}</title><style>body{{color:#222}}</style><script>if (1 < 2) {{ go("<div>"); }}</script></head><body>{body}{end}'


@lru_cache(maxsize=1)
def model(pages: int = 800) -> Boosted:
    """The trees; made once in a process."""
    xs, ys = [], []
    for html in training_pages(pages):
        marked = Page(html.replace('data-x="1"', 'role="xmarkx"'))
        bad = [False] * len(marked.tag)
        holds = [False] * len(marked.tag)
        for i in range(1, len(bad)):
            bad[i] = bad[marked.parent[i]] or "xmarkx" in marked.names[i]
        for node in (node for _, pieces in marked.blocks for node, s in pieces if s.strip()):
            while node >= 0 and not bad[node] and not holds[node]:
                holds[node] = True
                node = marked.parent[node]
        x = Page(html).features()
        use = [i for i in range(1, len(bad)) if bad[i] or holds[i]]
        xs.append(x[use])
        ys.append(np.array([holds[i] for i in use], float))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def texts(htmls: list[str | None], trees: Boosted) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    x = [p.features() for p in pages]
    odds = trees.log_odds(np.concatenate(x)) if x else np.zeros(0)
    ends = np.cumsum([len(f) for f in x])
    return [p.text(odds[e - len(f) : e]) for p, f, e in zip(pages, x, ends)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    arrow_batches(pages.sparkSession)
    trees = model()  # of fixed size

    @F.pandas_udf("string")
    def main(htmls: pd.Series) -> pd.Series:
        return pd.Series(texts(list(htmls), trees), dtype=object)

    return pages.select("page_id", "url", main("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages)
