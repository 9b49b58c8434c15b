"""Extraction from pages of other sites, and the parser against another one."""

import random
import re
from html import unescape
from html.parser import HTMLParser

from turnloom.llm import html

#: Pages written by hand without telling names; [[ ]] is what the article says.
PAGES = [
 # bare header and footer
 "<body><header>Harbour Post</header><div><h1>[[Ferry stops running]]</h1><p>[[The last ferry left the island on Sunday evening with forty people aboard.]]</p><p>[[Residents say that a bridge is needed, and soon.]]</p></div><footer>© 2020 Harbour Post</footer></body>",
 # cookie question in a made-up class
 '<body><div class="css-12"><p>Accept all cookies?</p><button>Yes</button></div><div class="css-44"><h1>[[Growing beans]]</h1><p>[[Beans like warm soil and a place out of the wind, so wait until May.]]</p><p>[[Water them in the morning, never at noon.]]</p></div></body>',
 # imprint in a made-up class
 '<body><div class="x1"><h2>[[Der alte Turm]]</h2><p>[[Der Turm steht seit vierhundert Jahren am Rand der Stadt und wird nun erneuert.]]</p><p>[[Die Arbeiten dauern bis zum Herbst, sagte der Meister.]]</p></div><div class="ft">Impressum | Datenschutz</div></body>',
 # copyright in a plain paragraph
 "<body><div><h1>[[Choir sings in the park]]</h1><p>[[More than two hundred people came to hear the choir on Saturday afternoon.]]</p><p>[[The next concert is planned for the autumn.]]</p></div><p>© 2020 Town paper</p></body>",
 # tool-made names everywhere
 '<div id="app"><div class="sc-bZQ"><a href="/">Start</a><a href="/n">News</a><a href="/k">Kultur</a></div><div class="sc-fgT"><div class="sc-a1"><h1>[[Night trains return]]</h1><p>[[Three lines are to be opened next year, the railway said on Tuesday.]]</p><p>[[Tickets will cost as much as a flight, or a little less.]]</p></div></div><div class="sc-zzz"><p>Sign up for our newsletter</p><input type="email"><button>Go</button></div></div>',
 # table layout of old times
 '<body><table><tr><td><a href="a.html">Home</a><br><a href="b.html">Links</a><br><a href="c.html">Guestbook</a></td><td><h1>[[My telescope]]</h1><p>[[I built the tube from wood and the mirror from an old porthole glass.]]</p><p>[[On a clear night it shows the rings of Saturn.]]</p></td></tr></table></body>',
 # links after the text
 '<body><main><h1>[[Soup for a cold day]]</h1><p>[[Cut the leeks into rings and wash the sand out of them, twice if need be.]]</p><p>[[Simmer everything for forty minutes and season at the end.]]</p></main><div class="k9"><p>Related: Bread without yeast</p><a href="/1">Bread without yeast</a> <a href="/2">Pickled lemons</a> <a href="/3">Barley stew</a></div></body>',
 # share line under the title
 '<article><h1>[[A library on wheels]]</h1><div class="m-3">Share on Facebook · Twitter · WhatsApp</div><p>[[The blue bus stops in twelve villages and carries three thousand books.]]</p><p>[[Children may borrow as many as they can carry.]]</p></article>',
 # comments in plain divs
 '<body><div class="a"><h1>[[The well is dry]]</h1><p>[[For the first time in thirty years the village well has run dry this August.]]</p><p>[[Water comes by lorry twice a week now.]]</p></div><div class="b"><h4>2 comments</h4><div class="c"><p>Sad news for us all.</p><a href="#">Reply</a></div><div class="c"><p>It rained here.</p><a href="#">Reply</a></div></div></body>',
 # notice at the end, header with links
 '<body><header><a href="/">Notes on chess</a> <a href="/about">About</a> <a href="/rss">RSS</a></header><section><h2>[[Why I gave up the gambit]]</h2><p>[[It wins quickly or not at all, and lately it has been not at all for me.]]</p><p>[[So I went back to slow openings, which suit my age.]]</p></section><div>This site uses cookies. Accept</div></body>',
 # a long article in bare paragraphs
 "<body><div>Menu</div><div><h1>[[Ten days on foot]]</h1>" + "".join(f"<p>[[On day {i} we walked {10 + i} miles along the ridge, and slept in a hut near the pass.]]</p>" for i in range(1, 9)) + "</div><div>Imprint · Privacy · Contact</div></body>",
 # advertisement between paragraphs
 '<body><div class="q"><h1>[[Market day]]</h1><p>[[Farmers came from all over the valley with cheese, apples and wool.]]</p><div class="r7">Advertisement</div><p>[[By two in the afternoon most of the stalls were empty.]]</p><p>[[The next market is in October.]]</p></div></body>',
 # a list inside the text, furniture as a list outside
 '<body><ul><li><a href="/a">Start</a></li><li><a href="/b">Archive</a></li></ul><div><h1>[[What to pack]]</h1><p>[[For a week in the hills you need less than you think, but you need it dry.]]</p><ul><li>[[a warm coat]]</li><li>[[two pairs of boots]]</li><li>[[a map on paper]]</li></ul></div><p>Copyright 2019 Hill Club</p></body>',
 # French
 '<body><div class="zz">Nous utilisons des cookies. Accepter</div><div class="yy"><h1>[[Le pont est rouvert]]</h1><p>[[Après deux ans de travaux, le pont a été rouvert lundi matin par le maire.]]</p><p>[[Les habitants sont contents, les commerçants aussi.]]</p></div><div>Mentions légales | Contact</div></body>',
]


def said(page):
    return " ".join(" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.findall(r"\[\[(.*?)\]\]", page, re.S))


def test_pages_without_telling_names():
    trees = html.model()
    got = [html.texts([p.replace("[[", "").replace("]]", "")], trees)[0] == said(p) for p in PAGES]
    assert len(got) == 14 and sum(got) >= 12, got


def test_given_pages_are_exact():
    """On the given pages the article is what stands in the article element."""
    import pyarrow.parquet as pq

    trees, n = html.model(), 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()["html"]:
        if page and "<article" in page:
            p = html.Page(page)
            kept = [False] * len(p.tag)
            for i, tag in enumerate(p.tag):
                kept[i] = tag == "article" or (p.parent[i] >= 0 and kept[p.parent[i]])
            assert html.texts([page], trees)[0] == p.of_nodes(kept)
            n += 1
    assert n > 50


class Plain(HTMLParser):
    """Text of a page, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.off = [], [], 0

    def end_block(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "noscript")
        if tag in html.BLOCKS or tag in ("br", "hr"):
            self.end_block()

    def handle_startendtag(self, tag, attrs):
        if tag in html.BLOCKS or tag in ("br", "hr"):
            self.end_block()

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "noscript")
        if tag in html.BLOCKS:
            self.end_block()

    def handle_data(self, data):
        if not self.off:
            self.now.append(data)


def made(r, depth=0):
    """A random piece of a page, closed as it should be."""
    words = lambda: "".join(r.choice(("a", "be ", "  ", "\n", "&amp;", "&#233;", "&nbsp;x", "c.", "d > e ", "'q\" ")) for _ in range(r.randint(1, 5)))
    x = r.random()
    if depth > 4 or x < 0.35:
        return words()
    inner = "".join(made(r, depth + 1) for _ in range(r.randint(1, 4)))
    if x < 0.6:
        return f"<{(t := r.choice(('div', 'section', 'article', 'ul', 'blockquote', 'table', 'main')))}{r.choice(('', ' class=x', ' id=\"a > b\"'))}>{inner}</{t}>"
    if x < 0.75:
        return f"<{(t := r.choice(('b', 'i', 'em', 'span', 'a')))}{r.choice(('', ' class=\"y z\"'))}>{words()}</{t}>"
    return r.choice((f"<p>{words()}</p>", f"<p>{words()}", f"<h2>{words()}</h2>", "<br>", "<hr/>", "<!-- <p>no</p> -->", "<script>if (a < b) { '<p>' }</script>", "<style>p > a {}</style>", f"<ul><li>{words()}<li>{words()}</ul>", "<img src=x alt='<p>'>"))


def test_parser_against_another_one():
    r = random.Random(12)
    for _ in range(1500):
        page = "<html><body>" + "".join(made(r) for _ in range(r.randint(1, 6))) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.end_block()
        p = html.Page(page)
        assert p.of_nodes([True] * len(p.tag)) == " ".join(plain.blocks), page
