"""Raw text, self-closing tags and names within articles: pages of parts whose text is known, and a standard parser's text."""

import random
from html.parser import HTMLParser

import pytest

from graphloom.llm.html_text import parse

#: (markup, its blocks) outside and inside an article.
PARTS = [
    ('<svg class="i"/>', []), ('<svg viewBox="0 0 1 1"><path d="M0"/><title>icon</title></svg>', []), ("<math/>", []), ('<p>One <svg/> two</p>', ["One two"]),
    ("<script>if(x<!--y){}</script>", []), ("""<script>s="<b x='";</script>""", []), ("<SCRIPT>a='</b>'</SCRIPT >", []), ("<style>p > a::before{content:'<p>'}</style\n>", []),
    ("<script>document.write('<p>no</p>')</script>", []), ("<noscript><p>turn it on</p></noscript>", []), ("<template><p>later</p></template>", []), ("<textarea><p>typed</p></textarea>", []),
    ("<iframe src=x><p>old</p></iframe>", []), ("<p>a &lt; b &amp; c</p>", ["a < b & c"]), ("<!-- <p>no</p> -->", []), ("<p>x<br/>y<hr/></p>", ["x y"]), ("<img src='>' alt=\"<p>\"/>", []),
    ("<ul><li>l1<li>l2</ul>", ["l1", "l2"]), ("<p title='a>b'>q</p>", ["q"]), ("<video src=v><p>fallback</p></video>", ["fallback"]), ("<nav><p>menu</p></nav>", []),
]
NAMED = [
    ('<h2 id="related-work">Related work</h2>', ["Related work"]), ('<section class="social-history"><p>S</p></section>', ["S"]), ('<div class="ad-hoc"><p>H</p></div>', ["H"]),
    ('<div id="notice-period"><p>N</p></div>', ["N"]), ('<p class="notice">P</p>', ["P"]), ('<blockquote id="reply-all">B</blockquote>', ["B"]), ('<div class="ad"><p>AD</p></div>', []),
    ('<div class="ad-slot top"><p>AD</p></div>', []), ('<ul class="share-links"><li>S</li></ul>', []), ('<section id="comments"><p>me</p></section>', []), ('<div class="related-posts"><p>R</p></div>', []),
]


@pytest.mark.parametrize("seed", range(60))
def test_pages_of_known_parts(seed):
    r = random.Random(seed)
    blocks, source = ["Title", "long enough to be the page. " * 5], "<html><body><article><h1>Title</h1><p>" + "long enough to be the page. " * 5 + "</p>"
    for markup, text in r.choices(PARTS + NAMED, k=12):
        source += markup
        blocks += text
    source += "</article>"
    for markup, text in r.choices(PARTS, k=5):
        source += markup
        blocks += text
    assert parse(source).text(set()) == "\n".join(" ".join(b.split()) for b in blocks)


class Plain(HTMLParser):
    """Text of a page as the standard library reads it, without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.raw:
            self.text.append(data)


@pytest.mark.parametrize("seed", range(50))
def test_text_of_a_standard_parser(seed):
    r = random.Random(1000 + seed)
    parts = ["<p>alpha</p>", "<div>beta <b>bold</b></div>", "<script>x='<p>'</script>", '<script>if(a<b){"</p>"}</script>', "<style>a>b{}</style>", "plain", "<br>", "<p>&eacute;&#65;</p>", "<span class='a>b'>span</span>", "<i>it</i>", "<!--c-->", "<h3>head</h3>"]
    source = " ".join(r.choices(parts, k=25))
    plain = Plain()
    plain.feed(source)
    plain.close()
    assert parse(source, names=False).text(set()).split() == "".join(" " if not t.strip() else t for t in plain.text).split()


def test_what_is_not_closed():
    assert parse("<svg><p>A</p>").text(set()) == "A" and parse("<p>A</p><script>x").text(set()) == "A"
    assert parse("<p>A</p><object><p>B").text(set()) == "A\nB" and parse("<p>a<script>1</script>b</p>").text(set()) == "ab"


def test_a_doubtful_name_expects_more():
    """In an article what a name casts doubt on is judged as outside it: by the higher threshold."""
    page = parse("<article><div class='social-history'><p>x</p></div><div class='plain'><p>y</p></div></article>")
    doubted = {e.tag + str(k): e.doubted for k, e in enumerate(page.elements) if e.tag == "div"}
    nodes = page.nodes()
    inside = [nodes[e.node][1] for e in page.elements if e.tag == "div"]
    assert list(doubted.values()) == [True, False] and inside == [False, True]
