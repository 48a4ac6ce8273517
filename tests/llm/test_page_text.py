"""Article text of pages: awkward markup, votes of a host, and a plain reading of simple pages."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from geocairn.llm import page_text as pt

PAGES = "page_id long, url string, html string"
PROSE = "A river of words runs here, slowly and without an end, past stones and mills. " * 4


def text_of(source, paths=()):
    return pt.Page(source).text(list(paths))


@pytest.mark.parametrize("source,want", [
    ("", ""), ("plain words only", "plain words only"), ("<p>one<p>two <b>bo<i>ld</b>er</i>", "one two bolder"),
    ("<div>1 < 2 &amp; 3 &gt; 2 &#x41;&#66;&eacute;&unknown; &copy</div>", "1 < 2 & 3 > 2 ABé&unknown; ©"),
    ("<div>a\n\t b<br>c<br/>d<!-- no --->e</div>", "a b c de"),
    ("<body><script>if (a < b) document.write('<p>x</p>')</script><style>p{}</style><p>text</p>", "text"),
    ("<body><p>text<script>never closed <p>lost", "text"), ("<p>text<!-- never closed <p>lost", "text"),
    ("<p>text<a href=\"never closed", "text"), ("<ul><li>one<li>two</ul>", "one two"), ("</div></p></b>x</3>", "x</3>"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<div hidden>no</div><div>yes</div>", "yes"),
    ("<title>no</title><p>yes</p>", "yes"), ("<html><head><meta x><p>in body</html>", "in body"), ("\x00 <p>  &nbsp; </p>", "\x00"),
])
def test_markup(source, want):
    assert text_of(source) == want


def test_only_the_article_is_left():
    page = f"""<html><body class="has-sidebar"><header><h1>Site</h1><form>Search <input></form></header><nav>Home | News</nav>
      <div class="cookie-notice">We use cookies</div><div id="wrap"><div class="post post-17"><header><h1>Title &amp; more</h1><span>by x</span></header>
      <div class="entry"><p>{PROSE}</p><p>Second, part.</p><div class="ad">Buy</div><form>Mail <input></form></div></div>
      <aside>Latest</aside><div class="comments"><p>{PROSE * 3}</p></div></div><footer>Imprint</footer></body></html>"""
    assert text_of(page) == f"Title & more {' '.join(PROSE.split())} Second, part."


def test_a_word_does_not_drop_most_of_the_text():
    assert text_of(f"<body><div class='with sidebar'><p>{PROSE}</p></div><div class=sidebar>x</div>") == " ".join(PROSE.split())


def test_a_title_above_the_text_belongs_to_it():
    assert text_of(f"<body><div class=a><h1>Title</h1><div class=b><p>{PROSE}</p></div></div>").startswith("Title A river")


def test_host_votes_decide_for_pages_that_cannot(spark):
    story = lambda i: f"<body><div class='box n{i}'><p>{PROSE}</p></div><div class=more><p>Teaser {i}</p></div></body>"
    short = f"<body><div class='box n99'><p>Short.</p></div><div class=more><p>{PROSE}</p></div></body>"
    rows = [(i, "https://a.example/x", story(i)) for i in range(5)]
    rows += [(10, "http://A.EXAMPLE?q", short), (11, "http://b.example/", short), (12, "no scheme", short), (13, None, short),
             (14, "http://a.example/", "<p>without a box</p>"), (None, "http://a.example/", None), (15, "http://a.example/", ""),
             (16, "http://a.example/", short), (16, "http://a.example/", short)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    for c in ("text", "host", "path", "votes", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    out = pt.with_main_text(df)
    assert out.columns == [*(c for c in df.columns if c != "text"), "text", "n_chars"]
    got = out.collect()
    prose = " ".join(PROSE.split())
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) and r.host == "clash" for r in got)
    assert all(by_id[i] == prose for i in range(5)) and by_id[10] == by_id[16] == "Short."
    assert by_id[11] == by_id[12] == by_id[13] == prose and by_id[14] == "without a box" and by_id[None] == by_id[15] == ""
    paths = {(r.host, r.rank): r.shown for r in pt.winning_paths(df).collect()}
    assert paths["a.example", 1] == "body>div.box.n#" and set(h for h, _ in paths) == {"a.example", "b.example"}


def test_no_pages(spark):
    assert pt.with_main_text(spark.createDataFrame([], PAGES)).count() == 0


class Plain(HTMLParser):
    """Text inside ``article`` of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "aside", "form")
        if tag not in ("b", "i", "a"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "aside", "form")
        if tag not in ("b", "i", "a"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_equals_a_plain_reading_of_generated_pages(spark):
    rng = random.Random(4)
    words = ["stone", "b&uuml;ro", "&lt;x&gt;", "a,", "<b>bold</b>", "<a href='#'>link</a>", "<i>it\nal</i>ic", "&#8364;", "<br>"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(80):
        body = "".join(rng.choice([f"<p>{line(30)} plain words to read</p>", f"<h2>{line(3)}</h2>", f"<ul><li>{line(9)} x</li><li>{line(2)}</li></ul>",
                                   f"<script>{line(3)}</script>", f"<aside>{line(5)}</aside>", f"<form><p>{line(4)}</p></form>"])
                       for _ in range(rng.randrange(1, 9))) + f"<p>{PROSE}</p>"
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body><nav>{line(9)}</nav><article class='n{i}'>{body}</article><footer>{line(9)}</footer></body></html>"))
    got = {r.page_id: r.text for r in pt.with_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i, _, source in rows:
        plain = Plain()
        plain.feed(source)
        assert got[i] == " ".join(" ".join(b.split()) for b in plain.blocks if b.split()), source


@pytest.mark.parametrize("source", [
    "<div>" * 40_000 + "x" + "</i>" * 40_000, "<b>" * 40_000 + "<p>x</p>" * 20_000, "<!--" * 100_000, "<a b='" * 50_001,
    "<p><b>" * 40_000, "<li>" * 40_000, "</x>" * 100_000, "<" * 100_000, "&" * 200_000, "<td>" * 40_000, "<script>" * 40_000, "<article>x</article>" * 20_000])
def test_hostile_markup_takes_time_in_proportion(source):
    began = time.time()
    page = pt.Page(source)
    page.text([page.paths[-1]])
    assert time.time() - began < 5
