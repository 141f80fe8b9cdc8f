"""Main text of pages: planted pages, odd markup, and bounded time on broken markup."""

import time

import numpy as np
import pytest

from pulsecheck.llm.extraction import Page, main_text, smoothed

LONG = "Some words of an article that go on for a while, as the sentences of articles do when nobody cuts them short."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Menu entry {i}</a></li>' for i in range(8)) + "</ul>"


def text(body):
    return Page(f"<!DOCTYPE html><html><head><title>Title | Site</title><style>p{{}}</style></head><body>{body}</body></html>").text()


AROUND = [
    f"<nav>{MENU}</nav>",
    f"<header><h2>The site</h2>{MENU}</header>",
    f"<footer>&copy; Site. {LONG}</footer>",
    f"<aside><h3>Popular</h3><p>{LONG}</p></aside>",
    f'<div class="sidebar-left"><p>{LONG}</p></div>',
    f'<div id="cookieNotice"><p>We use cookies. {LONG}</p><button>Accept</button></div>',
    f'<div class="ad">{LONG}</div>',
    f'<form action="/s"><label>Your name</label><input name="n"><p>{LONG}</p><select><option>One<option>Two</select></form>',
    f'<script>document.write("<p>{LONG}</p>")</script><style>p{{content:"{LONG}"}}</style><noscript><p>Switch on scripts</p></noscript>',
    f'<section class="post-comments"><h3>2 comments</h3><article class="comment"><p>{LONG}</p></article><p>{LONG}</p></section>',
    f'<ol id="comments"><li>{LONG}<li>{LONG}</ol>',
    f'<div role="complementary">{LONG}</div><div hidden>{LONG}</div><div style="display: none">{LONG}</div><p aria-hidden="true">{LONG}</p>',
    f"<!-- <p>{LONG}</p> --><?php echo 1 ?><![CDATA[ {LONG} ]]>",
]
ARTICLE = f"<h1>The &amp; title</h1><p>{LONG}<p>Short.</p><ul><li>One <b>bo</b>ld<li>Two<br>lines</ul><blockquote>Said &quot;so&quot;&nbsp;\n twice&hellip;</blockquote><p>{LONG}</p><p>End.</p>"
WANTED = ["The & title", LONG, "Short.", "One bold", "Two lines", 'Said "so" twice…', LONG, "End."]


@pytest.mark.parametrize("around", [*AROUND, "".join(AROUND), ""])
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="has-sidebar"><main><div class="content">{}</div></main></div>', "<div id=wrap><section>{}</section></div>", "{}"])
def test_article_without_what_is_around(around, frame):
    assert text(around + frame.format(ARTICLE) + around).split("\n") == WANTED


@pytest.mark.parametrize("around", [a for a in AROUND if not a.startswith("<header>")])  # an article's header may hold its title
def test_parts_inside_the_article(around):
    assert text(f"<article>{ARTICLE}{around}</article>").split("\n") == WANTED
    assert text(f"<div><article><header><h1>The &amp; title</h1><p>By me</p></header>{ARTICLE.split('</h1>')[1]}{around}").split("\n") == WANTED


def test_menus_and_lines_without_a_name():
    plain = f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><a href=/c>Contact</a></div><h1>The &amp; title</h1>{ARTICLE.split('</h1>')[1]}<div><a href=/i>Imprint</a> <a href=/p>Privacy</a></div><div>2024</div>"
    assert text(plain).split("\n") == WANTED


def test_small_pages():
    assert text("") == text("<p> </p>") == text("<nav>x</nav>") == Page("").text() == ""
    assert text("<p>Hello</p>") == "Hello"
    assert Page("no markup  at\nall").text() == "no markup at all"
    assert Page("a < b &lt; c <3 &am &amp d &#65;&#0;").text() == "a < b < c <3 &am & d A�"
    assert Page("<p>x<p title='a > b'>y<p title='odd>z").text() == "x\ny\nz"
    assert text(f"<article><p>{LONG}</article>").split("\n") == [LONG]


def test_cut_off_pages():
    whole = f"<html><body><nav>{MENU}</nav><article>{ARTICLE}"
    assert Page(whole).text().split("\n") == WANTED
    assert Page(whole + "<p class='x").text().split("\n") == WANTED
    assert Page(whole + "<script>x").text().split("\n") == WANTED
    assert Page(whole + "<!-- x").text().split("\n") == WANTED


PIECES = ["<!--", "<", "<a ", "<![CDATA[", "<![", "</", "<a b='", '<a b="x', '<a b="x>', '<a ">" ', "<?", "<script>", "<textarea>", "&#", "<a/", "<a =", "<div>", "<p><b>", "<li>", "</div>", "<table><tr><td>", "<plaintext>", "<svg>", "\x00", "😀".encode("utf-16", "surrogatepass").decode("utf-16")]


@pytest.mark.parametrize("piece", PIECES)
def test_broken_markup_takes_linear_time(piece):
    def seconds(n):
        start = time.process_time()
        Page(f"<p>{LONG}</p>" + piece * (n // len(piece))).text()
        return time.process_time() - start

    seconds(2000)
    assert seconds(200_000) < 10


def test_smoothing_keeps_constants_and_spreads():
    assert np.allclose(smoothed(np.ones(7)), 1)
    peak = smoothed(np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert peak.argmax() == 3 and peak[1] > 0 and peak[0] == 0 and np.allclose(peak, peak[::-1])


def test_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (1, "u", f"<article>{ARTICLE}</article>"), (None, None, "<p>x"), (3, "w", None), (4, "w", ""), (5, "v", f"<nav>m</nav>{'<p>' + LONG + '</p>' * 2}" * 20_000)]
    df = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, key int").repartition(3)
    got = sorted(map(tuple, main_text(df).collect()), key=repr)
    texts = [Page(h or "").text() for *_, h in rows]
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, texts)), key=repr)
    assert len(texts[-1].split("\n")) == 20_000
    assert main_text(df.limit(0)).count() == 0
