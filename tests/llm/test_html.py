import html as entities
import re

from riskweave.llm import op6_html as op
from riskweave.llm import registry

from .helpers import SMALL, table_rows


def by_pattern(page):
    """The given pages' article by splitting at block tags: nothing inside is set aside there."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", article)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    got = {r["page_id"]: r for r in registry.queries()["op6_main_text"](spark, SMALL).collect()}
    rows = table_rows("pages")
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == by_pattern(r["html"]) and got[r["page_id"]]["url"] == r["url"]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies.</p></div><ul class="top-menu"><li><a href="/">Home</a></li></ul>
%s<h2>Head &amp; tail</h2><p>First   paragraph of the
text with <b>bold</b> and <a href="x">a link</a>, long enough to count as content here.<p>Second&nbsp;one, unclosed, also with quite a lot of words in it.
<ul><li>point one<li>point two</ul><div class="advert">Buy now</div><script>var a = "</p><p>no";</script><p>Short.</p>
<form><p>Name</p><input></form>%s
<section class="comments"><h3>Comments</h3><p>A reader comment that is fairly long and reads like an article paragraph.</p></section>
<aside><p>Related stories</p></aside><footer>&copy; 2000</footer></body></html>"""
WANT = ("Head & tail\nFirst paragraph of the text with bold and a link, long enough to count as content here.\n"
        "Second one, unclosed, also with quite a lot of words in it.\npoint one\npoint two\nShort.")


def test_parts_that_are_not_the_article():
    for tags in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content"><div>', "</div></div>")):
        assert op.main_text(PAGE % tags) == WANT


def test_awkward_pages(spark):
    assert op.main_text(None) == op.main_text("") == op.main_text("<p></p><nav>x</nav>") == ""
    assert op.main_text("plain text only") == "plain text only"
    assert op.main_text("<p>a<p>b<!-- c --></div></b>") == "a\nb"
    assert op.main_text("<html><head><title>T</title><body><p>open head") == "open head"
    assert op.main_text("<article><p>x &lt;b&gt; &#233; &bogus; y</p><br>") == "x <b> é &bogus; y"
    assert op.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    long = "<article>" + "<p>" + "word " * 100_000 + "</p></article>"
    assert len(op.main_text(long)) == 499_999
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>t", "x"), (3, "u", "", "x")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in op.extract(p).collect()) == [(0, "t", 1), (1, "", 0), (1, "", 0), (3, "", 0)]
    assert op.extract(p.limit(0)).collect() == []


def test_smoothing_keeps_a_constant_and_spreads_a_peak():
    assert all(abs(x - 3) < 1e-12 for x in op.smoothed([3.0] * 7))
    s = op.smoothed([0, 0, 9, 0, 0])
    assert s[2] == max(s) and s[1] == s[3] > s[0] > 0


BODY = "<h1>Title here</h1><p>%s</p><p>Short one.</p><p>%s</p>" % ("first long paragraph of the article " * 8, "second long paragraph, also long " * 8)
TEXT = "Title here\n%s\nShort one.\n%s" % (("first long paragraph of the article " * 8).strip(), ("second long paragraph, also long " * 8).strip())
CHROME = ('<nav><a href="/">Home</a> <a href="/a">About us</a></nav>', '<footer>Imprint</footer><div class="cookie-notice"><p>We use cookies</p></div>')


def test_class_words_do_not_lose_the_article():
    for before, after in (
            ('<div class="site-content has-sidebar">', "</div>"), ('<main class="with-sidebar">', "</main>"),
            ('<article class="post comments-open">', "</article>"), ('<div class="page-header-fixed">', "</div>"),
            ('<article class="related-posts-enabled">', "</article>"), ('<form id="aspnetForm"><article>', "</article></form>"),
            ('<div id="header"><article>', "</article></div>"), ('<div class="modal"><div class="sponsored">', "</div></div>"),
            ('<div class="related"><main>', "</main></div>"), ("<nav><article>", "</article>"), ('<body class="dialog"><div>', "</div>"),
            ('<div class="header">', "</div>"), ("<section><div><div>", "</div></div></section>"), ("", "")):
        assert op.main_text(CHROME[0] + before + BODY + after + CHROME[1]) == TEXT, before


def test_named_parts_beside_the_article_go():
    comments = '<div class="comments">' + "<p>a reader says quite a lot about this, longer than the article itself</p>" * 60 + "</div>"
    teaser = '<aside><article><p>teaser of another story</p></article></aside><div class="related"><article>more</article></div>'
    for tags in (("<article>", "</article>"), ("<main>", "</main>"), ("<div><section>", "</section></div>")):
        for extra in (comments, teaser, '<div class="share-buttons">Share</div><p class="ad">Buy</p>', '<ul class="mainMenu"><li>x</ul>'):
            assert op.main_text(CHROME[0] + tags[0] + BODY + tags[1] + extra + CHROME[1]) == TEXT, (tags, extra)
    assert op.main_text("<article>" + BODY + '<p>one <span class="ad">buy</span> two</p></article>') == TEXT + "\none two"


def test_clusters_decide_pages_without_article_tags():
    """Several layouts without article tags: the text blocks stand among link lists of other containers."""
    links = "".join(f'<li><a href="/{i}">story number {i}</a></li>' for i in range(30))
    paragraphs = [f"paragraph {i} " + "with many words that tell something " * (2 + i % 4) for i in range(12)]
    want = "\n".join(" ".join(p.split()) for p in paragraphs)
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    cells = "".join(f"<div>{p}</div>" for p in paragraphs)
    for page in (f"<div><ul>{links}</ul></div><div><div>{body}</div></div><div><ul>{links}</ul></div>",
                 f"<table><tr><td><ul>{links}</ul></td><td>{body}</td><td><ul>{links}</ul></td></tr></table>",
                 f"<body><ul>{links}</ul><section>{cells}</section><ul>{links}</ul></body>",
                 f"<center><div>{body}</div></center><ul>{links}</ul>"):
        assert op.main_text(page) == want


def test_odd_declarations():
    for odd in ("<![foo bar]>", "<![x[>", "<![ b>", "<![CDATA[x]]>", "<![if IE]>", "<!ELEMENT x>", "<!>", "<?php x ?>", "<![endif]-->", "<!->"):
        assert op.main_text(f"<p>a</p>{odd}<p>b</p>").replace("\n", " ").replace("]]>", "").replace("-->", "").split() == ["a", "b"], odd
    for cut in ("<![", "<![x[", "<!", "<!--", "<!-- x", "</", "<", "<p", "<a href='", "<script>x", "&", "&#", "&#x"):
        assert op.main_text("<p>text</p>" + cut).startswith("text"), cut


def test_work_follows_the_length():
    import time
    for page in ("<div>x" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<div>" * 20_000 + "</i>" * 20_000, "<ul><li>" * 20_000 + "x",
                 '<div class="ad">x' * 10_000, "<p><b>" * 20_000):
        at = time.perf_counter()
        op.main_text(page)
        assert time.perf_counter() - at < 5, page[:20]
