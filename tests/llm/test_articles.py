"""Main text of pages whose text is known."""

import html
import re

import pytest

from tallyward.llm.articles import extracted, main_text

LINES = ["A first paragraph, with commas, runs on for a while so that it counts as text.", "Short.", "Another one, with a link in it, is kept as well, of course."]
BODY = "".join(f"<p>{line.replace('a link', '<a href=x>a link</a>')}</p>" for line in LINES)
TEXT = "\n".join(["Title", *LINES])

LAYOUTS = {
    "plain containers": f"<body><div id=top><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div><div class='content'><h1>Title</h1>{BODY}</div>"
    "<div class=sidebar><p>Side text, with commas, more and more.</p></div><div id=footer>(c) x</div></body>",
    "page parts by tag": f"<header><h2>Site</h2></header><nav>x</nav><main><h1>Title</h1>{BODY}<aside>no</aside></main><footer>f</footer>",
    "reader comments": f"<main><article><header><h1>Title</h1></header>{BODY}<footer>by me</footer></article><section class=comments>"
    "<article class=comment><p>I, for one, think, that, this, is long, long, long, long, and longer still, than all, of, it, together</p></article></section></main>",
    "layout table": f"<table><tr><td class=nav><a href=1>a</a><td><h1>Title</h1>{BODY}</td><td class=ads>ads</td></tr></table>",
    "wrappers": f"<div class=wrap><div class='post'><div class='post-title'><h1>Title</h1></div><div class=entry><section>{BODY}</section></div></div><div class='widget'>w</div></div>",
    "notices and forms": f"<div class='cookie-notice'><p>We use cookies, lots, of, them, and, more and more and more.</p><button>ok</button></div><article><h1>Title</h1>{BODY}"
    "<form><p>Sign up, now</p><input></form><div class='share-buttons'><a>f</a></div></article><div id='comments'><h3>3 comments</h3><p>Nice, one</p></div>",
    "form around the page": f"<form><div class=nav>menu</div><div class=body><h1>Title</h1>{BODY}</div></form>",
    "no containers": f"<body><nav>n</nav><h1>Title</h1>{BODY}<footer>f</footer>",
    "hidden parts": f"<article><h1>Title</h1><p hidden>x</p><div style='display: none'>y</div><script>var t='</p>';</script><style>p{{}}</style>{BODY}<!-- z --></article>",
    "words run together": f"<div id='siteHeader'>s</div><div class='mainContent'><h1>Title</h1>{BODY}<div class='cookiebar'>c, c, c</div><div id='userComments'><p>Nice, really</p></div>"
    "<section class='post-footnotes'></section></div><div id='pageFooter'>f</div>",
    "names that only mention a part": f"<body class='has-sidebar'><div class='post with-comments'><h1>Title</h1>{BODY}</div><div class='ad-slot'>buy, buy, buy</div></body>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert main_text(LAYOUTS[layout]) == TEXT


def test_blocks_and_references():
    assert main_text("<article><h1>A &amp; B</h1><p>x&nbsp; y\n z<br>w &copy &am</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>") == (
        "A & B\nx y z w © &am\none\ntwo\na b"
    )
    assert main_text("<p>before <span class=ad>not this</span> after</p>") == "before after"


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    long = "<p>" + "word, " * 60_000 + "</p>"
    pages = [None, "", "just words &amp; more", "<p>x" * 3 + "</div></article>", "<!-- unclosed <p>x", "<script>a<p>b", "a<![if x]>b", deep, long, "<p>cut off</p><p class='x"]
    want = ["", "", "just words & more", "x\nx\nx", "", "", "ab", "deep", ("word, " * 60_000).strip(), "cut off"]
    rows = spark.createDataFrame([(i or None, p, "own", 1) for i, p in enumerate(pages)] * 2, "page_id bigint, html string, text string, _text int")
    got = extracted(rows)
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == sorted([*enumerate(want)] * 2)
    assert extracted(rows.limit(0)).collect() == []


def test_all_pages(result, spark, small):
    """The tables' pages hold one article each, here cut out and split by patterns."""
    got = {r.page_id: r for r in result("op13_")}
    for page in spark.read.parquet(f"{small}/pages.parquet").collect():
        inside = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        lines = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", inside).replace("<br>", " "))]
        text = "\n".join(x for x in lines if x)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (text, len(text), page.url)
