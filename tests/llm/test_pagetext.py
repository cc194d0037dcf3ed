"""Main text of pages: given pages against a plain form, and layouts by hand."""

import html
import re

import pytest
from helpers import DATA, given

from storyweave.llm import pagetext
from storyweave.llm.queries import QUERIES



LONG = "The quick brown fox, as ever, jumps over the lazy dog; nobody minds. It was a long day."


def plain(page):
    """The given pages hold their text in one article, whose paragraphs aren't all closed."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    spaced = re.sub(r"<[^>]*>", "\n", re.sub(r"</?b>", "", inner))
    return " ".join(" ".join(html.unescape(x) for x in spaced.split("\n")).split())


def test_given_pages(spark):
    want = {i: (u, plain(h)) for i, u, h in given("pages")}
    got = QUERIES["op13_html_extraction"](spark, DATA).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


LAYOUTS = {
    "no article, plain names": (
        f"<body class='has-sidebar'><div id=top><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div class=wrap><div class=c1><h1>Title</h1>"
        f"<p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div></div><footer>c {LONG}</footer>",
        f"Title {LONG} Ok. {LONG}",
    ),
    "names that tell nothing": (
        f"<div class=a><a href=1>One</a> <a href=2>Two</a></div><div class=b><h2>Head</h2><p>{LONG}<p>Short.<p>{LONG}</div><div class=c><p>2020 Foo</p></div>",
        f"Head {LONG} Short. {LONG}",
    ),
    "an article in a form, with parts of its own": (
        f"<body><form action=x><header><h1>Site</h1></header><main><article class='post has-comments'><header><h1>Head</h1></header><p>Sh is.</p>"
        f"<aside>{LONG}</aside><div class=ad>buy</div><p>He<b>l</b>lo &amp wor&nbsp;ld<br>x</p><form>Join {LONG}</form>"
        f"<section class=comments>{LONG * 9}</section><footer>tags</footer></article></main><footer>{LONG * 4}</footer></form>",
        "Head Sh is. Hello & wor ld x",
    ),
    "notice and reader comments outlast the article": (
        f"<div class='cookie-notice'>{LONG * 3}</div><article><p>Brief.</p></article><div id='comments'><article class=comment><p>{LONG * 5}</p></article></div>",
        "Brief.",
    ),
    "scripts, styles, comments, references": (
        "<article><p>a &lt;b&gt; &#233;&eacute;</p><script>if(a<b){'</p>'}</script><style>p{}</style><!-- <p>no</p> --><noscript>on</noscript><p>c &am</p>",
        "a <b> éé c &am",
    ),
    "no tags": ("just  text\n&lt;here&gt;", "just text <here>"),
    "paragraphs alone": (f"<p>{LONG}<p>Two<p>{LONG}", f"{LONG} Two {LONG}"),
    "table": (f"<table><tr><td>menu<td><p>{LONG}</p><p>{LONG}</table>", f"{LONG} {LONG}"),
    "only navigation": ("<body><nav>a b c</nav><footer>d</footer>", ""),
    "cut short": ("<article><p>abc</p><p title='x", "abc"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert " ".join(pagetext.content(pagetext.blocks(page))) == want


def test_paths_with_long_punctuated_text_score_highest():
    scores = pagetext.path_scores([0, 0, 1, 1, 1, 0], *(pagetext.np.array(x, float) for x in ([9, 8, 200, 180, 220, 9], [9, 8, 0, 0, 0, 9], [0, 0, 6, 5, 7, 0])))
    assert scores[1] > 10 * scores[0]


def test_odd_rows(spark):
    deep = "<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>one</p>", "x"), (3, "u", "<p>one</p>", "x"), (None, "u", " \n ", "x"), (5, "u", deep, "x"), (6, "u", "<article><p>" + "word " * 200_000, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in pagetext.extract(table).collect()), key=repr)
    long = ("word " * 200_000).strip()
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "one", 3), (3, "one", 3), (0, "", 0), (5, "deep", 4), (6, long, len(long))], key=repr)
    assert pagetext.extract(table.limit(0)).count() == 0
