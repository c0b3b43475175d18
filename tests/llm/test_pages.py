import html
import re

import duckdb
import pytest

from skillgrid.llm import pages as PG
from skillgrid.llm.queries import QUERIES

from .conftest import SF


def text(page):
    return "\n".join(t for k, t in PG.read_blocks(page) if k == PG.MAIN)


def test_query_against_article_patterns(spark):
    """The tables' pages mark one flat article: cut it out with patterns instead of reading the page."""
    rows = duckdb.execute(f"SELECT page_id, url, html FROM read_parquet('{SF}/pages.parquet')").fetchall()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    want = {}
    for i, url, page in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        t = "\n".join(b for b in blocks if b)
        want[i] = (url, t, len(t))
    assert got == want and all(t for _, t, _ in want.values())


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain", ""), ("<article>a  b\n<b>c</b>d<p>e &amp; f&nbsp;g&lt;p&gt;</article>x", "a b cd\ne & f g<p>"),
    ("<body><header>top<h1>Site</h1></header><article><header><h1>Title</h1><p>by x</p></header><p>one<br>two</p></article>", "Title\none two"),
    ("<article><p>a</p><nav>m</nav><aside>s</aside><form>f<input>g</form><script>var x='</article>'</script><style>p{}</style><p>b</p></article>", "a\nb"),
    ("<article><p>a</p><div class='ad-box'>buy<div>now</div></div><div id=\"sideBar\">s</div><div class=cookie-notice>c</div><p>b</p></article>", "a\nb"),
    ("<article><p>a</p><section class='comments'><article class=comment><p>nice</p></article><article><p>no</p></article></section></article>", "a"),
    ("<article><p>a</p></article><div class=comments><article><p>I say</p></article></div>", "a"),
    ("<div class=ad>never closed <article><p>a</p></article>", "a"), ("<main><nav>m</nav><p>a</p></main><p>out</p>", "a"),
    ("<div role=main><p>a</p><div><div>b</div></div>c</div>d", "a\nb\nc"), ("<article><p>1 < 2 <!-- no <p> --> and</p><p>cut <a hre", "1 < 2 and\ncut"),
    ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</tr><tr><th>3</table><pre>p\n q</pre></article>", "x\ny\n1 2\n3\np q"),
    ("<ARTICLE><P TITLE='a>b'>Q<P title=\"unclosed>R</P></ARTICLE>", "Q\nR"), ("<article><p hidden>h</p><p style='display: none'>i</p><p>j", "j"),
    ("<article>a<script>never closed <p>b</p></article>", "a"), ("<article class='post has-comments-off'><p>x</p></article>", "x"),
    ("<body class='with-sidebar'><main class='no-nav'><p>x</p></main>", "x"),
])
def test_blocks(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page,want", [
    ('<article><p>A</p><svg class="i"/><p>B</p></article>', "A\nB"), ("<article><p>A</p><math/><p>B</p><math><mi>x</mi></math><p>C</p></article>", "A\nB\nC"),
    ("<article><p>A</p><svg><style/><path d='M0'/><svg/><title>t</title></svg><p>B</p></article>", "A\nB"),
    ("<article><p>A</p><svg class='menu'><path><p>B</p></article>", "A\nB"),
    *((f"<article><p>A</p><div><{t} class=x></div><p>B</p></article><{t}>c</{t}>", "A\nB") for t in "object audio video canvas select noscript template".split()),
    *((f"<article><p>A</p><{t} data-x='1'><p>B</p></article>", "A\nB") for t in "object audio video canvas noembed iframe svg".split()),
    *((f"<article><p>A</p><{t}>x<{t}><p>y</p></{t}>z</{t}><p>B</p></article>", "A\nB") for t in "object video svg template".split()),
    ("<article><p>A</p><iframe src='x'/><p>B</p><iframe><p>c</p></iframe></article>", "A\nB"),
    ("<article><p>A</p><textarea>x<p>y</p></article>", "A"), ("<article><p>A</p><p title=don't>B</p><p title='x'>C</p></article>", "A\nB\nC"),
])
def test_elements_left_open_or_closed_at_once(page, want):
    assert text(page) == want


@pytest.mark.parametrize("quote", "\"'")
def test_long_tags_keep_their_attributes(quote):
    data = "{a>b} " * 40_000
    page = f"<article><p>A</p><div data-json={quote}{data}{quote} class={quote}ad-box{quote}>buy</div><p data-json={quote}{data}{quote}>B</p></article>"
    assert text(page) == "A\nB"


def test_broken_tags_take_linear_time():
    import time
    for broken in ("<a b='>' ", "<a b=\">\" c='>' ", "<iframe>", "<video>", "<p x=\">", "<" + "a" * 50):
        start = time.process_time()
        PG.read_blocks("<article>" + broken * 20_000 + "<a b='")
        assert time.process_time() - start < 5


def test_unmarked_pages(spark):
    """Without article markup the host's repeated strings go and unique runs stay; another host's copy counts for nothing."""
    menu = "Home News Sport Weather Culture Travel Money Opinion Archive Contact and more of it"
    foot = "All rights reserved by the publisher of this site since nineteen ninety nine"
    pages = [(i, f"http://a.com/{i}", f"<body><div>{menu}</div><p>{'XYZ'[i]} is the story told only here, the ending is {'xyz'[i]}</p><div>{foot}</div>") for i in range(3)]
    pages += [(10, "http://b.com/", f"<body><div>{menu}</div><p>Alone.</p>"), (11, None, None), (None, "http://a.com/n", ""), (2, *pages[2][1:]),
              (12, "http://a.com/art", f"<article><p>{menu}</p></article>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, ord int")
    got = sorted((str(r.page_id), r.text) for r in PG.main_text(df).collect())
    story = [f"{'XYZ'[i]} is the story told only here, the ending is {'xyz'[i]}" for i in range(3)]
    assert got == sorted([("0", story[0]), ("1", story[1]), ("2", story[2]), ("2", story[2]), ("10", f"{menu}\nAlone."), ("11", ""), ("None", ""), ("12", menu)])
    assert PG.main_text(df.limit(0)).collect() == []
