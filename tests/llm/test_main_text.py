import html
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm.main_text import Weights, best_run, extract_main_text, main_text, read_page, read_tag, seen_kinds, train
from pairwright.llm.queries import ORACLES, QUERIES

COLUMNS = ["page_id", "url", "text", "n_chars"]
PRIOR = Weights()


def article_of(source):
    """The blocks of a page's only article, by patterns that fit the tables' pages."""
    inner = re.search("<article>(.*)</article>", source, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(filter(None, blocks))


def test_query_equals_articles_and_sql(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = sorted(tuple(r) for r in QUERIES["op13_html_extraction"](spark, sf).select(COLUMNS).collect())
    assert found == sorted((r.page_id, r.url, t := article_of(r.html), len(t)) for r in pages.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    assert found == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_html_extraction']})").fetchall())


def test_weights_of_half_the_pages_hold_for_the_other_half(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = train(pages.where("page_id % 2 = 0"), sample=50)
    assert weights.score["w:p"] > weights.score["w:li:a"] and weights.score["p"] > weights.score["body"]
    # The same pages without the element that marks the article: what the run finds by words and tags alone.
    for r in pages.where("page_id % 2 = 1").collect():
        bare = re.sub("</?article>", "", r.html)
        assert main_text(bare, weights) == article_of(r.html)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_best_run_has_the_greatest_sum(scores):
    start, end = best_run(scores)
    sums = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    assert sum(scores[start:end]) == max([s for s, _, _ in sums] + [0])
    assert (start < end) == any(s > 0 for s in scores)


PARAGRAPHS = ["The first paragraph tells of a long journey over many hills &amp; rivers, day after day.", "Here a second one follows, with <a href='/x'>a link</a>, <em>stress</em> and 3 &lt; 4.", "Short.", "And the last one closes the story with yet some more words than the others had before it."]
WANT = "A title\n\nThe first paragraph tells of a long journey over many hills & rivers, day after day.\n\nHere a second one follows, with a link, stress and 3 < 4.\n\nShort.\n\nAnd the last one closes the story with yet some more words than the others had before it."
BODY = "<h1>A  title</h1>" + "\n".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TOP = '<header class="top"><div class="logo">The Site</div><nav><a href="/">Home</a> <a href="/a">All about our products and services</a></nav></header><ul class="main-menu"><li><a href="#">One</a><li><a href="#">Two</a></ul>'
END = '<footer><p>All rights reserved, and a long line of text about the firm that nobody reads at all.</p></footer><script>document.write("<p>no text of any kind</p>")</script>'
SIDE = '<aside><h3>Popular</h3><p>Ten things that you would not believe about words that you read each day.</p></aside>'
NOTICE = '<div id="cookie-notice"><p>We use cookies to make this site better for you and all others. <button>Accept all of them</button></p></div>'
FORM = '<form action="/s"><p>Sign up for our letter and get a gift each week of the year.</p><input name="q"><select><option>One<option>Two</select></form>'
REMARKS = '<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this very much, thank you all for the lovely words.</p></div><article class="comment-body"><p>Me too, and I would like to add many words to it.</p></article></section>'
AD = '<div class="ad-slot"><p>Buy two and get a third for free only today and only here.</p></div><!-- <p>old words</p> --><style>p{content:"</p>"}</style>'


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{TOP}{NOTICE}{AD}<article>{BODY}</article>{SIDE}{REMARKS}{END}</body>",
        f"<body class='has-sidebar'>{TOP}<main><article>{BODY}{AD}{FORM}</article>{REMARKS}</main>{SIDE}{END}",
        f"<body>{TOP}<article><header>{BODY.replace('</h1>', '</h1></header>')}<footer>By somebody, on some day of the year</footer></article>{END}",
        f"<body>{TOP}{NOTICE}<main>{BODY}</main>{FORM}{SIDE}{END}</body>",
        f"<body>{TOP}{AD}<div id='content'><div class='post'>{BODY}</div></div>{REMARKS}{SIDE}{END}</body>",
        f"<BODY>{TOP}<DIV class='ad'>An unclosed advert of some words<ARTICLE>{BODY.replace('</p>', '')}</ARTICLE>{END}",
        f"<body>{TOP}<div class='page with-sidebar'><article>{BODY.replace('Short.', 'Short.</div>')}</article><div class='sidebar'><p>Other words to be read by others.</p></div></div>{END}",
        f"<body>{TOP}<article>{BODY.replace('<h1>', '<h1 title=' + chr(34) + 'a > b <p>' + chr(34) + '>')}<div hidden>Not shown to anyone</div><div style='display: none'>Nor this</div></article>{END}",
    ],
)
def test_pages_of_other_makes(page):
    assert main_text(page, PRIOR) == WANT


def test_characters_and_blocks():
    assert main_text("<article><p>a&nbsp;&#10;b&#x41;&hellip; &bogus; x<b>y</b>z<br>w &amp", PRIOR) == "a bA… &bogus; xyz w &"
    assert main_text("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><pre> a\n  b</pre>", PRIOR) == "one\n\ntwo\n\n1 2\n\n3\n\na b"
    for empty in (None, "", " ", "<p>", "<!-- a b c", "<script>a b c", "<nav>a b</nav>", "<article></article>"):
        assert main_text(empty, PRIOR) == ""
    assert main_text("just words", PRIOR) == "just words"


def test_tags():
    assert read_tag("<DIV CLASS=ad>") == ("div", False, True) and read_tag("<div class='x' id='main-menu'>")[2] and read_tag("<div role=navigation>")[2]
    assert not read_tag("<div class='with-sidebar'>")[2] and not read_tag("<span class='comment'>")[2] and not read_tag("<div class='adapter entry-header'>")[2]
    assert read_tag("<article class='comment-body'>")[2] and not read_tag("<article class='widget'>")[2]
    two = read_page("<article><p>a b</p></article><article>c</article>")
    assert seen_kinds(two) is None and seen_kinds(read_page("<p>a")) is None
    assert seen_kinds(read_page("<div>x y</div><article><p>a b</p></article>"))["w:p", True] == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<main>", "</main>", "<nav>", "</nav>", "<li>", "<a href='x'>", "</a>", "<", ">", '"', "<!--", "-->", "<script>", "</script>", "words here ", "<br/>", "&amp;", "<td>", "<b", "</"]), max_size=40))
def test_any_page_is_read(parts):
    text = main_text("".join(parts), PRIOR)
    assert text == "\n\n".join(" ".join(b.split()) for b in text.split("\n\n")) and "\n\n\n" not in text


def test_odd_rows(spark):
    long = "<article>" + "<p>words and more words</p>" * 100_000 + "</article>"
    hostile = "<div <div \"" * 20_000
    rows = [(1, None, "x", 1.0), (1, None, "x", 1.0), (None, "", None, None), (2, long, "y", 2.0), (2, "<p>one two three", "y", 2.0), (3, hostile, "z", 0.0)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars double")
    weights = train(df)
    got = sorted((r.page_id or 0, r.n_chars) for r in extract_main_text(df, weights).collect())
    assert got == sorted([(1, 0), (1, 0), (0, 0), (2, len("words and more words") * 100_000 + 2 * 99_999), (2, 13), (3, len(main_text(hostile, weights)))])
    assert extract_main_text(df.limit(0), train(df.limit(0))).columns == ["page_id", "text", "n_chars"] and extract_main_text(df.limit(0), weights).count() == 0
    other = spark.createDataFrame([("<p>a b", 1)], "TEXT string, html int")
    assert [tuple(r) for r in extract_main_text(other, weights, html_col="TEXT", out_col="main").collect()] == [(1, "a b", 3)]
