"""Main text of pages: cases by hand, a whole table, template deduction."""

import html
import re

import pytest

from quillframe.llm import templates


def alone(page):
    return templates.extract(page, [])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no markup  at\nall", "no markup at all"),
        ("<body><nav>menu</nav><article><h1>A</h1><p>b <b>c</b>d<p>e</article><footer>f</footer>", "A b cd e"),
        ("<main><p>x &amp;amp; y&nbsp;z &lt;b&gt;<br>w</main>", "x &amp; y z <b> w"),
        ("<article>a<script>var t='</article><p>';</script>b<!-- <p>c --><style>p{}</style></article>", "ab"),
        ("<article><p>a<div class='ad box'>buy</div><form>q<input></form><p>b</article>", "a b"),
        ("<article>a<section id=comments><article>first!</article></section></article><aside>z</aside>", "a"),
        ("<article>a</article><article class='comment'>b</article>", "a"),
        ("<div class='cookie-notice'>ok?</div><div id='content'><p>t</div><div class=sidebar>s</div>", "t"),
        ("<body><header>h</header><p>one</p><p>two<footer>f", "one two"),
        ("<article><header><h1>T</h1></header><p title='a > b'>x</p><!-- open", "T x"),
        ("<article><p>a</p><script>open", "a"),
        ("<article><p hidden>a</p><p>b < c & d</p></article>", "b < c & d"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ],
)
def test_pages(page, text):
    assert alone(page) == text


def test_template_words_go_and_data_stays(spark):
    rows = [
        (i, "http://h.example/x", f"<div><p>Read more at our site</p><p>own{i} text{i} more{i % 3}</p><p>Rights held</p></div>")
        for i in range(9)
    ] + [(20, None, None), (21, "", ""), (22, "http://alone.example", "<p>only one page here</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS template")
    got = {r.page_id: r.main_text for r in templates.main_text(df).collect()}
    for i in range(9):
        assert got[i] == f"own{i} text{i} more{i % 3}"
    assert got[20] == "" and got[21] == "" and got[22] == "only one page here"
    assert templates.main_text(df.limit(0)).count() == 0


def test_template_text_inside_articles_goes_without_names(spark):
    """No class names: what a host repeats inside its articles is known by repetition."""
    page = lambda i: (
        f"<p>top line</p><article><p>Sign up for our letter</p><p>story {i} begins with words {i * 7}</p>"
        f"<p>and goes on at length {i * i}</p><p>Tell us what you think of it</p></article><p>all rights held</p>"
    )
    rows = [("http://h/x", page(i)) for i in range(8)] + [("http://few/x", page(i)) for i in range(2)]
    got = {(r.url, r.html): r.main_text for r in templates.main_text(spark.createDataFrame(rows, "url string, html string")).collect()}
    for i in range(8):
        assert got[rows[i]] == f"story {i} begins with words {i * 7} and goes on at length {i * i}"
    assert got[rows[8]].startswith("Sign up")  # two pages say nothing of a template


def test_near_copies_keep_their_text(spark):
    body = "".join(f"<p>paragraph {k} of the one story all pages tell</p>" for k in range(6))
    rows = [("http://h/x", f"<div>ad {i}</div><article>{body}<p>seen {i} times</p></article><p>foot</p>") for i in range(9)]
    got = [r.main_text for r in templates.main_text(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert all(text.startswith("paragraph 0") and "paragraph 5" in text and "times" in text for text in got)


def test_classes_are_nested_or_left_out():
    outer, inner, crossing = [(1.0, 10), (5.0, 11), (9.0, 12)], [(2.0, 20), (3.0, 21), (4.0, 22)], [(4.5, 30), (6.0, 31), (7.0, 32)]
    assert templates.nest([outer, inner, crossing]) == [10, 20, 21, 22, 11, 12]
    assert templates.nest([]) == []


def test_vectors_against_brute_force(spark):
    """The template is the tokens that half of the pages and four have once, in classes."""
    from collections import Counter, defaultdict

    pages = [f"<div><p>Read more at our site</p><p>own{i} t{i % 2}</p><p>Rights held{' here' * (i % 3 == 0)}</p></div>" for i in range(9)]
    df = spark.createDataFrame([("http://h/x", p) for p in pages], "url string, html string")
    counts = [Counter({c: n for c, (n, _) in templates.page_tokens(p).items()}) for p in pages]
    vectors = defaultdict(list)
    for token in set().union(*counts):
        vectors[tuple(c[token] for c in counts)].append(token)
    want = {t for v, members in vectors.items() if max(v) == 1 and sum(v) >= 5 and len(members) >= 3 for t in members}
    assert set(templates.host_templates(df).first().template) == want and len(want) > 8


def test_copies_keep_their_text(spark):
    page = "<nav>a b c</nav><article><p>same text on every page</p></article><footer>d e f</footer>"
    df = spark.createDataFrame([(i, "http://h/x", page) for i in range(20)], "page_id long, url string, html string")
    assert {r.main_text for r in templates.main_text(df).collect()} == {"same text on every page"}


def test_copies_without_main_element_keep_their_text(spark):
    frame = lambda body: f"<div><p>Read more at our site</p><p>{body}</p><p>Rights held</p></div>"
    one = "<div><p>every word of this page stands once</p></div>"
    rows = [("http://h/x", frame("own words of the copied page"))] * 8
    rows += [("http://h/x", frame(f"own{i} text{i}")) for i in range(6)]
    rows += [("http://alone/x", one)] * 8 + [("http://odd/x", one)] * 7
    df = spark.createDataFrame(rows, "url string, html string")
    got = {(r.url, r.html): r.main_text for r in templates.main_text(df).collect()}
    assert got[rows[0]] == "own words of the copied page"
    assert all(got[rows[8 + i]] == f"own{i} text{i}" for i in range(6))
    assert got["http://alone/x", one] == got["http://odd/x", one] == "every word of this page stands once"


def test_long_broken_page():
    page = "<article><p>" + "<a href='" * 3 + "word " * 200_000 + "<" * 1000 + "</article>"
    assert alone(page).count("word") in (0, 200_000)
    assert alone("<article>" + "<div>" * 5000 + "deep" + "</article>") == "deep"


def test_whole_table(spark):
    df = templates.op7_template_text(spark, "/root/testdata/sf0.01")
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|br)>", body))
        text = " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
        assert (r.text, r.n_chars) == (text, len(text))
