import pytest
from fixtures import SF

from eoframe.llm import pages
from eoframe.llm.tables import table

SCHEMA = "page_id long, url string, html string, node string"


def texts(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], SCHEMA)
    return {r.page_id: r.text for r in pages.extract(frame).collect()}


@pytest.mark.parametrize("html, text", [
    ("<article><h1>T</h1><p>a  b\n c</p><p>d</p></article>", "T a b c d"),
    ("<nav>menu</nav><header>h</header><p>x<b>y</b>z<br>w<footer>f</footer>", "xyz w"),
    ("<p>1 &lt; 2 &amp;amp; &#233;&eacute;</p>", "1 < 2 &amp; éé"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes</p>", "yes"),
    ("<!-- <p>no</p> --><p>yes <!-- unclosed", "yes"),
    ("<div class='comments'><p>reader</p></div><div class=x><p>main</p></div><aside>side</aside>", "main"),
    ("<form>f<input></form><div role=navigation>n</div><p>a < b</p>", "a < b"),
    ("<p>open <b>bold<p>next", "open bold next"),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<article></article>", ""),
    ("<ul><li>one<li>two</ul>", "one two"),
    ("<article><div id='ad-1'>buy</div><p>text</p></article></article></div>", "text"),
    ("<ARTICLE><P TITLE='a > b'>upper</P></ARTICLE>", "upper"),
])
def test_one_page(spark, html, text):
    assert texts(spark, [(1, "http://h.example/x", html)]) == {1: text}


@pytest.mark.parametrize("html, text", [
    ("<body class='no-sidebar'><p>text</p></body>", "text"),
    ("<div class='content-sidebar-wrap'><p>text</p></div>", "text"),
    ("<article class='post share-enabled'><p>text</p></article>", "text"),
    ("<article class='post related'><p>text</p></article>", "text"),
    ("<article><section id='related-work'><p>text</p></section></article>", "text"),
    ("<div class='widget'><main><p>text</p></main><p>more</p></div>", "text more"),
    ("<div class='comments'><article>short</article></div><article><p>main article</p><p class=share>s</p></article>", "main article"),
    ("<div class='social'><p>all there is</p></div>", "all there is"),
    ("<p>one <span class='ad'>buy</span> two</p>", "one two"),
    ("<article><p>a</p><figure><img><figcaption>cap</figcaption></figure><math><mi>x</mi></math><object>o</object>"
     "<p><output>5</output><button>b</button></p></article>", "a cap x o 5 b"),
])
def test_names_of_elements_that_hold_the_main_text(spark, html, text):
    assert texts(spark, [(1, "http://h.example/x", html)]) == {1: text}


def test_template_of_a_host_finds_the_main_slot_without_names(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=a1><p>links {i} here</p></div><div class=b2><div class=c3>"
             f"<p>{'story ' * (20 + i)}</p></div></div><div class=d4>bottom</div>") for i in range(6)]
    assert texts(spark, rows) == {i: ("story " * (20 + i)).strip() for i in range(6)}


def test_all_slots_of_a_host_stay(spark):
    def page(i):
        return (f"<div class=top>Our site</div><article><h1>Title {'abcdef'[i]}</h1><div class=lead><p>lead {'uvwxyz'[i]}</p></div>"
                f"<div class=body><p>{'story ' * (20 + i)}</p></div><div class=more>{'mnopqr'[i]} end {i}</div></article>")

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    assert texts(spark, rows) == {
        i: f"Title {'abcdef'[i]} lead {'uvwxyz'[i]} {'story ' * (20 + i)}{'mnopqr'[i]} end {i}" for i in range(6)
    }


def test_a_line_that_repeats_inside_the_main_slot_goes(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><p>{'story ' * (20 + i)}</p><p>Get our letter.</p><p>{i} apples</p></article>")
            for i in range(6)]
    rows += [(9, "http://other.example/", "<article><p>Another letter.</p></article>")]
    want = {i: f"{'story ' * (20 + i)}{i} apples" for i in range(6)} | {9: "Another letter."}
    assert texts(spark, rows) == want


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", "<article><p>the same story</p></article>") for i in range(5)]
    rows += [(7, "http://h.example/7", "<article><p>another</p></article>")]
    assert texts(spark, rows) == dict.fromkeys(range(5), "the same story") | {7: "another"}


def test_every_row_comes_back(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "not a url", None), (None, "http://[bad", "<p>b</p>")]
    frame = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], SCHEMA)
    assert pages.extract(frame).count() == 4
    assert pages.extract(frame.limit(0)).count() == 0


def test_long_page(spark):
    html = "<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>"
    assert texts(spark, [(1, "http://h.example/", html)])[1] == " ".join(["word & more"] * 50_000)


def test_given_pages(spark):
    import html as entities
    import re

    rows = table(spark, SF, "pages")
    found = {r.page_id: r.text for r in pages.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        assert found[r.page_id] == " ".join(entities.unescape(inner).split())
