import time

import pytest

from termtide.functions.html import decode_entities, first_paragraph
from termtide.operators.descriptions import descriptions, submitted_descriptions

SNIPPET = "The speaker bar keeps the volume level between programs"
PAGE = f"""<html><body><p>Before</p><div class="x" id="productDescription" data-y="1">
<h3>Title</h3><p class="d">{SNIPPET} &amp; more.</p><p>Second</p></div><p>After</p></body></html>"""


def extract(spark, html, **options):
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    found = descriptions(pages, **options).collect()
    return found[0].description if found else None


def test_first_paragraph_of_the_container(spark):
    assert extract(spark, PAGE) == f"{SNIPPET} & more."


def test_page_without_container_gives_nothing(spark):
    assert extract(spark, "<html><body><p>Search</p></body></html>") is None
    assert extract(spark, None) is None


def test_url_without_page_gives_nothing(spark, rows):
    urls = spark.createDataFrame([("u",), ("unreachable",)], "url string")
    pages = spark.createDataFrame(
        [(1, "u", PAGE), (2, "other", PAGE)], "page_id long, url string, html string")
    for limit in (-1, 1 << 40):  # join after and before the extraction
        got = submitted_descriptions(urls, pages, broadcast_rows=limit)
        assert rows(got) == [("u", f"{SNIPPET} & more.")]


@pytest.mark.parametrize("html, expected", [
    ("<p>one<p>two", "one"),
    ("<p>one<div>two</div>", "one"),
    ("<P>One<BR>two<br/>three</P>", "One two three"),
    ("<p>a <b>bo</b>ld\n\t word</p>", "a bold word"),
    ("<p></p><p>two</p>", ""),
    ("<pre>x</pre><p>y</p>", "y"),
    ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ('<script>var t="<p>no</p>";</script><p>yes<script>"</p>"</script> too</p>', "yes too"),
    ("<p>5 < 6 &lt;b&gt; &amp;lt; &#65;&#x42; &nosuch; & &eacute;</p>", "5 < 6 <b> &lt; AB &nosuch; & é"),
    ("<div><div><p>deep</p></div></div>", "deep"),
    ("<div>x</div></div><p>outside", None),
    ("</div><div><p>outside</p></div>", None),
    ("<section>no paragraph</section>", None),
])
def test_paragraph_rules(spark, html, expected):
    assert extract(spark, f"<div id=productDescription>{html}</div><p>after</p>") == expected


@pytest.mark.parametrize("attributes, found", [
    ("id='productDescription'", True), ("class=a ID = \"productDescription\"", True),
    ("id=productDescription2", False), ("id='productdescription'", False),
    ("data-id='productDescription'", False),
])
def test_container_id(spark, attributes, found):
    assert (extract(spark, f"<div {attributes}><p>x</p></div>") == "x") is found


def test_tag_as_container(spark):
    assert extract(spark, "<articles><p>no</p></articles><article><p>x</p></article>",
                   container="article") == "x"


def test_character_references(spark):
    cases = {
        "&#0;": "\ufffd", "&#xD800;": "\ufffd", "&#99999999999999999999;": "\ufffd",
        "&#128512;": "\U0001F600", "&amp;amp;": "&amp;", "&&amp;&": "&&&", "&copy;2": "©2", "x&": "x&",
        "&#38;lt;": "&lt;",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", decode_entities("t").alias("d")).collect()} == cases


def _one(spark, html, container):
    df = spark.createDataFrame([(html,)], "html string")
    return [r.description for r in first_paragraph(df, container).collect()]


def test_quoted_values_may_hold_a_tag_end(spark):
    assert _one(spark, '<div id="d"><p title="a>b">first</p></div>', "#d") == ["first"]
    assert _one(spark, '<div data-x="a>b" id="d"><p>in</p></div>', "#d") == ["in"]
    assert _one(spark, "<article title='x>y'><p>a <b title='>'>b</b></p></article>", "article") == [
        "a b"]


@pytest.mark.parametrize("hidden", ["<script>", "<style>", "<!--"])
def test_what_is_not_closed_hides_the_rest(spark, hidden):
    assert _one(spark, f"{hidden}<article><p>a</p></article>", "article") == []
    assert _one(spark, f"<article><p>a</p>{hidden}<p>b</p></article>", "article") == ["a"]


@pytest.mark.parametrize("piece", ["<script>x", "<!--", "<a ", "<article ", "<p ", "<a '", '<i id="'])
@pytest.mark.parametrize("container", ["article", "#d"])
def test_a_megabyte_that_is_not_closed_takes_seconds(spark, piece, container):
    html = "<article id=d><p>x " + piece * (1_000_000 // len(piece))
    started = time.monotonic()
    assert len(_one(spark, html, container)) <= 1
    assert time.monotonic() - started < 15


def test_a_page_crawled_twice_has_one_description(spark, rows):
    page = '<div id="productDescription"><p>{}</p></div>'.format
    pages = spark.createDataFrame([
        (1, "http://a", page("old")), (2, "http://a", page("new")), (3, "http://a", "<p>none</p>"),
        (4, "http://b", page("other"))], "page_id long, url string, html string")
    urls = spark.createDataFrame([("http://a",)], "url string")
    for limit in (-1, 10):
        found = submitted_descriptions(urls, pages, broadcast_rows=limit)
        assert rows(found) == [("http://a", "new")]
