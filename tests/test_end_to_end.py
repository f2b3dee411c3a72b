"""The calculations against plain Python loops over the smallest data."""

import random
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
import regex

from tests.plain_porter import stem
from termtide import params, schemas
from termtide.operators.submissions import outcomes
from termtide.plans.queries import QUERIES
from termtide.sources.pages import read_pages
from termtide.sources.submissions import read_submissions

SF_DIR = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


class FirstParagraph(HTMLParser):
    """Text of the first paragraph of the article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.state, self.text = False, "before", []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag == "p" and self.inside:
            self.state = "in" if self.state == "before" else "after"
        elif tag == "br" and self.state == "in":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if self.state == "in" and tag in ("p", "article"):
            self.state = "after"

    def handle_data(self, data):
        if self.state == "in":
            self.text.append(data)


def description(html):
    parser = FirstParagraph()
    parser.feed(html)
    return " ".join("".join(parser.text).split())


def words(text):
    for word in regex.findall(params.TOKEN_RE, text or ""):
        if len(word) > 1 and word.lower() not in params.STOP_WORDS:
            yield word


def top(stems):
    least = params.HEAVY_HITTERS_PCT * sum(stems.values())
    ranked = sorted(((-n, w) for w, n in stems.items() if n >= least))
    return [(w, float(-n)) for n, w in ranked[: params.TOP_K]]


@pytest.fixture(scope="module")
def submitted():
    """URL -> description of the accepted submissions."""
    pages = table("pages")
    by_id = {p["page_id"]: p for p in pages}
    events = table("events")
    found = {}
    for event in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        page = by_id.get(event["event_id"] % len(pages))
        if page and event["event_type"] != "error":
            found.setdefault(page["url"], description(page["html"]))
    return found


def test_descriptions(spark, rows, submitted):
    got = dict(rows(QUERIES["q04_submitted_descriptions"](spark, SF_DIR), "url", "description"))
    assert got == submitted


def test_flagship(spark, submitted):
    stems = Counter(stem(w) for text in submitted.values() for w in words(text))
    got = [tuple(r) for r in QUERIES["q21_flagship"](spark, SF_DIR).collect()]
    assert got == top(stems)


def test_document_terms(spark):
    stems = Counter(stem(w) for d in table("documents") for w in words(d["text"]))
    got = [tuple(r) for r in QUERIES["q24_document_terms"](spark, SF_DIR).collect()]
    assert got == top(stems)


def test_random_submissions(spark, rows):
    rng = random.Random(5)
    urls = ["http://hot"] * 40 + [f"http://u{i}" for i in range(12)] + ["bad", "", None]
    data = [(i, rng.choice(urls), rng.randint(0, 50)) for i in range(600)]
    seen = ["http://u1", "http://u2"]
    expected, known = [], set(seen)
    for event, url, _ in sorted(data, key=lambda d: (d[2], d[0])):
        if not (url or "").startswith("http"):
            label = "malformed"
        else:
            label = "duplicate" if url in known else "accepted"
            known.add(url)
        expected.append((event, label))
    df = spark.createDataFrame(data, "event_id long, url string, s long").selectExpr(
        "event_id", "timestamp_seconds(s) AS ts", "url")
    history = spark.createDataFrame([(u,) for u in seen], schemas.SEEN)
    assert rows(outcomes(df, history), "event_id", "outcome") == sorted(expected)


def test_readers(spark, rows, tmp_path):
    df = spark.range(3).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "'u' AS url")
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        df.write.format(fmt).save(path)
        assert rows(read_submissions(spark, path, fmt)) == rows(df)
    pages = read_pages(spark, f"{SF_DIR}/pages.parquet")
    assert pages.schema == schemas.PAGES and pages.count() == 50
