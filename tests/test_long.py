"""One very long value must not exhaust the stack or take quadratic time."""

import time

import pytest

from newsloom.operators import chunking, extract, responses, scoring
from newsloom.operators import takeaways as tk

ARTICLE = "id LONG, title STRING, content STRING, takeaway STRING"
TEXTS = {
    "words": "some plain words without a full stop " * 2_000,
    "sentences": "Walmart uses ChatGPT for leaders. Nothing that matters! " * 2_000,
    "capitals": "Aa Bb " * 15_000,
    "spaces": "x" + " " * 50_000 + "y",
    "one word": "x" * 100_000,
    "digits": "1" * 50_000 + " x",
    "quotes": "\"\\'<a " * 15_000,
    "that": "that leader for relevant " * 4_000,
}


@pytest.mark.parametrize("name", TEXTS)
def test_long_articles(rows, name):
    start = time.time()
    df = rows([(1, "T", TEXTS[name], "")], ARTICLE)
    scoring.categorize_by_terms(scoring.score_relevance(scoring.evaluate_articles(df))).collect()
    assert chunking.chunk_articles(df, 1000).count() >= 1
    tk.extractive_takeaways(df).collect()
    tk.clean_takeaways(df, "content").collect()
    tk.validate_takeaways(df, "content").collect()
    assert time.time() - start < 40


def test_long_broken_response(rows):
    raw = '{"takeaway": "' + "line\\n" * 20_000
    assert len(responses.parse_takeaway_responses(rows([(raw,)], "raw STRING")).first()["takeaway"]) > 100_000


def test_long_pages(rows):
    pages = [
        (1, "http://a.example.com/", "<a href='/x'>" + "<b>t</b>" * 10_000 + "</a>"),
        (2, "http://a.example.com/", "<a " + " ".join(f'data-{i}="v"' for i in range(5_000)) + " href='/y'>t</a>"),
        (3, "http://a.example.com/", "<script>" * 200 + "<a href='/z'>t</a>" * 2_000),
        (4, "http://a.example.com/", "<a href='" + "../" * 5_000 + "top'>t</a>"),
        (5, "http://a.example.com/", "&#233;&amp;" * 10_000 + "<meta " * 200 + "<p" * 5_000),
    ]
    start = time.time()
    df = rows(pages, "page_id LONG, url STRING, html STRING")
    found = extract.resolve_links(extract.extract_links(df)).collect()
    by_page = {}
    for r in found:
        by_page.setdefault(r["page_id"], []).append(r["url"])
    assert by_page[1] == ["http://a.example.com/x"] and by_page[2] == ["http://a.example.com/y"]
    assert len(by_page[3]) == 2_000 and by_page[4] == ["http://a.example.com/top"]
    extract.extract_main_text(df).collect()
    extract.extract_page_metadata(df, "2024-01-31").collect()
    assert time.time() - start < 60


def test_chunks_of_a_long_text_in_linear_time(rows):
    seconds = []
    for size in (2_000, 40_000):
        df = rows([(1, "Some sentence of fifty characters, more or less so. " * size)], "id LONG, content STRING")
        start = time.time()
        chunking.chunk_articles(df).agg({"chunk": "max"}).collect()
        seconds.append(time.time() - start)
    assert seconds[1] < 20 * seconds[0] + 5
