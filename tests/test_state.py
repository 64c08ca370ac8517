"""Chunks, combination, memo, store, sources, reports and streams."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.operators import chunking, ranking
from newsloom.operators import takeaways as tk
from newsloom.session import new_folder
from newsloom.sources import readers, reports, store
from newsloom.streaming import jobs
from newsloom.streaming.log import ScanLog

QUIET = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def chunk_list(spark, text, tokens):
    df = spark.createDataFrame([(1, text)], "id LONG, content STRING")
    return [r["chunk"] for r in chunking.chunk_articles(df, tokens).orderBy("chunk_no").collect()]


def test_chunks_of_one_long_sentence(spark):
    chunks = chunk_list(spark, "word " * 10000, 1000)
    assert len(chunks) > 1 and all(len(c) <= 3000 for c in chunks)
    assert "".join(chunks) == ("word " * 10000).strip()


def test_truncated_chunks(spark):
    text = "Sentence. " * 6000
    df = spark.createDataFrame([(1, text)], "id LONG, content STRING")
    chunks = [r["chunk"] for r in chunking.truncate_chunks(df, 1000).orderBy("chunk_no").collect()]
    assert len(chunks) > 1 and all(len(c) <= 1200 for c in chunks)
    assert "".join(chunks).replace(" ", "")[:1000] in text.replace(" ", "")


def test_small_and_empty_content_is_one_chunk(spark):
    assert chunk_list(spark, " a  b ", 10) == ["a b"]
    assert chunk_list(spark, "", 10) == [""]


def packed_by_hand(text, limit):
    """The packing rule, read off one sentence at a time from a marked text."""
    text = " ".join(text.split())
    if len(text) < limit:
        return [text]
    for mark in ".!?":
        text = text.replace(mark + " ", mark + "\n")
    groups = [[]]
    for sentence in text.split("\n"):
        if len(sentence) > limit:
            groups += [[sentence[i : i + limit]] for i in range(0, len(sentence), limit)] + [[]]
        elif sum(map(len, groups[-1])) + len(sentence) > limit:
            groups.append([sentence])
        else:
            groups[-1].append(sentence)
    return [" ".join(g) for g in groups if g]


@QUIET
@given(st.lists(st.sampled_from(["Ab.", "word", "A longer one!", "Why?", "x" * 40 + ".", "é ü.", "..."]), max_size=60))
def test_chunks_equal_a_plain_loop(spark, words):
    text = " ".join(words)
    chunks = chunk_list(spark, text, 10)
    assert chunks == packed_by_hand(text, 30)
    assert "".join(chunks).replace(" ", "") == text.replace(" ", "")


CHUNK = "id LONG, chunk_no LONG, takeaway STRING"


def combined(spark, data, **options):
    df = spark.createDataFrame(data, CHUNK)
    return {r["id"]: r["takeaway"] for r in tk.combine_takeaways(df, **options).collect()}


def test_combination(spark):
    long = "y" * 3000
    got = combined(spark, [
        (1, 0, long), (2, 1, "second part"), (2, 0, "first part"), (3, 0, "a"), (3, 1, None), (4, 0, long), (4, 1, "z"),
        (5, 0, None), (5, 1, None), (6, 0, None),
    ])
    assert got == {
        1: long, 2: "first part second part", 3: tk.NOTHING_MEANINGFUL, 4: long + " z", 5: tk.NOTHING_MEANINGFUL, 6: None,
    }
    articles = spark.createDataFrame([(1,), (9,)], "id LONG")
    df = spark.createDataFrame([(1, 0, "only")], CHUNK)
    listed = {r["id"]: r["takeaway"] for r in tk.combine_takeaways(df, articles).collect()}
    assert listed == {1: "only", 9: tk.NOTHING_TO_COMBINE}


@QUIET
@given(st.lists(st.one_of(st.none(), st.sampled_from(["", "a", "long enough", "x" * 30])), min_size=2, max_size=60))
def test_combination_in_blocks_equals_a_join(spark, texts):
    got = combined(spark, [(1, i, t) for i, t in enumerate(texts)], max_chars=50, fan_in=3)[1]
    joined = " ".join(t for t in texts if t is not None)
    assert got == (joined[:50] if len(joined) >= 10 else tk.NOTHING_MEANINGFUL)


# --- store ----------------------------------------------------------------------------------------------------


def article_rows(spark, data):
    return spark.createDataFrame(data, "url STRING, title STRING, date STRING, content STRING, summary STRING")


def test_store_round_trip(spark):
    df = article_rows(spark, [("http://example.com", "Title", "2024-01-01", "c", "s")])
    folder = new_folder(spark, "store")
    store.save_store(store.to_store_rows(df, "2024-01-02"), folder)
    loaded = store.load_store(spark, folder).collect()
    assert [(r["url"], r["content"], r["ai_validation"], r["category"]) for r in loaded] == [
        ("http://example.com", "c", "", None)
    ]


def test_upsert_replaces_whole_rows(spark):
    first = store.to_store_rows(article_rows(spark, [("u", "One", "d", "text", "s"), ("v", "V", "d", "x", "s")]), "2024-01-01")
    bare = article_rows(spark, [("u", "Two", "d", None, None)]).drop("content")
    second = store.to_store_rows(bare, "2024-01-02")
    merged = store.upsert_store(first, second)
    got = {r["url"]: (r["title"], r["content"], str(r["created_at"])[:10]) for r in merged.collect()}
    assert got == {"u": ("Two", "", "2024-01-02"), "v": ("V", "x", "2024-01-01")}
    again = store.upsert_store(merged, second)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))
    assert [r["url"] for r in store.newest_stored(merged, 1).collect()] == ["u"]


def test_last_write_of_a_moment_wins(spark):
    df = spark.createDataFrame([("u", f"t{i}", "d", i) for i in range(50)], "url STRING, title STRING, date STRING, n LONG")
    assert store.upsert_store(None, store.to_store_rows(df, "2024-01-01", "n")).first()["title"] == "t49"


def test_evolution_adds_only_what_is_missing(spark):
    df = spark.createDataFrame([("u", 1)], "url STRING, n INT")
    wider = store.evolve_schema(df, {"url": "string", "category": "string"})
    assert wider.columns == ["url", "n", "category"] and wider.first()["category"] is None


# --- sources --------------------------------------------------------------------------------------------------


def test_source_lists(spark, tmp_path):
    lines = ["https://b.example.com", " https://a.example.com ", "", "https://b.example.com", "c.example.com,x"]
    path = tmp_path / "sites.csv"
    path.write_text("\n".join(lines))
    listed = [tuple(r) for r in readers.read_source_list(spark, str(path), "csv").orderBy("pos").collect()]
    assert listed == [(0, "https://b.example.com"), (1, "https://a.example.com"), (2, "c.example.com")]
    text = readers.read_source_list(spark, str(path), "text", distinct=False).orderBy("pos").collect()
    assert [r["url"] for r in text] == [x.strip() for x in lines if x.strip()]
    settings_file = tmp_path / "settings.json"
    settings_file.write_text(json.dumps({"full_scan_urls": ["u1", "u2", "u1"], "test_scan_urls": ["t"]}))
    full = readers.read_source_list(spark, str(settings_file), "json").orderBy("pos").collect()
    assert [r["url"] for r in full] == ["u1", "u2"]
    test = readers.read_source_list(spark, str(settings_file), "json", mode="test").collect()
    assert [r["url"] for r in test] == ["t"]
    assert readers.read_source_list(spark, str(tmp_path / "none"), "csv").count() == 0
    fallback = readers.read_source_list(spark, str(tmp_path / "none"), "json", mode="test").collect()
    assert [r["url"] for r in fallback] == list(p.TEST_SOURCES)
    fixed = readers.read_source_list(spark, None, mode="coordinator_test").orderBy("pos").collect()
    assert [r["url"] for r in fixed] == list(p.COORDINATOR_TEST_SOURCES)


def test_batches(spark):
    sources = spark.createDataFrame([(i, f"u{i}") for i in range(11)], "pos LONG, url STRING")
    got = [(r["batch"], round(r["progress"], 4)) for r in ranking.batch_sources(sources).orderBy("pos").collect()]
    assert got == [(0, 0.3333)] * 5 + [(1, 0.6667)] * 5 + [(2, 1.0)]


def test_term_lists(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"evaluation": {"companies": ["A", "B"], "tools": ["T"]}}))
    terms = readers.read_term_lists(spark, str(path), overrides={"tools": ["X", "Y"]})
    got = sorted(tuple(r) for r in terms.collect())
    assert got == [("companies", 0, "A"), ("companies", 1, "B"), ("tools", 0, "X"), ("tools", 1, "Y")]
    profile = readers.profile_from_terms(terms)
    assert profile.companies == ("A", "B") and profile.tools == ("X", "Y") and profile.retail_terms == p.RETAIL_TERMS
    defaults = readers.profile_from_terms(readers.read_term_lists(spark, str(tmp_path / "none")))
    assert defaults == p.Profile()
    broken = tmp_path / "broken.json"
    broken.write_text("{not json")
    assert readers.profile_from_terms(readers.read_term_lists(spark, str(broken))) == p.Profile()


def test_feed(spark, tmp_path):
    entries = "".join(
        f"<entry><title> T{i} </title><id>http://x/{i}</id><published>{d}</published><summary>S &amp; {i}</summary></entry>"
        for i, d in enumerate(["2024-06-20T00:00:00Z", "2024-06-01T00:00:00Z", "soon"])
    )
    path = tmp_path / "feed.xml"
    path.write_text(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>{entries}</feed>')
    got = readers.read_atom_feed(spark, str(path), "2024-06-15").orderBy("url").collect()
    assert [(r["title"], r["url"], r["source"], str(r["published_date"])[:10], r["content"]) for r in got] == [
        ("T0", "http://x/0", "arXiv", "2024-06-20", "S & 0"), ("T2", "http://x/2", "arXiv", "2024-06-15", "S & 2"),
    ]


def test_search_results(spark, tmp_path):
    def result(i, **more):
        return {"title": f"t{i}", "link": f"l{i}", "source": "s", "date": "2024-06-20"} | more

    dumps = [
        {"keyword": "k0", "pos": 0, "news_results": [result(i) for i in range(7)]},
        {"keyword": "k1", "pos": 1, "news_results": [
            result(0, title=None), result(1, date="2024-06-01"), result(2, date="bad"), result(3)]},
        {"keyword": "k9", "pos": 9, "news_results": [result(0)]},
    ]
    path = tmp_path / "dumps.json"
    path.write_text("\n".join(json.dumps(d) for d in dumps))
    got = readers.read_search_results(spark, str(path), "2024-06-15").collect()
    every = [("k0", f"l{i}") for i in range(7)] + [("k1", "l3"), ("k9", "l0")]
    assert sorted((r["keyword"], r["url"]) for r in got) == every
    some = readers.read_search_results(spark, str(path), "2024-06-15", max_keywords=5, per_keyword=5).collect()
    assert sorted((r["keyword"], r["url"]) for r in some) == [("k0", f"l{i}") for i in range(5)] + [("k1", "l3")]
    plan = readers.read_search_results(spark, str(path), "2024-06-15", per_keyword=5)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_framework(spark, tmp_path):
    path = tmp_path / "framework.txt"
    path.write_text("Heading\n1. Content & Creative\nUse of AI:\n- Ads\n- Visuals\n2. Other\nAll 3. things\n")
    got = sorted(tuple(r) for r in readers.read_framework(spark, str(path)).collect())
    assert got == [
        (1, "Content & Creative", 1, "Use of AI:"), (1, "Content & Creative", 2, "Ads"),
        (1, "Content & Creative", 3, "Visuals"), (2, "Other", 1, "All 3. things"),
    ]
    missing = readers.read_framework(spark, str(tmp_path / "none")).first()
    assert missing["line"] == readers.FRAMEWORK_MISSING


# --- reports and streams --------------------------------------------------------------------------------------


def test_report_of_nothing_is_empty(spark):
    df = spark.createDataFrame([], "url STRING, assessment STRING, assessment_score INT")
    assert reports.csv_report(df).columns == list(reports.REPORT_COLUMNS) and reports.csv_report(df).count() == 0


def test_report_defaults_and_widths(spark):
    df = spark.createDataFrame([("file:///x/https://a.b/c%20d", "OK", 50, None)],
                               "url STRING, assessment STRING, assessment_score INT, title STRING")
    row = reports.csv_report(df).first()
    assert tuple(row) == ("N/A", "https://a.b/c d", "", "", "", "N/A")
    widths = {r["column"]: r["width"] for r in reports.column_width_profile(reports.sheet_report(df)).collect()}
    assert widths == {"Use Case Category": 19, "URL": 17, "Title": 7, "Takeaway": 10, "Date": 6}


def test_same_day_report_is_replaced(spark):
    schema = "url STRING, assessment STRING, assessment_score INT"
    folder = new_folder(spark, "reports")
    reports.write_report_set(spark.createDataFrame([("a", "OK", 1), ("b", "OK", 1)], schema), folder, "2024-01-01")
    reports.write_report_set(spark.createDataFrame([("c", "OK", 1)], schema), folder, "2024-01-02")
    reports.write_report_set(spark.createDataFrame([("d", "OK", 1)], schema), folder, "2024-01-01")
    got = sorted((str(r["report_date"]), r["url"]) for r in spark.read.parquet(folder).collect())
    assert got == [("2024-01-01", "d"), ("2024-01-02", "c")]


def test_csv_file_keeps_order_and_quotes(spark):
    schema = "url STRING, assessment STRING, assessment_score INT, title STRING"
    data = [(f"u{i:03d}", "OK", i % 7, f'say "{i}", ok') for i in range(100)]
    folder = new_folder(spark, "csv")
    reports.write_csv_report(spark.createDataFrame(data, schema).repartition(5), folder)
    parts = sorted(f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("part-"))
    lines = [
        line for part in parts for line in open(f"{folder.removeprefix('file:')}/{part}").read().splitlines()[1:]
    ]
    want = sorted(data, key=lambda r: (-r[2], r[0]))
    assert [line.split(",")[1] for line in lines] == [r[0] for r in want]
    assert '"say ""' in lines[0]


def test_scan_stream_equals_batch_and_skips_what_it_has_seen(spark):
    folder, checkpoint = new_folder(spark, "pages"), new_folder(spark, "progress")
    log = ScanLog(spark, new_folder(spark, "log"), newest=True)
    seen = []

    def stage(batch):
        seen.append(batch.count())
        return batch.select("url", F.col("html").alias("title"))

    for step in (1, 2):
        data = [(i, f"u{i}", f"v{step}") for i in range(step * 2)]
        spark.createDataFrame(data, jobs.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_scan(jobs.read_page_stream(spark, folder), stage, log, checkpoint).awaitTermination()
    assert seen == [2, 4]
    got = {r["url"]: r["title"] for r in log.read().collect()}
    assert got == {"u0": "v2", "u1": "v2", "u2": "v2", "u3": "v2"}


@pytest.mark.parametrize("days, kept", [(7, 1), (40, 1)])
def test_url_stream_accepts_once(spark, days, kept):
    folder, out, checkpoint = (new_folder(spark, x) for x in ("links", "urls", "progress"))
    for day in ("2024-01-01", "2024-01-02"):
        df = spark.createDataFrame([("u", day)] * 3, "url STRING, d STRING")
        df.select("url", F.col("d").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("url STRING, ts TIMESTAMP").parquet(folder)
        jobs.run_to_folder(jobs.stream_dedup_urls(stream, lookback=f"{days} days"), out, checkpoint)
    assert spark.read.parquet(out).count() == kept
