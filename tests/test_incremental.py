"""Stores and logs that change batch by batch: repeated, failed, merged and expired batches; streams in any order."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import extract, joins
from newsloom.plans import queries, runs
from newsloom.session import new_folder
from newsloom.sources import store
from newsloom.sources.manifest import Manifests
from newsloom.streaming import jobs
from newsloom.streaming.log import ScanLog

WRITES = "url STRING, title STRING, content STRING, created_at TIMESTAMP, seq LONG"


def files_of(folder):
    return set(glob.glob(f"{folder.removeprefix('file:')}/**/part-*.parquet", recursive=True))


def writes(spark, urls, day, title):
    data = [(u, title, f"text of {u}", day, i) for i, u in enumerate(urls)]
    shaped = spark.createDataFrame(data, "url STRING, title STRING, content STRING, created_at STRING, seq LONG")
    return store.to_store_rows(shaped, F.col("created_at").cast("timestamp"), "seq")


def titles(df):
    return {r["url"]: r["title"] for r in df.collect()}


def test_descriptions_are_whole_and_numbered(spark):
    states = Manifests(spark, new_folder(spark, "states"))
    assert states.last() is None and states.numbers() == []
    for n in range(4):
        states.commit({"n": n, "text": "é"})
    assert states.last() == {"n": 3, "text": "é"} and states.numbers() == [0, 1, 2, 3]
    assert [s["n"] for s in states.forget(2)] == [0, 1] and states.numbers() == [2, 3]


def test_bucketed_store_rewrites_touched_buckets_only(spark):
    kept = store.BucketedStore(spark, new_folder(spark, "store"), buckets=8)
    assert kept.read().count() == 0
    kept.upsert(writes(spark, [f"u{i}" for i in range(40)], "2024-01-01", "old"))
    before = files_of(kept.folder)
    assert kept.upsert(writes(spark, ["u3", "u3", "new"], "2024-01-02", "next"))
    state = kept._state()
    touched = {b for b, v in state["at"].items() if v == 1}
    assert 1 <= len(touched) <= 2
    assert before <= files_of(kept.folder)  # none of the files of the version before was written again
    got = titles(kept.read())
    assert len(got) == 41 and got["u3"] == got["new"] == "next" and got["u4"] == "old"
    assert titles(store.BucketedStore(spark, kept.folder, buckets=3).read()) == got  # the number of buckets is the store's

    kept.upsert(writes(spark, ["u3"], "2024-01-03", "last"))
    untouched = {f for f in files_of(kept.folder) if "/data/0/" in f and not any(f"_bucket={b}/" in f for b in touched)}
    assert kept.vacuum(1) >= 1
    assert untouched <= files_of(kept.folder) and titles(kept.read())["u3"] == "last" and kept.read().count() == 41


def test_bucketed_store_repeated_and_failed_batches(spark, monkeypatch):
    kept = store.BucketedStore(spark, new_folder(spark, "store"), buckets=4)
    first, second = (writes(spark, urls, d, t) for urls, d, t in ((["a", "b"], "2024-01-01", "1"), (["b", "c"], "2024-01-02", "2")))
    assert kept.upsert(first, 0) and not kept.upsert(first, 0)

    def lost(self, state):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Manifests, "commit", lost)
        with pytest.raises(RuntimeError):
            kept.upsert(second, 1)
    assert titles(kept.read()) == {"a": "1", "b": "1"} and kept.version() == 0  # what was written is not seen
    assert kept.upsert(second, 1) and not kept.upsert(second, 1)
    assert titles(kept.read()) == {"a": "1", "b": "2", "c": "2"}
    assert sorted(map(tuple, kept.read().collect())) == sorted(
        map(tuple, store.upsert_store(store.upsert_store(None, first), second).collect())
    )


def test_bucketed_store_takes_new_columns_and_null_urls(spark):
    kept = store.BucketedStore(spark, new_folder(spark, "store"), buckets=4)
    kept.upsert(writes(spark, ["a", None], "2024-01-01", "1"))
    kept.upsert(writes(spark, ["b"], "2024-01-01", "1").withColumn("score", F.lit(5)))
    kept.upsert(writes(spark, ["c"], "2024-01-02", "1"))
    assert {r["url"]: r["score"] for r in kept.read().collect()} == {"a": None, None: None, "b": 5, "c": None}


def test_last_writes_do_not_sort_texts(spark):
    plan = store.last_writes(writes(spark, ["a", "a"], "2024-01-01", "t"))._jdf.queryExecution().executedPlan().toString()
    assert not any("SortAggregate" in line and "content" in line for line in plan.splitlines())


def batches(n, seed=1):
    rng = random.Random(seed)
    return [[(f"u{rng.randrange(25)}", b, i, f"t{b}.{i}", f"2024-01-{1 + b % 28:02d}") for i in range(6)] for b in range(n)]


FOUND = "url STRING, page_id LONG, pos LONG, title STRING, day STRING"


def found(spark, data):
    return spark.createDataFrame(data, FOUND).withColumn("ts", F.col("day").cast("timestamp"))


@pytest.mark.parametrize("newest", [False, True])
def test_merged_log_equals_unmerged_and_reads_few_runs(spark, newest):
    merged = ScanLog(spark, new_folder(spark, "log"), order=("page_id", "pos"), newest=newest, fan=3)
    plain = ScanLog(spark, new_folder(spark, "log"), order=("page_id", "pos"), newest=newest, fan=10**6)
    want, most = {}, 0
    for number, data in enumerate(batches(13)):
        for log in (merged, plain):
            assert log.commit(number, found(spark, data))
            assert not log.commit(number, found(spark, data))
        for url, page, pos, title, _ in (reversed(data) if newest else data):
            if newest or url not in want:
                want[url] = title
        most = max(most, len(merged.runs()))
    assert titles(merged.read()) == titles(plain.read()) == want
    assert most <= 6 and len(plain.runs()) == 13
    assert [(r["first"], r["last"]) for r in merged.runs()] == [(0, 8), (9, 11), (12, 12)]
    assert merged.vacuum(1) > 0 and titles(merged.read()) == want


def test_log_drops_what_falls_behind_the_lookback(spark):
    logs = [ScanLog(spark, new_folder(spark, "log"), order=("page_id",), ts="ts", fan=fan) for fan in (2, 100)]
    for number in range(5):
        day = 1 + 5 * number
        data = [(f"u{number}", number, 0, "t", f"2024-01-{day:02d}"), ("always", number, 1, "t", f"2024-01-{day:02d}"),
                (None, 0, 0, "no url", "2024-01-30"), (f"old{number}", 0, 0, "t", "2023-01-01"), (f"no day{number}", 0, 0, "t", None)]
        for log in logs:
            log.commit(number, found(spark, data), since=f"2024-01-{max(1, day - 7):02d}")
    got = [sorted(r["url"] for r in log.read().collect()) for log in logs]
    assert got[0] == got[1] == ["always", "u3", "u4"]
    stored = spark.read.parquet(*[f"{logs[0].folder}/runs/{r['name']}" for r in logs[0].runs()])
    assert stored.where("url = 'u0'").count() == 0


def page(i, links):
    body = "".join(f'<a href="{u}">{t}</a>' for u, t in links)
    return (i, f"http://s{i}.example.com/list", f"<html><title>List of all {i}</title><body>{body}</body></html>")


@pytest.fixture(scope="module")
def site(spark):
    """Pages that link to articles, some of them several times, with the articles' texts and dates."""
    rng = random.Random(3)
    pages = [page(i, [(f"http://a.example.com/{rng.randrange(20)}", f"the AI story {i}.{k}") for k in range(4)]) for i in range(12)]
    texts = spark.createDataFrame([(f"http://a.example.com/{i}", f"Amazon uses AI for shops, number {i}.") for i in range(18)],
                                  "url STRING, content STRING")
    metadata = spark.createDataFrame(
        [(f"http://a.example.com/{i}", f"A long page title {i}", f"2024-01-{1 + i:02d}") for i in range(20)],
        "url STRING, title STRING, date STRING",
    )
    return pages, metadata, texts


def rows_of(df):
    return sorted((r["url"], r["title"], r["date"], r["source"], r["assessment"], r["assessment_score"]) for r in df.collect())


@pytest.mark.parametrize("order", ["forward", "backward", "failing"])
def test_stream_scan_equals_batch(spark, site, order, monkeypatch):
    pages, metadata, texts = site
    want = rows_of(runs.run_scan(spark.createDataFrame(pages, jobs.PAGE_SCHEMA), metadata, texts, None, "2024-01-05"))
    assert 5 < len(want) < 18
    folder, checkpoint = new_folder(spark, "pages"), new_folder(spark, "progress")
    log = runs.scan_log(spark, new_folder(spark, "log"), fan=2)
    parts = [pages[i : i + 3] for i in range(0, 12, 3)]
    commit, calls = Manifests.commit, []
    for part in reversed(parts) if order == "backward" else parts:
        spark.createDataFrame(part, jobs.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_page_stream(spark, folder, 1)
        if order == "failing":
            def lost(self, state, at=len(calls)):
                calls.append(at)
                if len(calls) % 2:
                    raise RuntimeError("the driver is gone")
                commit(self, state)

            monkeypatch.setattr(Manifests, "commit", lost)
            with pytest.raises(Exception, match="the driver is gone"):
                runs.run_stream_scan(stream, metadata, texts, log, checkpoint, "2024-01-05")
            monkeypatch.setattr(Manifests, "commit", commit)
            stream = jobs.read_page_stream(spark, folder, 1)
        got = runs.run_stream_scan(stream, metadata, texts, log, checkpoint, "2024-01-05")
    assert rows_of(got) == want


def test_known_places(spark):
    links = spark.createDataFrame([("a", 1, 0), ("a", 3, 0), ("b", 2, 5), ("c", 1, 1)], "url STRING, page_id INT, pos INT")
    known = spark.createDataFrame([("a", 2, 0), ("b", 2, 5)], "url STRING, page_id INT, pos INT")
    got = sorted(map(tuple, joins.exclude_known(links, known, ("page_id", "pos")).collect()))
    assert got == [("a", 1, 0), ("c", 1, 1)]


LINK, DESCRIBED = "page_id LONG, pos LONG, url STRING, ts TIMESTAMP", "url STRING, title STRING, date STRING, ts TIMESTAMP"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_and_descriptions_meet_in_any_order(spark, seed):
    rng = random.Random(seed)
    links = [(i, 0, f"u{rng.randrange(30)}", f"2024-01-{1 + i // 4:02d}") for i in range(40)]
    described = [(f"u{i % 30}", None if i == 7 else f"title {i}", "2024-01-01", f"2024-01-{1 + i // 4:02d}") for i in range(40)]
    kinds = [("links", links, "page_id LONG, pos LONG, url STRING, d STRING"), ("pages", described, "url STRING, title STRING, date STRING, d STRING")]
    frames = {k: spark.createDataFrame(data, schema).select("*", F.col("d").cast("timestamp").alias("ts")).drop("d") for k, data, schema in kinds}
    folders = {k: new_folder(spark, k) for k in frames}
    out, checkpoint = new_folder(spark, "joined"), new_folder(spark, "progress")
    # three days at a time, but the two sides take turns at random, so that either may be ahead of the other
    steps = [(k, d) for k in frames for d in range(1, 11, 3)]
    turns = sorted(steps, key=lambda s: (s[1] + rng.choice([0, 3]), rng.random()))
    for k in frames:
        frames[k].limit(0).write.mode("append").parquet(folders[k])
    for k, d in turns:
        frames[k].where((F.dayofmonth("ts") >= d) & (F.dayofmonth("ts") < d + 3)).coalesce(1).write.mode("append").parquet(folders[k])
        left = spark.readStream.schema(LINK).parquet(folders["links"])
        right = spark.readStream.schema(DESCRIBED).parquet(folders["pages"])
        jobs.run_to_folder(jobs.stream_join_metadata(left, right, lookback="8 days"), out, checkpoint)
    got = jobs.settle_metadata(spark.read.parquet(out))
    near = joins.join_metadata(frames["links"], frames["pages"]).count()
    pairs = {(i, u): [] for i, _, u, _ in links}
    for i, _, u, d in links:
        for v, t, date, e in described:
            if u == v and t is not None and abs(int(d[-2:]) - int(e[-2:])) <= 8:
                pairs[i, u].append((date, t))
    want = sorted((i, u, *min(p)) for (i, u), p in pairs.items() if p)
    assert sorted((r["page_id"], r["url"], r["date"], r["page_title"]) for r in got.collect()) == want
    assert len(want) <= near


def test_state_of_the_metadata_join_is_bounded(spark):
    """Two months of links, one day a batch: what waits is what the look-back allows, not what has been seen."""
    links, pages = new_folder(spark, "links"), new_folder(spark, "pages")
    out, checkpoint = new_folder(spark, "joined"), new_folder(spark, "progress")
    waiting = []
    for day in range(0, 24, 2):
        ts = F.expr(f"timestamp'2024-01-01' + make_dt_interval({day})")
        spark.range(10).select(F.col("id").alias("page_id"), F.lit(0).cast("long").alias("pos"),
                               F.concat(F.lit(f"u{day}."), "id").alias("url"), ts.alias("ts")).write.mode("append").parquet(links)
        spark.range(10).select(F.concat(F.lit(f"u{day}."), "id").alias("url"), F.lit("t").alias("title"),
                               F.lit("2024-01-01").alias("date"), ts.alias("ts")).write.mode("append").parquet(pages)
        joined = jobs.stream_join_metadata(
            spark.readStream.schema(LINK).parquet(links), spark.readStream.schema(DESCRIBED).parquet(pages), lookback="2 days"
        )
        query = (joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        waiting.append(sum(op["numRowsTotal"] for p in query.recentProgress[-1:] for op in p["stateOperators"]))
    assert max(waiting) <= 100 and waiting[-1] <= max(waiting[:6])
    assert spark.read.parquet(out).count() == 120


def test_prepared_pages_of_the_registered_scan(spark):
    listed = queries.as_listing(spark.createDataFrame([(3, "http://x/1", "<title>T</title>"), (4, "http://x/2", "")], jobs.PAGE_SCHEMA))
    found = extract.extract_links(listed).collect()
    assert [(r["page_id"], r["title"]) for r in found] == [(3, "Permalink to T")]


def test_the_workflow_counts_while_it_writes(spark, tmp_path):
    """Texts come by once; the counts are those of the rows."""
    import uuid

    folder = str(tmp_path)

    def mark(batches):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    articles = spark.createDataFrame(
        [(i, f"u{i}", f"AI title {i}", None if i % 2 else "generative AI in retail", "2024-01-30", "") for i in range(20)],
        "id LONG, url STRING, title STRING, content STRING, date STRING, takeaway STRING",
    )
    texts = spark.createDataFrame([(f"u{i}", "artificial intelligence for Amazon") for i in range(0, 15)], "url STRING, content STRING")
    texts = texts.coalesce(1).mapInPandas(mark, "url STRING, content STRING")
    result = runs.run_workflow(articles, texts, "2024-01-31", tie=("id",))
    row = result.funnel.first()
    assert len(glob.glob(f"{folder}/*")) == 1
    assert (row["found"], row["with_content"]) == (20, 17)
    assert row["analyzed"] == result.analyzed.count() and row["selected"] == result.selected.count() == min(10, row["analyzed"])

    empty = runs.run_workflow(articles.limit(0), texts.limit(0), "2024-01-31", tie=("id",)).funnel.first()
    assert (empty["found"], empty["analyzed"], empty["reports_generated"]) == (0, 0, False)


def test_index_finds_what_the_texts_hold(spark):
    """Phrases, parts of words, terms at both ends of a text, double spaces; in batches, repeated and failed ones."""
    from newsloom.sources.word_index import WordIndex

    rng = random.Random(2)
    words = ["the", "old", "mill", "Walking", "word7", "üb7er", "", "near", "x\ny", "near,", "new"]
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, " "), (63, "the old")]
    terms = ["the old", "old mill near", "he ol", " ", "  ", "e", "mill", "walking THE", "d m", "near, new", "x\ny near", "y n",
             "the old mill word7 üb7er", "the ", " the", "no such", "the  old", "", "old the old the", "üb"]
    want = {(i, t) for i, text in data if text for t in terms if t and t.lower() in text.lower()}
    docs = spark.createDataFrame(data, "id LONG, content STRING")
    asked = spark.createDataFrame([(t,) for t in terms], "term STRING")
    index = WordIndex(spark, new_folder(spark, "index"), buckets=5)
    assert index.search(asked).count() == 0
    assert index.add(3, docs.where("id < 20")) and not index.add(3, docs.where("id < 20"))
    docs.where("id > 40").selectExpr("'junk' word", "id", "1 pos", "0 _bucket").write.parquet(f"{index.folder}/postings/4")  # of a lost batch
    assert index.add(4, docs.where("id >= 20"))
    got = [tuple(r) for r in WordIndex(spark, index.folder).search(asked).collect()]
    assert len(got) == len(want) and set(got) == want
    texts = sum(1 for _, t in data if t and "mill" in t.lower().split(" "))
    assert index.vocabulary().where("word = 'mill'").first()["texts"] == texts


def test_a_word_of_all_texts_is_no_single_task(spark, monkeypatch):
    """Texts are dealt out by their size, so that what one task sorts does not grow with the batch; short phrases need no look-up."""
    from newsloom.sources import word_index

    monkeypatch.setattr(word_index, "PIECE_CHARS", 1000, raising=False)
    docs = spark.range(400).select("id", F.concat(F.lit("the old mill the old "), "id").alias("content"))
    index = word_index.WordIndex(spark, new_folder(spark, "index"), buckets=3)
    assert index.add(0, docs)
    held = spark.read.parquet(f"{index.folder}/postings/0").where("word = 'the'").groupBy(F.input_file_name()).count()
    assert held.count() > 8
    asked = spark.createDataFrame([("old mill",), ("mill the old",), ("ld mill the old 1",), ("the the",)], "term string")
    assert {r["term"]: r["count"] for r in index.search(asked).groupBy("term").count().collect()} == {
        "old mill": 400, "mill the old": 400, "ld mill the old 1": 111,
    }


def test_an_index_is_small_and_moves_what_is_sought(spark):
    """A piece's postings are one packed file; of a long phrase the short words need no look-up, and near misses are none."""
    from newsloom.sources import word_index

    words = ["of", "mill", "a", "the", "walking", "to", "it", "river", "x"]
    long = " ".join(words)
    misses = [" ".join([*words[:k], "no", *words[k + 1:]]) for k in range(len(words))]
    docs = spark.createDataFrame(list(enumerate([long, f"z{long} y", f"y {long}z", *misses])), "id long, content string")
    index = word_index.WordIndex(spark, new_folder(spark, "index"))
    assert index.add(0, docs)
    files = spark.read.parquet(f"{index.folder}/postings/0")
    assert len(files.inputFiles()) == 1 and ".zstd." in files.inputFiles()[0]
    sought = index._holding(spark.createDataFrame([("walking",), ("absent",)], "word string"))
    assert {r["word"] for r in sought.collect()} == {"walking"}
    asked = spark.createDataFrame([(long,)], "term string")
    assert sorted(r["id"] for r in index.search(asked).collect()) == [0, 1, 2]
