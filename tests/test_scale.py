"""Plans and skew: what must hold when the tables are a thousand times larger."""

import __spark_entry__ as entry_points
from oracle import plan
from pyspark.sql import functions as F

from newsloom.operators import joins, ranking
from newsloom.operators import takeaways as tk
from newsloom.profile import CORPUS_PROFILE
from newsloom.sources import store

SF = "/root/testdata/sf0.001"


def skewed(spark, n=3000):
    """A third of the rows share one URL."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"),
        F.col("id").alias("page_id"),
        (F.col("id") % 7).cast("int").alias("pos"),
        F.concat(F.lit("t"), "id").alias("title"),
    )


def test_hot_url_is_combined_before_the_shuffle(spark):
    result = ranking.dedup_urls(skewed(spark))
    assert "partial_min_by" in plan(result)
    got = {r["url"]: (r["page_id"], r["pos"]) for r in result.collect()}
    assert len(got) == 2001 and got["hot"] == (0, 0)


def test_per_group_limit_is_applied_before_the_shuffle(spark):
    result = ranking.first_per_group(skewed(spark), ["url"], [F.col("page_id").asc()], 5)
    text = plan(result)
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")
    assert result.where("url = 'hot'").count() == 5


def test_small_batch_does_not_shuffle_the_store(spark):
    existing = store.to_store_rows(skewed(spark).where("url <> 'hot'").withColumn("date", F.lit("d")), "2024-01-01")
    batch = store.to_store_rows(
        spark.createDataFrame([("u1", "new", "d")], "url STRING, title STRING, date STRING"), "2024-01-02"
    )
    merged = store.upsert_store(existing, batch)
    text = plan(merged)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert merged.count() == 2000 and merged.where("title = 'new'").count() == 1


def test_hot_key_of_a_lookup_is_split(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        links = skewed(spark, 9000).repartition(8, "page_id")
        metadata = links.select("url", F.lit("Page").alias("title"), F.lit("2024-01-01").alias("date"))
        joined = joins.join_metadata(links.drop("title"), metadata)
        rows = joined.collect()
        assert len(rows) == 9000
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_term_tables_of_any_size_give_the_same_rows(spark):
    data = [(i, f"Walking word{i} near the old mill, xWord{i % 7}y and üb{i}er\nnew line {i}") for i in range(40)]
    docs = spark.createDataFrame(data, "id LONG, content STRING")
    names = (
        [f"word{i}" for i in range(12)] + ["near THE old mill", "the old", "ld m", " ", "e", "ab", "xword3y", "üb7"]
        + ["new line 5", "no such phrase here", "", "old mill, xword6y and üb6er", "  double  gap "]
    )
    terms = spark.createDataFrame([(t,) for t in names], "term STRING")
    want = {(i, t) for i, text in data for t in names if t and t.lower() in text.lower()}
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            rows = joins.match_term_table(docs, terms).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want, threshold


def test_matches_travel_by_word_and_by_text(spark):
    """What hangs on a word is one row, and what is found in a text is one: pairs of text and term are not shuffled."""
    docs = spark.range(20).select("id", F.lit("aaaa baaaa aaaac baaaac daaaa").alias("content"))
    wanted = joins.wanted_terms(spark.createDataFrame([("a" * n,) for n in range(1, 5)] + [("aa baa",)], "term STRING"))
    vocabulary = docs.select(F.explode(F.split("content", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("texts"))
    hooks = joins.word_hooks(wanted, vocabulary, 4)
    assert hooks.count() == 5 and hooks.agg(F.sum(F.size("sure"))).first()[0] == 20
    found = joins.matched_numbers(docs, wanted, "content")
    assert found.where("size(_nos) = 4").count() == 20 and found.where("size(_nos) = 1").count() == 20 and found.count() == 40


def test_a_document_is_fetched_once_for_all_its_keywords(spark):
    docs = spark.range(9).select("id", F.lit("alpha beta gamma").alias("content"), F.lit("t").alias("title"))
    keywords = spark.createDataFrame([(3, "alph"), (1, "bet"), (2, "bet"), (5, "amma"), (6, "none")], "pos LONG, keyword STRING")
    hits = joins.keyword_hits(keywords, docs, column="content")
    text = hits._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode") < text.index("Join Inner, (id")  # above the join
    assert {(r["pos"], r["id"]) for r in hits.collect()} == {(p, i) for p in (1, 3, 5) for i in range(9)} and hits.count() == 27


def test_positions_are_dense_for_any_partitioning(spark):
    df = skewed(spark).repartition(13)
    got = [r["pos2"] for r in ranking.with_position(df, [F.col("url"), F.col("page_id")], "pos2").collect()]
    assert sorted(got) == list(range(3000))
    ordered = ranking.with_position(df, [F.col("page_id")], "place").where("place <> page_id")
    assert ordered.count() == 0


def test_one_article_with_most_of_the_chunks(spark):
    chunks = spark.range(5000).select(
        F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).cast("long").alias("id"),
        F.col("id").alias("chunk_no"),
        F.concat(F.lit("part"), "id").alias("takeaway"),
    )
    result = tk.combine_takeaways(chunks, fan_in=16)
    hot = result.where("id = 1").first()["takeaway"]
    assert hot == " ".join(f"part{i}" for i in range(4000))
    assert result.count() == 1001


def test_costly_columns_are_computed_once(spark):
    """A filter on a scored column must not score twice."""
    text = plan(entry_points.queries()["filter_relevant"](spark, SF))
    assert text.count("replace(_low") == len(CORPUS_PROFILE.content_terms)
