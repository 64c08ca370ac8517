"""Requests by content and the answers that held at a time, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import answers, requests

ASKED = "id LONG, content STRING"
TIMED = "id LONG, content_key STRING, rubric_key STRING, asked_at TIMESTAMP"
GIVEN = "content_key STRING, rubric_key STRING, answered_at TIMESTAMP, raw STRING"


def asked_for(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), ASKED)
    return requests.build_requests(df, "takeaway")


def test_copies_are_asked_for_once(spark):
    texts = ["a", "b", "a", None, "", "c", "a", "b", ""] + ["hot"] * 200
    asked = asked_for(spark, texts)
    first = answers.distinct_requests(asked)
    assert first.columns == asked.columns
    assert sorted(r["id"] for r in first.collect()) == [0, 1, 4, 5, 9]
    stored = asked.where(F.col("id").isin(5, 7))
    assert sorted(r["id"] for r in answers.distinct_requests(asked, stored).collect()) == [0, 4, 9]
    assert answers.distinct_requests(asked, asked).count() == 0
    assert answers.distinct_requests(asked.limit(0), stored).count() == 0


def test_copies_in_the_documents_cause_no_second_request(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    asked = requests.build_requests(docs, "takeaway")
    copies = docs.count() - docs.select("content").distinct().count()
    assert copies == 73 and answers.distinct_requests(asked).count() == asked.count() - copies


def test_chunks_of_one_article_keep_their_numbers(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (2, 1, "x"), (0, 5, "y")], "id LONG, chunk_no INT, content STRING")
    got = answers.distinct_requests(requests.build_requests(df, "takeaway")).collect()
    assert sorted((r["id"], r["chunk_no"]) for r in got) == [(0, 5), (1, 0)]


@pytest.mark.parametrize("rows_per_part", [1, 7, 10**6])
def test_answers_come_back_to_every_copy(spark, rows_per_part):
    texts = ["a", None, "b", "c"] + ["hot"] * 300
    asked = asked_for(spark, texts)
    given = answers.distinct_requests(asked).where("id <> 3").select(*answers.KEYS, F.concat(F.lit("r"), "id").alias("raw"))
    given = given.unionByName(given.withColumn("raw", F.lit("z")))  # a second answer
    got = answers.fan_out(asked, given, rows_per_part=rows_per_part)
    assert got.columns == [*asked.columns, "raw"]
    want = [(0, "r0"), (1, None), (2, "r2"), (3, None), *[(i, "r4") for i in range(4, 304)]]
    assert sorted((r["id"], r["raw"]) for r in got.collect()) == want


def test_a_hot_text_is_dealt_into_parts(spark):
    asked = asked_for(spark, ["hot"] * 4000 + [f"t{i}" for i in range(100)])
    hot = spark.createDataFrame([("hot",)], "t STRING").select(requests.fingerprint(F.col("t"))).first()[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = answers.distinct_requests(asked).select(*answers.KEYS, F.lit("r").alias("raw"))
        got = answers.fan_out(asked, given, rows_per_part=100).withColumn("_task", F.spark_partition_id())
        sizes = [r["count"] for r in got.where(F.col("content_key") == hot).groupBy("_task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 1500 and len(sizes) >= 6


@pytest.mark.parametrize("bucket, spread", [(None, 8), (7, 1), (1000, 3), (1, 2)])
def test_the_answer_of_the_time(spark, bucket, spread):
    rng = random.Random(spread)

    def moment(seconds):
        return f"2024-01-01 {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"

    given = [(rng.choice("abc"), "r", rng.randrange(400), f"x{i}") for i in range(40)] + [("a", "r", 100, "later"), ("a", "r", 100, "early")]
    asked = [(i, rng.choice(["a", "a", "a", "b", "c", "d"]), "r", rng.randrange(500)) for i in range(150)]
    asked += [(200, "a", "r", 100), (200, "a", "r", 100), (201, None, "r", 100), (202, "a", "other", 100), (203, "a", "r", None)]
    df = spark.createDataFrame([(i, k, q, None if t is None else moment(t)) for i, k, q, t in asked], TIMED.replace("TIMESTAMP", "STRING"))
    df = df.withColumn("asked_at", F.col("asked_at").cast("timestamp"))
    held = spark.createDataFrame([(k, q, moment(t), raw) for k, q, t, raw in given], GIVEN.replace("TIMESTAMP", "STRING"))
    held = held.withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    got = answers.asof_responses(df, held, 60, bucket_seconds=bucket, spread=spread)
    want = []
    for i, k, q, t in asked:
        fits = [(s, raw) for key, rubric, s, raw in given if key == k and rubric == q and t is not None and 0 <= t - s < 60]
        newest = max((s for s, _ in fits), default=None)
        want.append((i, min((raw for s, raw in fits if s == newest), default=None)))
    assert sorted((r["id"], r["raw"] or "") for r in got.collect()) == sorted((i, raw or "") for i, raw in want)


def test_as_of_without_answers(spark):
    df = spark.createDataFrame([(1, "a", "r", None)], TIMED).withColumn("asked_at", F.lit("2024-01-01").cast("timestamp"))
    got = answers.asof_responses(df, spark.createDataFrame([], GIVEN), 60).collect()
    assert [(r["id"], r["raw"], r["answered_at"]) for r in got] == [(1, None, None)]
