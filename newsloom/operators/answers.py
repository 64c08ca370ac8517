"""Requests by content: one for each text, its answer for every article that has the text, the answer that held at a time.

Request tables come from ``build_requests``; ``id`` and, where there is one, ``chunk_no`` tell their rows apart. Prompts
and answers are long, so what is asked, which answer holds and how a text's rows are dealt out is settled on keys, and
only what was chosen is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import stage

KEYS = ("content_key", "rubric_key")


def _place(asked: DataFrame, key: str) -> list[str]:
    return [c for c in (key, "chunk_no") if c in asked.columns]


def distinct_requests(asked: DataFrame, answered: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One request for every text and rubric that has no answer yet, that of the smallest ``key`` (and ``chunk_no``).

    ``answered`` needs the two keys only. Copies are counted out by a partial aggregate, so a text that a third of the
    articles share is one row of each task. Requests for null texts are left out: there is nothing to ask about.
    """
    place = _place(asked, key)
    first = asked.where(F.col("content_key").isNotNull()).groupBy(*KEYS).agg(F.min(F.struct(*place)).alias("_first"))
    if answered is not None:
        first = first.join(answered.select(*KEYS).distinct(), list(KEYS), "left_anti")
    chosen = stage(first.select("_first.*", *KEYS), "chosen")
    return asked.join(chosen, [*place, *KEYS], "left_semi").select(*asked.columns)


def fan_out(asked: DataFrame, answers: DataFrame, key: str = "id", rows_per_part: int = 100_000) -> DataFrame:
    """Every request with the answer to its text and rubric, or null: ``asked`` and ``raw``.

    A text with more than ``rows_per_part`` requests is dealt into parts, and its answer is repeated once for each part,
    so that no task gets a whole hot text. There are at most as many such texts as the table has parts of that size.
    """
    known = answers.groupBy(*KEYS).agg(F.min("raw").alias("raw"))
    parts = F.ceil(F.count(F.lit(1)) / F.lit(rows_per_part)).cast("int")
    hot = stage(asked.groupBy(*KEYS).agg(parts.alias("_parts")).where("_parts > 1"), "hot")
    count = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = asked.join(hot, list(KEYS), "left").withColumn("_part", F.pmod(F.xxhash64(*_place(asked, key)), count).cast("int"))
    repeated = known.join(hot, list(KEYS), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), count - 1)))
    found = dealt.drop("_parts").join(repeated.drop("_parts"), [*KEYS, "_part"], "left")
    return found.select(*asked.columns, "raw")


def asof_responses(
    asked: DataFrame, answered: DataFrame, ttl_seconds: int, key: str = "id", bucket_seconds: int | None = None, spread: int = 8
) -> DataFrame:
    """Every request with the newest answer of its time: given at or before ``asked_at``, less than ``ttl_seconds`` earlier.

    ``answered`` has ``answered_at`` and ``raw``; of answers of the same moment the smallest stands. Result: ``asked``,
    ``raw`` and ``answered_at``, null where no answer held.

    Time is cut into buckets (as wide as the answers live, unless set). What held before a bucket is the last answer of
    some bucket before, found in a table with one row for each key and bucket; inside a bucket, requests and answers are
    put in order. Requests of a key and bucket are dealt into ``spread`` parts that each get its answers, so a key with a
    third of all rows is spread over buckets and parts. Only keys and times are sorted.
    """
    keys, place, width = list(KEYS), _place(asked, key), (bucket_seconds or ttl_seconds) * 1_000_000

    def bucket(ts: str) -> Column:
        return F.floor(F.unix_micros(ts) / F.lit(width)).alias("_bucket")

    times = stage(answered.where("answered_at IS NOT NULL").groupBy(*keys, "answered_at").agg(F.min("raw").alias("raw")), "times")
    given = times.select(*keys, F.col("answered_at").alias("_at"), bucket("answered_at"))
    wanted = asked.where("asked_at IS NOT NULL").select(
        *keys, *place, F.col("asked_at").alias("_at"), bucket("asked_at"),
        F.pmod(F.xxhash64(*place), F.lit(spread)).cast("int").alias("_part"),
    )

    last = given.groupBy(*keys, "_bucket").agg(F.max("_at").alias("_last"))
    steps = wanted.select(*keys, "_bucket", F.lit(None).cast("timestamp").alias("_last")).distinct().unionByName(last)
    steps = steps.groupBy(*keys, "_bucket").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))

    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    nothing = [F.lit(None).cast(dict(asked.dtypes)[c]).alias(c) for c in place]
    events = wanted.select(*keys, *place, "_at", "_bucket", "_part", F.lit(None).cast("timestamp").alias("_given"))
    events = events.unionByName(
        given.select(*keys, *nothing, "_at", "_bucket", F.col("_at").alias("_given")).withColumn("_part", every)
    )
    so_far = Window.partitionBy(*keys, "_bucket", "_part").orderBy("_at", F.col("_given").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # a request is told from an answer by what stands in _given; several requests may have the same place
    in_bucket = events.withColumn("_held", F.last("_given", ignorenulls=True).over(so_far)).where(F.col("_given").isNull())
    held = in_bucket.join(carried, [*keys, "_bucket"], "left").withColumn("_held", F.coalesce("_held", "_carried"))
    young = F.unix_micros("_at") - F.unix_micros("_held") < F.lit(ttl_seconds * 1_000_000)
    settled = held.where(young).select(*place, *keys, F.col("_at").alias("asked_at"), F.col("_held").alias("answered_at")).distinct()
    texts = settled.join(times, [*keys, "answered_at"])
    return asked.join(texts, [*place, *keys, "asked_at"], "left").select(*asked.columns, "raw", "answered_at")
