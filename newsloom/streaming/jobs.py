"""Repeated scans as streams. What has been processed is the stream's checkpoint; nothing else is remembered."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import dates
from newsloom.operators.filters import filter_recent
from newsloom.streaming.log import ScanLog

PAGE_SCHEMA = "page_id LONG, url STRING, html STRING"


def read_page_stream(spark: SparkSession, path: str, files_per_batch: int = 5) -> DataFrame:
    """Page files as they arrive, a few per micro-batch."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_scan(
    pages: DataFrame, stage: Callable[[DataFrame], DataFrame], log: ScanLog, checkpoint: str, since: str | None = None
) -> StreamingQuery:
    """Run ``stage`` on every micro-batch and commit its articles to the scan log, until all input is used.

    ``stage`` finds, filters and evaluates; it may look at what the log holds. A batch that is repeated after a failure
    replaces what it left, and one that is delivered again after its commit does no work.
    """

    def append(batch: DataFrame, number: int) -> None:
        if number > log.last_batch():
            log.commit(number, stage(batch), since)

    return (
        pages.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_join_metadata(links: DataFrame, metadata: DataFrame, ts: str = "ts", lookback: str = "7 days") -> DataFrame:
    """Links with the title and date of their pages, both sides arriving in any order within the look-back.

    Either side waits for the other as long as the look-back: a pair is found if the times of link and page are no farther
    apart, whichever comes first, and the state of both sides ends with it. A page may be described more than once, and
    every description is joined; ``settle_metadata`` keeps the one that the batch join keeps. Pages without a title join nothing.
    """
    left = links.withWatermark(ts, lookback)
    known = metadata.where(F.col("title").isNotNull()).select(
        F.col("url").alias("_url"), F.col("title").alias("page_title"), "date", F.col(ts).alias("_ts")
    ).withWatermark("_ts", lookback)
    apart = F.expr(f"interval {lookback}")
    near = (F.col("_ts") >= F.col(ts) - apart) & (F.col("_ts") <= F.col(ts) + apart)
    return left.join(known, (F.col("url") == F.col("_url")) & near).drop("_url", "_ts")


def settle_metadata(joined: DataFrame, key: Sequence[str] = ("page_id", "pos")) -> DataFrame:
    """One row for each link: the description with the earliest date, then the smallest title."""
    rest = [c for c in joined.columns if c not in (*key, "date", "page_title")]
    return (
        joined.groupBy(*key, *rest).agg(F.min(F.struct("date", "page_title")).alias("_page"))
        .select(*key, *rest, "_page.date", "_page.page_title")
    )


def stream_dedup_urls(links: DataFrame, ts: str = "ts", lookback: str = "7 days") -> DataFrame:
    """Every URL once. State lasts as long as the look-back, so it stays bounded."""
    return links.withWatermark(ts, lookback).dropDuplicatesWithinWatermark(["url"])


def stream_recent(records: DataFrame, cutoff, ts: str = "ts") -> DataFrame:
    """Records after the cutoff, as they arrive."""
    return filter_recent(records, dates.as_timestamp(cutoff), ts)


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Drive a stream over all input there is and append its rows to a Parquet folder."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
