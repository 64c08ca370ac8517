"""Counts and summaries. All use aggregates that combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.requests import fingerprint


def source_scan_summary(sources: DataFrame, pages: DataFrame, articles: DataFrame) -> DataFrame:
    """``url, processed, article_count`` for every source, whether or not it gave anything."""
    fetched = pages.select("url").distinct().withColumn("processed", F.lit(True))
    found = articles.groupBy(F.col("source").alias("url")).agg(F.count(F.lit(1)).alias("article_count"))
    return (
        sources.select("url")
        .distinct()
        .join(fetched, "url", "left")
        .join(found, "url", "left")
        .select(
            "url",
            F.coalesce("processed", F.lit(False)).alias("processed"),
            F.coalesce("article_count", F.lit(0)).alias("article_count"),
        )
    )


def funnel_counts(articles: DataFrame, min_confidence: int = 40, max_selected: int = 10) -> DataFrame:
    """One row: ``found, with_content, analyzed, selected, reports_generated``."""
    has_content = F.coalesce(F.length("content") > 0, F.lit(False))
    relevant = has_content & (F.col("ai_confidence") >= min_confidence) & (F.length("ai_validation") > 0)
    counted = articles.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(has_content).alias("with_content"),
        F.count_if(relevant).alias("analyzed"),
    )
    return selection_counts(counted, max_selected)


def selection_counts(counted: DataFrame, max_selected: int = 10) -> DataFrame:
    """Adds ``selected`` and ``reports_generated`` to a row with ``analyzed``."""
    selected = F.least(F.col("analyzed"), F.lit(max_selected).cast("long"))
    return counted.withColumn("selected", selected).withColumn("reports_generated", F.col("selected") > 0)


def content_fingerprints(
    df: DataFrame, key: str = "id", column: str = "content", first_chars: int | None = None
) -> DataFrame:
    """``content_key, copies, first_id``: articles with the same fingerprint share one analysis.

    The whole text is hashed; ``first_chars`` hashes a beginning only.
    """
    return df.groupBy(fingerprint(F.col(column), first_chars).alias("content_key")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")
    )


def unique_source_count(sources: DataFrame, column: str = "url") -> DataFrame:
    return sources.agg(F.count_distinct(F.nullif(F.trim(F.col(column)), F.lit(""))).alias("sources"))
