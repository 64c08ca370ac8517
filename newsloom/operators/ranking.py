"""Deduplication, global positions, report order and top lists.

Duplicates are settled with ``min_by``, which combines on the map side, so a URL that fills a third of the table
costs one row per task. Positions come from a range-partitioned sort plus per-partition counts: no step puts the
whole table, or a whole group, into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.session import cut_lineage, stage


def first_per_key(df: DataFrame, key: str | Column, order: Sequence[str], key_name: str = "_key") -> DataFrame:
    """The row with the smallest ``order`` for every key, by partial aggregation."""
    names = df.columns
    picked = df.groupBy((F.col(key) if isinstance(key, str) else key).alias(key_name)).agg(
        F.min_by(F.struct(*names), F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*")


def dedup_urls(links: DataFrame, order: Sequence[str] = ("page_id", "pos")) -> DataFrame:
    """The first link to every URL, by source position, then position on the page."""
    return first_per_key(links, "url", order)


def dedup_titles(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Titles equal but for case are one article; the first stays."""
    return first_per_key(df, F.lower("title"), order)


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Adds the 0-based position of every row in ``order``.

    The sorted rows are written once to the shared folder, which fixes what each partition holds; the table of
    partition sizes (one row per partition) is then all that has to be summed in one place.
    """
    return number_rows(df.orderBy(*order), name)


def number_rows(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """Adds the 0-based position of every row of a sorted table."""
    numbered = cut_lineage(ordered).withColumn("_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        numbered.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )


def batch_sources(sources: DataFrame, size: int = 5) -> DataFrame:
    """Adds ``batch`` (0-based) and ``progress`` after it, from a dense 0-based ``pos``."""
    total = F.ceil(sources.agg(F.max("pos") + 1).scalar() / F.lit(size)).cast("long")
    batch = F.floor(F.col("pos") / F.lit(size)).cast("long")
    return sources.withColumn("batch", batch).withColumn("progress", (F.col("batch") + 1) / total)


def assessment_priority(column: str = "assessment") -> Column:
    """INCLUDE first, then OK; CUT, anything else and nothing at all come last."""
    return F.when(F.col(column) == "INCLUDE", 0).when(F.col(column) == "OK", 1).otherwise(2)


def report_order(tie: Sequence[str]) -> list[Column]:
    return [
        assessment_priority().asc(),
        F.coalesce(F.col("assessment_score"), F.lit(0)).desc(),
        *[F.col(t).asc() for t in tie],
    ]


def sort_by_assessment(df: DataFrame, tie: Sequence[str] = ("url",)) -> DataFrame:
    """Report order: assessment, then score, then the given columns for a stable end."""
    return df.orderBy(*report_order(tie))


def rank_report(df: DataFrame, tie: Sequence[str] = ("url",)) -> DataFrame:
    """Adds ``rank``, the 1-based place in report order.

    Rows are written once, each with a number; only that and the columns of the order are sorted, and the places come
    back by the number.
    """
    rows = stage(df.withColumn("_line", F.monotonically_increasing_id()), "ranked")
    slim = rows.select("_line", *dict.fromkeys(("assessment", "assessment_score", *tie)))
    places = with_position(slim, report_order(tie), "rank").select("_line", (F.col("rank") + 1).alias("rank"))
    return rows.join(places, "_line").drop("_line")


def select_top_articles(
    df: DataFrame, as_of, n: int = 10, tie: Sequence[str] = ("url",), score: str = "relevance_score"
) -> DataFrame:
    """The ``n`` best by relevance, newest first among equals, in report order.

    ``score`` must already be there (see ``scoring.report_relevance``). A missing date counts as 2000-01-01 and an
    unreadable one sorts last.
    """
    day = dates.parse_day(F.coalesce(F.col("date"), F.lit("2000-01-01")))
    best = df.orderBy(F.col(score).desc(), day.desc_nulls_last(), *[F.col(t).asc() for t in tie]).limit(n)
    return sort_by_assessment(best, tie)


def newest_first(df: DataFrame, column: str = "published_date", tie: Sequence[str] = ("url",)) -> DataFrame:
    return df.orderBy(F.col(column).desc(), *[F.col(t).asc() for t in tie])


def top_keywords(keywords: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` keywords by position."""
    return keywords.orderBy("pos").limit(k)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark trims every group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def union_batches(*batches: DataFrame) -> DataFrame:
    """All rows of all batches, duplicates kept, missing columns null."""
    result = batches[0]
    for batch in batches[1:]:
        result = result.unionByName(batch, allowMissingColumns=True)
    return result
