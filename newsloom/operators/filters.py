"""Row predicates. All are plain column conditions, so Catalyst moves them towards the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.functions import dates, text


def topic_pattern(patterns: Sequence[str]) -> str:
    return "(?iU)" + "|".join(f"(?:{x})" for x in patterns)


def filter_topic_titles(links: DataFrame, patterns: Sequence[str] = p.TOPIC_PATTERNS) -> DataFrame:
    """Links whose title matches any topic pattern; one alternation, one pass."""
    return links.where(F.col("title").rlike(topic_pattern(patterns)))


def is_specific_article(url: Column, title: Column) -> Column:
    listing = F.lower(url).rlike("(?U)" + "|".join(f"(?:{x})" for x in p.NON_ARTICLE_URL_PATTERNS))
    too_short = (text.word_count(title) < 2) & (F.length(title) < 5)
    return ~listing & ~too_short


def filter_specific_articles(df: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Drop legal pages, category, tag and topic listings, and pages with next to no title."""
    return df.where(is_specific_article(F.col(url), F.col(title)))


def filter_consent_pages(
    df: DataFrame, column: str = "content", phrases: Sequence[str] = p.CONSENT_PHRASES
) -> DataFrame:
    """Adds ``is_consent_page``."""
    return df.withColumn("is_consent_page", text.contains_any(F.lower(F.col(column)), phrases))


def filter_recent(df: DataFrame, cutoff, column: str = "published_ts", inclusive: bool = False) -> DataFrame:
    """Rows after the cutoff (scans) or at and after it (searches); unreadable dates drop out."""
    limit = dates.as_timestamp(cutoff)
    ts = F.col(column)
    return df.where(ts >= limit if inclusive else ts > limit)


def filter_recent_days(df: DataFrame, cutoff, column: str = "date") -> DataFrame:
    """Whole-day variant on a ``yyyy-MM-dd`` string."""
    return df.where(dates.parse_day(F.col(column)) >= F.to_date(dates.as_timestamp(cutoff)))


def filter_with_content(df: DataFrame, column: str = "content") -> DataFrame:
    return df.where(F.length(column) > 0)


def filter_relevant(df: DataFrame, threshold: int = 40) -> DataFrame:
    return df.where((F.col("ai_confidence") >= threshold) & (F.length("ai_validation") > 0))


def drop_failed_takeaways(df: DataFrame, column: str = "takeaway") -> DataFrame:
    """Takeaways that only report a failure are neither kept nor remembered."""
    return df.where(~F.col(column).isin(*p.FAILED_TAKEAWAYS))


def filter_unprocessed(sources: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    return sources.join(processed.select(key).distinct(), key, "left_anti")
