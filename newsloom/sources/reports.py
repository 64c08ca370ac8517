"""Report tables and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.operators.ranking import rank_report, report_order
from newsloom.session import stage

# Report columns, in order.
SHEET_COLUMNS = ("Use Case Category", "URL", "Title", "Takeaway", "Date")
REPORT_COLUMNS = SHEET_COLUMNS + ("Use Case Category Justification",)
_FILE_NAMES = {c: c.lower().replace(" ", "_") for c in REPORT_COLUMNS}
COLOURS = {"INCLUDE": "green", "OK": "orange", "CUT": "red"}


def _or(df: DataFrame, name: str, default: str):
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _report_columns(df: DataFrame) -> list:
    return [
        _or(df, "category", "N/A").alias(REPORT_COLUMNS[0]),
        urls.strip_artifacts(_or(df, "url", "")).alias(REPORT_COLUMNS[1]),
        _or(df, "title", "").alias(REPORT_COLUMNS[2]),
        _or(df, "takeaway", "").alias(REPORT_COLUMNS[3]),
        _or(df, "date", "").alias(REPORT_COLUMNS[4]),
        _or(df, "category_justification", "N/A").alias(REPORT_COLUMNS[5]),
    ]


def csv_report(df: DataFrame, tie: tuple[str, ...] = ("url",)) -> DataFrame:
    """The six report columns in report order.

    Only what the report shows is staged and sorted; the articles' texts are not.
    """
    shown = df.select(
        *_report_columns(df), "assessment", "assessment_score", *[F.col(t).alias(f"_tie_{t}") for t in tie]
    )
    staged = stage(shown.withColumnsRenamed(_FILE_NAMES), "report").withColumnsRenamed(
        {file: name for name, file in _FILE_NAMES.items()}
    )
    ordered = staged.orderBy(*report_order([f"_tie_{t}" for t in tie]))
    return ordered.select(*[F.col(f"`{c}`") for c in REPORT_COLUMNS])


def sheet_report(df: DataFrame, tie: tuple[str, ...] = ("url",), justification: bool = False) -> DataFrame:
    """The workbook's table: five columns, or six as the coordinator writes it."""
    report = csv_report(df, tie)
    return report if justification else report.select(*SHEET_COLUMNS)


def column_width_profile(df: DataFrame) -> DataFrame:
    """``column, width``: the longest value or name of each column, plus two. One pass over the table."""
    longest = [
        F.greatest(
            F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))
        ).alias(f"w{i}")
        for i, c in enumerate(df.columns)
    ]
    widths = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), (F.col(f"w{i}") + 2).alias("width"))
            for i, c in enumerate(df.columns)
        ]
    )
    return df.agg(*longest).select(F.explode(widths).alias("w")).select("w.position", "w.column", "w.width")


def detail_report(df: DataFrame, tie: tuple[str, ...] = ("url",)) -> DataFrame:
    """One ranked row per article with everything the detailed report shows."""
    assessment = _or(df, "assessment", "N/A")
    colour = F.coalesce(
        *[F.when(F.upper("assessment") == name, F.lit(c)) for name, c in COLOURS.items()], F.lit("black")
    )
    criteria = F.transform(
        "criteria_results",
        lambda c: F.concat(F.when(c["status"], "✓ ").otherwise("✗ "), c["criteria"], F.lit(": "), c["notes"]),
    )
    shown = df.select(
        *[t for t in tie if t != "url"],
        _or(df, "title", "Untitled").alias("title"),
        F.col("url"),
        urls.strip_artifacts(_or(df, "url", "")).alias("clean_url"),
        _or(df, "date", "Unknown date").alias("date"),
        _or(df, "category", "N/A").alias("category"),
        assessment.alias("assessment"),
        F.coalesce("assessment_score", F.lit(0)).alias("assessment_score"),
        _or(df, "takeaway", "No takeaway available").alias("takeaway"),
        _or(df, "category_justification", "N/A").alias("category_justification"),
        criteria.alias("criteria"),
    ).withColumn("colour", colour)
    return rank_report(shown, tie)


def write_csv_report(df: DataFrame, path: str, tie: tuple[str, ...] = ("url",)) -> None:
    """The report as CSV with a header, in report order across the part files."""
    csv_report(df, tie).write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_report_set(df: DataFrame, folder: str, as_of: str, tie: tuple[str, ...] = ("url",)) -> None:
    """The report of a day under ``report_date=<day>``; a second run on the same day replaces the first."""
    dated = csv_report(df, tie).withColumn("report_date", F.lit(as_of))
    (
        dated.withColumnsRenamed(_FILE_NAMES)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_date")
        .parquet(folder)
    )
