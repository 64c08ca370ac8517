"""Input tables: source lists, term lists, pages, feeds, search results, the category framework, the store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.functions import dates, text
from newsloom.operators.filters import filter_recent
from newsloom.operators.ranking import with_position
from newsloom.profile import Profile

_ENTRY = "title STRING, id STRING, published STRING, summary STRING"
_RESULTS = (
    "keyword STRING, pos INT, "
    "news_results ARRAY<STRUCT<title: STRING, link: STRING, source: STRING, date: STRING>>"
)
_SCAN_LISTS = "full_scan_urls ARRAY<STRING>, test_scan_urls ARRAY<STRING>"
FRAMEWORK_MISSING = "Error: Categorization framework file not found."


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be listed; a missing file is an empty list, not an error."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def distinct_in_order(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """Trim, drop blanks, keep the first occurrence of every URL; ``pos`` is dense and 0-based."""
    named = lines.withColumn("url", text.strip(F.col("url"))).where(F.length("url") > 0)
    first = named.groupBy("url").agg(F.min(F.struct(*order)).alias("_first"))
    return with_position(first, [F.col("_first")]).select("pos", "url")


def read_source_list(
    spark: SparkSession,
    path: str | None,
    fmt: str = "csv",
    mode: str = "full",
    distinct: bool = True,
) -> DataFrame:
    """``pos, url`` from a headerless CSV (first field), a text file or a JSON settings file.

    ``mode`` is ``full`` or ``test``; ``coordinator_test`` is the coordinator's own fixed list. The order is file,
    then line. ``distinct=False`` keeps repeats, as the coordinator does.
    """
    if mode == "coordinator_test":
        return _listed(spark, p.COORDINATOR_TEST_SOURCES)
    found = path is not None and _exists(spark, path)
    if mode == "test":
        lines = _json_list(spark, path, "test_scan_urls") if found and fmt == "json" else None
        if lines is None or lines.isEmpty():
            return _listed(spark, p.TEST_SOURCES)
    elif not found:
        return _listed(spark, ())
    elif fmt == "json":
        lines = _json_list(spark, path, "full_scan_urls")
    elif fmt == "csv":
        lines = _in_file_order(spark.read.schema("url STRING").csv(path))
    elif fmt == "text":
        lines = _in_file_order(spark.read.text(path).withColumnRenamed("value", "url"))
    else:
        raise ValueError(f"unknown source list format {fmt!r}")
    if distinct:
        return distinct_in_order(lines, ["_file", "_line"])
    kept = lines.withColumn("url", text.strip(F.col("url"))).where(F.length("url") > 0)
    return with_position(kept, [F.col("_file"), F.col("_line")]).select("pos", "url")


def _listed(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(urls)), "pos LONG, url STRING")


def _in_file_order(lines: DataFrame) -> DataFrame:
    """Adds the file, and the line order within it (block start, then row of the scan)."""
    return lines.select(
        "url",
        F.col("_metadata.file_path").alias("_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("_line"),
    )


def _json_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    settings = spark.read.schema(_SCAN_LISTS).json(path, multiLine=True)
    return settings.select(F.lit(path).alias("_file"), F.posexplode(name).alias("_line", "url"))


def read_term_lists(
    spark: SparkSession,
    path: str | None = None,
    overrides: Mapping[str, Sequence[str]] | None = None,
    profile: Profile = Profile(),
) -> DataFrame:
    """``list_name, pos, term`` from a settings file; defaults if it is missing; lists replaced whole by overrides."""
    lists = ("companies", "tools", "retail_terms", "deployment_terms", "major_platforms")
    defaults = [
        (name, i, term) for name in lists for i, term in enumerate(getattr(profile, name))
    ]
    schema = "list_name STRING, pos INT, term STRING"
    terms = spark.createDataFrame(defaults, schema)
    if path is not None and _exists(spark, path):
        fields = ", ".join(f"{name}: ARRAY<STRING>" for name in lists)
        settings = spark.read.schema(f"evaluation STRUCT<{fields}>").json(path, multiLine=True)
        pairs = F.array(
            *[F.struct(F.lit(n).alias("list_name"), F.col(f"evaluation.{n}").alias("terms")) for n in lists]
        )
        loaded = (
            settings.select(F.explode(pairs).alias("l"))
            .select("l.list_name", F.posexplode("l.terms").alias("pos", "term"))
        )
        # an unreadable file gives no rows and leaves the defaults
        if not loaded.isEmpty():
            terms = loaded
    if overrides:
        given = [(name, i, term) for name, values in overrides.items() for i, term in enumerate(values)]
        replaced = terms.where(~F.col("list_name").isin(*overrides))
        terms = replaced.unionByName(spark.createDataFrame(given, schema)) if given else replaced
    return terms


def profile_from_terms(terms: DataFrame, profile: Profile = Profile()) -> Profile:
    """A profile with the lists of a term table. Settings are small by nature: a few hundred short strings."""
    lists: dict[str, list[str]] = {}
    for row in terms.orderBy("list_name", "pos").collect():
        lists.setdefault(row["list_name"], []).append(row["term"])
    return profile.with_terms(**lists)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages; a page without content is a failed fetch and gives nothing."""
    return spark.read.parquet(path).where(F.length("html") > 0)


def read_atom_feed(spark: SparkSession, path: str, cutoff, newest: int | None = None) -> DataFrame:
    """Feed entries from the cutoff day on, the ``newest`` of them if set; one without a readable date gets that day."""
    day = F.to_date(dates.as_timestamp(cutoff))
    entries = spark.read.format("xml").option("rowTag", "entry").schema(_ENTRY).load(path)
    published = F.coalesce(F.substring("published", 1, 10).try_cast("date"), day)
    rows = entries.select(
        text.strip(F.coalesce("title", F.lit(""))).alias("title"),
        text.strip(F.coalesce("id", F.lit(""))).alias("url"),
        F.lit("arXiv").alias("source"),
        published.cast("timestamp").alias("published_date"),
        text.strip(F.coalesce("summary", F.lit(""))).alias("content"),
    )
    recent = filter_recent(rows, day.cast("timestamp"), "published_date", inclusive=True)
    return recent if newest is None else recent.orderBy(F.col("published_date").desc(), "url").limit(newest)


def search_results(
    dumps: DataFrame, cutoff, max_keywords: int | None = None, per_keyword: int | None = None
) -> DataFrame:
    """Result rows from dumps ``pos, keyword, news_results``; see ``read_search_results``."""
    results = F.col("news_results") if per_keyword is None else F.slice("news_results", 1, per_keyword)
    asked = (
        (dumps if max_keywords is None else dumps.where(F.col("pos") < max_keywords))
        .select("pos", "keyword", F.posexplode(results).alias("result_no", "r"))
        .select("pos", "keyword", "result_no", "r.*")
    )
    complete = asked.where(F.col("title").isNotNull() & F.col("link").isNotNull() & F.col("source").isNotNull())
    dated = complete.select(
        "keyword",
        "result_no",
        "title",
        F.col("link").alias("url"),
        "source",
        dates.parse_date(F.col("date")).alias("published_date"),
    )
    return filter_recent(dated, cutoff, "published_date", inclusive=True)


def read_search_results(
    spark: SparkSession, path: str, cutoff, max_keywords: int | None = None, per_keyword: int | None = None
) -> DataFrame:
    """News search dumps: results that are complete and not before the cutoff; limits only where the caller sets them."""
    return search_results(spark.read.schema(_RESULTS).json(path), cutoff, max_keywords, per_keyword)


def framework_lines(text_rows: DataFrame) -> DataFrame:
    """``cat_no, category, line`` from whole framework files in column ``value``.

    A heading is ``<number>. <name>``; the lines up to the next heading belong to it. The file is one row, so its
    sections are split in place.
    """
    sections = text_rows.select(F.explode(F.split("value", r"(?m)^(?=\d+\. )")).alias("section"))
    headed = sections.where(F.col("section").rlike(r"^\d+\. ")).select(
        F.regexp_extract("section", r"^(\d+)\. ", 1).cast("int").alias("cat_no"),
        F.trim(F.regexp_extract("section", r"^\d+\. ([^\r\n]*)", 1)).alias("category"),
        F.posexplode(F.split("section", r"\r?\n")).alias("pos", "line"),
    )
    body = headed.withColumn("line", F.regexp_replace(F.trim("line"), r"^- ", ""))
    return body.where((F.col("pos") > 0) & (F.col("line") != "")).select("cat_no", "category", "pos", "line")


def read_framework(spark: SparkSession, path: str) -> DataFrame:
    """The category framework; a missing file gives one row that says so."""
    if not _exists(spark, path):
        return spark.createDataFrame(
            [(None, "Error", 0, FRAMEWORK_MISSING)], "cat_no INT, category STRING, pos INT, line STRING"
        )
    return framework_lines(spark.read.text(path, wholetext=True))
