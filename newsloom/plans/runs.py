"""The end-to-end runs. A stage is a function from DataFrame to DataFrame, chained with ``transform``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import dates, text
from newsloom.operators import (
    aggregates, chunking, extract, filters, joins, ranking, requests, responses, scoring, takeaways as tk,
)
from newsloom.profile import Profile
from newsloom.session import stage
from newsloom.sources import reports, store
from newsloom.streaming import jobs
from newsloom.streaming.log import ScanLog

Stage = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        df = df.transform(stage)
    return df


def discover(
    pages: DataFrame,
    metadata: DataFrame,
    cutoff,
    profile: Profile = Profile(),
    seen: DataFrame | None = None,
    specific: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """New articles linked from the pages: ``url, title, date, published_ts, source`` and the link's columns to ``keep``.

    The cheap title test comes first, then one row per URL, and only then the metadata join. ``seen`` holds URLs to leave
    out; if it has the columns to ``keep``, only where they were seen at or before the link's place.
    """
    links = chain(
        pages,
        extract.extract_links,
        extract.resolve_links,
        extract.clean_titles,
        lambda df: filters.filter_topic_titles(df, profile.topic_patterns),
        ranking.dedup_urls,
    )
    if seen is not None:
        placed = keep and set(keep) <= set(seen.columns)
        links = joins.exclude_known(links, seen, keep) if placed else joins.exclude_seen(links, seen)
    found = joins.join_metadata(links, metadata)
    if specific:
        found = filters.filter_specific_articles(found, "url", "page_title")
    dated = found.withColumn("published_ts", dates.parse_date(F.col("date")))
    recent = filters.filter_recent(dated, cutoff)
    return recent.select("url", "title", "date", "published_ts", F.col("source_url").alias("source"), *keep)


def run_scan(
    pages: DataFrame,
    metadata: DataFrame,
    texts: DataFrame,
    takeaways: DataFrame | None,
    cutoff,
    profile: Profile = Profile(),
    seen: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The interactive scan: discover, fetch text, attach takeaways, evaluate and categorise."""
    # what was found is small beside the pages: kept once, it is what the texts are narrowed down by
    found = stage(discover(pages, metadata, cutoff, profile, seen, keep=keep), "found")
    found = found.withColumn("content", F.lit(None).cast("string"))
    articles = filters.filter_with_content(joins.join_content(found, texts))
    if takeaways is None:
        articles = articles.withColumn("takeaway", F.lit("No takeaway available"))
    else:
        given = takeaways.groupBy("url").agg(F.min("takeaway").alias("takeaway"))
        articles = articles.join(given, "url", "left").withColumn(
            "takeaway", F.coalesce("takeaway", F.lit("No takeaway available"))
        )
    noted = articles.withColumn("ai_validation", F.lit("AI-related article found in scan"))
    return chain(
        noted,
        lambda df: scoring.evaluate_articles(df, profile),
        lambda df: scoring.categorize_by_terms(df, profile),
    )


PLACE = ("page_id", "pos")


def scan_log(spark: SparkSession, folder: str, fan: int = 8) -> ScanLog:
    """The log of a repeated scan: an article holds as its first link, by page and position, found it."""
    return ScanLog(spark, folder, order=PLACE, ts="published_ts", fan=fan)


def run_stream_scan(
    pages: DataFrame,
    metadata: DataFrame,
    texts: DataFrame,
    log: ScanLog,
    checkpoint: str,
    cutoff: str,
    profile: Profile = Profile(),
    prepare: Stage = lambda pages: pages,
) -> DataFrame:
    """The scan over a stream of pages: each micro-batch finds, filters and evaluates its articles and commits them.

    Articles that the log holds from an earlier place are not evaluated again. Returns what the log holds at the end,
    which equals ``run_scan`` over all pages at once, however they were cut into batches and in whatever order they came.
    """

    def one(batch: DataFrame) -> DataFrame:
        known = log.read("url string, page_id long, pos int, seq long").select("url", *PLACE)
        return run_scan(prepare(batch), metadata, texts, None, cutoff, profile, known, PLACE)

    jobs.stream_scan(pages, one, log, checkpoint).awaitTermination()
    return log.read()


def store_scan(scanned: DataFrame, existing: DataFrame | None, as_of: str, folder: str | None = None) -> DataFrame:
    """The end of a scan: the articles go into the store, and into the day's report if a folder is given."""
    scanned = stage(scanned, "scanned")
    if folder is not None:
        reports.write_report_set(scanned, folder, as_of)
    rows = scanned.withColumn("summary", F.col("takeaway"))
    return store.upsert_store(existing, store.to_store_rows(rows, as_of))


def audience_checked(df: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds ``passes_check`` for the takeaway as it is, whose fingerprint ``checks`` have as ``takeaway_key``."""
    named = df.withColumn("takeaway_key", requests.fingerprint(F.col("takeaway")))
    return tk.audience_check(named, checks, "takeaway_key").drop("takeaway_key", "check_issues")


def review(drafts: DataFrame, checks: DataFrame) -> DataFrame:
    """One round of checks over ``drafts(takeaway, _verdict, _rewritten, _refined)``: the drafts as they leave it.

    Every takeaway is checked for its audience, and what fails (no verdict fails, too) is replaced by its rewritten form, if
    there is one. Then rules and the attached verdicts ``_verdict`` judge it; what fails, with something to change, is replaced by
    its refined form (without one it stays) and judged by the rules once more. Adds ``passes_validation, issues_found,
    rewritten, refined``; the text as it is at the end is for ``audience_checked``. What ``_rewritten`` and ``_refined`` hold is
    attached beforehand (``attach_responses``), while the drafts lie by that key; all but the check stays in the row.
    """
    known = audience_checked(drafts.withColumn("_new", text.null_if_empty(text.strip(F.col("_rewritten")))), checks)
    first = known.withColumn("rewritten", ~F.col("passes_check") & F.col("_new").isNotNull()).withColumn(
        "takeaway", F.when(F.col("rewritten"), F.col("_new")).otherwise(F.col("takeaway"))
    ).drop("_new", "passes_check")
    judged = tk.refinement_instructions(tk.merge_verdicts(tk.validate_takeaways(first)))
    due = ~F.col("passes_validation") & (F.col("refinement") != tk.ALL_CLEAR)
    # what is not due has no refined form to be replaced by
    settled = judged.withColumn("refined", due).select(
        *[c for c in drafts.columns if c not in ("takeaway", "_verdict", "_rewritten", "_refined")], "rewritten", "refined",
        F.when(F.col("refined"), F.col("_refined")).alias("raw"), F.col("takeaway").alias("_first"),
        F.col("passes_validation").alias("_passes"), F.col("issues_found").alias("_issues"),
    )
    again = tk.validate_takeaways(responses.parse_takeaway_responses(settled, fallback="_first"))
    return again.withColumns({
        "passes_validation": F.when(F.col("refined"), F.col("passes_validation")).otherwise(F.col("_passes")),
        "issues_found": F.when(F.col("refined"), F.col("issues_found")).otherwise(F.col("_issues")),
    }).drop("raw", "_first", "_passes", "_issues", "word_count", "sentence_count", "has_list_marks")


def run_takeaways(
    articles: DataFrame,
    answers: DataFrame,
    verdicts: DataFrame,
    refined: DataFrame,
    checks: DataFrame,
    rewritten: DataFrame,
    profile: Profile = Profile(),
    max_tokens: int = 40_000,
) -> DataFrame:
    """``id, takeaway, passes_validation, issues_found, rewritten, refined, passes_check`` for ``articles(id, content)``.

    Short contents get their fixed text. The others are cut into chunks, and every chunk is a request; answers are
    attached by fingerprint, parsed and reviewed (``review``), so rewriting and refining are asked for by chunk, too. The
    takeaways of an article of several chunks are combined, and the combination is reviewed in turn; ``verdicts`` on an
    article hold for its only chunk or for the combination.
    """
    guarded = tk.short_content_guard(articles.select("id", "content"))
    due = guarded.where(F.col("takeaway").isNull()).select("id", "content")
    chunks = chunking.chunk_articles(due, max_tokens).select("id", "chunk_no", F.col("chunk").alias("content"))
    asked = requests.build_requests(chunks, "takeaway", profile).drop("prompt", "kind")
    counts = asked.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("sole"))
    given = verdicts.withColumnRenamed("id", "judged")
    # what is known by article is joined before the texts come
    named = asked.join(counts, "id").withColumn("judged", F.when(F.col("sole"), F.col("id")))
    placed = tk.attach_verdicts(named, given, "judged").drop("judged")
    known = joins.attach_responses(placed, {"raw": answers, "_rewritten": rewritten, "_refined": refined})
    drafts = responses.parse_takeaway_responses(known).drop("raw", "content_key", "rubric_key")
    parts = stage(review(drafts, checks), "parts")

    whole = tk.combine_takeaways(parts.where(~F.col("sole")).select("id", "chunk_no", "takeaway"))
    joined = stage(
        tk.attach_verdicts(whole.withColumn("judged", F.col("id")), given, "judged").drop("judged").withColumns(
            {"content_key": requests.fingerprint(F.col("takeaway")), "rubric_key": F.md5(F.lit(profile.rubric))}
        ),
        "combined",
    )
    # few of the tables' rows, which are those of all chunks, are for combinations
    rewritten, refined = joins.asked_responses(joined, rewritten), joins.asked_responses(joined, refined)
    spoken = joined.select(F.col("content_key").alias("takeaway_key")).unionByName(
        rewritten.select(requests.fingerprint(text.strip(F.col("raw"))).alias("takeaway_key"))
    ).unionByName(
        responses.parse_takeaway_responses(refined).select(requests.fingerprint(F.col("takeaway")).alias("takeaway_key"))
    )
    met = stage(checks.join(spoken.distinct(), "takeaway_key", "left_semi"), "checks")
    combined = audience_checked(
        review(joins.attach_responses(joined, {"_rewritten": rewritten, "_refined": refined}), met), met
    )

    shown = ["id", "takeaway", "passes_validation", "issues_found", "rewritten", "refined", "passes_check"]
    none, no = F.array().cast("array<string>"), F.lit(False)
    short = guarded.where(F.col("takeaway").isNotNull()).withColumns(
        {"passes_validation": no, "issues_found": none, "rewritten": no, "refined": no, "passes_check": no}
    )
    sole = audience_checked(parts.where("sole"), checks)  # nobody asks for the check of a part
    return sole.select(*shown).unionByName(combined.select(*shown)).unionByName(short.select(*shown))


@dataclass(frozen=True)
class Workflow:
    """What the coordinator hands back. The analysed articles come without their texts."""

    analyzed: DataFrame
    selected: DataFrame
    funnel: DataFrame


def run_workflow(
    articles: DataFrame, texts: DataFrame, as_of, profile: Profile = Profile(), tie: tuple[str, ...] = ("url",)
) -> Workflow:
    """The coordinator's run over discovered articles: score, keep the relevant, evaluate, select the best.

    The texts are joined and scored in one pass; what comes by is counted while its results are written. Both counts are
    taken after the last shuffle, in the tasks that write, where Spark counts each task once however often it was tried.
    """
    spark = articles.sparkSession
    found, kept = Observation(), Observation()
    filled = joins.join_content(articles, texts).observe(
        found,
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.coalesce(F.length("content") > 0, F.lit(False))).alias("with_content"),
    )
    scored = chain(
        filled,
        filters.filter_with_content,
        lambda df: scoring.score_relevance(df, profile),
        lambda df: filters.filter_relevant(df, profile.min_confidence),
        lambda df: scoring.evaluate_articles(df, profile),
        lambda df: scoring.report_relevance(df, as_of),
    )
    analyzed = stage(scored.drop("content").observe(kept, F.count(F.lit(1)).alias("analyzed")), "analyzed")
    selected = ranking.select_top_articles(analyzed, as_of, profile.max_report_articles, tie)
    counts = {"found": 0, "with_content": 0, "analyzed": 0} | found.get | kept.get  # nothing is observed of an empty plan
    counted = spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))
    return Workflow(analyzed, selected, aggregates.selection_counts(counted, profile.max_report_articles))


def run_search(
    keywords: DataFrame,
    docs: DataFrame,
    cutoff,
    profile: Profile = Profile(),
    max_keywords: int | None = None,
    per_keyword: int | None = None,
) -> DataFrame:
    """The criteria search: recent, specific articles with content, matched with the keywords, labelled, newest first.

    Limits are off unless the caller sets them; the hits of a keyword are then its newest.
    """
    fitting = chain(
        docs,
        lambda df: filters.filter_recent(df, cutoff, "published_date", inclusive=True),
        filters.filter_specific_articles,
        filters.filter_with_content,
    )
    asked = keywords if max_keywords is None else ranking.top_keywords(keywords, max_keywords)
    hits = joins.keyword_hits(asked, fitting, per_keyword, ("-published_date",), column="content")
    return chain(
        hits,
        lambda df: scoring.label_relevance(df, profile),
        lambda df: df.withColumn("ai_confidence", F.lit(100)),
        lambda df: ranking.newest_first(df, tie=("pos", "url")),
    )
