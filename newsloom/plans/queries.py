"""Every operator as a named query over the supplied tables.

The tables hold invented words and no dates, so articles get a title (first sentence), a takeaway (second sentence),
an address and a day derived from their own columns, and the term lists of ``CORPUS_PROFILE`` are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.functions import dates, text, urls
from newsloom.operators import (
    aggregates, answers, chunking, extract, filters, joins, ranking, requests, responses, scoring, takeaways,
)
from newsloom.plans import runs
from newsloom.profile import CORPUS_PROFILE as PROFILE
from newsloom.session import new_folder, spread, stage
from newsloom.sources import readers, reports, store
from newsloom.sources.word_index import WordIndex
from newsloom.streaming import jobs

AS_OF = "2024-01-31"
CUTOFF = "2024-01-16"
TTL_SECONDS = 10 * 86400
CHUNK_TOKENS = 100
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- tables ----------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def day_of(c: Column) -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(c, F.lit(30)).cast("int")), "yyyy-MM-dd")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id").alias("url"),
        F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"),
        F.col("text").alias("content"),
        F.regexp_extract("text", r"^[^.!?\n]*[.!?\n]+([^.!?\n]*)", 1).alias("takeaway"),
        "source",
        "lang",
        day_of(F.col("doc_id")).alias("date"),
    )


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.evaluate_articles(articles(spark, sf), PROFILE)


def categorized(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.categorize_by_terms(evaluated(spark, sf), PROFILE)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"), "page_id").where(F.length("html") > 0)


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    return as_listing(pages(spark, sf))


def as_listing(pages: DataFrame) -> DataFrame:
    """The pages with a publication date in the head and a permalink to themselves at the end."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.where(F.length("html") > 0).withColumn(
        "html",
        F.concat(
            F.lit('<meta property="article:published_time" content="'),
            day_of(F.col("page_id")),
            F.lit('">'),
            "html",
            F.lit('<a class="permalink" href="'),
            "url",
            F.lit('">Permalink to '),
            title,
            F.lit("</a>"),
        ),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.resolve_links(extract.extract_links(pages(spark, sf)))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("chunk_no"), "role", F.col("text").alias("takeaway")
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        (F.col("quality") == 1).alias("passes"),
        F.when(F.col("toxic") == 1, F.array(F.lit("Toxic wording"))).otherwise(none).alias("issues"),
        F.when(F.col("quality") == 0, "Name a company.").otherwise("").alias("suggestions"),
    )


def escaped(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def raw_responses(spark: SparkSession, sf: str, field: str = "takeaway", extra: str = "") -> DataFrame:
    """What a model might have sent back for each document: mostly JSON, broken in a way that depends on the source."""
    good = escaped(F.col("content"))
    raw = (
        F.when(F.col("source") == "src1", F.concat(F.lit(f'{{"{field}": "'), "content", F.lit(f'"{extra}}}')))
        .when(F.col("source") == "src2", F.concat(F.lit('{"other": "'), good, F.lit('"}')))
        .when(F.col("source") == "src3", F.concat(F.lit(f'{{"{field}": "'), good))
        .when(F.col("source") == "src4", F.concat(F.lit(f"{{'x', \"{field}\": '"), "content", F.lit("'}")))
        .when(F.col("source") == "src5", F.lit(None))
        .when(F.col("source") == "src6", F.concat(F.lit(f'```json{{"{field}": "'), good, F.lit(f'"{extra}}}```')))
        .otherwise(F.concat(F.lit(f' {{"{field}": "'), good, F.lit(f'"{extra}}}\n')))
    )
    return articles(spark, sf).select("id", "source", "content", raw.alias("raw"))


# --- sources ---------------------------------------------------------------------------------------------------


def _source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).orderBy("id").select(
        F.concat(F.lit("  https://"), "source", F.lit(".example.com/"), "lang", F.lit("/ ")).alias("line")
    )


@query
def read_source_list(spark, sf):
    folder = new_folder(spark, "sources")
    _source_lines(spark, sf).write.csv(folder, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_source_list(spark, folder, "csv")


@query
def read_source_list_text(spark, sf):
    folder = new_folder(spark, "sources")
    _source_lines(spark, sf).write.text(folder)
    return readers.read_source_list(spark, folder, "text", distinct=False)


@query
def read_term_lists(spark, sf):
    """Term lists from a settings file, one of them replaced, with the documents that each term occurs in."""
    folder = new_folder(spark, "settings")
    kept = {n: getattr(PROFILE, n) for n in ("companies", "tools", "deployment_terms")} | {"major_platforms": p.MAJOR_PLATFORMS}
    lists = [F.array(*map(F.lit, terms)).alias(n) for n, terms in kept.items()]
    spark.range(1).select(F.struct(*lists, F.array(F.lit("replaced")).alias("retail_terms")).alias("evaluation")).write.json(folder)
    terms = readers.read_term_lists(spark, folder, overrides={"retail_terms": PROFILE.retail_terms})
    found = joins.match_term_table(articles(spark, sf), terms.select("term"))
    return terms.join(found, "term").groupBy("list_name", "pos", "term").agg(F.count("id").alias("articles"))


@query
def read_pages(spark, sf):
    return readers.read_pages(spark, f"{sf.rstrip('/')}/pages.parquet").select(
        "page_id", "url", F.md5("html").alias("html_key")
    )


@query
def read_atom_feed(spark, sf):
    folder = new_folder(spark, "feed")
    published = F.when(F.col("source") == "src3", F.lit("soon")).otherwise(F.concat("date", F.lit("T08:00:00Z")))
    entries = articles(spark, sf).select(
        F.concat(F.lit(" "), "title", F.lit(" ")).alias("title"),
        F.col("url").alias("id"),
        published.alias("published"),
        text.collapse_spaces(F.col("content")).alias("summary"),
    )
    entries.write.xml(folder, rowTag="entry", rootTag='feed xmlns="http://www.w3.org/2005/Atom"')
    return readers.read_atom_feed(spark, folder, CUTOFF).withColumn(
        "published_date", dates.format_date(F.col("published_date"))
    )


@query
def read_search_results(spark, sf):
    sentence_list = takeaways.sentences(text.collapse_spaces(F.col("content")))
    dumps = articles(spark, sf).select(
        F.col("id").cast("int").alias("pos"),
        "url",
        F.col("url").alias("keyword"),
        F.transform(
            sentence_list,
            lambda s: F.struct(
                s.alias("title"),
                F.concat("url", F.lit("#"), F.length(s)).alias("link"),
                F.when(F.col("lang") != "de", F.col("source")).alias("source"),
                F.col("date").alias("date"),
            ),
        ).alias("news_results"),
    )
    folder = new_folder(spark, "search")
    dumps.drop("url").write.json(folder)
    found = readers.read_search_results(spark, folder, CUTOFF)
    return found.withColumn("published_date", dates.format_date(F.col("published_date")))


@query
def read_framework(spark, sf):
    """Framework files, each with two sections for each of its documents."""
    folder = new_folder(spark, "frameworks")
    value = F.concat(
        F.lit("1. "), "title", F.lit("\n- "),
        F.replace(text.collapse_spaces(F.col("content")), F.lit(". "), F.lit("\n- ")),
        F.lit("\n2. "), "source", F.lit("\n"), "lang",
    )
    articles(spark, sf).select(value.alias("value")).write.text(folder)
    return readers.read_framework(spark, folder)


def _store_rows(spark, sf):
    rows = articles(spark, sf).withColumn("summary", F.col("takeaway"))
    stamped = rows.withColumn("created_at", F.col("date").cast("timestamp"))
    return store.to_store_rows(stamped, F.col("created_at"), "id")


@query
def load_store(spark, sf):
    folder = new_folder(spark, "store")
    store.save_store(_store_rows(spark, sf).drop("seq"), folder)
    loaded = ranking.number_rows(store.load_store(spark, folder))
    return loaded.withColumn("created_at", dates.format_date(F.col("created_at")))


# --- sinks -----------------------------------------------------------------------------------------------------


@query
def csv_report(spark, sf):
    return reports.csv_report(categorized(spark, sf))


@query
def write_csv_report(spark, sf):
    folder = new_folder(spark, "report")
    reports.write_csv_report(categorized(spark, sf), folder)
    back = spark.read.csv(
        folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in back.columns])


@query
def sheet_report(spark, sf):
    return reports.sheet_report(categorized(spark, sf))


@query
def column_width_profile(spark, sf):
    return reports.column_width_profile(reports.sheet_report(categorized(spark, sf)))


@query
def detail_report(spark, sf):
    return reports.detail_report(categorized(spark, sf)).withColumn("criteria", F.array_join("criteria", " / "))


@query
def write_report_set(spark, sf):
    folder = new_folder(spark, "reports")
    ranked = stage(categorized(spark, sf).drop("content"))
    reports.write_report_set(ranked.where(F.col("assessment") == "CUT"), folder, AS_OF)
    reports.write_report_set(ranked, folder, AS_OF)
    return spark.read.parquet(folder).withColumn("report_date", F.col("report_date").cast("string"))


@query
def upsert_store(spark, sf):
    existing = _store_rows(spark, sf)
    # the same addresses again, a day later and without content, for the labelled documents
    again = articles(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    incoming = store.to_store_rows(
        again.drop("content").withColumn("created_at", F.date_add(F.col("date").cast("date"), 1).cast("timestamp")),
        F.col("created_at"),
        "id",
    )
    kept = store.BucketedStore(spark, new_folder(spark, "store"))
    kept.upsert(existing)
    kept.upsert(incoming)
    merged = kept.read()
    return merged.withColumn("created_at", dates.format_date(F.col("created_at"))).drop("seq")


@query
def evolve_schema(spark, sf):
    return store.evolve_schema(
        articles(spark, sf).select("id", "url", "title"), {"title": "string", "category": "string", "score": "int"}
    )


# --- extraction ------------------------------------------------------------------------------------------------


@query
def extract_links(spark, sf):
    return extract.extract_links(pages(spark, sf))


@query
def resolve_links(spark, sf):
    return links(spark, sf).select("page_id", "pos", "url")


@query
def normalize_source_urls(spark, sf):
    bare = pages(spark, sf).select("page_id", F.regexp_replace("url", "^http://", "").alias("url"))
    return extract.normalize_source_urls(bare)


@query
def source_domains(spark, sf):
    return extract.source_domains(pages(spark, sf).select("page_id", "url"))


@query
def clean_titles(spark, sf):
    return extract.clean_titles(extract.extract_links(listing_pages(spark, sf))).select("page_id", "pos", "title")


@query
def extract_page_metadata(spark, sf):
    return extract.extract_page_metadata(listing_pages(spark, sf), AS_OF)


@query
def extract_main_text(spark, sf):
    return extract.extract_main_text(pages(spark, sf)).select("page_id", "content")


@query
def extract_main_text_glued(spark, sf):
    return extract.extract_main_text(pages(spark, sf), joiner="").select("page_id", "content")


def _uncontained(df: DataFrame) -> DataFrame:
    """Pages whose text stands in no container, between a menu and a list of further articles."""
    menu = '<ul><li><a href="/">Home page</a></li><li><a href="/all">All the news of today</a> more</li></ul>'
    more = '<div><a href="/1">Read this next if you like it</a></div><p>Imprint and terms</p>'
    bare = F.regexp_replace("html", "</?(article|body|html|main)>", "")
    return df.withColumn("html", F.concat(F.lit(menu), bare, F.lit(more)))


@query
def extract_dense_text(spark, sf):
    return extract.extract_dense_text(_uncontained(pages(spark, sf))).select("page_id", "content")


@query
def normalize_content(spark, sf):
    return extract.normalize_content(articles(spark, sf)).select("id", "content")


@query
def strip_url_artifacts(spark, sf):
    wrapped = articles(spark, sf).select(
        "id",
        F.when(
            F.col("lang") == "en",
            F.concat(F.lit("file:///tmp/a%20b/"), "url", F.lit("?t="), F.replace("title", F.lit(" "), F.lit("%20"))),
        )
        .otherwise(F.concat("url", F.lit("?q=a+b%2Fc&t="), F.replace("title", F.lit(" "), F.lit("%20"))))
        .alias("url"),
    )
    return extract.strip_url_artifacts(wrapped)


# --- filters ---------------------------------------------------------------------------------------------------


@query
def filter_topic_titles(spark, sf):
    return filters.filter_topic_titles(articles(spark, sf), PROFILE.topic_patterns).select("id", "title")


@query
def filter_specific_articles(spark, sf):
    directories = (
        F.when(F.col("lang") == "en", F.concat(F.lit("/Tag/"), "source", F.lit("/")))
        .when(F.col("lang") == "de", F.concat(F.lit("/topics/"), "source"))
        .when(F.col("lang") == "fr", F.concat(F.lit("/about-"), "source"))
        .otherwise(F.concat(F.lit("/category/x/"), "id"))
    )
    named = articles(spark, sf).withColumn("url", F.concat(F.lit("https://a.example.com"), directories))
    return filters.filter_specific_articles(named).select("id", "url", "title")


@query
def filter_consent_pages(spark, sf):
    return filters.filter_consent_pages(articles(spark, sf), phrases=PROFILE.consent_phrases).select(
        "id", "is_consent_page"
    )


def _requested(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def filter_recent(spark, sf):
    return filters.filter_recent(_requested(spark, sf), CUTOFF, "ts").select("event_id", "user_id")


@query
def filter_recent_inclusive(spark, sf):
    dated = articles(spark, sf).withColumn("published_date", dates.parse_date(F.col("date")))
    return filters.filter_recent(dated, CUTOFF, "published_date", inclusive=True).select("id", "date")


@query
def filter_recent_days(spark, sf):
    odd = articles(spark, sf).withColumn("date", F.when(F.col("lang") == "de", "bad-date").otherwise(F.col("date")))
    return filters.filter_recent_days(odd, CUTOFF).select("id", "date")


@query
def filter_with_content(spark, sf):
    emptied = articles(spark, sf).withColumn(
        "content", F.when(F.col("lang") == "de", "").when(F.col("lang") == "en", F.col("content"))
    )
    return filters.filter_with_content(emptied).select("id")


@query
def filter_relevant(spark, sf):
    scored = scoring.score_relevance(articles(spark, sf), PROFILE)
    return filters.filter_relevant(scored).select("id", "ai_confidence")


@query
def drop_failed_takeaways(spark, sf):
    failed = articles(spark, sf).withColumn(
        "takeaway",
        F.when(F.length("content") < 300, p.FAILED_TAKEAWAYS[0])
        .when(F.col("lang") == "de", p.FAILED_TAKEAWAYS[4])
        .otherwise(F.col("takeaway")),
    )
    return filters.drop_failed_takeaways(failed).select("id", "takeaway")


@query
def filter_unprocessed(spark, sf):
    processed = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return filters.filter_unprocessed(articles(spark, sf), processed, "id").select("id", "url")


# --- joins -----------------------------------------------------------------------------------------------------


@query
def join_metadata(spark, sf):
    listed = listing_pages(spark, sf)
    found = extract.resolve_links(extract.extract_links(listed))
    joined = joins.join_metadata(found, extract.extract_page_metadata(listed, AS_OF))
    return joined.select("page_id", "url", "title", "page_title", "date")


@query
def join_content(spark, sf):
    every = articles(spark, sf)
    partly = every.withColumn("content", F.when(F.col("lang") == "en", F.col("content")).otherwise(""))
    texts = every.where(F.col("lang") != "fr").select("url", F.col("title").alias("content"))
    return joins.join_content(partly, texts).select("id", "content")


@query
def exclude_seen(spark, sf):
    """Documents whose text is not among the benchmark passages or the conversation turns."""
    keyed = articles(spark, sf).select("id", requests.fingerprint(F.col("content")).alias("url"))
    seen = table(spark, sf, "benchmark").select(F.md5("text").alias("url")).unionByName(
        table(spark, sf, "conversations").select(F.md5("text").alias("url"))
    )
    return joins.exclude_seen(keyed, seen).select("id")


@query
def match_terms(spark, sf):
    return joins.match_terms(articles(spark, sf), PROFILE.retail_terms + PROFILE.tools)


@query
def match_words(spark, sf):
    return joins.match_terms(articles(spark, sf), PROFILE.companies + PROFILE.tools, whole_word=True)


@query
def match_term_table(spark, sf):
    """Which part names' words and benchmark passages occur in which documents."""
    return joins.match_term_table(articles(spark, sf), _terms(spark, sf)).select("id", F.md5("term").alias("term_key"))


@query
def word_index(spark, sf):
    """The same from an index that is built in two batches."""
    index = WordIndex(spark, new_folder(spark, "index"))
    every = articles(spark, sf).select("id", "content", "lang")
    index.add(0, every.where(F.col("lang") == "en"))
    index.add(1, every.where(~F.col("lang").eqNullSafe("en")))
    return index.search(_terms(spark, sf)).select("id", F.md5("term").alias("term_key"))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    passages = table(spark, sf, "benchmark").select(F.col("text").alias("term"))
    sentences = table(spark, sf, "benchmark").select(
        F.explode(takeaways.sentences(text.collapse_spaces(F.col("text")))).alias("term")
    )
    return words.unionByName(passages).unionByName(sentences)


@query
def join_responses(spark, sf):
    asked = requests.build_requests(articles(spark, sf), "takeaway", PROFILE)
    answered = raw_responses(spark, sf).select(
        requests.fingerprint(F.col("content")).alias("content_key"),
        F.md5(F.lit(PROFILE.rubric)).alias("rubric_key"),
        F.when(F.col("source") != "src7", F.col("raw")).alias("raw"),
    )
    return joins.join_responses(asked, answered).select("id", F.md5("raw").alias("raw_key"))


def _centroids(vectors: DataFrame) -> DataFrame:
    """The mean vector of every label."""
    cells = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("criterion")
    )


@query
def similarity_score(spark, sf):
    vectors = table(spark, sf, "embeddings")
    paired = vectors.join(stage(_centroids(vectors)), "label")
    return scoring.similarity_score(paired, "embedding", "criterion").select("vec_id", "similarity")


@query
def best_criteria(spark, sf):
    vectors = table(spark, sf, "embeddings")
    criteria = _centroids(vectors).select(F.col("label").cast("long").alias("criterion_no"), "criterion")
    return joins.best_criteria(vectors, stage(criteria), 3, "vec_id")


@query
def fresh_responses(spark, sf):
    """Answers given on the articles' days, of which those of the last ten days hold."""
    asked = requests.build_requests(articles(spark, sf), "takeaway", PROFILE)
    answered = raw_responses(spark, sf).join(articles(spark, sf).select("id", "date"), "id").select(
        requests.fingerprint(F.col("content")).alias("content_key"),
        F.md5(F.lit(PROFILE.rubric)).alias("rubric_key"),
        "raw",
        F.col("date").cast("timestamp").alias("answered_at"),
    )
    fresh = joins.fresh_responses(asked, answered, AS_OF, TTL_SECONDS)
    return fresh.select("id", F.md5("raw").alias("raw_key"))


@query
def distinct_requests(spark, sf):
    """One request for each text that no document of one source has, whose answers are there already."""
    asked = requests.build_requests(articles(spark, sf), "takeaway", PROFILE)
    stored = requests.build_requests(articles(spark, sf).where(F.col("source") == "src1"), "takeaway", PROFILE)
    return answers.distinct_requests(asked, stored).select("id", "content_key", F.md5("prompt").alias("prompt_key"))


@query
def fan_out(spark, sf):
    """Answers to the distinct requests, given back to all documents; texts with over 20 copies are dealt into parts."""
    asked = requests.build_requests(articles(spark, sf), "takeaway", PROFILE).select("id", *answers.KEYS)
    given = answers.distinct_requests(asked).select(*answers.KEYS, F.concat(F.lit("answer to "), "id").alias("raw"))
    return answers.fan_out(asked, given, rows_per_part=20).select("id", "raw")


@query
def asof_responses(spark, sf):
    """Each event asks for what its user bought last, within two days."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rubric = F.md5(F.lit(PROFILE.rubric)).alias("rubric_key")
    user = F.md5(F.col("user_id").cast("string")).alias("content_key")
    asked = events.where(F.col("event_type") != "purchase").select(F.col("event_id").alias("id"), user, rubric, F.col("ts").alias("asked_at"))
    bought = events.where(F.col("event_type") == "purchase").select(
        user, rubric, F.col("ts").alias("answered_at"), F.concat("event_id", F.lit(" "), "props").alias("raw")
    )
    return answers.asof_responses(asked, bought, 2 * 86400).select("id", "raw")


def _keywords(spark, sf):
    """Words the part names are made of, in order of first use."""
    words = table(spark, sf, "conversations").where(F.col("turn") == 0).select(
        F.col("conv_id").alias("pos"), F.lower(F.regexp_extract("text", r"^[^\s.,!?]+", 0)).alias("keyword")
    )
    first = words.where(F.length("keyword") > 3).groupBy("keyword").agg(F.min("pos").alias("pos"))
    return first.select("pos", "keyword")


@query
def keyword_hits(spark, sf):
    return joins.keyword_hits(_keywords(spark, sf), articles(spark, sf), column="content").select(
        "pos", "keyword", "id"
    )


# --- aggregates ------------------------------------------------------------------------------------------------


@query
def source_scan_summary(spark, sf):
    every = articles(spark, sf)
    sources = every.select(F.concat("source", F.lit("/"), "lang").alias("url"))
    fetched = every.where(F.col("lang") != "de").select(F.concat("source", F.lit("/"), "lang").alias("url"))
    found = filters.filter_topic_titles(every, PROFILE.topic_patterns).select(
        F.concat("source", F.lit("/"), "lang").alias("source")
    )
    return aggregates.source_scan_summary(sources, fetched, found)


@query
def funnel_counts(spark, sf):
    scored = scoring.score_relevance(articles(spark, sf), PROFILE)
    partly = scored.withColumn("content", F.when(F.col("lang") != "de", F.col("content")))
    return aggregates.funnel_counts(partly)


@query
def criteria_score(spark, sf):
    return scoring.criteria_score(evaluated(spark, sf)).select("id", "criteria_met")


@query
def term_counts(spark, sf):
    return scoring.term_counts(articles(spark, sf), PROFILE.content_terms).select("id", "term_count")


@query
def combine_takeaways(spark, sf):
    every = articles(spark, sf).select("id")
    silent = turns(spark, sf).withColumn("takeaway", F.when(F.length("takeaway") > 40, F.col("takeaway")))
    return takeaways.combine_takeaways(silent, every)


@query
def content_fingerprints(spark, sf):
    return aggregates.content_fingerprints(extract.normalize_content(articles(spark, sf)))


@query
def unique_source_count(spark, sf):
    return aggregates.unique_source_count(pages(spark, sf).select(urls.domain(F.col("url")).alias("url")))


# --- order -----------------------------------------------------------------------------------------------------


@query
def dedup_urls(spark, sf):
    return ranking.dedup_urls(links(spark, sf)).select("url", "page_id", "pos")


@query
def dedup_titles(spark, sf):
    return ranking.dedup_titles(articles(spark, sf).select("id", "title"), ["id"])


@query
def batch_sources(spark, sf):
    listed = readers.distinct_in_order(
        pages(spark, sf).select("page_id", F.col("url").alias("url")), ["page_id"]
    )
    return ranking.batch_sources(listed).withColumn("progress", F.round("progress", 9))


@query
def rank_report(spark, sf):
    return ranking.rank_report(evaluated(spark, sf).select("id", "url", "assessment", "assessment_score"))


@query
def chunk_articles(spark, sf):
    return chunking.chunk_articles(articles(spark, sf), CHUNK_TOKENS)


@query
def sort_by_assessment(spark, sf):
    judged = evaluated(spark, sf).select("id", "url", "assessment", "assessment_score")
    return ranking.number_rows(ranking.sort_by_assessment(judged)).drop("url")


def _ranked_relevance(spark, sf):
    scored = scoring.score_relevance(evaluated(spark, sf), PROFILE)
    return scoring.report_relevance(scored, AS_OF)


@query
def select_top_articles(spark, sf):
    best = ranking.select_top_articles(_ranked_relevance(spark, sf), AS_OF, 10, ("id",))
    return best.select("id", "date", "assessment", F.round("relevance_score", 6).alias("relevance_score"))


@query
def newest_first(spark, sf):
    return ranking.number_rows(ranking.newest_first(articles(spark, sf).select("id", "date"), "date", ("id",)))


@query
def top_keywords(spark, sf):
    return ranking.top_keywords(_keywords(spark, sf))


@query
def union_batches(spark, sf):
    every = articles(spark, sf).select("id", "title", "lang")
    return ranking.union_batches(
        every.where(F.col("lang") == "en").drop("lang"), every, every.select("id", F.lit("x").alias("takeaway"))
    )


# --- scoring ---------------------------------------------------------------------------------------------------


@query
def evaluate_articles(spark, sf):
    judged = evaluated(spark, sf)
    status = [F.col("criteria_results")[i]["status"].alias(f"c{i + 1}") for i in range(7)]
    return judged.select("id", "assessment", "assessment_score", *status)


@query
def find_entities(spark, sf):
    return scoring.find_entities(articles(spark, sf), PROFILE).select("id", "entity")


@query
def find_tools(spark, sf):
    return scoring.find_tools(articles(spark, sf), PROFILE).select("id", "tool")


@query
def explode_criteria(spark, sf):
    return scoring.explode_criteria(evaluated(spark, sf))


@query
def score_relevance(spark, sf):
    return scoring.score_relevance(articles(spark, sf), PROFILE).select("id", "ai_confidence", "ai_validation")


@query
def label_relevance(spark, sf):
    logged = articles(spark, sf).withColumn(
        "_source_log", F.concat(F.when(F.col("lang") == "fr", "Found potential AI article: ").otherwise(""), "url")
    )
    return scoring.label_relevance(logged, PROFILE, "_source_log").select("id", "is_relevant", "reason")


@query
def report_relevance(spark, sf):
    return _ranked_relevance(spark, sf).select("id", F.round("relevance_score", 6).alias("relevance_score"))


@query
def categorize_by_terms(spark, sf):
    return scoring.categorize_by_terms(articles(spark, sf), PROFILE).select(
        "id", "category_no", "category", "category_justification"
    )


@query
def extractive_takeaways(spark, sf):
    return takeaways.extractive_takeaways(articles(spark, sf), PROFILE).select("id", "takeaway")


# --- takeaway quality and responses ----------------------------------------------------------------------------


def _validated(spark, sf):
    shortened = takeaways.extractive_takeaways(articles(spark, sf), PROFILE)
    return takeaways.validate_takeaways(shortened.select("id", "takeaway"))


@query
def validate_takeaways(spark, sf):
    marked = turns(spark, sf).withColumn(
        "takeaway",
        F.when(F.col("id") % 5 == 0, F.concat("takeaway", F.lit(" • one")))
        .when(F.col("id") % 7 == 0, F.concat("takeaway", F.lit(" so that AI leaders can act.")))
        .otherwise(F.col("takeaway")),
    )
    judged = takeaways.validate_takeaways(marked)
    return judged.select(
        "id", "chunk_no", "word_count", "sentence_count", "passes_validation",
        F.array_join("issues_found", " | ").alias("issues"),
    )


@query
def merge_verdicts(spark, sf):
    merged = takeaways.merge_verdicts(_validated(spark, sf), verdicts(spark, sf))
    return merged.select("id", "passes_validation", F.array_join("issues_found", " | ").alias("issues"))


@query
def audience_check(spark, sf):
    checked = takeaways.audience_check(articles(spark, sf), verdicts(spark, sf))
    return checked.select("id", "passes_check", F.array_join("check_issues", " | ").alias("issues"))


@query
def refinement_instructions(spark, sf):
    merged = takeaways.merge_verdicts(_validated(spark, sf), verdicts(spark, sf))
    return takeaways.refinement_instructions(merged).select("id", "refinement")


@query
def parse_takeaway_responses(spark, sf):
    return responses.parse_takeaway_responses(raw_responses(spark, sf)).select("id", "takeaway")


@query
def parse_category_responses(spark, sf):
    raw = raw_responses(spark, sf, "category", ', "justification": "as told"').withColumn(
        "raw",
        F.when(F.col("source") == "src8", F.lit('{"category": 5, "justification": null}'))
        .when(F.col("source") == "src9", F.concat(F.lit('{"category": "a", "category": "'), "id", F.lit('", "justification": "b"}')))
        .otherwise(F.col("raw")),
    )
    return responses.parse_category_responses(raw).select("id", "category", "category_justification")


@query
def parse_takeaway_fallback(spark, sf):
    """What cannot be read is replaced by a text of the caller's."""
    raw = raw_responses(spark, sf).withColumn("joined", F.concat(F.lit("joined "), "id"))
    return responses.parse_takeaway_responses(raw, fallback="joined").select("id", "takeaway")


@query
def parse_keyword_responses(spark, sf):
    words = F.split(text.collapse_spaces(F.regexp_replace("content", r'["\\]', " ")), " ")
    listed = F.concat(F.lit('["'), F.array_join(words, '", "'), F.lit('"]'))
    raw = (
        F.when(F.col("lang") == "de", F.concat(F.lit('{"keywords": '), listed))
        .when(F.col("lang") == "fr", F.concat(F.lit('{"terms": '), listed, F.lit("}")))
        .otherwise(F.concat(F.lit('{"keywords": '), listed, F.lit("}")))
    )
    parsed = responses.parse_keyword_responses(articles(spark, sf).select("id", raw.alias("raw")))
    return parsed.select("id", F.array_join("keywords", "|").alias("keywords"))


def _request_query(kind: str) -> Query:
    def run(spark, sf):
        instructed = articles(spark, sf).withColumn("refinement", F.concat(F.lit("Shorten "), "title"))
        criteria = F.col("content") if kind == "keywords" else "New tools in use"
        return requests.build_requests(
            instructed, kind, PROFILE, framework="1. Creative\n2. Other", criteria=criteria
        )

    run.__name__ = f"request_{kind}"
    return run


for _kind in requests.TEMPLATES:
    query(_request_query(_kind))


@query
def short_content_guard(spark, sf):
    return takeaways.short_content_guard(turns(spark, sf).withColumn("content", F.col("takeaway"))).select(
        "id", "chunk_no", "takeaway"
    )


@query
def clean_takeaways(spark, sf):
    """Document texts with figures spaced apart, as models return them."""
    spaced = articles(spark, sf).select(
        "id",
        F.concat("content", F.lit(" $ "), "id", F.lit(" . 5 and 1"), "id", F.lit(" 200 000 , 7x ! "), "url").alias(
            "takeaway"
        ),
    )
    return takeaways.clean_takeaways(spaced)


@query
def date_functions(spark, sf):
    shapes = (
        F.when(F.col("lang") == "en", F.col("date"))
        .when(F.col("lang") == "de", F.concat("date", F.lit(" 10:20:30")))
        .when(F.col("lang") == "fr", F.concat("date", F.lit("T10:20:30+02:00")))
        .when(F.col("source") == "src3", F.lit("2024"))
        .otherwise(F.concat("date", F.lit("T10:20:30Z")))
    )
    parsed = dates.parse_date(shapes)
    as_of = F.lit(AS_OF).cast("timestamp")
    days = dates.lookback_days(F.lit(2), F.when(F.col("lang") == "en", "Weeks").otherwise("days"))
    return articles(spark, sf).select(
        "id",
        F.unix_seconds(parsed).alias("seconds"),
        dates.format_date(dates.parse_date_or(shapes, as_of)).alias("day"),
        dates.format_date(dates.cutoff(as_of, days)).alias("cutoff"),
    )


# --- streams -----------------------------------------------------------------------------------------------------


def _event_stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf.rstrip('/')}/events*.parquet")


def _page_stream(spark, sf):
    # a pattern, because a stream's path may not be a single file
    return jobs.read_page_stream(spark, f"{sf.rstrip('/')}/pages*.parquet")


@query
def stream_scan(spark, sf):
    """The scan over pages as they arrive, articles evaluated and kept batch by batch."""
    listed = listing_pages(spark, sf)
    texts = stage(extract.extract_main_text(listed).select("url", "content"), "texts")
    metadata = stage(extract.extract_page_metadata(listed, AS_OF).select("url", "title", "date"), "metadata")
    log, checkpoint = runs.scan_log(spark, new_folder(spark, "scan")), new_folder(spark, "scan-progress")
    found = runs.run_stream_scan(
        _page_stream(spark, sf), metadata, texts, log, checkpoint, CUTOFF, PROFILE, as_listing
    )
    return found.select("url", "title", "date", "source", "assessment", "assessment_score", "category")


@query
def stream_join_metadata(spark, sf):
    """Links and descriptions of pages as two streams that meet within the look-back."""
    folder, checkpoint = new_folder(spark, "joined"), new_folder(spark, "joined-progress")
    arriving = as_listing(_page_stream(spark, sf))
    found = extract.resolve_links(extract.extract_links(arriving)).withColumn("ts", day_of(F.col("page_id")).cast("timestamp"))
    described = extract.extract_page_metadata(arriving, AS_OF).withColumn("ts", F.col("date").cast("timestamp"))
    jobs.run_to_folder(jobs.stream_join_metadata(found, described, lookback="31 days"), folder, checkpoint)
    return jobs.settle_metadata(spark.read.parquet(folder)).select("page_id", "pos", "url", "page_title", "date")


@query
def stream_dedup_urls(spark, sf):
    folder, checkpoint = new_folder(spark, "urls"), new_folder(spark, "urls-progress")
    found = extract.resolve_links(extract.extract_links(_page_stream(spark, sf)))
    dated = found.withColumn("ts", day_of(F.col("page_id")).cast("timestamp"))
    jobs.run_to_folder(jobs.stream_dedup_urls(dated, lookback="31 days").select("url"), folder, checkpoint)
    return spark.read.parquet(folder)


@query
def stream_recent(spark, sf):
    folder, checkpoint = new_folder(spark, "recent"), new_folder(spark, "recent-progress")
    arriving = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.run_to_folder(jobs.stream_recent(arriving, CUTOFF).select("event_id", "user_id"), folder, checkpoint)
    return spark.read.parquet(folder)


# --- end-to-end runs -------------------------------------------------------------------------------------------


@query
def scan_articles(spark, sf):
    listed = listing_pages(spark, sf)
    texts = extract.extract_main_text(listed).select("url", "content")
    metadata = extract.extract_page_metadata(listed, AS_OF)
    result = runs.run_scan(listed, metadata, texts, None, CUTOFF, PROFILE)
    return result.select("url", "title", "date", "source", "assessment", "assessment_score", "category")


@query
def scan_store(spark, sf):
    """The scan with takeaways, put into a store that holds every other page already."""
    listed = listing_pages(spark, sf)
    texts = stage(extract.extract_main_text(listed).select("url", "content"))
    metadata = extract.extract_page_metadata(listed, AS_OF)
    given = texts.select("url", F.substring("content", 1, 60).alias("takeaway"))
    scanned = runs.run_scan(listed, metadata, texts, given, CUTOFF, PROFILE)
    old = pages(spark, sf).where(F.col("page_id") % 2 == 0).select("url", F.lit("Old").alias("title")).distinct()
    existing = store.to_store_rows(old, CUTOFF)
    merged = runs.store_scan(scanned, existing, AS_OF, new_folder(spark, "reports"))
    return merged.select(
        "url", "title", "date", "summary", "category", dates.format_date(F.col("created_at")).alias("created_at")
    )


def _answer(content: Column) -> Column:
    return F.concat(F.lit('{"takeaway": "'), escaped(content), F.lit('"}'))


@query
def takeaway_run(spark, sf):
    """Chunked requests whose answers repeat their chunk or are missing, with audience checks, rewritten forms, verdicts
    and refined forms for some of them."""
    every = articles(spark, sf)
    rubric = F.md5(F.lit(PROFILE.rubric)).alias("rubric_key")
    chunk = chunking.chunk_articles(every, CHUNK_TOKENS).select(F.col("chunk").alias("c"), F.length("chunk").alias("n"))
    key = requests.fingerprint(F.col("c"))
    answered = chunk.where("n % 5 <> 0").select(key.alias("content_key"), rubric, _answer(F.col("c")).alias("raw"))
    checks = chunk.select(
        key.alias("takeaway_key"), (F.col("n") % 3 != 0).alias("passes"), F.array().cast("array<string>").alias("issues")
    )
    rewritten = chunk.where("n % 2 = 0").select(
        key.alias("content_key"), rubric, F.concat(F.lit(" Rewritten: "), "c").alias("raw")
    )
    refined = chunk.where("n % 7 < 5").select(
        key.alias("content_key"), rubric, _answer(F.concat(F.lit("Refined: "), "c")).alias("raw")
    )
    result = runs.run_takeaways(
        every, answered, verdicts(spark, sf), refined, checks, rewritten, PROFILE, CHUNK_TOKENS
    )
    return result.select(
        "id", F.md5("takeaway").alias("takeaway_key"), "passes_validation", "rewritten", "refined", "passes_check",
        F.array_join("issues_found", " | ").alias("issues"),
    )


@query
def workflow_selected(spark, sf):
    every = articles(spark, sf)
    result = runs.run_workflow(
        every.withColumn("content", F.when(F.col("lang") != "en", F.col("content"))),
        every.select("url", "content"),
        AS_OF,
        PROFILE,
        ("id",),
    )
    return result.selected.select("id", "assessment", "assessment_score", "ai_confidence")


@query
def workflow_funnel(spark, sf):
    every = articles(spark, sf)
    emptied = every.withColumn("content", F.when(F.col("lang") != "en", F.col("content")))
    texts = every.where(F.col("source") != "src2").select("url", "content")
    return runs.run_workflow(emptied, texts, AS_OF, PROFILE).funnel


@query
def search_articles(spark, sf):
    dated = articles(spark, sf).withColumn("published_date", dates.parse_date(F.col("date")))
    result = runs.run_search(_keywords(spark, sf), dated, CUTOFF, PROFILE)
    return result.select("pos", "keyword", "id", "date", "reason", "ai_confidence")
