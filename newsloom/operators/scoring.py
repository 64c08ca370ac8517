"""Scoring and classification. Every scorer is one projection over whole texts: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.functions import dates, text
from newsloom.functions.rows import compute_once
from newsloom.profile import Profile

# First run of one to four capitalised words, when no listed company is named.
CAPITALISED = r"(?U)\b([A-Z][A-Za-z&]+(?:\s+[A-Z][A-Za-z&]+){0,3})\b"

# Criterion label, note when met, note when not met. Notes 1 and 2 start with found names.
CRITERIA = (
    ("Specific companies using AI tools", " using ", "No specific company/tool usage identified"),
    ("Tool is third-party Gen AI", " is an external, open-source model", "Using internal/proprietary solution"),
    ("Measurable ROI / Business impact", "Clear metrics tied to business outcomes",
     "No quantifiable business metrics provided"),
    ("Relevance to retail priorities", "Directly relates to retail/e-commerce operations",
     "Not tied to e-commerce, personalization, or retail"),
    ("Neutral tone", "Focuses on reporting rather than promotion", "Contains promotional language"),
    ("Not customer-service or visionary fluff", "Descriptive of actual deployment",
     "Focuses on future possibilities/customer service"),
    ("OpenAI / Microsoft / Google release impact", "Major platform update with retail angle",
     "No significant retail platform impact"),
)


def _full_text() -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "content", "takeaway")]
    return F.concat_ws(" ", *parts)


def entity(c: Column, companies: Sequence[str]) -> Column:
    fallback = text.null_if_empty(F.regexp_extract(c, CAPITALISED, 1))
    return F.coalesce(text.first_word_match(c, companies), fallback)


def tool(c: Column, profile: Profile) -> Column:
    generic = F.when(c.rlike(f"(?iU){profile.generic_tool_pattern}"), F.lit(profile.generic_tool_name))
    return F.coalesce(text.first_word_match(c, profile.tools), generic)


def find_entities(df: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Adds ``entity``: the first listed company named, else the first capitalised name."""
    named = df.withColumn("_text", _full_text())
    return compute_once(named, {"entity": entity(F.col("_text"), profile.companies)}).drop("_text")


def find_tools(df: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Adds ``tool``: the first listed tool named, else the generic one if a generic phrase occurs."""
    named = df.withColumn("_text", _full_text())
    return compute_once(named, {"tool": tool(F.col("_text"), profile)}).drop("_text")


def with_criteria(df: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Adds ``entity``, ``tool`` and the seven booleans ``c1`` to ``c7``."""
    found = df.withColumn("_text", _full_text()).withColumn("_low", F.lower("_text"))
    low = F.col("_low")
    found = compute_once(
        found, {"entity": entity(F.col("_text"), profile.companies), "tool": tool(F.col("_text"), profile)}
    )
    has_tool = F.col("tool").isNotNull()
    return compute_once(
        found,
        {
            "c1": F.col("entity").isNotNull() & has_tool,
            "c2": has_tool & ~text.matches(low, profile.in_house_pattern),
            "c3": text.contains_any(low, profile.metric_words) & text.matches(low, profile.roi_pattern),
            "c4": text.contains_any(low, profile.retail_terms),
            "c5": ~text.matches(low, profile.promotional_pattern),
            "c6": text.contains_any(low, profile.deployment_terms),
            "c7": text.contains_any(low, profile.major_platforms) & text.matches(low, profile.commerce_pattern),
        },
    ).drop("_text", "_low")


def criteria_score(df: DataFrame) -> DataFrame:
    """Adds ``criteria_met``, the number of true criteria, from ``criteria_results``."""
    met = F.aggregate("criteria_results", F.lit(0), lambda n, c: n + c["status"].cast("int"))
    return df.withColumn("criteria_met", met)


def evaluate_articles(df: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Adds ``criteria_results``, ``assessment`` and ``assessment_score``.

    Five criteria and retail relevance make INCLUDE, three make OK, the rest is CUT. The score is the share of six
    criteria in per cent, so seven give 116.
    """
    results = []
    for i, (label, met, unmet) in enumerate(CRITERIA, start=1):
        note = F.lit(met)
        if i == 1:
            note = F.concat(F.col("entity"), note, F.col("tool"))
        elif i == 2:
            note = F.concat(F.col("tool"), note)
        status = F.col(f"c{i}")
        results.append(
            F.struct(
                F.lit(label).alias("criteria"),
                status.alias("status"),
                F.when(status, note).otherwise(F.lit(unmet)).alias("notes"),
            )
        )
    met_count = reduce(lambda a, b: a + b, [F.col(f"c{i}").cast("int") for i in range(1, 8)])
    judged = with_criteria(df, profile).withColumn("_met", met_count)
    return judged.withColumns(
        {
            "criteria_results": F.array(*results),
            "assessment": F.when((F.col("_met") >= 5) & F.col("c4"), "INCLUDE")
            .when((F.col("_met") >= 3) & F.col("c4"), "OK")
            .otherwise("CUT"),
            "assessment_score": F.floor(F.col("_met") * 100 / 6).cast("int"),
        }
    ).drop("_met", "entity", "tool", *[f"c{i}" for i in range(1, 8)])


def explode_criteria(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per article and criterion: label, status, mark and note."""
    # outer: an inner explode would repeat the evaluation in a filter on the array's size
    rows = df.select(key, F.posexplode_outer("criteria_results").alias("pos", "c"))
    return rows.select(
        key,
        (F.col("pos") + 1).alias("criterion_no"),
        F.col("c.criteria").alias("criteria"),
        F.col("c.status").alias("status"),
        F.when(F.col("c.status"), "✓").otherwise("✗").alias("mark"),
        F.col("c.notes").alias("notes"),
    )


def term_total(c: Column, terms: Sequence[str]) -> Column:
    """Occurrences of all terms together; overlapping terms both count."""
    return reduce(lambda a, b: a + b, [text.occurrences(c, t) for t in terms], F.lit(0))


def term_counts(
    df: DataFrame, terms: Sequence[str], column: str = "content", first_chars: int | None = None
) -> DataFrame:
    """Adds ``term_count`` over the lower-cased text; ``first_chars`` looks at a sample only."""
    c = F.coalesce(F.col(column), F.lit(""))
    sample = F.substring(c, 1, first_chars) if first_chars else c
    lowered = df.withColumn("_low", F.lower(sample))
    return compute_once(lowered, {"term_count": term_total(F.col("_low"), terms)}).drop("_low")


def score_relevance(df: DataFrame, profile: Profile = Profile(), first_chars: int | None = None) -> DataFrame:
    """Adds ``ai_confidence`` (0, 30, 40, 50, 70 or 80) and ``ai_validation``, the last rule that fired."""
    title, takeaway, content = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "takeaway", "content"))
    if first_chars:
        content = F.lower(F.substring(F.coalesce(F.col("content"), F.lit("")), 1, first_chars))
    lowered = df.withColumns({"_low": content, "_title": text.first_contained(title, profile.title_terms)})
    counted = F.when(F.col("_title").isNull(), term_total(F.col("_low"), profile.content_terms)).otherwise(0)
    scored = compute_once(
        lowered,
        {
            "_title": F.col("_title"),
            "_takeaway": text.first_contained(takeaway, profile.title_terms),
            "_count": counted,
        },
    )
    base = F.when(F.col("_title").isNotNull(), 50).when(F.col("_count") >= 5, 40).otherwise(0)
    bonus = F.when(F.col("_takeaway").isNotNull(), 30).otherwise(0)
    reason = F.coalesce(
        F.concat(F.lit("AI term '"), F.col("_takeaway"), F.lit("' found in article takeaway")),
        F.concat(F.lit("AI term '"), F.col("_title"), F.lit("' found in title")),
        F.when(
            F.col("_count") >= 5,
            F.concat(F.lit("Multiple AI references ("), F.col("_count"), F.lit(") found in content")),
        ),
        F.lit("Not explicitly about AI"),
    )
    return scored.withColumns({"ai_confidence": (base + bonus).cast("int"), "ai_validation": reason}).drop(
        "_title", "_takeaway", "_low", "_count"
    )


def label_relevance(df: DataFrame, profile: Profile = Profile(), log: str | None = None) -> DataFrame:
    """Adds ``is_relevant`` (always true) and ``reason``; ``log`` names a column with the scan's own note."""
    title = F.coalesce(F.col("title"), F.lit(""))
    noted = F.col(log).contains("Found potential AI article:") if log else F.lit(False)
    reason = (
        F.when(
            text.contains_any(F.lower(title), profile.direct_title_terms),
            F.concat(F.lit("Direct AI mention in title: "), title),
        )
        .when(noted, "Identified as potential AI article during initial scan")
        .otherwise("Passed initial AI content scan")
    )
    return df.withColumns({"is_relevant": F.lit(True), "reason": reason})


def report_relevance(df: DataFrame, as_of) -> DataFrame:
    """Adds ``relevance_score``: half confidence, 30 % recency (5 points a day), 20 % substance.

    A future date scores above 100 for recency; a missing date is 2000-01-01; an unreadable one has no recency.
    """
    day = dates.parse_day(F.coalesce(F.col("date"), F.lit("2000-01-01")))
    age = F.datediff(F.to_date(dates.as_timestamp(as_of)), day)
    recency = F.coalesce(F.greatest(F.lit(0), F.lit(100) - age * 5), F.lit(0))
    points = F.col("key_points") if "key_points" in df.columns else F.array()
    substance = F.when(F.length("takeaway") > 50, 50).otherwise(0) + F.when(
        F.coalesce(F.size(points), F.lit(0)) >= 3, 50
    ).otherwise(0)
    confidence = F.coalesce(F.col("ai_confidence"), F.lit(0)).cast("double")
    return df.withColumn(
        "relevance_score",
        confidence * F.lit(0.5) + recency * F.lit(0.3).cast("double") + substance * F.lit(0.2).cast("double"),
    )


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length of a vector."""
    return F.sqrt(_sum_of(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Cosine of two vectors, cut to the shorter one; null for a zero vector. ``norms`` is the product if it is known."""
    size = F.least(F.size(a), F.size(b))
    dot = _sum_of(
        F.zip_with(
            F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: x.cast("double") * y.cast("double")
        )
    )
    return F.try_divide(dot, norm(a) * norm(b) if norms is None else norms)


def similarity_points(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Cosine as 1 to 10 points, halves to even; anything that cannot be computed is 1."""
    points = F.coalesce(F.bround(cosine(a, b, norms) * 10).cast("int"), F.lit(1))
    return F.greatest(F.lit(1), F.least(F.lit(10), points))


def similarity_score(df: DataFrame, a: str, b: str) -> DataFrame:
    return compute_once(df, {"similarity": similarity_points(F.col(a), F.col(b))})


def categorize_by_terms(df: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Adds ``category_no``, ``category`` and ``category_justification``.

    Most keyword hits win, ties go to the lower number, nothing means 'Other Applications'. A competitor together
    with a topic term makes 'Competitor Updates'.
    """
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    judged = df.withColumn("_low", low)

    def hits(terms: Sequence[str]) -> Column:
        return F.array_compact(F.array(*[F.when(F.col("_low").contains(t), F.lit(t)) for t in terms]))

    def counted(no: int, terms: Sequence[str]) -> Column:
        return text.let(
            hits(terms),
            lambda found: F.struct(F.size(found).alias("n"), F.lit(-no).alias("order"), found.alias("terms")),
        )

    numbered = [counted(no, terms) for no, terms in profile.category_keywords]
    best = F.greatest(*numbered) if len(numbered) > 1 else numbered[0]
    rival = hits(profile.competitors)
    topical = text.contains_any(F.col("_low"), profile.title_terms)
    judged = compute_once(judged, {"_best": best, "_rival": rival, "_topical": topical})
    rivalry = (F.size("_rival") > 0) & F.col("_topical")
    number = (
        F.when(rivalry, p.COMPETITOR_CATEGORY)
        .when(F.col("_best.n") > 0, -F.col("_best.order"))
        .otherwise(p.OTHER_CATEGORY)
    )
    names = F.create_map(*[F.lit(x) for pair in p.CATEGORIES for x in pair])
    terms = F.when(rivalry, F.col("_rival")).otherwise(F.col("_best.terms"))
    why = F.when(F.size(terms) > 0, F.concat(F.lit("Matched terms: "), F.array_join(terms, ", "))).otherwise(
        "No category term found"
    )
    return (
        judged.withColumn("category_no", number)
        .withColumn("category", F.element_at(names, F.col("category_no")))
        .withColumn("category_justification", why)
        .drop("_low", "_best", "_rival", "_topical")
    )
