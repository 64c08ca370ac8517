"""Takeaway quality: rule checks, verdicts, clean-up, extraction and combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.functions import text
from newsloom.functions.rows import compute_once
from newsloom.profile import Profile

# The texts callers look for.
LIST_ISSUE = "Takeaway contains bullet points or list-like formatting."
AUDIENCE_ISSUE = "Takeaway overtly mentions 'AI leader', 'retail leader', or the target reader."
ALL_CLEAR = "Takeaway meets all primary criteria."
REFINE_INTRO = "Please address the following issues:\n"
REFINE_MORE = "Additionally, consider these qualitative improvements:\n"
CHECK_FAILED = "LLM check failed to return content."
TOO_SHORT = p.FAILED_TAKEAWAYS[0]
NOTHING_TO_COMBINE = "No content available to summarize."
NOTHING_MEANINGFUL = "Unable to extract meaningful content from the articles."


def _linear(pattern: str) -> str:
    """``head.*tail`` tried once per line, from its first head on, instead of from every head."""
    head, gap, tail = pattern.partition(".*")
    return f"^(?>.*?{head}).*{tail}" if gap else pattern


_AUDIENCE = "(?iUdm)" + "|".join(f"(?:{_linear(x)})" for x in p.AUDIENCE_MERGED)
# Every audience pattern needs one of these; texts without any skip the patterns, which rescan long texts.
_AUDIENCE_GATE = "(?iU)leader|executive|target (?:audience|reader)"
_NO_STRINGS = "array<string>"


def validate_takeaways(df: DataFrame, column: str = "takeaway") -> DataFrame:
    """Adds ``word_count, sentence_count, has_list_marks, issues_found, passes_validation``."""
    c = F.col(column)
    counted = compute_once(
        df,
        {
            "word_count": text.word_count(c),
            "sentence_count": text.sentence_mark_count(c),
            "has_list_marks": text.contains_any(c, p.BULLET_MARKS),
            "_audience": c.rlike(_AUDIENCE_GATE) & c.rlike(_AUDIENCE),
        },
    )
    words, sentences = F.col("word_count"), F.col("sentence_count")
    issues = F.array_compact(
        F.array(
            F.when(
                ~sentences.between(3, 4),
                F.concat(F.lit("Sentence count is "), sentences, F.lit(", should be 3-4.")),
            ),
            F.when(
                ~words.between(70, 90),
                F.concat(F.lit("Word count is "), words, F.lit(", should be 70-90 words.")),
            ),
            F.when(F.col("has_list_marks"), F.lit(LIST_ISSUE)),
            F.when(F.col("_audience"), F.lit(AUDIENCE_ISSUE)),
        )
    )
    return (
        counted.withColumn("issues_found", issues)
        .withColumn("passes_validation", F.size("issues_found") == 0)
        .drop("_audience")
    )


def attach_verdicts(df: DataFrame, judgements: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``_verdict``, the verdict ``(key, passes, issues, suggestions)`` on each row, for ``merge_verdicts``."""
    verdicts = judgements.groupBy(key).agg(
        F.min_by(
            F.struct("passes", "issues", "suggestions"), F.struct("passes", "issues", "suggestions")
        ).alias("_verdict")
    )
    return df.join(verdicts, key, "left")


def merge_verdicts(df: DataFrame, judgements: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Combine the rules with optional verdicts ``(key, passes, issues, suggestions)``, or those attached already.

    A failing verdict fails the takeaway and adds its issues; no verdict leaves the rules alone (fail-open).
    """
    joined = df if judgements is None else attach_verdicts(df, judgements, key)
    passes = F.coalesce(F.col("_verdict.passes"), F.lit(True))
    found = F.coalesce(F.col("_verdict.issues"), F.array().cast(_NO_STRINGS))
    return joined.withColumns(
        {
            "verdict_issues": found,
            "suggestions": F.coalesce(F.col("_verdict.suggestions"), F.lit("")),
            "issues_found": F.when(passes, F.col("issues_found")).otherwise(F.concat("issues_found", found)),
            "passes_validation": F.col("passes_validation") & passes,
        }
    ).drop("_verdict")


def audience_check(df: DataFrame, judgements: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``passes_check`` and ``check_issues``; a missing verdict does not pass (fail-closed)."""
    verdicts = judgements.groupBy(key).agg(
        F.min_by(F.struct("passes", "issues"), F.struct("passes", "issues")).alias("_v")
    )
    missing = F.col("_v.passes").isNull()
    return (
        df.join(verdicts, key, "left")
        .withColumns(
            {
                "passes_check": F.coalesce(F.col("_v.passes"), F.lit(False)),
                "check_issues": F.when(missing, F.array(F.lit(CHECK_FAILED))).otherwise(
                    F.coalesce(F.col("_v.issues"), F.array().cast(_NO_STRINGS))
                ),
            }
        )
        .drop("_v")
    )


def refinement_instructions(df: DataFrame) -> DataFrame:
    """Adds ``refinement``, what to change, from the columns of ``merge_verdicts``."""
    bullets = F.array_join(
        F.transform("issues_found", lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), ""
    )
    suggestions, passes = F.col("suggestions"), F.col("passes_validation")
    structure = (
        F.col("word_count").between(70, 90) & F.col("sentence_count").between(3, 4) & ~F.col("has_list_marks")
    )
    more = F.when(suggestions != "", F.concat(F.lit(REFINE_MORE), suggestions)).otherwise("")
    nothing_found = (F.size("verdict_issues") == 0) & (passes | (F.size("issues_found") == 0))
    wording = (
        F.when(nothing_found, "")
        .when(
            structure,
            F.when(suggestions != "", F.concat(F.lit(REFINE_INTRO), suggestions))
            .when(~passes, F.concat(F.lit(REFINE_INTRO), bullets))
            .otherwise(""),
        )
        .otherwise(F.concat(F.lit(REFINE_INTRO), bullets, more))
    )
    return df.withColumn("refinement", F.coalesce(text.null_if_empty(text.strip(wording)), F.lit(ALL_CLEAR)))


def short_content_guard(df: DataFrame, column: str = "content") -> DataFrame:
    """Adds ``takeaway``: the failure text for content under 100 characters, else null (a request is due)."""
    return df.withColumn(
        "takeaway",
        F.when(F.coalesce(F.length(column), F.lit(0)) < 100, F.lit(TOO_SHORT)),
    )


# A run of digits, or what the last replacement left of one, and a run of spaces: each is entered at its start only. What a
# pattern begins with is one character that most of a text is not, so that other places cost no look-behind.
_DIGITS = r"(?=\d)(?:(?<!\d)|\G)(\d++)"
_SPACES = r" (?<!  ) *+"
# The clean-up passes, in order.
_SPACING = (
    (rf"(?U){_DIGITS}([a-zA-Z])", "$1 $2"),
    (r"(?U)(?=\d)(?<=[a-zA-Z])", " "),
    (r"(?U)\$ *+(\d++)", r"\$$1"),
    (r"(?U)\$ *+(\d++) *+\. *+(\d++)", r"\$$1.$2"),
    (rf"(?U){_DIGITS} ++(\d{{3}})", "$1,$2"),
    (rf"(?U){_DIGITS} *+, *+(\d++)", "$1,$2"),
    (rf"(?U){_DIGITS} *+\. *+(\d++)", "$1.$2"),
    (rf"{_SPACES}([.,!?:;])", "$1"),
)
_LAST_PASSES = (_SPACING[4], _SPACING[7])


def _rewrite(c: Column, passes) -> Column:
    for pattern, replacement in passes:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def clean_takeaways(df: DataFrame, column: str = "takeaway") -> DataFrame:
    """Repair spacing in numbers and punctuation; cut words over 25 characters into pieces of 20."""
    spaced = text.collapse_spaces(_rewrite(F.col(column), _SPACING))

    def pieces(word: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(word), F.lit(20))
        cut = F.array_join(F.transform(starts, lambda i: F.substr(word, i, F.lit(20))), " ")
        return F.when((F.length(word) > 25) & ~word.rlike(r"(?U)^[\d.,]+\z"), cut).otherwise(word)

    words = F.transform(F.split(spaced, " "), pieces)
    return compute_once(df, {column: _rewrite(F.array_join(words, " "), _LAST_PASSES)})


def sentences(c: Column) -> Column:
    """Sentences of a white-space-normalised text."""
    return F.split(c, r"(?<=[.!?]) +")


def extractive_takeaways(
    df: DataFrame, profile: Profile = Profile(), column: str = "content", max_words: int = 90
) -> DataFrame:
    """Adds ``takeaway``: the four (three, if four pass ``max_words``) most telling sentences in text order.

    A sentence scores 2 for a company, 2 for a tool, 1 for a figure, 1 for a business term. This stands in for the
    model's prose and is not equal to it. Row-local: the sentences of an article never leave its row.
    """
    business = tuple(profile.metric_words) + tuple(profile.retail_terms) + tuple(profile.deployment_terms)

    def score(s: Column) -> Column:
        points = (
            F.when(s.rlike(text.any_word_pattern(profile.companies)), 2).otherwise(0)
            + F.when(s.rlike(text.any_word_pattern(profile.tools)), 2).otherwise(0)
            + F.when(s.rlike(r"(?U)\d"), 1).otherwise(0)
            + F.when(text.contains_any(F.lower(s), business), 1).otherwise(0)
        )
        return points

    rated = F.transform(
        sentences(text.collapse_spaces(F.col(column))),
        lambda s, i: F.struct((-score(s)).alias("rank"), i.alias("pos"), s.alias("s"), text.word_count(s).alias("w")),
    )
    best = F.slice(F.array_sort(rated), 1, 4)
    words = F.aggregate("_best", F.lit(0), lambda n, s: n + s["w"])
    chosen = F.when(words > max_words, F.slice("_best", 1, 3)).otherwise(F.col("_best"))
    ordered = F.array_sort(F.transform(chosen, lambda s: F.struct(s["pos"].alias("pos"), s["s"].alias("s"))))
    return (
        compute_once(df, {"_best": best})
        .withColumn("takeaway", F.array_join(F.transform(ordered, lambda s: s["s"]), " "))
        .drop("_best")
    )


def combine_takeaways(
    chunks: DataFrame,
    articles: DataFrame | None = None,
    key: str = "id",
    max_chars: int | None = None,
    fan_in: int = 256,
) -> DataFrame:
    """``key, takeaway`` from ``chunks(key, chunk_no, takeaway)``, in chunk order; key and number name one chunk.

    One chunk speaks for itself; several are joined with spaces, whole unless the caller sets ``max_chars``. Chunks are
    joined in blocks of ``fan_in`` neighbours, then blocks of blocks.
    """
    c = F.col("takeaway")

    def cut(joined: Column) -> Column:
        return joined if max_chars is None else F.substring(joined, 1, max_chars)

    node = chunks.select(
        key,
        F.col("chunk_no").cast("long").alias("no"),
        F.lit(1).cast("long").alias("rows"),
        c.isNotNull().cast("long").alias("texts"),
        F.coalesce(F.length(c), F.lit(0)).cast("long").alias("chars"),
        cut(c).alias("head"),
        c.alias("sole"),
    ).repartition(key)  # texts move once, however many levels there are
    highest = chunks.agg(F.max("chunk_no")).first()[0] or 0
    while True:
        last = highest < fan_in
        group = [F.col(key)] if last else [F.col(key), F.floor(F.col("no") / fan_in).cast("long").alias("no")]
        heads = F.sort_array(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("no", "head"))))
        node = node.groupBy(*group).agg(
            F.sum("rows").alias("rows"),
            F.sum("texts").alias("texts"),
            F.sum("chars").alias("chars"),
            F.when(
                F.count("head") > 0,
                cut(F.array_join(F.transform(heads, lambda h: h["head"]), " ")),
            ).alias("head"),
            F.max("sole").alias("sole"),
        )
        if last:
            break
        highest //= fan_in
    length = F.col("chars") + F.greatest(F.col("texts") - 1, F.lit(0))
    combined = node.select(
        key,
        F.when(F.col("rows") == 1, F.col("sole"))
        .when(length < 10, F.lit(NOTHING_MEANINGFUL))
        .otherwise(F.col("head"))
        .alias("takeaway"),
    )
    if articles is None:
        return combined
    found = combined.withColumn("_found", F.lit(True))
    return articles.select(key).distinct().join(found, key, "left").select(
        key, F.when(F.col("_found"), F.col("takeaway")).otherwise(NOTHING_TO_COMBINE).alias("takeaway")
    )
