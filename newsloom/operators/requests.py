"""Tables of prompts for offline batch inference, keyed by text and rubric fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.profile import Profile

# Our own wording. Names in braces are columns, ``rubric`` and ``framework`` are parameters.
TEMPLATES = {
    "categorize": (
        "Pick the one category of this framework that fits the article best; a listed competitor's own use of "
        "generative AI is '" + p.CATEGORIES[6][1] + "', anything that fits nowhere is '" + p.CATEGORIES[5][1] + "'.\n"
        "{framework}\nTitle: {title}\nContent: {snippet}\n"
        'Answer with JSON: {{"category": "...", "justification": "..."}}'
    ),
    "takeaway": (
        "Write a business takeaway by these rules and do not address any reader.\n{rubric}\n"
        'Answer with JSON: {{"takeaway": "..."}}\n{snippet}'
    ),
    "rationale": (
        "In two sentences (30-40 words) say what is new here and why it matters for these criteria.\n"
        "Criteria: {criteria}\nTitle: {title}\nContent: {snippet}"
    ),
    "validate": (
        "Judge the takeaway by the rubric.\nRubric: {rubric}\nTakeaway: {takeaway}\nSource: {snippet}\n"
        'Answer with JSON: {{"passes": true, "issues": [], "suggestions": ""}}'
    ),
    "refine": (
        "Improve the takeaway.\nTakeaway: {takeaway}\nInstructions: {refinement}\nRubric: {rubric}\n"
        'Source: {snippet}\nAnswer with JSON: {{"takeaway": "..."}}'
    ),
    "rewrite": (
        "Rewrite the takeaway without naming leaders or an audience.\nTakeaway: {takeaway}\nRubric: {rubric}\n"
        "Source: {snippet}"
    ),
    "combine": (
        "Combine these takeaways into one.\nRubric: {rubric}\nTakeaways: {snippet}\n"
        'Answer with JSON: {{"takeaway": "..."}}'
    ),
    "keywords": 'List five search keywords for these criteria as JSON: {{"keywords": []}}\nCriteria: {criteria}',
}


def _fill(template: str, values: Mapping[str, Column]) -> Column:
    """The template as one concatenation of literals and columns."""
    pieces: list[Column] = []
    rest = template.replace("{{", "\x02").replace("}}", "\x03")
    while rest:
        literal, _, rest = rest.partition("{")
        if literal:
            pieces.append(F.lit(literal.replace("\x02", "{").replace("\x03", "}")))
        if rest:
            name, _, rest = rest.partition("}")
            pieces.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*pieces)


def fingerprint(c: Column, first_chars: int | None = None) -> Column:
    return F.md5(F.substring(c, 1, first_chars) if first_chars else c)


def snippet(c: Column, max_chars: int | None = None) -> Column:
    """The text a request carries: all of it, unless the caller sets a size; what is left out is marked."""
    if max_chars is None:
        return c
    return F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit("..."))).otherwise(c)


def build_requests(
    df: DataFrame,
    kind: str,
    profile: Profile = Profile(),
    key: str = "id",
    column: str = "content",
    template: str | None = None,
    framework: str = "",
    criteria: str | Column = "",
    max_chars: int | None = None,
) -> DataFrame:
    """``key, kind, content_key, rubric_key, prompt`` for one kind of request, and ``chunk_no`` if the input has it.

    Requests carry whole texts. A text too long for a model is sent as several rows: cut it with ``chunk_articles`` and
    pass the chunks, whose numbers stay with their requests. ``criteria`` may be a column.
    """
    wording = template or TEMPLATES[kind]
    content = F.col(column)
    values = {name: F.col(name) for name in df.columns}
    values |= {
        "snippet": snippet(content, max_chars),
        "rubric": F.lit(profile.rubric),
        "framework": F.lit(framework),
        "criteria": criteria if isinstance(criteria, Column) else F.lit(criteria),
    }
    return df.select(
        *[c for c in (key, "chunk_no") if c in df.columns],
        F.lit(kind).alias("kind"),
        fingerprint(content).alias("content_key"),
        F.md5(F.lit(profile.rubric)).alias("rubric_key"),
        _fill(wording, values).alias("prompt"),
    )
