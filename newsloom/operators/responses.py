"""Reading model output: strict JSON first, patterns for broken JSON, fixed texts when nothing helps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.functions import text
from newsloom.functions.rows import compute_once

# Fallback texts and the three patterns for a takeaway in broken JSON.
NO_TAKEAWAY = "Error extracting content."
NOT_AN_OBJECT = "Error occurred during content processing."
UNCATEGORIZED = "Uncategorized"
FORMAT_ERROR = "LLM output format error."
DECODE_ERROR = "Error decoding LLM JSON response."
NO_RESPONSE = "LLM response error."
_BROKEN = (
    r'"takeaway"\s*:\s*"((?:[^"\\]++|\\.)*+)(?:"|\z)',
    r'"takeaway"\s*:\s*"([^"]*)',
    r"""(?s)"takeaway"\s*:\s*["']?([^"}']+)""",
)


def _parsed(df: DataFrame, raw: Column, *names: str) -> DataFrame:
    """Adds ``_json``, ``_keys`` of an object, and ``_last``: named fields of an object that repeats a key.

    A repeated key is no variant, but it is JSON, and the last value holds.
    """
    fields = ", ".join(f"{name} STRING" for name in names)
    read = compute_once(df, {"_json": F.try_parse_json(raw), "_keys": F.json_object_keys(raw)})
    repeated = F.col("_json").isNull() & (F.size("_keys") > F.size(F.array_distinct("_keys")))
    return read.withColumn("_last", F.when(repeated, F.from_json(raw, fields)))


def _readable() -> Column:
    return F.col("_json").isNotNull() | F.col("_last").isNotNull()


def _field(name: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col("_json"), f"$.{name}", "string"), F.col(f"_last.{name}"))


def _salvaged(c: Column) -> Column:
    """Takeaway from text that is not JSON; null if no pattern fits."""
    ladder = F.when(c.rlike(_BROKEN[0]), F.regexp_extract(c, _BROKEN[0], 1))
    for pattern in _BROKEN[1:]:
        ladder = ladder.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))
    return ladder


def parse_takeaway_responses(df: DataFrame, raw: str = "raw", fallback: str | None = None) -> DataFrame:
    """Adds ``takeaway``. ``fallback`` names a column to use instead of the fixed failure text."""
    stripped = df.withColumn("_raw", text.strip(F.col(raw)))
    parsed = _parsed(stripped, F.col("_raw"), "takeaway")
    from_json = F.when(F.col("_keys").isNotNull(), F.coalesce(_field("takeaway"), F.lit(""))).otherwise(NOT_AN_OBJECT)
    last = F.col(fallback) if fallback else F.lit(NO_TAKEAWAY)
    takeaway = (
        F.when(_readable(), from_json)
        .when(F.length("_raw") > 0, F.coalesce(_salvaged(F.col("_raw")), last))
        .otherwise(last)
    )
    return compute_once(parsed, {"takeaway": takeaway}).drop("_raw", "_json", "_keys", "_last")


def parse_category_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``category`` and ``category_justification``; code fences around the JSON are dropped."""
    bare = text.strip(F.col(raw))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\A```json", ""), r"```\z", "")
    parsed = _parsed(df, bare, "category", "justification")
    category, why = _field("category"), _field("justification")
    # both keys are there; their values may be null
    complete = F.coalesce(
        _readable() & F.array_contains("_keys", "category") & F.array_contains("_keys", "justification"), F.lit(False)
    )
    return parsed.withColumns(
        {
            "category": F.when(complete, category).otherwise(UNCATEGORIZED),
            "category_justification": F.when(complete, why)
            .when(_readable(), FORMAT_ERROR)
            .when(F.col(raw).isNull(), NO_RESPONSE)
            .otherwise(DECODE_ERROR),
        }
    ).drop("_json", "_keys", "_last")


def parse_keyword_responses(df: DataFrame, raw: str = "raw", limit: int | None = None) -> DataFrame:
    """Adds ``keywords``: those of the response (the first ``limit``, if set), or the default ones if it cannot be read."""
    parsed = _parsed(df, F.col(raw), "keywords")
    listed = F.coalesce(
        F.try_variant_get(F.col("_json"), "$.keywords", "array<string>"),
        F.from_json("_last.keywords", "ARRAY<STRING>"),
        F.array().cast("array<string>"),
    )
    defaults = F.array(*[F.lit(k) for k in p.FALLBACK_KEYWORDS])
    readable = _readable() & F.col("_keys").isNotNull()
    return parsed.withColumn("keywords", F.when(readable, listed if limit is None else F.slice(listed, 1, limit)).otherwise(defaults)).drop(
        "_json", "_keys", "_last"
    )
