"""Pages to links, metadata and text. Every step is a row-local projection; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls
from newsloom.functions.rows import compute_once

# Markup whose content is never a link or text.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_ANCHOR = r"""(?is)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</a\s*>|(?=<a\s)|\z)"""
_OPEN_TAG = r"""(?is)^<a\s((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_BOILERPLATE = (
    r"(?is)<!--.*?-->|<(script|style|header|footer|nav)\b[^>]*>.*?</\1\s*>|<(?:meta|link)\b[^>]*>"
)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted either way or bare; null if the attribute is missing."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

    def value(raw: Column) -> Column:
        quoted = raw.startswith('"') | raw.startswith("'")
        bare = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(raw != "", text.decode_entities(bare, attribute=True))

    return text.let(F.regexp_extract(tag, pattern, 1), value)


def extract_links(pages: DataFrame) -> DataFrame:
    """Every ``<a href>`` in document order: ``page_id, pos, source_url, href, title``.

    The title is the trimmed ``title`` attribute, else the trimmed text of the anchor.
    """
    visible = F.regexp_replace("html", _HIDDEN, "")
    # outer: an inner explode would repeat the extraction in a filter on the size of its array
    anchors = pages.select(
        "page_id",
        F.col("url").alias("source_url"),
        F.posexplode_outer(F.regexp_extract_all(visible, F.lit(_ANCHOR), F.lit(0))).alias("pos", "anchor"),
    )
    opened = compute_once(anchors, {"tag": F.regexp_extract("anchor", _OPEN_TAG, 1)})
    targeted = opened.where(F.col("tag").rlike(r"(?i)(^|\s)href\s*=\s*\S"))
    label = text.strip(text.decode_entities(text.strip_tags(F.col("anchor"))))
    titled = text.null_if_empty(text.strip(_attribute(F.col("tag"), "title")))
    return compute_once(
        targeted,
        {
            "href": F.coalesce(_attribute(F.col("tag"), "href"), F.lit("")),
            "title": F.coalesce(titled, label),
        },
    ).drop("anchor", "tag")


def resolve_links(links: DataFrame) -> DataFrame:
    """Adds ``url``, the absolute form of ``href``."""
    return compute_once(links, {"url": urls.resolve(F.col("source_url"), F.col("href"))})


def normalize_source_urls(sources: DataFrame, column: str = "url") -> DataFrame:
    return sources.withColumn(column, urls.with_scheme(F.col(column)))


def source_domains(df: DataFrame, column: str = "url") -> DataFrame:
    return df.withColumn("domain", urls.domain(F.col(column)))


def clean_titles(links: DataFrame, column: str = "title") -> DataFrame:
    """Drop one leading ``Permalink to ``."""
    prefix = "Permalink to "
    title = F.col(column)
    return links.withColumn(
        column,
        F.when(title.startswith(prefix), F.substr(title, F.lit(len(prefix) + 1))).otherwise(title),
    )


def _meta_content(html: Column, name: str) -> Column:
    """``content`` of a ``<meta>`` tag by ``property`` or ``name``, whichever attribute comes first."""
    tag = F.regexp_extract(
        html, rf"""(?is)<meta\s[^>]*(?:property|name)\s*=\s*["']{name}["'][^>]*>""", 0
    )
    return text.null_if_empty(text.strip(_attribute(tag, "content")))


def extract_page_metadata(pages: DataFrame, as_of) -> DataFrame:
    """``url, title, date``: the page's own title and date, else the host and the day of ``as_of``.

    Title from ``<title>`` then ``og:title``; date from ``article:published_time``, ``<time datetime>``, then a
    JSON-LD ``datePublished``.
    """
    html = F.col("html")
    title = F.coalesce(
        text.null_if_empty(
            text.strip(text.decode_entities(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
        ),
        _meta_content(html, "og:title"),
        F.concat(F.lit("Article from "), urls.domain(F.col("url"))),
    )
    date = F.coalesce(
        _meta_content(html, "article:published_time"),
        text.null_if_empty(F.regexp_extract(html, r"""(?is)<time\b[^>]*datetime\s*=\s*["']([^"']+)["']""", 1)),
        text.null_if_empty(F.regexp_extract(html, r'(?is)"datePublished"\s*:\s*"([^"]+)"', 1)),
        dates.format_date(dates.as_timestamp(as_of)),
    )
    return compute_once(pages.select("url", "html"), {"title": title, "date": date}).drop("html")


def _block(html: Column, tag: str) -> Column:
    """What the first element of a name holds, elements of the same name inside included; null if there is none."""
    opened = rf"(?is)<{tag}\b[^>]*>"
    pieces = F.split(F.regexp_extract(html, rf"{opened}(.*)\z", 1), rf"(?i)(?=</?{tag}\b)")

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.rlike(rf"(?i)\A</{tag}\b"), -1).when(
            piece.rlike(rf"(?i)\A<{tag}\b"), 1
        ).otherwise(0)
        inside = (acc["depth"] > 0) & (depth > 0)
        return F.struct(
            F.when(inside, depth).otherwise(0).alias("depth"),
            F.when(inside, F.concat(acc["kept"], F.array(piece))).otherwise(acc["kept"]).alias("kept"),
        )

    begin = F.struct(F.lit(1).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return F.when(html.rlike(opened), F.array_join(F.aggregate(pieces, begin, step)["kept"], ""))


def extract_main_text(pages: DataFrame, joiner: str = " ") -> DataFrame:
    """Adds ``content``: text of the first ``article``, ``main`` or ``body`` without boilerplate blocks.

    Text nodes are joined with one space; ``joiner=""`` glues the stripped nodes together.
    """
    cleaned = F.regexp_replace("html", _BOILERPLATE, "")
    blocks = [_block(F.col("_clean"), tag) for tag in ("article", "main", "body")]
    body = F.coalesce(*blocks, F.col("_clean"))
    if joiner:
        content = text.collapse_spaces(text.decode_entities(text.strip_tags(body, joiner)))
    else:
        glued = F.regexp_replace(body, rf"(?U){text.SPACE}*<[^>]*>{text.SPACE}*", "")
        content = text.strip(text.decode_entities(glued))
    return compute_once(pages.withColumn("_clean", cleaned), {"content": content}).drop("_clean")


_BLOCKS = (
    "address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|form|h[1-6]|hr|li|main|ol|p"
    "|pre|section|table|tbody|td|th|thead|tr|ul"
)


def extract_dense_text(pages: DataFrame, link_weight: int = 3, block_cost: int = 4) -> DataFrame:
    """Adds ``content``: the run of neighbouring blocks that holds most running text, for pages without a container.

    The page, without its title and boilerplate elements, is cut at every block-level tag. A block is worth its words, less
    ``link_weight`` for each word inside a link, less ``block_cost`` if it has words at all: paragraphs are worth much,
    menus and short labels less than nothing. The text is that of the contiguous run of blocks with the largest sum (of
    equal runs the first, and of those the shortest), so what stands between paragraphs stays and menus around them go.
    Null if no block is worth anything. One pass over the blocks of a page, in its row.
    """
    cleaned = F.regexp_replace(F.regexp_replace("html", _BOILERPLATE, ""), r"(?is)<title\b[^>]*>.*?</title\s*>", "")

    def block(piece: Column) -> Column:
        plain = text.collapse_spaces(text.decode_entities(text.strip_tags(piece, " ")))
        anchors = F.array_join(F.regexp_extract_all(piece, F.lit(_ANCHOR), F.lit(0)), " ")
        words, linked = text.word_count(plain), text.word_count(text.strip_tags(anchors, " "))
        worth = words - link_weight * linked - F.when(words > 0, block_cost).otherwise(0)
        return F.struct(plain.alias("text"), worth.cast("long").alias("worth"))

    pieces = F.transform(F.split(cleaned, rf"(?i)(?=</?(?:{_BLOCKS})\b)"), block)
    none = F.lit(0).cast("long")

    def step(run: Column, b: Column) -> Column:
        fresh = run["sum"] <= 0
        start = F.when(fresh, run["at"]).otherwise(run["start"])
        total = F.when(fresh, b["worth"]).otherwise(run["sum"] + b["worth"])
        better = total > run["best"]
        return F.struct(
            (run["at"] + 1).alias("at"), start.alias("start"), total.alias("sum"),
            F.when(better, total).otherwise(run["best"]).alias("best"),
            F.when(better, start).otherwise(run["first"]).alias("first"),
            F.when(better, run["at"]).otherwise(run["last"]).alias("last"),
        )

    begin = F.struct(*[none.alias(n) for n in ("at", "start", "sum", "best", "first", "last")])
    run = F.aggregate("_blocks", begin, step)
    chosen = F.slice("_blocks", (F.col("_run.first") + 1).cast("int"), (F.col("_run.last") - F.col("_run.first") + 1).cast("int"))
    joined = F.array_join(F.filter(F.transform(chosen, lambda b: b["text"]), lambda t: t != ""), " ")
    found = compute_once(compute_once(pages, {"_blocks": pieces}), {"_run": run})
    return found.withColumn("content", F.when(F.col("_run.best") > 0, joined)).drop("_blocks", "_run")


def normalize_content(df: DataFrame, column: str = "content") -> DataFrame:
    """One space per white-space run; empty becomes null."""
    return compute_once(df, {column: text.null_if_empty(text.collapse_spaces(F.col(column)))})


def strip_url_artifacts(df: DataFrame, column: str = "url") -> DataFrame:
    return df.withColumn(column, urls.strip_artifacts(F.col(column)))
