"""URL expressions: host, joining a link to its page (RFC 3986), percent-decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import let

_HIERARCHICAL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _HIERARCHICAL, group)


def authority(url: Column) -> Column:
    """Host with port and user info; empty if the URL has none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Host of the URL, or the URL itself when it has no host."""
    return F.coalesce(F.nullif(authority(url), F.lit("")), url)


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(
        F.concat(F.lit("https://"), url)
    )


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path that starts with ``/``."""

    def resolved(t: Column) -> Column:
        kept = F.aggregate(
            F.split(t, "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        # a path that ends in a dot segment names a folder
        ended = F.when(t.rlike(r"/\.\.?\z"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return let(
            F.array_join(ended, "/"), lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j))
        )

    return let(path, lambda t: F.when(t.rlike(r"/\.\.?(/|\z)"), resolved(t)).otherwise(t))


def _split_base(base: Column) -> Column:
    return F.struct(
        _part(base, 1).alias("scheme"), _part(base, 2).alias("host"), _part(base, 3).alias("path"),
        _part(base, 4).alias("query"),
    )


def _split_href(href: Column) -> Column:
    return F.struct(
        F.regexp_extract(href, r"(?s)^([^?#]*)", 1).alias("path"),
        F.regexp_extract(href, r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"),
        F.regexp_extract(href, r"(?s)#(.*)\z", 1).alias("fragment"),
    )


def _relative(base: Column, ref: Column) -> Column:
    folder = let(
        F.regexp_extract(base["path"], r"(?s)^(.*/)", 1), lambda t: F.when(t == "", F.lit("/")).otherwise(t)
    )
    # joining never keeps empty segments between the folder and the relative path
    joined = F.regexp_replace(F.concat(folder, ref["path"]), r"/{2,}", "/")
    rooted = remove_dot_segments(F.when(ref["path"].startswith("/"), ref["path"]).otherwise(joined))
    query = F.when((ref["path"] == "") & (ref["query"] == ""), base["query"]).otherwise(ref["query"])
    return F.concat(
        base["scheme"],
        F.lit("://"),
        base["host"],
        F.when(ref["path"] == "", base["path"]).otherwise(rooted),
        let(query, lambda t: F.when(t != "", F.concat(F.lit("?"), t)).otherwise("")),
        F.when(ref["fragment"] != "", F.concat(F.lit("#"), ref["fragment"])).otherwise(""),
    )


def resolve(base: Column, href: Column) -> Column:
    """The absolute form of ``href`` found on page ``base``."""

    def joined(h: Column) -> Column:
        return let(
            _split_base(base),
            lambda b: F.when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(b["host"] == "", h)
            .otherwise(let(_split_href(h), lambda r: _relative(b, r))),
        )

    return let(
        href,
        lambda h: F.when(h.startswith("http://") | h.startswith("https://"), h)
        .when(h == "", base)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .otherwise(joined(h)),
    )


def percent_decode(url: Column) -> Column:
    """Decode ``%xx``; ``+`` and malformed escapes stay as they are."""

    def decoded(u: Column) -> Column:
        escaped = F.regexp_replace(u, r"%(?![0-9A-Fa-f]{2})", "%25")
        return F.coalesce(F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))), u)

    return let(url, lambda u: F.when(u.contains("%"), decoded(u)).otherwise(u))


def strip_artifacts(url: Column) -> Column:
    """Drop a ``file:///`` wrapper around a web address, then percent-decode."""
    unwrapped = F.when(
        url.contains("file:///"),
        F.concat(F.lit("https://"), F.element_at(F.split(url, "https://"), -1)),
    ).otherwise(url)
    return percent_decode(unwrapped)
