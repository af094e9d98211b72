"""URL rewriting and resolution as Column expressions; a bad URL never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _before_query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^([^?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def _fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^#]*#(.*)\z", 1)


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, r"//([^/]+)", 1)


def quote(value: Column) -> Column:
    """Form encoding: a space becomes ``+``; letters, digits and ``_.-~`` stay."""
    encoded = F.url_encode(value)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def unquote(value: Column) -> Column:
    """Form decoding; a percent sign without two hex digits is taken literally."""
    lenient = F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(lenient), value)


def page_url(base: Column, param: Column, offset: Column) -> Column:
    """Set query parameter ``param`` to ``offset``.

    Of a repeated name the first value stays, blanks stay, an existing parameter is replaced in
    its place, a missing one is appended; fragment and other parameters are kept.
    """

    def pair(item: Column) -> Column:
        return F.struct(
            unquote(F.substring_index(item, "=", 1)).alias("name"),
            unquote(F.regexp_extract(item, r"(?s)^[^=]*=(.*)\z", 1)).alias("value"),
        )

    items = F.filter(F.split(_query(base), "&"), lambda item: item != "")
    number = offset.cast("string")

    def rebuilt(pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: p["name"])
        firsts = F.filter(pairs, lambda p, i: F.array_position(names, p["name"]) == i + 1)
        kept = F.transform(
            firsts,
            lambda p: F.concat(
                quote(p["name"]),
                F.lit("="),
                quote(F.when(p["name"] == param, number).otherwise(p["value"])),
            ),
        )
        added = F.concat(quote(param), F.lit("="), quote(number))
        query = F.when(F.array_contains(names, param), kept).otherwise(
            F.concat(kept, F.array(added))
        )
        return F.array_join(query, "&")

    fragment = _fragment(base)
    return F.concat(
        _before_query(base),
        F.lit("?"),
        let(F.transform(items, pair), rebuilt),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _without_dots(path: Column, keep_empty: bool = False) -> Column:
    """``path`` with a leading slash and ``.`` and ``..`` folded away.

    Empty segments inside stay only where ``keep_empty``: in a path that a link gives whole.
    """
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))
    if not keep_empty:
        inner = F.filter(inner, lambda s: s != "")
    folded = F.aggregate(
        F.concat(F.slice(segments, 1, 1), inner, F.when(F.size(segments) > 1, F.array(last)).otherwise(F.array())),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")
    return let(joined, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def _trimmed(url: Column) -> Column:
    """A link without control characters and spaces in front, without line breaks and tabs, and without
    the two slashes of an authority that is empty."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return F.regexp_replace(plain, r"^//(?=[/?#])", "")


def resolve_url(url: Column, base: Column) -> Column:
    """Empty -> the base; with a scheme -> unchanged; else joined to the base (RFC 3986)."""
    return let(_trimmed(url), lambda link: _resolved(link, base))


def _resolved(url: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, SCHEME, 0)
    authority = F.regexp_extract(base, r"^[^/?#]*(//[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"(?s)^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    path, query, fragment = _before_query(url), _query(url), _fragment(url)

    merged = (
        F.when(path == "", base_path)
        .when(path.startswith("/"), _without_dots(path, keep_empty=True))
        .otherwise(
            _without_dots(
                F.concat(F.regexp_replace(base_path, r"(?s)[^/]*\z", ""), path)
            )
        )
    )
    full_query = F.when((path == "") & (query == ""), _query(base)).otherwise(query)
    joined = F.concat(
        scheme,
        authority,
        merged,
        F.when(full_query != "", F.concat(F.lit("?"), full_query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    return (
        F.when(url.isNull() | (url == ""), base)
        .when(url == "//", F.substring_index(base, "#", 1))
        .when(url.rlike(SCHEME), url)
        .when(url.startswith("//"), F.concat(scheme, url))
        .otherwise(joined)
    )
