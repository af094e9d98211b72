"""HTML and reply text as Column -> Column expressions (no Python at run time)."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import folded_text

# Tags whose whole content is dropped, and the fence of a quoted reply.
CONTENT_FREE_TAGS = ("nav", "footer", "header")
FENCE = "```"

# Characters a text node is stripped of: Unicode white space, as str.strip sees it.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Stands for "a tag was here" until the text nodes are put together again.
MARK = "\x01"

# One left-to-right pass, so that a comment inside a script (or the reverse) is read correctly.
OPAQUE = (
    r"(?s)<(?:!--.*?(?:-->|\z)"
    r"|(?i:script)(?=[\s/>])[^>]*>.*?(?:</(?i:script)[^>]*>|\z)"
    r"|(?i:style)(?=[\s/>])[^>]*>.*?(?:</(?i:style)[^>]*>|\z))"
)
LD_SCRIPT = r"(?is)^<script\s(?:[^>]*[\s\"'/])?type\s*=\s*[\"']?application/ld\+json[\"'\s/>].*"
SCRIPT_BODY = r"(?is)^<script[^>]*>(.*?)(?:</script[^>]*>)?\z"
TIME_TAG = (
    r"(?s)<(?i:time)\s(?:[^>]*?[\s\"'/])?(?i:datetime)\s*=\s*"
    r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>.*?(?:</(?i:time)\s*>|\z)"
)
# Innermost block of its own kind: possessive groups run as loops, without recursion.
_KINDS = "|".join(CONTENT_FREE_TAGS)
DROPPED_BLOCK = (
    rf"<((?i:{_KINDS}))(?=[\s/>])[^>]*>[^<]*+(?:<(?!/?(?i:\1)[\s/>])[^<]*+)*+</(?i:\1)[^>]*>"
)
DROPPED_OPEN = rf"<(?i:{_KINDS})[\s/>]"
DROPPED_CLOSE = rf"</(?i:{_KINDS})[\s/>]"
MOST_BLOCKS = 8  # of which the innermost are taken out again and again
# Elements that are left out as well, but mostly end without a closing tag of their own.
RARE_HIDDEN = r"<(?i:template|rt|rp)[\s/>]"
TAG_START = r"<(?:[!?]|/?[a-zA-Z])"
ANY_TAG = r"<(?:[!?]|/?[a-zA-Z])(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>"

ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
RARE_ENTITY = r"&(?!amp;|lt;|gt;|quot;)[A-Za-z#]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda over one Column)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs_rejoined(text: Column, pattern: str, replace) -> Column:
    """Replace every match of ``pattern`` by ``replace(match)``, an arbitrary expression."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(
            between,
            found,
            lambda piece, match: F.concat(
                F.coalesce(piece, F.lit("")), F.coalesce(replace(match), F.lit(""))
            ),
        ),
        "",
    )


def jsonld_date(script: Column) -> Column:
    """``datePosted: X`` for one JSON-LD script element, NULL without a truthy date."""
    value = F.get_json_object(F.regexp_extract(script, SCRIPT_BODY, 1), "$.datePosted")
    truthy = ~value.isin("", "0", "0.0", "false", "[]", "{}")
    return F.when(
        script.rlike(LD_SCRIPT) & truthy, F.concat(F.lit("datePosted: "), value)
    )


def _escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def drop_scripts(html: Column) -> Column:
    """Comments, scripts and styles become a mark; JSON-LD leaves its posting date behind."""
    with_dates = _pairs_rejoined(
        html,
        OPAQUE,
        lambda m: F.when(
            m.isNotNull(),
            F.concat(F.lit(MARK), F.coalesce(_escape(jsonld_date(m)), F.lit("")), F.lit(MARK)),
        ),
    )
    return F.when(F.contains(html, F.lit("ld+json")), with_dates).otherwise(
        F.regexp_replace(html, OPAQUE, MARK)
    )


def time_tag(html: Column) -> Column:
    """``<time datetime=X>...</time>`` shows X; a time element without it is kept."""
    return F.regexp_replace(html, TIME_TAG, f"<time>{MARK}$1$2$3{MARK}</time>")


def drop_blocks(html: Column) -> Column:
    """Remove nav, footer and header with their content, nested ones included."""
    once = F.regexp_replace(html, DROPPED_BLOCK, MARK)
    return let(
        once,
        lambda h: F.when(
            h.rlike(DROPPED_CLOSE),
            F.aggregate(
                F.sequence(F.lit(1), F.regexp_count(h, F.lit(DROPPED_CLOSE))),
                h,
                lambda acc, _: F.regexp_replace(acc, DROPPED_BLOCK, MARK),
            ),
        ).otherwise(h),
    )


def _windows_1252(number: int) -> str:
    try:
        return bytes([number]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(number)


def _entity_map(names: dict[str, str]) -> Column:
    """Name -> text from two literals, which fold into one constant map."""
    ordered = sorted(names.items())
    return F.map_from_arrays(
        F.split(F.lit(" ".join(n for n, _ in ordered)), " "),
        F.split(F.lit(" ".join(t for _, t in ordered)), " "),
    )


def _code_point(number: Column) -> Column:
    """Character for a numeric reference; 128-159 are read as Windows-1252, as browsers do."""
    cp1252 = F.split(F.lit(" ".join(_windows_1252(i) for i in range(128, 160))), " ")
    bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return (
        F.when(bad, F.lit("�"))
        .when(number.between(128, 159), F.element_at(cp1252, (number - 127).cast("int")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _entity(match: Column) -> Column:
    body = F.regexp_replace(match, "^&|;$", "")
    # Names come from the standard library's tables, the short one of HTML 4 first.
    common = {n: html.entities.html5[f"{n};"] for n in html.entities.name2codepoint}
    rest = {
        n[:-1]: t
        for n, t in html.entities.html5.items()
        if n.endswith(";") and n[:-1] not in common
    }
    hexadecimal = F.substring(body, 2, 1).isin("x", "X")
    digits = F.regexp_replace(body, "^#[xX]?0*", "")
    # more digits than any character needs stand for a number beyond the last one
    numeric = (
        F.when(digits == "", F.lit(0))
        .when(F.length(digits) > 8, F.lit(0x110000))
        .when(hexadecimal, F.conv(digits, 16, 10))
        .otherwise(digits)
        .cast("bigint")
    )
    return (
        F.when(body == "amp", F.lit("&"))
        .when(body.startswith("#"), _code_point(numeric))
        .otherwise(
            F.coalesce(
                F.element_at(_entity_map(common), body),
                F.element_at(_entity_map(rest), body),
                # An unknown name is text, without the semicolon the parser has taken.
                F.concat(F.lit("&"), body),
            )
        )
    )


def unescape(text: Column) -> Column:
    """Decode character references once (``&amp;lt;`` gives ``&lt;``)."""
    simple = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        simple = F.replace(simple, F.lit(f"&{name};"), F.lit(char))
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(~text.rlike(RARE_ENTITY), simple)
        .otherwise(
            _pairs_rejoined(text, ENTITY, lambda m: F.when(m.isNotNull(), _entity(m)))
        )
    )


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def _last_is_closed(html: Column, name: str) -> Column:
    """Whether the last tag that opens ``name`` has a closing one behind it."""
    lowered = F.lower(html)
    behind = F.substring_index(lowered, f"<{name}", -1)
    return ~F.contains(lowered, F.lit(f"<{name}")) | F.contains(behind, F.lit(f"</{name}"))


def well_nested(html: Column) -> Column:
    """Whether expressions read the page as a parser does, and in time that grows with its length: every tag ends, menus and
    the like are few and closed, and so is the last ``time`` element."""
    tail = F.substring_index(html, ">", -1)
    blocks = F.regexp_count(html, F.lit(DROPPED_OPEN))
    calm = ~tail.rlike(TAG_START) & (blocks <= MOST_BLOCKS) & (blocks == F.regexp_count(html, F.lit(DROPPED_CLOSE)))
    for name in (*CONTENT_FREE_TAGS, "time"):
        calm = calm & _last_is_closed(html, name)
    times = F.regexp_count(html, F.lit(r"<(?i:time)[\s/>]")) == F.regexp_count(html, F.lit(r"</(?i:time)[\s/>]"))
    return calm & times & ~html.rlike(RARE_HIDDEN)


def html_clean(html: Column) -> Column:
    """Visible text of a page: one stripped text node per line, scripts and menus gone.

    Pages that do not nest go through one pass over their tags in Python, all others stay in the JVM.
    """
    nested = well_nested(html)
    return F.when(nested, _nested_text(html)).otherwise(folded_text(F.when(~nested, html)))


def _nested_text(html: Column) -> Column:
    marked = let(
        drop_scripts(html),
        lambda h: F.regexp_replace(drop_blocks(time_tag(h)), ANY_TAG, MARK),
    )
    nodes = let(marked, lambda t: F.split(unescape(t), MARK, -1))
    lines = F.array_join(F.filter(F.transform(nodes, strip), lambda n: n != ""), "\n")
    return let(
        lines,
        lambda t: F.when(
            F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")
        ).otherwise(t),
    )


def _element(html: Column, name: str) -> Column:
    """Content of the first ``name``; empty where it does not end. The end of the page ends the search."""
    pattern = rf"(?is)<{name}[^>]*(?:>(.*?)(</{name}\s*>|\z)|\z)"
    closed = F.regexp_extract(html, pattern, 2) != ""
    return F.when(closed, F.regexp_extract(html, pattern, 1)).otherwise(F.lit(""))


def html_title(html: Column) -> Column:
    """Text of ``<title>``, else of the first ``<h1>``, else an empty string."""
    raw = F.coalesce(
        F.nullif(_element(html, "title"), F.lit("")),
        _element(html, "h1"),
    )
    return let(F.regexp_replace(raw, ANY_TAG, ""), lambda t: strip(unescape(t)))


def strip_fences(text: Column) -> Column:
    """Trim a reply and take it out of its code fence, if it has one."""

    def unfenced(raw: Column) -> Column:
        body = F.regexp_replace(raw, r"^[^\n]*\n", "")
        return strip(F.regexp_replace(body, rf"(?s)^(.*){FENCE}.*\z", "$1"))

    return let(
        strip(text), lambda raw: F.when(raw.startswith(FENCE), unfenced(raw)).otherwise(raw)
    )


def terms(text: Column) -> Column:
    """Distinct lower-case words (letters and digits of any script)."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    )
