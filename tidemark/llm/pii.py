"""Personal data and secrets: expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is built-in expressions over the whole text. ``KINDS`` says what is proposed; a kind with
``base`` is reported whenever its own condition holds, the others only where their score reaches
``threshold``. A score starts from the kind, gains ``CONFIRMED`` where a checksum (Luhn, mod 97) holds, or a secret has at
least ``ENTROPY`` bits a character, and ``NEARBY`` where one of the kind's context words stands in the ``CONTEXT`` code points
before the span, other matches included, or in those behind it up to the next match of the kind. The score of a base
kind orders its spans for a reader; it never takes one away.

Positions come without a scan in code: the pieces between matches and the matches alternate, so that
their lengths add up to the starts. Patterns are written so that a match is found in one pass: a
candidate starts only where a run of its characters starts or where the last match ended, and
runs are possessive, which changes no match because what follows a run is never part of it.

Edge cases: a missing or empty text has no spans. Missing ids and repeated rows are kept, one result row
for each input row. Spans of different kinds may overlap; those of one kind never do. Positions count
code points, the end is exclusive. Further columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import text_of

CONFIRMED, NEARBY, CONTEXT, THRESHOLD = 0.4, 0.3, 40, 0.8
ENTROPY = 2.5
_NAMED = r"(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?key)"
_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    needs: str  # a text without a match of this has none of the kind
    base: bool = False
    words: str = ""  # context, as alternatives in lower case


#: In the order in which spans with equal starts are listed.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "@", True,
         "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", 0.6, ".", True, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.5, "", True, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "+", True, "tel|phone|call|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.4, "",
         words="iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.5, "-",
         words="ssn|social security|tax id"),
    Kind("local_phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", 0.5, "",
         words="tel|phone|call|fax|mobile"),
    # the value of what is named a secret
    Kind("secret", rf"(?<![A-Za-z0-9+/_.~-])(?<={_NAMED}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)[A-Za-z0-9+/_.~-]{{12,}}+", 0.4, "",
         words="key|secret|token|credential|login"),
    # keys that their first characters tell
    Kind("api_key", r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
         r"|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_])",
         0.9, ""),
    Kind("private_key", r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----(?:[^-]++-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----)?", 0.9,
         "PRIVATE KEY-----"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.array_remove(backwards, ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (spaces removed) leaves 1 when divided by 97."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    rest = F.aggregate(
        F.array_remove(F.split(turned, ""), ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def entropy(value: Column) -> Column:
    """Bits a character, by how often each character stands in the value."""
    chars = F.array_distinct(F.array_remove(F.split(value, ""), ""))
    n = F.length(value)

    def bits(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return total - share * F.log2(share)

    return F.aggregate(chars, F.lit(0.0), bits)


def _holds(kind: str, value: Column) -> Column:
    """The condition without which a match is dropped."""
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checksum(kind: str, value: Column) -> Column:
    if kind == "card":
        return F.lit(True)  # without Luhn it is dropped
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    if kind == "secret":
        return value.rlike("[0-9]") & (entropy(value) >= ENTROPY)
    return F.lit(False)


_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string,score:double>>"


_FOUND = "array<struct<start:int,value:string,near:string>>"
BLOCK = 256


def _placed(kind: Kind) -> Column:
    """Starts and values of the matches that hold, from the columns ``m_`` (matches) and ``z_`` (with the pieces between).

    Lengths are added up block by block, then over the blocks, so that the work stays far below the
    square of the number of matches.
    """
    matches = F.col(f"m_{kind.name}")
    none = F.array().cast(_FOUND)

    def add(a: Column, x: Column) -> Column:
        before = F.right(F.concat(a["tail"], F.coalesce(x["p"], F.lit(""))), F.lit(CONTEXT))
        near = F.concat(before, F.lit("\n"), F.left(F.coalesce(x["q"], F.lit("")), F.lit(CONTEXT)))
        here = F.array(F.struct((a["at"] + F.length(x["p"])).alias("start"), x["m"].alias("value"), near.alias("near")))
        found = F.when(x["m"].isNull(), none).when(_holds(kind.name, x["m"]), here).otherwise(none)
        length = F.coalesce(F.length(x["p"]), F.lit(0)) + F.coalesce(F.length(x["m"]), F.lit(0))
        tail = F.right(F.concat(before, F.coalesce(x["m"], F.lit(""))), F.lit(CONTEXT))
        return F.struct(F.concat(a["found"], found).alias("found"), (a["at"] + length).alias("at"), tail.alias("tail"))

    def join(a: Column, b: Column) -> Column:
        moved = F.transform(
            b["found"],
            lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["value"].alias("value"), s["near"].alias("near")),
        )
        return F.struct(F.concat(a["found"], moved).alias("found"), (a["at"] + b["at"]).alias("at"), b["tail"].alias("tail"))

    def start(tail: Column) -> Column:
        return F.struct(none.alias("found"), F.lit(0).alias("at"), tail.alias("tail"))

    pairs = f"z_{kind.name}"  # (piece, match, next piece) in order
    if_one = F.aggregate(pairs, start(F.lit("")), add, lambda a: a["found"])

    def block(at: Column) -> Column:
        last = F.get(F.col(pairs), at - 1)
        tail = F.when(at > 0, F.right(F.concat(last["p"], last["m"]), F.lit(CONTEXT))).otherwise(F.lit(""))
        return F.aggregate(F.slice(pairs, at + 1, BLOCK), start(tail), add)

    blocks = F.transform(F.sequence(F.lit(0), F.size(matches), F.lit(BLOCK)), block)
    many = F.aggregate(blocks, start(F.lit("")), join, lambda a: a["found"])
    return F.when(F.size(matches) == 0, none).when(F.size(matches) < BLOCK, if_one).when(F.size(matches) >= BLOCK, many)


def _pairs(kind: Kind) -> Column:
    """(piece, match, next piece) of a kind, in order."""
    pieces, matches = F.col(f"p_{kind.name}"), F.col(f"m_{kind.name}")
    both = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    following = F.slice(pieces, F.lit(2), F.size(pieces))
    return F.zip_with(both, following, lambda x, q: F.struct(x["p"].alias("p"), x["m"].alias("m"), q.alias("q")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col`` and ``spans``: array of (start, kind_no, end, kind, value, score) in order."""
    text = F.col("_text")
    base = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    # a text is searched for a kind only where it has what the kind cannot do without
    base = base.withColumn("_digits", text.rlike("[0-9]"))
    for kind in KINDS:
        possible = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
        if kind.name not in ("email", "private_key"):
            possible = possible & F.col("_digits")
        base = base.withColumn(
            f"m_{kind.name}", F.when(possible, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
        )
    for kind in KINDS:
        found = F.size(f"m_{kind.name}") > 0
        base = base.withColumn(f"p_{kind.name}", F.when(found, F.split(text, kind.pattern, -1)))
    base = base.withColumns({f"z_{k.name}": _pairs(k) for k in KINDS})
    base = base.withColumns({f"s_{k.name}": _placed(k) for k in KINDS})
    scored = [F.coalesce(_scored(no, kind, threshold), F.array().cast(_SPAN)) for no, kind in enumerate(KINDS)]
    return base.select(id_col, F.array_sort(F.concat(*scored)).alias("spans"))


def _scored(no: int, kind: Kind, threshold: float) -> Column:
    """Spans of a kind with their score; those of an added kind only from ``threshold`` on."""

    def span(s: Column) -> Column:
        score = (
            F.lit(kind.score)
            + F.when(_checksum(kind.name, s["value"]), CONFIRMED).otherwise(0.0)
            + (F.when(F.lower(s["near"]).rlike(f"(?:{kind.words})"), NEARBY).otherwise(0.0) if kind.words else F.lit(0.0))
        )
        return F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind_no"),
            (s["start"] + F.length(s["value"])).cast("int").alias("end"), F.lit(kind.name).alias("kind"),
            s["value"].alias("value"), F.least(F.round(score, 2), F.lit(1.0)).alias("score"),
        )

    spans = F.transform(f"s_{kind.name}", span)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= threshold)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind_no"] < len(BASE))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become the first one's."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
                s["end"].alias("at"),
            ),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
