"""Personal data: patterns propose spans, checksums confirm, context scores.

The base kinds (email, ip, card, phone) stay whatever their score.  The added
kinds (iban by mod-97, ssn by the words before it) need ``MIN_SCORE``.
Everything is a native expression; each pattern runs only on texts that hold
a character it can't do without, and can't backtrack over a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums, total

MIN_SCORE = 0.6
CONTEXT = 40
SPANS = "array<struct<start:int,ord:int,kind:string,stop:int,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(i: Column, n: Column, d: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return let(
        digits,
        lambda d: total(F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: term(i, F.length(d), d))) % 10 == 0,
    )


def _ip(m: Column) -> Column:
    small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    value = lambda p: F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255
    return F.forall(F.split(m, "[.]"), lambda p: small(p) & value(p))


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _mod97(m: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count from 10."""

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c) - F.when(c < "A", 48).otherwise(55)
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

    def check(s: Column) -> Column:
        turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
        return F.aggregate(F.array_remove(F.split(turned, ""), ""), F.lit(0), step) == 1

    return let(F.replace(m, F.lit(" "), F.lit("")), check)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: object
    valid: object
    prior: float
    context: str

    @property
    def base(self) -> bool:
        return self.name in BASE


# Possessive forms of the contract's patterns.  A match can only begin where
# a run of its first class begins, or where the last match has ended (\G), so
# a long run is read once and not once for each of its characters.
_LOCAL = "[A-Za-z0-9._%+-]"
_has_digit = lambda t: t.rlike("[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip, 0.7, "host|server|address|ip"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9][0-9 -]{13}"), _card, 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), _phone, 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9]{1,3})?", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), _mod97, 0.6, "iban|account|bank"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: F.lit(True), 0.3, "ssn|social security"),
)
BONUS = 0.3


def _spans(text: Column, kind: Kind, ord_: int) -> Column:
    """The confirmed spans of one kind in ``text``; code points, end exclusive."""

    def place(found: Column, gaps: Column) -> Column:
        gap, length = F.transform(gaps, F.length), F.transform(found, F.length)
        steps = F.zip_with(F.slice(gap, F.lit(1), F.size(found)), length, lambda g, n: g + n)
        return let(
            prefix_sums(steps),
            lambda before: F.transform(found, lambda m, k: make(m, F.get(before, k) + F.length(F.get(gaps, k)))),
        )

    def make(m: Column, at: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT))))
        score = F.lit(kind.prior) + F.when(before.rlike(kind.context), BONUS).otherwise(0.0)
        return F.struct(at.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind.name).alias("kind"), (at + F.length(m)).alias("stop"), score.cast("double").alias("score"), m.alias("m"))

    # Matches are tested before they are scored; the test sees the text alone.
    placed = let(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda found: F.when(
            F.exists(found, kind.valid), let(F.split(text, kind.pattern), lambda gaps: place(found, gaps))
        ),
    )
    good = F.filter(placed, lambda s: kind.valid(s["m"]) & (F.lit(kind.base) | (s["score"] >= MIN_SCORE)))
    bare = F.transform(good, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "ord", "kind", "stop", "score")]))
    none = F.array().cast(SPANS)
    return F.when(kind.needs(text), F.coalesce(bare.cast(SPANS), none)).otherwise(none)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: the scored spans of each text, by start then kind.

    One row for each row of ``docs``; a null text has no spans.  Spans of
    different kinds may overlap.  Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), let(text, lambda t: F.sort_array(F.concat(*[_spans(t, k, i) for i, k in enumerate(KINDS)]))).alias("found"))
    return base


def span_list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: counts of the base kinds and their digest."""
    of = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("bigint")
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    return pii_spans(docs, id_col, text_col).select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("found")).alias("spans"),
    )
