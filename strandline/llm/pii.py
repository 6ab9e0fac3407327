"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is Spark SQL expressions. A pattern's matches and the gaps between
them come from ``regexp_extract_all`` and ``split``; running sums of their lengths
give the spans in code points. Patterns that could start at any character of a
long run are tied to the start of the run or the end of the last match
(``\\G``), which finds the same matches in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .shelf import free_name

_MAIL = "[A-Za-z0-9._%+-]"
#: Kind, pattern and score of a match that its validator confirms, in the order of report.
PATTERNS = {
    "email": (rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", 0.6),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", 0.9),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8),
    "ssn": (r"(?<![A-Za-z0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9])", 0.4),
    "secret": (r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])", 0.4),
}
BASE = ("email", "ip", "card", "phone")
#: A quick test that no match can fail.
_HINT = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words that raise or lower the score when they stand within ``REACH`` characters before or after the span, as far as the
#: kind's next match on that side. An underscore parts words.
RAISE = {
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
    "secret": r"(?i)\b(?:token|secret|password|api[_ -]?key|apikey|bearer)\b",
    "card": r"(?i)\b(?:card|visa|mastercard)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile)\b",
    "email": r"(?i)\b(?:e-?mail|contact)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
}
LOWER = r"(?i)\b(?:example|sample|isbn|version|sha(?:1|256)?|md5|commit|checksum)\b"
REACH, STEP, THRESHOLD = 40, 0.3, 0.6
BLOCK = 128


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    back = F.split(F.reverse(digits), "")
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    points = F.transform(back, lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 1, double(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48)))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        bare = F.regexp_replace(m, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "ssn":  # numbers that are never issued
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("^...-00") & ~m.rlike("0000$")
    return F.lit(True)


SPAN = "struct<start:int,no:int,end:int,kind:string,value:string,score:double>"


def _score(kind: str, before: Column, after: Column) -> Column:
    """The score of a confirmed match, moved by the words that stand before and after it."""
    near = lambda words: before.rlike(words) | after.rlike(words)
    move = F.when(near(RAISE[kind]), STEP).otherwise(0.0) - F.when(near(LOWER), STEP).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(PATTERNS[kind][1]) + move)), 2)


def _matches(text: Column, kind: str, threshold: float) -> Column:
    """Spans of a kind in order: confirmed, and of a base kind or with a score of ``threshold``."""
    pattern, no = PATTERNS[kind][0], list(PATTERNS).index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), found.alias("m"))
    near = lambda x: F.translate(x, "_", " ")
    parts = let(zipped, lambda every: F.transform(every, lambda z, i: F.struct(
        F.length(z["g"]).alias("g"), F.length(z["m"]).alias("n"), z["m"].alias("m"),
        near(F.right(z["g"], F.lit(REACH))).alias("b"), near(F.coalesce(F.left(F.get(every, i + 1)["g"], F.lit(REACH)), F.lit(""))).alias("a"),
    )))
    none = F.array().cast(f"array<{SPAN}>")
    # Spans are gathered in blocks, so that a text with very many of them isn't copied once per span.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("blocks"), none.alias("last"))

    def step(a: Column, z: Column) -> Column:
        at = a["at"] + z["g"]
        end = at + F.coalesce(z["n"], F.lit(0))
        keep = F.when(z["m"].isNotNull(), confirmed(kind, z["m"])).otherwise(False)
        if kind not in BASE:
            keep = keep & (_score(kind, z["b"], z["a"]) >= threshold)
        one = F.array(F.struct(at.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), z["m"].alias("value"), _score(kind, z["b"], z["a"]).alias("score")))
        full = F.size(a["last"]) >= BLOCK
        return F.struct(
            end.alias("at"),
            F.when(full, F.concat(a["blocks"], F.array(a["last"]))).otherwise(a["blocks"]).alias("blocks"),
            F.concat(F.when(full, none).otherwise(a["last"]), F.when(keep, one).otherwise(none)).alias("last"),
        )

    whole = F.aggregate(parts, begin, step, lambda a: F.flatten(F.concat(a["blocks"], F.array(a["last"]))))
    possible = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else F.lit(True)
    return F.when(possible & (F.size(found) > 0), whole).otherwise(none)


def find_spans(docs: DataFrame, *, text: str = "text", out: str = "pii_spans", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``out``: array of (start, no, end, kind, value, score), by start, then kind in the order of ``PATTERNS``.

    Offsets are code points, the end exclusive. Spans of the base kinds stay whatever their score, the others need
    ``threshold``. A null or empty text has no span. Repeated rows are searched each; an empty table gives an empty one. A column
    named like ``out`` is replaced.
    """
    body = free_name(docs, "pii_body")
    names = {kind: free_name(docs, f"pii_{kind}") for kind in PATTERNS}
    found = docs.withColumn(body, F.coalesce(docs[text], F.lit("")))
    found = found.withColumns({names[k]: _matches(F.col(body), k, threshold) for k in PATTERNS})
    every = F.concat(*(F.col(c) for c in names.values()))
    ordered = F.array_sort(every)
    return found.withColumn(out, ordered).drop(body, *names.values())


def joined(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; of overlapping spans the first covers the others.

    A null text stays null, a text without spans stays as it is.
    """
    t, s = F.col(text), F.col(spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        new = F.concat(a["parts"], F.array(F.substring(t, a["at"] + 1, x["start"] - a["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], new).otherwise(a["parts"]).alias("parts"))

    done = F.aggregate(s, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    return docs.withColumn(text, F.when(t.isNull() | (F.size(s) == 0), t).otherwise(done))
