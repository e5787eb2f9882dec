"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is a Catalyst expression.  A pattern's hits come from regexp_extract_all and the gaps between them from
split with the same pattern, so running sums of their lengths are the hits' places in code points.  The patterns are
written with lookbehinds and possessive quantifiers so that matching stays linear in texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

_LOCAL = "A-Za-z0-9._%+-"
#: A chain of digits with single separators is found whole, so that a longer chain never yields a part of itself.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: An account number's pattern finds its first four characters; where it ends depends on its country's length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(f"(?:{x.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, x in IBAN_LENGTHS.items())
_IBAN_KNOWN = rf"^(?:{_KNOWN})(?![A-Za-z0-9])"
_IBAN_COUNTRY = rf"^(?:{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})"
_IBAN_LONGEST = 4 + 2 * 30 + 1
#: What a text must hold for a kind to be looked for.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Scores of confirmed spans before and after a context word of the kind stands near.
SCORES = {"email": (0.90, 0.97), "ip": (0.60, 0.85), "card": (0.85, 0.98), "phone": (0.65, 0.90), "iban": (0.95, 0.99), "ssn": (0.30, 0.85)}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|reach|correo|courriel|adresse)",
    "ip": r"(?i)\b(?:ip|address|host|server|client|login)",
    "card": r"(?i)\b(?:card|visa|master|amex|credit|debit|carte|karte|tarjeta|pay)",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|llam)",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)",
    "ssn": r"(?i)\b(?:ssn|social|security)",
}
WINDOW = 40
THRESHOLD = 0.5
_BLOCK = 256
#: Characters of the pieces of a text from which the surroundings of a hit are read, so that long texts aren't read for each hit.
_PIECE = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text pass the Luhn check."""
    digits = F.filter(F.split(F.reverse(_digits(text)), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x)
    return (total % 10 == 0) & (F.size(digits) > 0)


def mod97(text: Column) -> Column:
    """Whether an account number in the IBAN form leaves 1 modulo 97 after its first four characters move last."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def _account(tail: Column) -> Column:
    """The account number that tail begins with, or null: of its country's length, else the longest that passes mod97.

    A known country's number may also be all that stands together, as long as it passes.
    """
    lengths = F.when(tail.rlike(_IBAN_COUNTRY), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(30), F.lit(11), F.lit(-1)))
    ends = F.transform(lengths, lambda n: F.regexp_substr(tail, F.concat(F.lit("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){"), n.cast("string"), F.lit("}(?![A-Za-z0-9])"))))
    whole = F.regexp_extract(tail, "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0)
    found = F.concat(F.array(F.regexp_extract(tail, _IBAN_KNOWN, 0)), ends, F.array(whole))
    return F.try_element_at(F.filter(found, lambda x: (F.length(x) > 0) & mod97(x)), F.lit(1))


def _octets(text: Column) -> Column:
    """Parts at most 255, however long and however many leading zeros."""
    return F.forall(F.split(text, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.lit(True),
    "ip": _octets,
    "card": luhn,
    "phone": lambda t: F.length(_digits(t)).between(9, 15),
    "iban": lambda t: F.length(t) > 0,
    "ssn": lambda t: ~t.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints, in two levels so that the work stays near n * sqrt(n)."""

    def sums(values: Column) -> Column:
        start = F.array().cast("array<int>")
        return F.aggregate(values, start, lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))

    def blocked(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), sums(totals))
        return let(before, lambda base: F.flatten(F.transform(blocks, lambda b, i: let(F.get(base, i), lambda at: F.transform(sums(b), lambda x: x + at)))))

    return let(lengths, lambda values: F.when(F.size(values) <= _BLOCK, sums(values)).otherwise(blocked(values)))


def find_spans(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """df with an array of {kind, start, end, score}: code points, end exclusive, by kind as in KINDS, then start.

    A null text reads as empty and has no spans.  Spans of a kind don't overlap; spans of different kinds may.  Base
    kinds are kept whatever their score, added kinds (iban, ssn) only with a score of THRESHOLD or more.
    """
    names = {k: (f"__hits_{k}", f"__gaps_{k}") for k in KINDS}
    source = "__pii_text"
    found = df.withColumn(source, F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<string>")

    def hits(kind: str) -> Column:
        every = F.regexp_extract_all(F.col(source), F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(F.col(source), F.lit(NEEDED[kind])), every).otherwise(none) if NEEDED[kind] else every

    found = found.withColumns({names[k][0]: hits(k) for k in KINDS})
    found = found.withColumns({names[k][1]: F.when(F.size(names[k][0]) > 0, F.split(F.col(source), PATTERNS[k], -1)) for k in KINDS})

    pieces = "__pii_pieces"
    some = F.greatest(*(F.size(names[k][0]) for k in KINDS)) > 0
    found = found.withColumn(pieces, F.when(some, F.regexp_extract_all(F.col(source), F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))))

    def stretch(start: Column, length: int) -> Column:
        """So many characters from start on, length at most _PIECE; fewer at the text's end."""
        first = F.floor(start / _PIECE).cast("int")
        both = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
        return F.substring(both, start % _PIECE + 1, F.lit(length))

    def spans(kind: str) -> Column:
        every, gaps = F.col(names[kind][0]), F.col(names[kind][1])
        ends = _running(F.zip_with(F.slice(gaps, F.lit(1), F.size(every)), every, lambda g, h: F.length(g) + F.length(h)))

        def whole(h: Column, e: Column) -> Column:
            start = e - F.length(h)
            if kind != "iban":
                return F.struct(start.alias("start"), e.alias("end"), h.alias("hit"))
            return let(F.coalesce(_account(stretch(start, _IBAN_LONGEST)), F.lit("")), lambda x: F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("hit")))

        def scored(x: Column) -> Column:
            first = F.greatest(x["start"] - WINDOW, F.lit(0))
            before = F.left(stretch(first, WINDOW), x["start"] - first)
            near = F.concat(before, F.lit(" "), stretch(x["end"], WINDOW))
            score = F.when(near.rlike(CONTEXT[kind]), SCORES[kind][1]).otherwise(SCORES[kind][0])
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

        kept = F.filter(F.zip_with(every, ends, whole), lambda x: VALID[kind](x["hit"]))
        if kind == "iban":
            kept = let(kept, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x["start"] >= F.get(all_, i - 1)["end"])))
        floor = 0.0 if kind in BASE_KINDS else THRESHOLD
        kept = F.filter(F.transform(kept, scored), lambda x: x["score"] >= floor)
        return F.when(F.size(every) > 0, kept).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))

    found = found.withColumns({f"__spans_{k}": spans(k) for k in KINDS})
    found = found.withColumn(out, F.concat(*(f"__spans_{k}" for k in KINDS)))
    return found.drop(source, pieces, *(x for pair in names.values() for x in pair), *(f"__spans_{k}" for k in KINDS))


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df with each span's characters in text replaced by <KIND>; overlapping spans become one, named after the first.

    A text without spans stays as it is, null included.
    """

    def order(a: Column, b: Column) -> Column:
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])

    blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        kept = F.substring(F.col(text), a["at"] + 1, x["start"] - a["at"])
        parts = F.when(fresh, F.concat(a["parts"], F.array(kept, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))))).otherwise(a["parts"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), parts.alias("parts"))

    def whole(a: Column) -> Column:
        return F.concat(F.array_join(a["parts"], ""), F.substring(F.col(text), a["at"] + 1, F.length(F.col(text))))

    masked = F.aggregate(F.array_sort(F.col(spans), order), blank, step, whole)
    return df.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return docs.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii_spans")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii_spans", lambda x: x["score"])), F.lit(0.0)), 4).alias("max_score"),
    )
