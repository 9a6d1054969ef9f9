"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Everything is a column expression. Offsets follow from the texts between matches: a text is split at the same
pattern whose matches are extracted, and the lengths add up. Patterns start only where a run of their characters
starts (or where the last match ended) and never give back what they took, so long runs cost no more than
linear time; this leaves the leftmost matches as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import text_of

# Characters before and after a span in which words count as near, and what such a word adds or takes.
NEAR, FOR, AGAINST = 40, 0.1, 0.2
# Matches whose offsets are summed together.
BLOCK = 128
SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn's check: from the right, every second digit counts double, less 9 if above 9; the sum ends in 0."""
    at = F.split(F.reverse(digits), "")
    worth = F.transform(at, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.pmod(d.cast("int") * 2, F.lit(10)) + F.when(d.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, w: a + w) % 10 == 0


def passes_mod97(value: Column) -> Column:
    """The check of account numbers: the first four characters go last, A to Z become 10 to 35, and 1 is left of 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)) == 1


@dataclass(frozen=True)
class Kind:
    """A pattern, what confirms its matches, a score, and words that speak for and against it nearby."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    words: str
    against: str
    hint: str


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Characters of an account number by country, from the registry. A number is bounded by its country's length where a run
# ends there, so that words after it are no part of it; other runs are taken as far as they go, up to such a number.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_BOUNDED = "(?:" + "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, codes in _LENGTHS.items()) + ")(?![A-Za-z0-9])"
_OPEN = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{_BOUNDED}))?+[A-Z0-9]{{4}}){{2,7}}+(?:(?: (?!{_BOUNDED}))?+[A-Z0-9]{{1,3}})?+(?![A-Za-z0-9])"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++", lambda v: F.lit(True), 0.85,
         "mail|contact|write|address", "example|noreply", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 0.6, r"\bip\b|host|server|client|login", "version|release", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])", lambda v: passes_luhn(_digits(v)),
         0.7, "card|visa|credit|debit|pay|kart|tarjeta|carte", "order|invoice|isbn|serial", ""),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 0.7,
         "phone|tel|call|mobile|fax|ruf", "price|score", "+"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BOUNDED}|{_OPEN})",
         passes_mod97, 0.9, "iban|account|bank|konto|cuenta|compte", "order|serial", ""),
)


def _cut(gaps: Column, found: Column) -> Column:
    """Matches with the text before and after each; ``gaps`` are the texts between them."""
    n = F.size(found)
    zipped = F.arrays_zip(F.slice(gaps, 1, n).alias("gap"), found.alias("value"), F.slice(gaps, 2, n).alias("next"))
    return F.when(n > 0, zipped).otherwise(F.array().cast("array<struct<gap:string,value:string,next:string>>"))


def _block_starts(cut: Column) -> Column:
    """Offset of the text before every BLOCK-th match: sums by block, so that many matches cost little more than few."""
    lengths = F.transform(cut, lambda z: F.char_length(z["gap"]) + F.char_length(z["value"]))
    blocks = F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.when(F.size(cut) > 0, F.slice(starts, 1, F.size(starts) - 1)).otherwise(F.array().cast("array<int>"))


def _spans(cut: Column, starts: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind from its matches and the offsets of their blocks."""
    def step(acc: Column, z: Column) -> Column:
        gap, value = z["gap"], z["value"]
        here = acc["at"] + F.char_length(gap)
        end = here + F.char_length(value)
        near = F.lower(F.concat(F.right(gap, F.lit(NEAR)), F.lit(" "), F.left(z["next"], F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.words), FOR).otherwise(0.0) - F.when(
            near.rlike(kind.against), AGAINST).otherwise(0.0)
        span = F.struct(F.lit(kind.name).alias("kind"), here.alias("start"), end.alias("end"), value.alias("value"),
                        F.round(score, 2).alias("score"))
        return F.struct(end.alias("at"), F.when(kind.confirmed(value), F.concat(acc["out"], F.array(span))).otherwise(
            acc["out"]).alias("out"))

    def block(at: Column, place: Column) -> Column:
        none = F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(F.slice(cut, place * BLOCK + 1, F.lit(BLOCK)), none, step, lambda acc: acc["out"])

    return F.flatten(F.transform(starts, block))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row: kind, start, end (code points, end exclusive), value and score, by start.

    Spans of different kinds may overlap. A null or empty text has none. Rows are independent, so repeated rows
    and null ids need no care; an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        matches = F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))
        rows = rows.withColumn(kind.name, F.when(F.contains("t", F.lit(kind.hint)), matches).otherwise(none))
    gaps = {f"{k.name}_gaps": F.when(F.size(k.name) > 0, F.split("t", k.pattern, -1)).otherwise(none) for k in KINDS}
    rows = rows.withColumns(gaps).select("doc_id", *[_cut(F.col(f"{k.name}_gaps"), F.col(k.name)).alias(k.name) for k in KINDS])
    rows = rows.withColumns({f"{k.name}_starts": _block_starts(F.col(k.name)) for k in KINDS})
    rows = rows.select("doc_id", *[_spans(F.col(k.name), F.col(f"{k.name}_starts"), k).alias(k.name) for k in KINDS])
    ordered = F.array_sort(F.concat(*[F.transform(k.name, _ranked(n)) for n, k in enumerate(KINDS)]))
    return rows.select("doc_id", F.transform(ordered, lambda s: s["span"]).alias("spans"))


def _ranked(place: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s.alias("span"))
