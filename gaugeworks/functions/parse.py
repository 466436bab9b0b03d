"""Dates, money and durations out of text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.text import SPACE, folded, let, stripped
from gaugeworks.taxonomy import DAYS_PER, MONTHS, NUMBER_WORDS

_NAME = r"([A-Za-z]{3,9})\.?"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def month_number(name: Column) -> Column:
    """1 to 12 from an English month name or its first three letters or more."""
    short = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m[:3], k)])
    whole = F.array(*map(F.lit, MONTHS))
    low = F.lower(name)
    return let(F.try_element_at(short, F.substring(low, 1, 3)), lambda k: F.when(F.element_at(whole, k).startswith(low) | (low == "sept"), k))


# Ordinal endings and "day of" phrases inside a date.
_ORDINAL, _DAY_OF = r"(?i)(\d)(st|nd|rd|th)\b", r"(?i)\b(\d{1,2})[a-z]*(?:\s+[a-z]+)*\s+day\s+of\b"
# The writings of a date and where year, month and day stand in each; "?" marks a month that may be a day.
_WRITINGS = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s?(?:Z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", "$3|?$1|$2"),
    (r"(?is)^.*?\b(\d{1,2})\s+day\s+of\s+([A-Za-z]+)[,\s]*(\d{4}).*$", "$3|$2|$1"),
    (rf"(?i)^(?:[a-z]+day,? )?{_NAME}[ -](\d{{1,2}}),?[ -](\d{{4}})$", "$3|$1|$2"),
    (rf"(?i)^(?:[a-z]+day,? )?(\d{{1,2}})[ -](?:of )?{_NAME}[ ,-]+(\d{{4}})$", "$3|$2|$1"),
]


def parse_date(text: Column) -> Column:
    """The date of a text in one of the usual writings, else null.

    ISO (with or without a time), m/d/y (day first where the month can't be), month name
    first, day first, and ``Nth day of Month, Year``; ordinal endings and stray brackets
    at the end are ignored. Two-digit years are 20xx up to 68. A text must state all
    three parts: nothing is filled in from the present day.

    The first writing that matches is taken apart by one replacement.
    """
    s = F.regexp_replace(stripped(text), f"{SPACE}+", " ")
    s = F.regexp_replace(s, _ORDINAL, "$1")
    s = F.regexp_replace(s, _DAY_OF, "$1 day of")
    s = F.trim(F.regexp_replace(s, r"[(\[{,]+$", ""))

    def parted(s: Column) -> Column:
        out = None
        for pattern, order in _WRITINGS:
            found, to = s.rlike(pattern), F.regexp_replace(s, pattern, order)
            out = F.when(found, to) if out is None else out.when(found, to)
        return F.split(out, r"\|")

    return let(let(s, parted), _date_of)


def _date_of(part: Column) -> Column:
    year, month, day = part[0].try_cast("int"), part[1], part[2].try_cast("int")
    year = F.when(F.length(part[0]) > 2, year).when(year <= 68, year + 2000).otherwise(year + 1900)
    first = F.ltrim(month, F.lit("?")).try_cast("int")
    swapped = month.startswith("?") & (first > 12)
    number = F.when(swapped, day).when(first.isNotNull(), first).otherwise(month_number(month))
    zero = F.lit(0)
    return F.try_make_timestamp(year, number, F.when(swapped, first).otherwise(day), zero, zero, zero).cast("date")


def parse_money(text: Column) -> Column:
    """An amount as a double: signs of currency and thousands gone, one of M, K, B at the end
    multiplies, then one name of a currency is dropped."""

    def shortened(s: Column) -> Column:
        cut = F.when(F.substring(s, -1, 1).isin("M", "K", "B"), F.rtrim(s.substr(F.lit(1), F.length(s) - 1))).otherwise(s)
        return F.trim(F.regexp_replace(cut, " (?:USD|DOLLARS|EUROS)$", ""))

    def amount(s: Column) -> Column:
        last = F.substring(s, -1, 1)
        factor = F.when(last == "M", 1e6).when(last == "K", 1e3).when(last == "B", 1e9).otherwise(1.0)
        number = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:E[+-]?\d+)?$"
        return let(shortened(s), lambda x: F.when(x.rlike(number), x.try_cast("double") * factor))

    return let(F.regexp_replace(F.upper(stripped(text)), "[,$€£]", ""), amount)


# Fixed value: an amount of time.
DURATION = r"(?i)(\d+|[a-z][a-z-]*)\s*(?:\(\s*(\d+)\s*\))?\s*(years?|months?|weeks?|days?)"


def parse_duration(text: Column) -> Column:
    """Days of the last amount of time a text names; ``annual`` is a year."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    days = F.create_map(*[F.lit(x) for kv in DAYS_PER.items() for x in kv])

    def length(s: Column) -> Column:
        last = lambda g: F.try_element_at(F.regexp_extract_all(s, F.lit(DURATION), F.lit(g)), F.lit(-1))
        unit = F.try_element_at(days, F.regexp_replace(last(3), "s$", ""))
        named = let(last(1), lambda w: F.when(w.rlike("^[0-9]+$"), w.try_cast("int")).otherwise(F.try_element_at(words, w)))
        number = let(last(2), lambda d: F.when(d != "", d.try_cast("int")).otherwise(named))
        return F.when(s.rlike(r"\ban[n]?ual"), 365).otherwise(number * unit)

    return let(F.lower(F.regexp_replace(text, "[,.]", " ")), length)


def no_real_date(text: Column) -> Column:
    """A blank template or a mere label where a date is expected."""
    low = F.lower(text)
    named = low.rlike("|".join(MONTHS))
    return text.contains("_") | low.contains("blank") | (~named & ~low.rlike(r"\b(19|20)\d{2}\b"))


def _phrase_within(nc: Column, nt: Column, date: Column) -> Column:
    """The same on folded texts; ``date`` is that of the target."""
    explicit = nt.rlike(" (?:" + "|".join(MONTHS) + ")") | nt.rlike(r"\b\d{4}-\d{1,2}\b")
    month, day, year = F.lower(F.date_format(date, "MMMM")), F.dayofmonth(date).cast("string"), F.date_format(date, "yyyy")
    forms = F.array(F.date_format(date, "yyyy MM dd"), F.concat_ws(" ", month, day, year), F.concat_ws(" ", day, month, year))
    other = date.isNotNull() & F.exists(forms, lambda f: nc.contains(f))
    literal = nc.contains(nt) & ((F.size(F.split(nt, " ")) >= 3) | explicit)
    return F.coalesce((nc != "") & (nt != "") & (literal | other), F.lit(False))


def date_phrase_within(container: Column, target: Column) -> Column:
    """The date phrase of ``target`` stands in ``container``, as it is or in another writing."""
    return let(folded(container), lambda nc: let(folded(target), lambda nt: let(parse_date(target), lambda d: _phrase_within(nc, nt, d))))


def date_score(pred: Column, exp: Column) -> Column:
    """Score of two dates given as text; null where the fallback on similarity is due.

    Each text is parsed and folded once."""
    p, e = F.coalesce(pred, F.lit("")), F.coalesce(exp, F.lit(""))
    side = lambda t: F.struct(parse_date(t).alias("date"), folded(t).alias("text"))

    def scored(sp: Column, se: Column) -> Column:
        dp, de, tp, te = sp["date"], se["date"], sp["text"], se["text"]
        same_year, same_month = F.year(dp) == F.year(de), F.month(dp) == F.month(de)
        both = dp.isNotNull() & de.isNotNull()
        return (
            F.when(de.isNull() & no_real_date(e), F.when(stripped(p) == "", 1.0).otherwise(0.0))
            .when(both & (dp == de), 1.0)
            .when(_phrase_within(tp, te, de) | _phrase_within(te, tp, dp), 1.0)
            .when(both & same_year & same_month, 0.67)
            .when(both & (F.abs(F.datediff(dp, de)) <= 45), 0.67)
            .when(both & (same_year | same_month), 0.33)
            .when(both, 0.0)
        )

    return let(side(p), lambda sp: let(side(e), lambda se: scored(sp, se)))


# The spans of a document that may be dates.
DATE_SPANS = (
    r"(?i)\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b"
    r"|\b\d{1,2}[a-z]*(?:\s+[a-z]+)*\s+day\s+of\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*,?\s*\d{4}\b"
)


def date_grounded(date: Column, doc: Column) -> Column:
    """The document states the date in some writing."""
    spans = F.regexp_extract_all(F.coalesce(doc, F.lit("")), F.lit(DATE_SPANS), F.lit(0))
    return F.coalesce(F.exists(spans, lambda s: parse_date(s) == date), F.lit(False))


def prose_date(text: Column) -> Column:
    """A date as ``April 3, 2004``; other texts as they are."""
    prose = lambda d: F.concat(F.date_format(d, "MMMM"), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.date_format(d, "yyyy"))
    return let(parse_date(text), lambda d: F.coalesce(prose(d), text))
