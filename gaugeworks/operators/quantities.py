"""Quantities in different units, scales and languages, brought to common units.

A small grammar reads numbers (digits in either notation, fractions, number words in
four languages, a figure in brackets after its words) and unit expressions around
them: names with powers, joined by products and "per". A unit expression becomes one
:class:`Unit`, an exponent vector over base dimensions with a scale and an offset, and
:func:`convert` brings the number to the canonical unit of the dimension that is asked
for, in exact fractions; an amount of another dimension ("30 days per year") isn't
one. Amounts named together add up; amounts in clauses on notice, cure or payment
don't count. Dates are read by the same scanner or as bare numbers on a scale of days,
of which a serial day number, Unix seconds and milliseconds are units with an offset.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a worker remembers, and characters of a value beyond which it isn't.
MEMO, MEMO_CHARS = 200_000, 400

#: Base dimensions of the exponent vectors.
BASES = ("time", "length", "mass", "temperature")
TIME = (1, 0, 0, 0)
#: Locales in which the month comes first in all-numeric dates; languages with a decimal comma.
MONTH_FIRST, COMMA = ("en-US", "en-PH"), ("de", "fr", "es", "it")


@dataclass(frozen=True)
class Unit:
    """canonical = value * scale + offset, for quantities of one exponent vector."""

    dims: tuple[int, ...]
    scale: Fraction
    offset: Fraction = Fraction(0)

    def __mul__(self, other: Unit) -> Unit:
        if self.offset or other.offset:
            raise ValueError("units with an offset can't be multiplied")
        return Unit(tuple(a + b for a, b in zip(self.dims, other.dims, strict=True)), self.scale * other.scale)

    def __pow__(self, n: int) -> Unit:
        if self.offset and n != 1:
            raise ValueError("units with an offset have no powers")
        return Unit(tuple(a * n for a in self.dims), self.scale**n, self.offset)

    def canonical(self, value: Fraction) -> Fraction:
        return value * self.scale + self.offset


def convert(value: Fraction, source: Unit, target: Unit) -> Fraction:
    """``value`` of one unit in another of the same exponent vector."""
    if source.dims != target.dims:
        raise ValueError(f"{source.dims} isn't {target.dims}")
    return (source.canonical(value) - target.offset) / target.scale


#: The canonical unit of time.
DAY = Unit(TIME, Fraction(1))


def time_units(hours: dict[str, int]) -> dict[str, Unit]:
    """Units of time from their lengths in hours."""
    return {name: Unit(TIME, Fraction(n, 24)) for name, n in hours.items()}


# Scales of dates in days since 1970-01-01: units of time with an offset.
DATE_SCALES = {
    "serial_1900": Unit(TIME, Fraction(1), Fraction(-25569)),
    "unix_day": Unit(TIME, Fraction(1)),
    "unix_second": Unit(TIME, Fraction(1, 86_400)),
    "unix_milli": Unit(TIME, Fraction(1, 86_400_000)),
}

# Names of the units of time, as regular expressions, by unit and language.
UNIT_NAMES = {
    "hour": {"en": "hours?|hrs?|h", "de": "stunden?|std", "fr": "heures?", "es": "horas?"},
    "day": {"en": "days?|dys?|d", "de": "tag(?:e[ns]?|s)?", "fr": "jours?|j", "es": "d[ií]as?"},
    "week": {"en": "weeks?|wks?|w", "de": "wochen?", "fr": "semaines?", "es": "semanas?"},
    "fortnight": {"en": "fortnights?", "fr": "quinzaines?", "es": "quincenas?"},
    "month": {"en": "months?|mths?|mos?|m", "de": "monat(?:e[ns]?|s)?", "fr": "mois", "es": "mes(?:es)?"},
    "quarter": {"en": "quarters?|qtrs?|qrs?|q", "de": "quartal(?:e[ns]?|s)?|vierteljahre?", "fr": "trimestres?", "es": "trimestres?"},
    "year": {"en": "years?|yrs?|y", "de": "jahr(?:e[ns]?|s)?", "fr": "ans?|ann[ée]es?", "es": "años?|anos?"},
    "decade": {"en": "decades?", "de": "jahrzehnte?[ns]?", "fr": "décennies?", "es": "d[ée]cadas?"},
}
# Words that mean one of a unit.
ONE_OF = {
    "hour": "hourly|stündlich", "day": "daily|täglich", "week": "weekly|wöchentlich", "fortnight": "fortnightly",
    "month": "monthly|monatlich", "quarter": "quarterly|vierteljährlich", "year": "annual(?:ly)?|anual(?:mente)?|yearly|jährlich|annuel(?:le)?",
    "decade": "decennial",
}
# Number words. Each language has its units, teens and tens.
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve",
}
TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety",
    "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig",
    "fr": "vingt trente quarante cinquante soixante soixante-dix quatre-vingt quatre-vingt-dix",
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa",
}
HUNDRED = {"en": "hundred", "de": "hundert", "fr": "cent", "es": "cien"}
ONES = {"en": ("a", "an", "one"), "de": ("ein", "eine", "einem", "einer", "eines", "einen"), "fr": ("un", "une"), "es": ("un", "una")}
ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth "
    "seventeenth eighteenth nineteenth twentieth"
)
MONTH_NAMES = {
    1: "jan(?:uary|uar)?|jänner|janvier|enero|ene", 2: "feb(?:ruary|ruar)?|f[ée]vrier|f[ée]vr?|febrero", 3: "mar(?:ch|s|zo)?|märz|mrz",
    4: "apr(?:il)?|avril|avr|abril|abr", 5: "may|mai|mayo", 6: "june?|juni|juin|junio", 7: "july?|juli|juillet|juil|julio",
    8: "aug(?:ust)?|ao[ûu]t|agosto|ago", 9: "sep(?:t(?:ember)?)?|septembre|septiembre", 10: "o[ck]t(?:ober)?|octobre|octubre",
    11: "nov(?:ember)?|novembre|noviembre", 12: "de[cz](?:ember)?|d[ée]cembre|d[ée]c|diciembre|dic",
}
# Where a clause begins, and words of clauses that state no term.
CLAUSE = r";|,\s|\bunless\b|\(\s*(?![\d.,]+\s*\))|\bwith an?\b|\beither party\b|\bprovided\b|\bsubject to\b|\bupon (?=[^,;]*notice)|\bon (?=[^,;]*notice)|\bexcept\b"
NO_TERM = r"\b(?:notice|cure|remedy|remedied|payment|payable|pays?|paid|invoices?|grace)\b|kündigung|zahlung|préavis|paiement|preaviso|pago"


def _fold(text: str) -> str:
    if text.isascii():
        return " ".join(text.split())
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"[\u200b-\u200d\ufeff]", "", text).replace("’", "'").replace("⁄", "/")
    return re.sub(r"\s+", " ", text.replace("–", "-").replace("—", "-").replace("−", "-")).strip()


def _words() -> dict[str, tuple[int, str]]:
    found: dict[str, tuple[int, str]] = {}
    for lang, names in NUMBER_WORDS.items():
        for n, w in enumerate(names.split()):
            found[w] = (n, lang)
        for k, w in enumerate(TENS[lang].split()):
            found[w] = (20 + 10 * k, lang)
        for w in ONES[lang]:
            found.setdefault(w, (1, lang))
    small = NUMBER_WORDS["de"].split()
    for k, ten in enumerate(TENS["de"].split()):
        for n in range(1, 10):
            found[("ein" if n == 1 else small[n]) + "und" + ten] = (20 + 10 * k + n, "de")
    for n, w in enumerate(NUMBER_WORDS["es"].split()[1:10], 1):
        found["veinti" + w] = (20 + n, "es")
    plain = {unicodedata.normalize("NFD", w): v for w, v in found.items()}
    for w, v in plain.items():
        found.setdefault("".join(c for c in w if not unicodedata.combining(c)), v)
        found.setdefault("".join(c for c in w if not unicodedata.combining(c)).replace("ß", "ss"), v)
    return found


WORDS = _words()
_JOIN = {"and", "und", "et", "y"}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def number_of_words(words: list[str]) -> int | None:
    """The number that words such as ``one hundred eighty`` spell; None if they spell none."""
    total, current, seen = 0, 0, False
    parts: list[str] = []
    for w in words:
        parts += [w] if w in WORDS else w.split("-")
    for w in parts:
        if w in WORDS:
            current += WORDS[w][0]
            seen = True
        elif w in ("hundred", "hundert", "cent", "cents", "cien", "ciento"):
            current = max(1, current) * 100
            seen = True
        elif w in ("thousand", "tausend", "mille", "mil"):
            total, current, seen = total + max(1, current) * 1000, 0, True
        elif w not in _JOIN:
            return None
    return total + current if seen else None


def number_of_digits(text: str, comma: bool) -> Fraction | None:
    """``1,095`` ``0,6`` ``7.5`` ``2 1/2``; ``comma`` tells that a comma is the decimal sign."""
    text = text.strip().replace(" ", "").replace("'", "")
    if comma:
        text = re.sub(r"\.(?=\d{3}(?:\D|$))", "", text).replace(",", ".")
    else:
        text = re.sub(r",(?=\d{3}(?:\D|$))", "", text).replace(",", ".")
    try:
        return Fraction(text)
    except (ValueError, ZeroDivisionError):
        return None


_UNIT = {f"{u}_{lang}": names for u, langs in UNIT_NAMES.items() for lang, names in langs.items()}
_UNIT_RE = "|".join(f"(?P<{n}>{p})" for n, p in _UNIT.items())
_DIGITS = r"\d+(?:[.,]\d+)*"
_WORD_NUMBER = r"[^\W\d_]+(?:[\s-]+[^\W\d_]+){0,6}?"
_AMOUNT = re.compile(
    rf"(?<![\w.,])(?:(?P<whole>\d+)\s+(?P<num>\d+)\s*/\s*(?P<den>\d+)|(?P<num2>\d+)\s*/\s*(?P<den2>\d+)|(?P<digits>{_DIGITS}))\)?[\s-]*(?:{_UNIT_RE})(?![^\W_])\.?",
    re.I,
)
_UNIT_FIRST = re.compile(rf"(?<![^\W_])(?:\[\s*)?(?:{_UNIT_RE})\s*(?:\]|[:=])\s*(?P<digits>{_DIGITS})(?![\w])", re.I)
_SPELT = re.compile(rf"(?<![^\W\d_])(?P<unit>{'|'.join(f'(?P<{n}>{p})' for n, p in _UNIT.items() if True)})(?![^\W_])", re.I)
_ISO = re.compile(r"^P(?=.)(?:(\d+(?:[.,]\d+)?)Y)?(?:(\d+(?:[.,]\d+)?)M)?(?:(\d+(?:[.,]\d+)?)W)?(?:(\d+(?:[.,]\d+)?)D)?(?:T(?:(\d+(?:[.,]\d+)?)H)?)?$", re.I)
_BARE = re.compile(rf"^(?:(?:the\s+)?(?:initial\s+)?(?:term|renewal|duration|laufzeit|durée|plazo|duración)s?(?:\s+of)?\s*[:=]?\s*)?(?P<digits>[+]?{_DIGITS})$", re.I)
_ONE_OF = re.compile("|".join(rf"(?P<{u}>\b(?:{p})\b)" for u, p in ONE_OF.items()), re.I)
_HALF = re.compile(r"\b(?P<n>[^\W\d_]+|\d+)\s+and\s+(?:a|one)\s+half\b", re.I)
_HALF_A = re.compile(r"\bhalf\s*(?:an?\s+|-\s*)(?=[^\W\d_]+)", re.I)
_DOZEN = re.compile(r"\b(?P<half>half\s+)?(?:an?\s+|(?P<n>one|two|three|\d+)\s+)?dozens?\b", re.I)
_RECORD = re.compile(r"""^\{\s*"value"\s*:\s*"?(?P<n>[\d.,]+)"?\s*,\s*"unit"\s*:\s*"(?P<u>[^"]+)"\s*\}$|^\{\s*"unit"\s*:\s*"(?P<u2>[^"]+)"\s*,\s*"value"\s*:\s*"?(?P<n2>[\d.,]+)"?\s*\}$""", re.I)
_DIGIT, _LABELLED = re.compile(r"\d"), re.compile(r"[\]:=]")
_CLAUSE, _NO_TERM = re.compile(CLAUSE, re.I), re.compile(NO_TERM, re.I)


#: What may follow a unit's name in a unit expression.
_POWER = re.compile(r"\s?(?:(?:\^|\*\*)\s?(?P<n>[+-]?\d{1,2})|(?P<sup>[²³]))")
_LINK = re.compile(r"\s?(?:(?P<times>[·×*])|(?P<over>/)|\bper\b(?<=per))\s?", re.I)
_NAME_HERE = re.compile(rf"(?:{_UNIT_RE})(?![^\W_])\.?", re.I)
_PLAIN_NAME = re.compile(r"[^\W\d_²³]+|°\s?[^\W\d_²³]+|%")
_QUANTITY = re.compile(rf"\s*(?P<n>[+-]?(?:\d+\s+\d+\s*/\s*\d+|\d+\s*/\s*\d+|{_DIGITS}))\s*(?P<unit>\S.*?)?\s*", re.S)


def _unit(m: re.Match) -> tuple[str, str]:
    """(unit, language) of a match of one of the patterns above."""
    name = m.lastgroup
    if name not in _UNIT:
        name = next(k for k in _UNIT if m.group(k))
    return tuple(name.split("_"))


def _power(text: str, at: int, unit: Unit) -> tuple[Unit, int]:
    if m := _POWER.match(text, at):
        return unit ** (int(m["n"]) if m["n"] else "²³".index(m["sup"]) + 2), m.end()
    return unit, at


def unit_expression(text: str, at: int, first: Unit, named) -> tuple[Unit, int]:
    """The unit of an expression whose first name ends at ``at``, and where it ends: powers,
    and further names joined by a product or by "per". ``named`` gives (unit, end) of the
    name at a position, or None. A unit with an offset stands alone."""
    unit, at = _power(text, at, first)
    while (link := _LINK.match(text, at)) and (more := named(text, link.end())):
        other, end = _power(text, more[1], more[0])
        unit, at = unit * other ** (1 if link["times"] else -1), end
    return unit, at


def parse_unit(text: str, units: dict[str, Unit]) -> Unit | None:
    """The unit that a whole text such as ``kg*m/s^2`` means; None if it means none."""

    def named(t: str, at: int) -> tuple[Unit, int] | None:
        m = _PLAIN_NAME.match(t, at)
        found = m and (units.get(m[0]) or units.get(m[0].lower()))
        return (found, m.end()) if found else None

    text = text.strip()
    try:
        if (first := named(text, 0)) is None:
            return None
        unit, end = unit_expression(text, first[1], first[0], named)
    except ValueError:
        return None
    return unit if end == len(text) else None


def quantity(text: str | None, units: dict[str, Unit], comma: bool = False) -> tuple[Fraction, tuple[int, ...]] | None:
    """(canonical value, exponent vector) of a text that is a number and a unit expression of
    any dimension; None for other texts."""
    m = _QUANTITY.fullmatch(text) if text else None
    unit = parse_unit(m["unit"], units) if m and m["unit"] else None
    if unit is None:
        return None
    *whole, last = m["n"].split()
    n = Fraction(last) if "/" in last and not last.endswith("/0") else number_of_digits(m["n"], comma)
    return None if n is None else (unit.canonical(n + (int(whole[0]) if whole else 0)), unit.dims)


def _time_name(units: dict[str, Unit]):
    """The ``named`` of :func:`unit_expression` for the names of the units of time."""

    def named(text: str, at: int) -> tuple[Unit, int] | None:
        m = _NAME_HERE.match(text, at)
        unit = units.get(_unit(m)[0]) if m else None
        return (unit, m.end()) if unit else None

    return named


def stated_clauses(text: str) -> list[str]:
    """The clauses of a text that may state a term."""
    cuts = [0, *(m.start() for m in _CLAUSE.finditer(text)), len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [p for p in parts if not _NO_TERM.search(p)]


def _days(n: Fraction | int, unit: Unit | None) -> Fraction | None:
    """``n`` of a unit in days; None for no unit and for one that isn't a length of time."""
    if unit is None or unit.dims != TIME:
        return None
    return convert(Fraction(n), unit, DAY)


def duration(value: str, locale: str | None, bare_unit: str | None, units: dict[str, Unit], comma_in: tuple[str, ...] = COMMA) -> Fraction | None:
    """The length of time a text states, in days; None if it states none.

    ``units`` are the units of time by name, ``bare_unit`` that of a number without one.
    """
    text = _fold(value).strip("~;:.* \"'").strip()
    comma = (locale or "en")[:2] in comma_in
    if text[:1] in "Pp" and (m := _ISO.fullmatch(text.replace(" ", ""))):
        names = ("year", "month", "week", "day", "hour")
        found = [_days(number_of_digits(g.replace(",", "."), False), units.get(u)) for g, u in zip(m.groups(), names, strict=True) if g]
        return sum(found) if found and None not in found else None
    if text[:1] == "{" and (m := _RECORD.fullmatch(text)):
        text, comma = f"{m['n'] or m['n2']} {m['u'] or m['u2']}", False
    if m := _BARE.fullmatch(text):
        n = number_of_digits(m["digits"].lstrip("+"), comma and "," in m["digits"])
        return None if n is None else _days(n, units.get(bare_unit))
    named, amounts = _time_name(units), []
    for clause in stated_clauses(text):
        clause = clause.replace("_", " ")
        if "ozen" in clause or "OZEN" in clause:
            clause = _DOZEN.sub(lambda m: str((6 if m["half"] else 12) * (int(m["n"]) if (m["n"] or "").isdigit() else WORDS.get((m["n"] or "one").lower(), (1,))[0])), clause)
        if "alf" in clause or "ALF" in clause:
            clause = _HALF.sub(lambda m: f"{m['n'] if m['n'].isdigit() else WORDS.get(m['n'].lower(), (m['n'],))[0]} 1/2", clause)
            clause = _HALF_A.sub("1/2 ", clause)
        taken: list[tuple[int, int]] = []

        def add(m: re.Match, n: Fraction | int | None, unit: Unit | None, clause: str = clause, taken: list = taken) -> None:
            """Counts an amount with the unit expression that begins at its unit's name."""
            if n is None or unit is None:
                return
            unit, end = unit_expression(clause, m.end(), unit, named)
            taken.append((m.start(), end))
            if (days := _days(n, unit)) is not None:
                amounts.append(days)

        digits = _DIGIT.search(clause) is not None
        for pattern, due in ((_UNIT_FIRST, digits and _LABELLED.search(clause)), (_AMOUNT, digits)):
            for m in pattern.finditer(clause) if due else ():
                if any(m.start() < e and m.end() > s for s, e in taken):
                    continue
                unit, lang = _unit(m)
                g = m.groupdict()
                if g.get("whole"):
                    n = Fraction(int(g["whole"])) + (Fraction(int(g["num"]), int(g["den"])) if int(g["den"]) else 0)
                elif g.get("num2"):
                    n = Fraction(int(g["num2"]), int(g["den2"])) if int(g["den2"]) else None
                else:
                    n = number_of_digits(g["digits"], lang != "en")
                add(m, n, units.get(unit))
        # spelt-out numbers stand before their unit's name; an amount that is the whole clause leaves none
        for m in _SPELT.finditer(clause) if not taken or taken[0] != (0, len(clause)) else ():
            if any(m.start() < e and m.end() > s for s, e in taken) or len(m.group()) < 2:
                continue
            before = clause[: m.start()].rstrip(" -").lower()
            words = _WORD.findall(before)[-8:]
            if before and words and before.endswith(words[-1]):
                best = None
                for k in range(1, len(words) + 1):
                    tail = words[-k:]
                    if re.search(r"[.,;:()\d]", before[before.rfind(tail[0]) :]):
                        break
                    if tail[0] in _JOIN:
                        continue
                    n = number_of_words(tail)
                    if n is None:
                        break
                    best = n
                add(m, best, units.get(_unit(m)[0]))
        if not taken and (m := _ONE_OF.search(clause)):
            add(m, 1, units.get(m.lastgroup))
    return sum(amounts) if amounts else None


_M = "|".join(f"(?P<m{k}>{p})" for k, p in MONTH_NAMES.items())
_ORD = {w: i for i, w in enumerate(ORDINALS.split(), 1)} | {f"twenty-{w}": 20 + i for i, w in enumerate(ORDINALS.split()[:9], 1)} | {"thirtieth": 30, "thirty-first": 31}
_O = "|".join(sorted(_ORD, key=len, reverse=True))
_DAY = rf"(?:(?P<day>\d{{1,2}})(?:st|nd|rd|th|er|º|\.)?|(?P<ord>{_O}))"
_DATES = [
    ("ymd", re.compile(r"(?<!\d)(?P<y>\d{4})([-/.])(?P<mo>\d{1,2})\2(?P<d>\d{1,2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?(?![\d])", re.I)),
    ("week", re.compile(r"(?<!\d)(?P<y>\d{4})-?W(?P<w>\d{2})-?(?P<wd>[1-7])(?!\d)", re.I)),
    ("yday", re.compile(r"(?<!\d)(?P<y>\d{4})-(?P<yd>\d{3})(?!\d)")),
    ("num", re.compile(r"(?<![\d.])(?P<a>\d{1,2})\s?([-/.])\s?(?P<b>\d{1,2})\s?\2\s?(?P<y>\d{4}|\d{2})(?!\d)")),
    ("dmy", re.compile(rf"(?<![\w]){_DAY}(?:\s+day)?[\s-]*(?:of\s+|de\s+)?\s*(?:{_M})\.?(?![^\W\d_])[\s,-]*(?:of\s+|de\s+|del\s+)?(?P<y>\d{{4}}|'?\d{{2}}(?!\d))", re.I)),
    ("mdy", re.compile(rf"(?<![^\W\d_])(?:{_M})\.?[\s-]+{_DAY}[\s,-]+(?P<y>\d{{4}})(?!\d)", re.I)),
    ("compact", re.compile(r"(?<!\d)(?P<y>(?:19|20)\d{2})(?P<mo>0[1-9]|1[0-2])(?P<d>0[1-9]|[12]\d|3[01])(?!\d)")),
]
_SIGNED = re.compile(r"\b(?:signed|executed|signature|unterzeichnet|unterschrieben|signé|firmado)\b", re.I)
_EFFECTIVE = re.compile(r"effective|commenc|in force|wirksam|in kraft|effet|vigor|vigencia|begin", re.I)
_EPOCH = datetime.date(1970, 1, 1)


#: What any full date has: a year of four digits, digits around a separator, or a word before two digits.
_DATE_HINT = re.compile(r"\d{4}|\d\s?[-/.]\s?\d|[^\W\d_]{3}[\s.,'-]*(?:(?:of|del?)\s+)?'?\d\d(?!\d)", re.I)


def dates_in(text: str, locale: str | None, month_first: tuple[str, ...] = MONTH_FIRST) -> list[tuple[int, int, int]]:
    """(start, end, days since 1970-01-01) of the full dates in a folded text."""
    found: list[tuple[int, int, int]] = []
    if not _DATE_HINT.search(text):
        return found
    for kind, pattern in _DATES:
        if found and found[0][0] == 0 and found[0][1] == len(text):
            return found
        for m in pattern.finditer(text):
            if any(m.start() < e and m.end() > s for s, e, _ in found):
                continue
            g = m.groupdict()
            year = int(g["y"].strip("'"))
            year += 2000 if year < 100 else 0
            try:
                if kind == "yday":
                    day = datetime.date(year, 1, 1) + datetime.timedelta(int(g["yd"]) - 1)
                    if day.year != year:
                        continue
                elif kind == "week":
                    day = datetime.date.fromisocalendar(year, int(g["w"]), int(g["wd"]))
                elif kind == "num":
                    a, b = int(g["a"]), int(g["b"])
                    month, dom = (a, b) if locale in month_first else (b, a)
                    day = datetime.date(year, month, dom)
                elif kind in ("ymd", "compact"):
                    day = datetime.date(year, int(g["mo"]), int(g["d"]))
                else:
                    month = next(k for k in MONTH_NAMES if g[f"m{k}"])
                    day = datetime.date(year, month, int(g["day"]) if g["day"] else _ORD[g["ord"].lower()])
            except ValueError:
                continue
            found.append((m.start(), m.end(), (day - _EPOCH).days))
    return sorted(found)


def single_day(value: str, locale: str | None, scale: str | None, month_first: tuple[str, ...] = MONTH_FIRST) -> int | None:
    """Days since 1970-01-01 of the one day that a text fixes; None if it fixes none.

    A bare number is on ``scale``. Days of signing don't count where another is named.
    """
    text = _fold(value).strip("~; ")
    if m := re.fullmatch(r"([+-]?\d+(?:[.,]\d+)?)", text):
        n = Fraction(m[1].replace(",", "."))
        if scale == "yyyymmdd":
            try:
                return (datetime.datetime.strptime(str(int(n)), "%Y%m%d").date() - _EPOCH).days
            except ValueError:
                return None
        if scale not in DATE_SCALES:
            return None
        days = convert(n, DATE_SCALES[scale], DAY)
        return days.numerator // days.denominator
    found = dates_in(text, locale, month_first)
    days = {d for _, _, d in found}
    if len(days) > 1:
        told: dict[int, list[str]] = {}
        cut = 0
        for s, e, d in found:
            told.setdefault(d, []).append(text[cut:s])
            cut = e
        effective = {d for d, said in told.items() if any(_EFFECTIVE.search(x) for x in said)}
        unsigned = {d for d, said in told.items() if not all(_SIGNED.search(x) for x in said)}
        days = effective if len(effective) == 1 else unsigned
    elif found and _SIGNED.search(text) and not _EFFECTIVE.search(text):
        return None
    return next(iter(days)) if len(days) == 1 else None


class Reader:
    """Reads values with the units of their site, and remembers them."""

    def __init__(self, sites: dict[int, tuple[str | None, str | None, str | None]], hours: dict[str, int], month_first: tuple[str, ...] = MONTH_FIRST, comma: tuple[str, ...] = COMMA):
        self.sites, self.units, self.month_first, self.comma = sites, time_units(hours), month_first, comma
        self._memo: dict[tuple, tuple[int | None, int | None]] = {}

    def read(self, kind: str, value: str | None, site: int | None) -> tuple[int | None, int | None]:
        """(days, last day): at most one of both. kind is length, term or date."""
        if value is None or not value.strip():
            return None, None
        locale, unit, scale = self.sites.get(site, (None, None, None))
        key = (kind, value, locale, unit, scale)
        found = self._memo.get(key)
        if found is None:
            found = self._read(*key)
            if len(value) <= MEMO_CHARS:
                if len(self._memo) >= MEMO:
                    self._memo.clear()
                self._memo[key] = found
        return found

    def _read(self, kind: str, value: str, locale: str | None, unit: str | None, scale: str | None) -> tuple[int | None, int | None]:
        if kind == "date":
            return single_day(value, locale, scale, self.month_first), None
        text = _fold(value)
        dates = [] if re.fullmatch(r"[~\s]*[\d.,]+[;\s]*", text) else dates_in(text, locale, self.month_first)
        if dates:
            last = {d for _, _, d in dates}
            rest = text
            for s, e, _ in reversed(dates):
                rest = rest[:s] + " " + rest[e:]
            length = duration(rest, locale, None, self.units, self.comma)
            if length is None:
                return None, dates[-1][2] if kind == "term" and len(last) == 1 else None
            return round(length), None
        length = duration(value, locale, unit, self.units, self.comma)
        return (None if length is None else round(length)), None


_READERS: dict[str, Reader] = {}


def _reader(key: str, *settings) -> Reader:
    """The reader of these settings, one per worker, so that tasks share what it remembers."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(*settings)
    return _READERS[key]


def with_days(
    df: DataFrame, kind: str, value: str, site: str, sites: dict, hours: dict[str, int], month_first: tuple[str, ...] = MONTH_FIRST, comma: tuple[str, ...] = COMMA
) -> DataFrame:
    """``df`` with ``days`` and ``last_day``, read from ``value`` by a :class:`Reader`.

    ``kind`` names the column with length, term or date. ``sites`` (id -> locale, unit of bare
    numbers, scale of bare dates) and ``hours`` are small and fixed; the caller checks
    their size. ``month_first`` are the locales of dates such as 12/31/2024, ``comma`` the
    languages with a decimal comma. Null, blank and senseless values and
    unknown sites give null; columns of these two names are replaced.
    """
    df = df.drop("days", "last_day")
    shared = df.sparkSession.sparkContext.broadcast((sites, hours, month_first, comma))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "days bigint", "last_day bigint"])
    columns, of = df.columns, hashlib.sha1(repr((sites, hours, month_first, comma)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(of, *shared.value)
        at = [columns.index(c) for c in (kind, value, site)]
        for batch in batches:
            found = [reader.read(*row) for row in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            days, last = zip(*found, strict=True) if found else ((), ())
            arrays = [*batch.columns, pa.array(list(days), pa.int64()), pa.array(list(last), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "days", "last_day"])

    return df.mapInArrow(run, schema)


def site_units(sites: DataFrame, units: DataFrame, limit: int = 100_000) -> tuple[dict, dict[str, int]]:
    """The two small tables as dictionaries, their size checked."""
    from gaugeworks.runtime import bounded_rows

    rows = bounded_rows(sites.select("site_id", "locale", "duration_unit", "date_scale"), limit, "sites")
    lengths = bounded_rows(units.select("unit", "hours"), limit, "duration units")
    return {r[0]: (r[1], r[2], r[3]) for r in rows}, {r[0]: int(r[1]) for r in lengths if r[0] is not None and r[1] is not None}


def lengths_from_last_days(df: DataFrame, extraction: str, side: str, is_start: str) -> DataFrame:
    """``days`` of rows with a ``last_day``, counted from the start date on the same side of
    the same extraction. Start rows are those where ``is_start`` holds; of several the one
    of the smallest row id counts. Only rows with a last day meet the start dates.

    ``df`` is read three times; the caller materialises what was dear to make."""
    starts = (
        df.where(F.col(is_start) & F.col("days").isNotNull() & F.col(extraction).isNotNull())
        .groupBy(extraction, side)
        .agg(F.min_by("days", "row_id").alias("__start"))
    )
    open_ = df.where("last_day is not null").join(starts, [extraction, side]).withColumn("days", F.col("last_day") - F.col("__start")).drop("__start")
    return df.where("last_day is null").unionByName(open_)


def with_canonical(df: DataFrame, value: str, units: dict[str, Unit], out: str = "quantity", comma: bool = False) -> DataFrame:
    """``df`` with ``out``, a struct of the canonical value (double) and the exponent vector
    over :data:`BASES` of the quantity that ``value`` states, of whatever dimension.

    ``units`` are the known units by name; names are tried as written, then in lower case.
    Null, blank and senseless values and unknown units give null; a column named ``out``
    is replaced."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast((units, comma))
    columns, at = df.columns, df.columns.index(value)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` struct<value: double, dims: array<int>>"])
    kind = pa.struct([("value", pa.float64()), ("dims", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, decimal_comma = shared.value
        for batch in batches:
            found = [quantity(v, known, decimal_comma) for v in batch.column(at).to_pylist()]
            rows = [None if q is None else {"value": float(q[0]), "dims": list(q[1])} for q in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*columns, out])

    return df.mapInArrow(run, schema)
