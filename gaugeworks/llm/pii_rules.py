"""Patterns of personal data: weak labels to train on, and exact checks of found spans.

The labeller marks spans whose form and surroundings leave no doubt; the tagger learns
from its labels and generalises. After tagging, a span of a kind is snapped to the
form it overlaps, or dropped if it has none.
"""

from __future__ import annotations

import re
from collections import Counter

KINDS = ("email", "phone", "id_number", "address", "name")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:@| ?\( ?at ?\) ?| ?\[ ?at ?\] ?| @ | at )"
_DOT = r"(?:\.| ?\( ?dot ?\) ?| ?\[ ?dot ?\] ?| dot )"
EMAIL = re.compile(
    rf"(?<![\w.+'’%-])[A-Za-z0-9_][\w.+'’%-]*(?:(?:@| @ | ?\( ?at ?\) ?| ?\[ ?at ?\] ?){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}| at {_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,}})(?![\w@-])"
)
_S = r"[ .\-/]"
PHONE = re.compile(
    r"(?<![\w.,/+$€£-])(?:"
    r"\+\d{1,3}[ .\-]?(?:\(0\)[ ]?)?(?:\d[ .\-/]?){6,11}\d"
    r"|00[1-9]\d{0,2}[ .\-](?:\d[ .\-]?){6,10}\d"
    r"|1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}"
    r"|0\d{3,4}[ /]\d{5,8}|0\d{2}[ /]\d{4} \d{4}|0\d{2}[ /]\d{7,8}|0\d{2} \d{5} \d{3}|0\d(?: \d{2}){4}|\d{10}|07\d{9}"
    r")(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w/]|[.,\-]\d)"
)
ID = re.compile(
    r"(?<![\w.,/$€£+-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}"
    r"|[A-Z]\d{3}-\d{4}-\d{4}"
    r"|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{8}-?[A-Z]|[XYZ]\d{7}-?[A-Z]?|[A-Z]{1,2}\d{7}"
    r"|\d{2} \d{3} \d{3} \d{3}|\d{11}"
    r"|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?"
    r")(?![\w/]|-\d|[.,]\d)"
)
_ID_CUE = re.compile(
    r"(?:SSN|social security|soc\. ?sec|taxpayer|tax id|tax identifier|Steuer|DNI|NIE|NIF|passport|driving licen[cs]e|driver'?s licen[cs]e|DL ?#?|national insurance|NI no|national identity|identity card|personal|insurance number|Ausweis|Reisepass|passeport|pasaporte|\bID\b)[^\n]{0,24}$",
    re.I,
)
_NOT_ID = re.compile(r"(?:invoice|ref|sku|isbn|isbn-like|order|docket|checksum|ticket|account|version|build|run|page|plot)(?:\s*(?:no|nr|number|id))?[.:#]*\s*$", re.I)

_STREET = r"(?:Street|St\.|Avenue|Ave\.?|Road|Rd\.?|Blvd\.?|Boulevard|Lane|Ln\.?|Mews|Close|Drive|Dr\.|Court|Ct\.|Way|Terrace|Place|Pl\.|Square|Row|Walk|Quay|Wharf|Hill|Crescent)"
_W = r"[A-ZÀ-Þ][\w'’]*"
_TOWN = rf"{_W}(?:[ -]{_W}){{0,2}}"
_PLACE = rf"{_W}(?:-[\w'’]+)*"
_CODE = r"(?:,? [A-Z]{2} \d{5}(?:-\d{4})?| [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}| \d{5})"
_ROOM = r"(?:Apt\.?|Apartment|Suite|Ste\.?|Floor|Fl\.?|Unit|Flat|Room|No\.) ?\w+"
_GAP = r"(?:,\s*|\s*\n\s*| )"
ADDRESS = re.compile(
    rf"(?<![\w/-])(?:{_ROOM}, )?\d{{1,5}}[A-Za-z]? (?:{_W} ){{1,4}}{_STREET}(?:, {_ROOM})?{_GAP}{_TOWN}{_CODE}"
    rf"|(?<![\w/-])(?:{_ROOM}, )?\d{{1,5}}[A-Z]? (?:[A-Z'’]+ ){{1,4}}(?:STREET|ROAD|AVENUE|LANE|CLOSE|MEWS|BLVD|DRIVE|WAY){_GAP}[A-Z]+(?: [A-Z]+)?{_CODE}"
    rf"|(?<![\w/-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|quai|avenue|boulevard|place|allée|chemin|impasse|cours|route)(?: (?:de |du |des |la |le |les |l'|d')*){_W}(?:[ -](?:{_W}|de|du|des|la))*{_GAP}\d{{5}} {_PLACE}"
    rf"|(?<![\w/-])(?:C/|Calle|Avda\.?|Avenida|Plaza|Paseo|Pza\.?|Camino|Ronda|Travesía)(?: (?:de |del |la |las |los |el )*){_W}(?:[ -](?:{_W}|de|del|la|las|los))*, (?:n\.?º ?)?\d{{1,4}}[a-z]?(?:, ?\d{{1,2}}[ºª°] ?(?:[A-Z]|izq\.?|dcha\.?)?)?{_GAP}\d{{5}} {_PLACE}"
    rf"|(?<![\w/-]){_W}(?:[ -]{_W}){{0,2}}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|Straße|Str\.|Weg|Platz|Gasse) \d{{1,4}} ?[a-z]?{_GAP}\d{{5}} {_PLACE}"
)
# Words after a surname that make it a company's or a place's, and words before a person's name.
COMPANY = re.compile(
    r"[ ,]{1,2}(?:Holdings|Robotics|Biologics|Foods|GmbH|AG|Systems|Textiles|Media|Logistics|Freight|Energy|& |and Sons|Inc\b|Ltd\b|LLC|PLC|LP\b|Corp|Co\.|S\.A\.|Partners|Group|Wharf|Street|Road|Lane|Quay|Close|Mews|Hill|Ave|Blvd|St\.)"
)
TITLES = r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Sir|Dame|Judge|Justice|Frau|Herr|Señora?|Sra|Sr|Mme|Mlle|M|Me|Maître|Madame|Monsieur|Don|Doña|Hon|Rev)\.?"
PARTICLE = r"(?:van der|van den|van de|von der|von|van|de la|de los|del|de|di|da|le|la|zu|ter)"


class NameForms:
    """Word forms of person names, from a lexicon of given names and surnames.

    Names of a lexicon share beginnings and endings; a word made of a common beginning and
    a common ending of one kind counts as a name of that kind, whether listed or not.
    """

    def __init__(self, names: list[tuple[str, str]], least: int = 2):
        self.given = self._form([n for n, k in names if k == "given"], least)
        self.surname = self._form([n for n, k in names if k == "surname"], least)
        g, s = f"(?:{self.given})", f"(?:{self.surname})"
        sur = rf"(?:{PARTICLE} )?{s}(?:-{s})?"
        initial = r"(?:[A-Z]\. ?)"
        body = rf"{g}(?:-{g})?(?: {initial}+)?\s{sur}|{g} {initial}?{sur}|{sur}, {g}(?: {initial})?|{initial}{{1,2}}\s?{sur}|{sur}|{g}"
        self.any_case = re.compile(rf"(?<![\w@'’.+-])(?:{body})(?![\w@-]|'(?!s\b)|\.\w)", re.I)
        self.single = re.compile(rf"(?:{s}|{g})", re.I)
        self.two = re.compile(rf"(?:{g}(?: {initial})? {sur}|{sur}, {g}(?: {initial})?)", re.I)

    @staticmethod
    def _form(names: list[str], least: int) -> str:
        heads, tails = Counter(), Counter()
        for n in names:
            for i in range(2, len(n) - 1):
                heads[n[:i]] += 1
                tails[n[i:]] += 1
        first, last = set(), set()
        for n in names:
            ways = [(min(heads[n[:i]], 8) * min(tails[n[i:]], 8), -i) for i in range(2, len(n) - 1)]
            if not ways:
                continue
            i = -max(ways)[1]
            if tails[n[i:]] >= least and (heads[n[:i]] >= least or tails[n[i:]] >= 2 * least):
                first.add(n[:i])
                last.add(n[i:])
        order = lambda x: "|".join(sorted(map(re.escape, x), key=lambda w: (-len(w), w)))
        made = f"(?:{order(first)})(?:{order(last)})|" if first else ""
        return f"{made}{order(names)}" if names else "(?!)"


def _free(taken: list[tuple[int, int, str]], start: int, end: int) -> bool:
    return not any(start < e and end > s for s, e, _ in taken)


def weak_labels(text: str, forms: NameForms) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the spans that leave no doubt, in order."""
    out: list[tuple[int, int, str]] = []
    for m in EMAIL.finditer(text):
        out.append((m.start(), m.end(), "email"))
    for m in ADDRESS.finditer(text):
        if _free(out, m.start(), m.end()):
            out.append((m.start(), m.end(), "address"))
    for m in ID.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        nine = re.fullmatch(r"\d{9}|\d{11}|\d{3} \d{2} \d{4}|[A-Z]{1,2}\d{7}|\d{2} \d{3} \d{3} \d{3}", m.group())
        if not _free(out, m.start(), m.end()) or _NOT_ID.search(before[-22:]):
            continue
        near = before[-1:] in "(|" or text[m.end() : m.end() + 1] in ")|"
        if nine and re.fullmatch(r"\d{9}|\d{11}", m.group()) and not (_ID_CUE.search(before) or near):
            continue
        out.append((m.start(), m.end(), "id_number"))
    for m in PHONE.finditer(text):
        before = text[max(0, m.start() - 22) : m.start()]
        if _free(out, m.start(), m.end()) and not re.search(r"(?:Ref\.?|SKU|Invoice no\.|ISBN-like|checksum) *$", before) and not re.match(r"/\d", text[m.end() : m.end() + 2]):
            out.append((m.start(), m.end(), "phone"))
    for m in forms.any_case.finditer(text):
        found = m.group()
        start, end = m.start(), m.end()
        if not _free(out, start, end) or COMPANY.match(text[end : end + 14]):
            continue
        if found.islower() and not forms.two.fullmatch(found):
            continue
        if re.match(r" ?(?:@|\(at\)|\[at\])", text[end : end + 5]):
            continue
        out.append((start, end, "name"))
    return sorted(out)


_TRIM_L = re.compile(rf"^(?:{TITLES}\s+|[\s,;:.(\[{{\"'<|/-]+)+")
_TRIM_R = re.compile(r"(?:['’]s|[\s,;:)\]}\"'>|/-]+)+$")
_TITLED = re.compile(rf"(?<!\w){TITLES}\s+$")
_FILLER = re.compile(r"([^\W\d_])\1{3}", re.I)
#: How far a form may reach beyond the span that was found.
REACH = 48
_NW = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_INITIALS = r"(?:[^\W\d_]\.\s?){1,2}"
#: One person's name: surname first, with initials, or two words; then single words.
NAME = re.compile(
    rf"{_NW},\s{_NW}(?:\s[A-Z]\.(?!\w))?|{_NW}\s{_INITIALS}\s?(?:{PARTICLE}\s)?{_NW}|{_INITIALS}\s?(?:{PARTICLE}\s)?{_NW}|{_NW}\s(?:{PARTICLE}\s)?{_NW}|{_NW}", re.I
)
_FORMS = {"email": EMAIL, "phone": PHONE, "address": ADDRESS}


def snap(text: str, begin: int, end: int, kind: str) -> list[tuple[int, int]]:
    """The exact spans of a found one, none if it has no form: for names the single names
    without title, possessive and punctuation, else the form that it overlaps most."""
    if kind == "name":
        return _names(text, begin, end)
    low, high = max(0, begin - REACH), min(len(text), end + REACH * (2 if kind == "address" else 1))
    best, most = None, 0
    for m in _FORMS.get(kind, ID).finditer(text, low, high):
        common = min(m.end(), end) - max(m.start(), begin)
        if common > most:
            best, most = (m.start(), m.end()), common
    if best is None or 2 * most < min(end - begin, best[1] - best[0]):
        return []
    if kind == "phone" and re.match(r"/\d", text[best[1] : best[1] + 2]):
        return []
    if kind in ("phone", "id_number") and _NOT_ID.search(text[max(0, best[0] - 20) : best[0]]):
        return []
    return [best]


def _names(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    while begin > 0 and text[begin - 1].isalpha() and text[begin].isalpha():
        begin -= 1
    while end < len(text) and text[end].isalpha() and text[end - 1].isalpha():
        end += 1
    if m := _TRIM_L.match(text[begin:end]):
        begin += m.end()
    if m := _TRIM_R.search(text[begin:end]):
        end = begin + m.start()
    piece = text[begin:end]
    letters = lambda x: sum(c.isalpha() for c in x)
    # two letters are a name behind a title only
    least = 2 if _TITLED.search(text[max(0, begin - 16) : begin]) else 3
    if letters(piece) < least or any(c.isdigit() or c == "@" for c in piece) or COMPANY.match(text[end : end + 14]):
        return []
    out = [(begin + m.start(), begin + m.end()) for m in NAME.finditer(piece)]
    # a word that is left over behind a whole name belongs to the next sentence
    whole = [s for s in out if re.search(r"[\s,]", text[s[0] : s[1]])]
    kept = whole or [s for s in out if letters(text[s[0] : s[1]]) >= (least if s[0] == begin else 3)]
    # what is long is a name unless it is filler of one letter
    return [s for s in kept if s[1] - s[0] <= 60 or not _FILLER.search(text, *s)]
