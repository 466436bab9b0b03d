"""Mixed timestamp writings and zones, brought to one instant in UTC.

Method: an ordered cascade of anchored format patterns. The first pattern that
matches the whole value splits it into year, month, day, time, half of day and
zone; the parts are checked strictly by ``try_make_timestamp``. All of it stays in
JVM expressions, so the scan, the cascade and the conversion are one stage.

Policy for local times: a time that occurs twice is the earlier instant, one that
never occurs is read with the offset in force before the change. Both are what
java.time does when a local time meets its zone.
"""

from __future__ import annotations

import datetime
import functools
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Locales in which the month comes first in all-numeric dates.
MONTH_FIRST = ("en-US", "en-PH")
# Offsets in minutes of zone abbreviations that a value's own zone doesn't have.
ABBREVIATIONS = {
    "Z": 0, "MEZ": 60, "MESZ": 120, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "JST": 540, "KST": 540, "IST": 330,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
}

# Month names by their first letters, in English, German, French and Spanish.
MONTHS = {
    1: ["jan", "ene"], 2: ["feb", "fév", "fev"], 3: ["mar", "mär", "maer"], 4: ["apr", "avr", "abr"],
    5: ["may", "mai"], 6: ["jun", "juin"], 7: ["jul", "juil"], 8: ["aug", "aoû", "aou", "ago"],
    9: ["sep"], 10: ["oct", "okt"], 11: ["nov"], 12: ["dec", "dez", "déc", "dic"],
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?:\s*(?:([+\-−])(\d{2}):?(\d{2})?(?:\[[A-Za-z0-9_/+\-]+\])?|([A-Za-z]{1,5}|[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)))?"
_GAP = r"(?:\s*[Tt]\s*|,?\s+(?:at\s+|um\s+|à\s+|a\s+las\s+)?)"
_DOW = r"(?:\p{L}{2,10}\.?,?\s+)?"
_MON = r"(\p{L}{3,10})\.?"

# name, pattern, where year, month, day, hour, minute, second, fraction, half of day, and sign, hours, minutes, name of the zone stand
CASCADE: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_GAP}{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,12}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|$10|$11"),
    ("numeric", rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}){_GAP}{_TIME}{_ZONE}$", "$3|?$1|?$2|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    ("day_name", rf"^{_DOW}(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s\-]+(?:de\s+)?{_MON}[\s,\-]+(?:de\s+)?(\d{{4}}){_GAP}{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    ("name_day", rf"^{_DOW}{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_GAP}{_TIME}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    ("ctime", rf"^\p{{L}}{{3}},?\s+{_MON}\s+(\d{{1,2}})\s+{_TIME}{_ZONE}\s+(\d{{4}})$", "$12|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
]
# digits of a bare number: seconds, milliseconds, microseconds or nanoseconds since 1970
EPOCH = r"^([+\-−]?)(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.(\d{1,12}))?$"


@functools.lru_cache(maxsize=1)
def abbreviations_by_zone() -> list[tuple[str, int]]:
    """("zone|abbreviation", minutes) for every zone of the zone database, as of the latest year
    in which the zone had the abbreviation: about 1,500 rows. CST is another time in Chicago
    than in Shanghai, IST another in Dublin than in Kolkata."""
    found: dict[str, int] = {}
    moments = [datetime.datetime(y, m, 1, tzinfo=datetime.UTC) for y in range(1970, 2038) for m in (1, 7)]
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)
        for moment in moments:
            local = moment.astimezone(zone)
            if (said := local.tzname()) and said.isalpha():
                found[f"{name}|{said}".lower()] = int(local.utcoffset().total_seconds() // 60)
    return sorted(found.items())


def _site_abbreviations(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(abbreviations_by_zone(), "__site_key string, __site_minutes int"))


def _zones(df: DataFrame) -> DataFrame:
    """(__zone_key, __zone_name, __zone_minutes): IANA names and abbreviations, about 600 rows."""
    rows = [(z.lower(), z, None) for z in available_timezones() if "/" in z and not z.startswith("posix/")]
    rows += [(a.lower(), "UTC", m) for a, m in ABBREVIATIONS.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "__zone_key string, __zone_name string, __zone_minutes int"))


def with_utc_millis(df: DataFrame, value: str, zone: str, locale: str, out: str = "utc_ms", month_first: tuple[str, ...] = MONTH_FIRST) -> DataFrame:
    """``df`` with ``out``: milliseconds since 1970-01-01 UTC of the timestamp in ``value``.

    ``zone`` names the column with the IANA zone of values that state none, ``locale``
    the one that settles whether day or month comes first in all-numeric dates (month
    for the locales in ``month_first``, else day). An abbreviation means what it means in
    the zone of ``zone``; only one that this zone doesn't have is looked up in
    :data:`ABBREVIATIONS`. Bare numbers may be negative. Null, blank, date-only, time-only and impossible
    values give null, as does a zone that doesn't exist; digits beyond milliseconds are
    cut off. Rows and other columns stay as they are; columns that begin with ``__`` are
    reserved.

    Each step is a projection of its own, so that Spark runs a pattern once per row, and
    zones are looked up in a broadcast table of fixed size.
    """
    step = df.withColumn("__text", F.trim(F.regexp_replace(value, r"[\s\u00a0\u2007\u2009\u202f]+", " ")))
    text = F.col("__text")
    parsed = F.when(text.rlike(EPOCH), F.concat(F.lit("e|"), F.regexp_replace(text, EPOCH, "$1|$2|$3")))
    for _, pattern, order in CASCADE:
        parsed = parsed.when(text.rlike(pattern), F.regexp_replace(text, pattern, order))
    step = step.withColumn("__parts", F.split(parsed, r"\|")).withColumn("__n", F.size("__parts"))
    part = lambda i: F.try_element_at("__parts", F.lit(i))
    stated = F.col("__n") == 12
    swap = part(2).startswith("?") & ~F.coalesce(F.col(locale).isin(*month_first), F.lit(False))
    named = F.when(stated & (part(12) != ""), F.lower(part(12))).when(stated & (part(9) == ""), F.lower(F.col(zone)))
    step = step.withColumns(
        {
            "__month": F.lower(F.ltrim(F.when(swap, part(3)).otherwise(part(2)), F.lit("?"))),
            "__day": F.ltrim(F.when(swap, part(2)).otherwise(part(3)), F.lit("?")).try_cast("int"),
            "__hour": part(4).try_cast("int"),
            "__half": F.lower(part(8)),
            "__offset": F.when(part(9) != "", F.when(part(9) == "+", 1).otherwise(-1) * (part(10).try_cast("int") * 60 + F.coalesce(part(11).try_cast("int"), F.lit(0)))),
            "__site_key": F.when(stated & (part(9) == "") & (part(12) != ""), F.lower(F.concat(F.col(zone), F.lit("|"), part(12)))),
            "__zone_key": F.when(stated & (part(9) != ""), F.lit("utc")).otherwise(named),
        }
    )
    months = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names for x in (n, m)])
    month, half, hour = F.col("__month"), F.col("__half"), F.col("__hour")
    head = F.substring(month, 1, F.when(month.startswith("jui"), 4).otherwise(3))
    step = step.join(_zones(df), "__zone_key", "left").join(_site_abbreviations(df), "__site_key", "left")
    step = step.withColumn("__zone_name", F.when(F.col("__site_minutes").isNotNull(), "UTC").otherwise(F.col("__zone_name"))).withColumns(
        {
            "__month": F.when(month.rlike(r"^\d"), month.try_cast("int")).otherwise(F.try_element_at(months, head)),
            "__hour": F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)),
            "__second": F.concat(F.when(part(6) == "", F.lit("0")).otherwise(part(6)), F.lit("."), F.substring(F.rpad(part(7), 3, "0"), 1, 3)).try_cast(
                "decimal(16,6)"
            ),
        }
    )
    instant = F.try_make_timestamp(
        part(1).try_cast("int"), F.col("__month"), F.col("__day"), F.col("__hour"), part(5).try_cast("int"), F.col("__second"), F.col("__zone_name")
    )
    shift = F.coalesce("__offset", "__site_minutes", "__zone_minutes", F.lit(0)).cast("bigint") * 60000
    whole, after = part(3).try_cast("bigint"), F.substring(F.rpad(part(4), 3, "0"), 1, 3).try_cast("bigint")
    length = F.length(part(3))
    epoch = (
        F.when(length <= 10, whole * 1000 + after)
        .when(length <= 13, whole)
        .when(length <= 16, F.call_function("div", whole, F.lit(1000)))
        .otherwise(F.call_function("div", whole, F.lit(1000000)))
    )
    step = step.withColumn(out, F.when(F.col("__n") == 4, F.when(part(2).isin("-", "−"), -epoch).otherwise(epoch)).when(stated, F.unix_millis(instant) - shift))
    return step.select(*[c for c in df.columns if c != out], out)
