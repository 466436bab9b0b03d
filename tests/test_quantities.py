import datetime as dt
from fractions import Fraction

import pytest

from gaugeworks.operators.quantities import DATE_SCALES, TIME, Reader, Unit, convert, lengths_from_last_days, number_of_words, quantity, with_canonical, with_days

HOURS = {"hour": 1, "day": 24, "week": 168, "fortnight": 336, "month": 720, "quarter": 2160, "year": 8760, "decade": 87600}
SITES = {1: ("en-US", "month", "serial_1900"), 2: ("de-DE", "year", "yyyymmdd"), 3: ("en-GB", "day", "unix_second")}


def day(*d):
    return (dt.date(*d) - dt.date(1970, 1, 1)).days


@pytest.mark.parametrize(
    ("text", "site", "days"),
    [
        ("26 weeks", 1, 182), ("[week] 26", 1, 182), ("104 WEEKS", 1, 728), ("one and a half months", 1, 45), ("4 qtr", 1, 360), ("P18M", 1, 540), ("P1Y3M", 1, 455),
        (" 24", 1, 720), ("3", 2, 1095), ("2555.0", 3, 2555), ("three (3) years", 1, 1095), ("a term of three (3) years plus six (6) months", 1, 1275),
        ("1 1/2 months", 1, 45), ("8,760 hours", 1, 365), ("vier (4) Jahre", 2, 1460), ("0,6 Jahre", 2, 219), ("0.8 years", 2, 292), ("on a fortnightly basis", 1, 14),
        ("for one year, unless sooner terminated unless notice is given ninety (90) days' before expiry", 1, 365),
        ("2 years (payment falls due within fifteen (15) days' of invoice)", 1, 730), ("further SIX MONTHS upon written consent", 1, 180),
        ("eighteen-month period", 1, 540), ("term_years=4", 1, 1460), ("3 yr. 3 mos.", 1, 1185), ("two decades", 1, 7300), ("a dozen months", 1, 360),
        ("half a month", 1, 15), ('{"value": 9, "unit": "YEAR"}', 1, 3285), ("cuatro (4) trimestres", 1, 360), ("one hundred eighty days", 1, 180),
        ("evergreen", 1, None), ("______ years", 1, None), ("several years", 1, None), ("as set out in Section 4.2", 1, None), ("", 1, None), (None, 1, None),
        ("30 days' notice", 1, None), ("5", 99, None), ("2 years " + "x" * 50_000, 1, 730),
    ],
)
def test_lengths(text, site, days):
    assert Reader(SITES, HOURS).read("length", text, site)[0] == days


@pytest.mark.parametrize(
    ("text", "site", "days"),
    [
        ("3/2/2011", 1, day(2011, 3, 2)), ("3/2/2011", 3, day(2011, 2, 3)), ("12.9.13", 2, day(2013, 9, 12)), ("the twenty-third day of September, 2005", 1, day(2005, 9, 23)),
        ("the 28th day of November, 2023 (", 1, day(2023, 11, 28)), ("38226", 1, 12657), ("1052092800.0", 3, day(2003, 5, 5)), ("20031203", 2, day(2003, 12, 3)),
        ("Signed December 3, 2018; effective December 6, 2018", 1, day(2018, 12, 6)), ("2002-195", 1, day(2002, 7, 14)), ("2004-W53-7", 1, day(2005, 1, 2)),
        ("9. April 2002", 2, day(2002, 4, 9)), ("2020-02-15T00:00:00+00:00", 1, day(2020, 2, 15)), ("FY 2023", 1, None), ("Q3 2022", 1, None), ("March 2011", 1, None),
        ("31.02.2011", 2, None), ("upon signing", 1, None),
    ],
)
def test_days(text, site, days):
    assert Reader(SITES, HOURS).read("date", text, site)[0] == days


def test_units_convert_by_scale_and_offset():
    celsius, kelvin = Unit((0, 0, 0, 1), Fraction(1), Fraction(27315, 100)), Unit((0, 0, 0, 1), Fraction(1))
    fahrenheit = Unit((0, 0, 0, 1), Fraction(5, 9), Fraction(45967, 180))
    assert convert(Fraction(100), celsius, kelvin) == Fraction(37315, 100)
    assert convert(Fraction(212), fahrenheit, celsius) == 100
    assert DATE_SCALES["serial_1900"].canonical(Fraction(25569)) == 0
    metre, second = Unit((0, 1, 0, 0), Fraction(1)), Unit(TIME, Fraction(1))
    assert (metre * second**-2).dims == (-2, 1, 0, 0)
    with pytest.raises(ValueError):
        convert(Fraction(1), metre, second)


def test_number_words():
    assert number_of_words(["seven", "hundred", "thirty"]) == 730
    assert number_of_words(["twenty-six"]) == 26
    assert number_of_words(["sechsunddreißig"]) == 36
    assert number_of_words(["and", "lease"]) is None


def test_last_day_counts_from_the_start(spark):
    rows = [(1, 7, "term", "predicted", "until June 30, 2010", 1), (2, 7, "date", "predicted", "June 30, 2009", 1), (2, 7, "date", "predicted", "June 30, 2009", 1),
            (3, 8, "term", "predicted", "until June 30, 2010", 1), (4, None, "term", "expected", "2 years", 1), (5, 9, "length", "expected", None, None)]
    df = spark.createDataFrame(rows, "row_id int, ext int, kind string, side string, value string, site int")
    read = with_days(df.withColumn("days", df.row_id), "kind", "value", "site", SITES, HOURS)
    found = lengths_from_last_days(read.withColumn("is_date", read.kind == "date"), "ext", "side", "is_date")
    got = sorted((r.row_id, r.days) for r in found.where("kind <> 'date' and days is not null").collect())
    assert got == [(1, 365), (4, 730)]
    assert with_days(df.limit(0), "kind", "value", "site", SITES, HOURS).count() == 0


UNITS = {"m": Unit((0, 1, 0, 0), Fraction(1)), "km": Unit((0, 1, 0, 0), Fraction(1000)), "h": Unit(TIME, Fraction(1, 24)), "s": Unit(TIME, Fraction(1, 86_400)),
         "kg": Unit((0, 0, 1, 0), Fraction(1)), "°c": Unit((0, 0, 0, 1), Fraction(1), Fraction(27315, 100))}


@pytest.mark.parametrize(
    ("text", "value", "dims"),
    [("36 km/h", 864_000, (-1, 1, 0, 0)), ("3 km per h", 72_000, (-1, 1, 0, 0)), ("5 kg*m²", 5, (0, 2, 1, 0)), ("20 °C", Fraction(29315, 100), (0, 0, 0, 1)), ("1 1/2 km", 1500, (0, 1, 0, 0)), ("2 m^-1", 2, (0, -1, 0, 0))],
)
def test_unit_expressions(text, value, dims):
    assert quantity(text, UNITS) == (value, dims)


def test_senseless_quantities(spark):
    for text in (None, "", "  ", "7", "x", "2 furlong", "3 °C/s", "3 km/", "9" * 50_000 + " q", "1/0 km"):
        assert quantity(text, UNITS) is None
    df = spark.createDataFrame([(1, "36 km/h", "a"), (2, None, "b"), (2, "x", "b")], "id int, v string, quantity string")
    rows = with_canonical(df, "v", UNITS).collect()
    assert rows[0].quantity.value == 864_000 and list(rows[0].quantity.dims) == [-1, 1, 0, 0] and rows[1].quantity is None and rows[2].quantity is None
    assert with_canonical(df.limit(0), "v", UNITS).count() == 0


def test_an_amount_of_another_dimension_is_no_length():
    read = Reader(SITES, HOURS).read
    assert read("length", "30 days per year", 1) == (None, None)
    assert read("length", "2 years, 30 days per year", 1) == (730, None)
    assert read("length", "12 months/renewable", 1) == (360, None)


def test_month_first_and_comma_are_parameters():
    assert Reader({1: ("xx-AA", None, None)}, HOURS, month_first=("xx-AA",)).read("date", "3/2/2011", 1)[0] == day(2011, 3, 2)
    assert Reader({1: ("xx-AA", "year", None)}, HOURS, comma=("xx",)).read("length", "0,5", 1)[0] == 182
