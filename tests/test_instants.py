import datetime as dt

from gaugeworks.operators.instants import with_utc_millis


def ms(*parts, tz=0):
    return int(dt.datetime(*parts, tzinfo=dt.timezone(dt.timedelta(hours=tz))).timestamp() * 1000)


CASES = [
    ("2025-01-05T00:17:38Z", "UTC", "en-GB", ms(2025, 1, 5, 0, 17, 38)),
    ("  2025-01-05t01:27:28z ", "UTC", "en-GB", ms(2025, 1, 5, 1, 27, 28)),
    ("2025-01-05 21:01:04.5489 +09:00", "UTC", "en-GB", ms(2025, 1, 5, 12, 1, 4) + 548),
    ("20250105T010451Z", "UTC", "en-GB", ms(2025, 1, 5, 1, 4, 51)),
    ("06/01/2025 19:08", "Asia/Tokyo", "en-GB", ms(2025, 1, 6, 10, 8)),
    ("01/06/2025 7:08 pm", "Asia/Tokyo", "en-US", ms(2025, 1, 6, 10, 8)),
    ("Jan 5, 2025 12:48:57 AM", "UTC", "en-US", ms(2025, 1, 5, 0, 48, 57)),
    ("5 January 2025 20:14:37 CST", "America/Chicago", "en-US", ms(2025, 1, 6, 2, 14, 37)),
    ("Sun, 05 Jan 2025 01:37:53 -0700", "UTC", "en-US", ms(2025, 1, 5, 8, 37, 53)),
    ("Mon Jan  6 22:32:29 UTC 2025", "Asia/Tokyo", "en-US", ms(2025, 1, 6, 22, 32, 29)),
    ("2026-05-16T17:50:15 America/New_York", "UTC", "en-US", ms(2026, 5, 16, 21, 50, 15)),
    ("2025-01-04T23:12:05-05:00[America/New_York]", "UTC", "en-US", ms(2025, 1, 5, 4, 12, 5)),
    ("1736037412", "Asia/Tokyo", "en-US", 1736037412000),
    ("1736041259.059452", "UTC", "en-US", 1736041259059),
    ("1736047600889618", "UTC", "en-US", 1736047600889),
    ("2025-11-02 01:30:00", "America/New_York", "en-US", ms(2025, 11, 2, 5, 30)),  # twice: the earlier
    ("2025-03-09 02:30:00", "America/New_York", "en-US", ms(2025, 3, 9, 7, 30)),  # never: offset before
    ("2026-13-45T99:00:00", "UTC", "en-US", None),
    ("0000-00-00 00:00:00", "UTC", "en-US", None),
    ("2026-08", "UTC", "en-US", None),
    ("12:41", "UTC", "en-US", None),
    ("yesterday", "UTC", "en-US", None),
    ("", "UTC", "en-US", None),
    (None, "UTC", "en-US", None),
    ("2025-01-05 10:00:00", "No/Where", "en-US", None),
    ("2025-01-05 10:00:00", None, None, None),
    ("x" * 100_000, "UTC", "en-US", None),
    # abbreviations are those of the site; others come from the fixed table
    ("2025-07-05 20:14:37 PST", "Asia/Manila", "en-PH", ms(2025, 7, 5, 12, 14, 37)),
    ("2025-07-05 20:14:37 PST", "America/Los_Angeles", "en-US", ms(2025, 7, 6, 4, 14, 37)),
    ("2025-07-05 20:14:37 IST", "Europe/Dublin", "en-GB", ms(2025, 7, 5, 19, 14, 37)),
    ("2025-07-05 20:14:37 IST", "Asia/Kolkata", "en-GB", ms(2025, 7, 5, 14, 44, 37)),
    ("2025-07-05 20:14:37 CST", "Asia/Shanghai", "en-GB", ms(2025, 7, 5, 12, 14, 37)),
    ("2025-07-05 20:14:37 MESZ", "Europe/Berlin", "de-DE", ms(2025, 7, 5, 18, 14, 37)),
    ("2025-07-05 20:14:37 EST", None, None, ms(2025, 7, 6, 1, 14, 37)),
    ("2025-07-05 20:14:37 QQQ", "Europe/Berlin", "de-DE", None),
    ("-1736037412", "Asia/Tokyo", "en-US", -1736037412000),
    ("-1736041259.059452", "UTC", "en-US", -1736041259059),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "zone_key int, said string, tz string, loc string, utc_ms bigint")
    got = {r.zone_key: r.found for r in with_utc_millis(df, "said", "tz", "loc", "found").collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES)}


def test_keeps_rows_and_replaces_out(spark):
    df = spark.createDataFrame([("1736037412", "UTC", "x", 1)] * 3, "said string, tz string, loc string, utc_ms int")
    found = with_utc_millis(df, "said", "tz", "loc")
    assert found.columns == ["said", "tz", "loc", "utc_ms"]
    assert [r.utc_ms for r in found.collect()] == [1736037412000] * 3
    assert with_utc_millis(df.limit(0), "said", "tz", "loc").count() == 0
