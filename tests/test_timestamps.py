import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from tidemark.operators.timestamps import normalised_instants, parser_for, utc_micros, zone_table


def one(text, zone=None):
    got = utc_micros(pd.Series([text], dtype=object), pd.Series([zone], dtype=object))[0]
    return None if pd.isna(got) else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=int(got))


def at(*x):
    return datetime(*x, tzinfo=UTC)


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2022-06-11T17:45:00Z", "Europe/Athens", at(2022, 6, 11, 17, 45)),
        ("2024-04-11T13:00:00.000+01:00", None, at(2024, 4, 11, 12)),
        ("Thu, 30 Jun 2022 12:30:00 -0400", None, at(2022, 6, 30, 16, 30)),
        ("Mar 11, 2023 3:00 PM", "Europe/Berlin", at(2023, 3, 11, 14)),
        ("Mar 11, 2023 12:05 AM", None, at(2023, 3, 11, 0, 5)),
        ("29/01/23 15:00", "America/New_York", at(2023, 1, 29, 20)),
        ("10.02.2024 20:00:00,123", None, at(2024, 2, 10, 20, 0, 0, 123000)),
        ("1626638400", "Asia/Tokyo", datetime.fromtimestamp(1626638400, UTC)),
        ("1649347200123", None, datetime.fromtimestamp(1649347200, UTC) + timedelta(milliseconds=123)),
        ("20210721T150000+0200", None, at(2021, 7, 21, 13)),
        ("2021-07-01 19:30 Europe/Berlin", "Asia/Tokyo", at(2021, 7, 1, 17, 30)),
        ("2021-07-03T18:00:00+01:00[Europe/London]", None, at(2021, 7, 3, 17)),
        ("30 Oct 2022 02:46 CET", "Europe/Berlin", at(2022, 10, 30, 1, 46)),
        ("01 Aug 2021 18:00 EDT", None, at(2021, 8, 1, 22)),
        ("2021-08-23T17:30:00.000000465Z", None, at(2021, 8, 23, 17, 30)),
        ("2021-08-23T17:30:00.123456999Z", None, at(2021, 8, 23, 17, 30, 0, 123456)),
        (" 2023-03-27T20:45 ", "Europe/London", at(2023, 3, 27, 19, 45)),
        ("2022-10-30 02:30:00", "Europe/Berlin", at(2022, 10, 30, 0, 30)),  # twice: the first
        ("2022-03-27 02:30:00", "Europe/Berlin", at(2022, 3, 27, 1, 30)),  # skipped: moved on
    ],
)
def test_forms(text, zone, want):
    assert one(text, zone) == want


@pytest.mark.parametrize("text", [None, "", "  ", "-", "n/a", "TBC", "postponed", "0000-00-00 00:00:00", "31/02/2023 15:00", "2023-13-01T00:00:00Z", "2023-01-01T24:00:00Z", "2023-01-01 10:00 Nowhere/Zone", "2023-01-01", "９" * 10, "9" * 5000])
def test_unusable(text):
    assert one(text, "Europe/Berlin") is None


def test_unknown_row_zone_is_unusable_unless_the_text_names_one():
    assert one("2023-01-01 10:00:00", "No/Zone") is None
    assert one("2023-01-01T10:00:00Z", "No/Zone") == at(2023, 1, 1, 10)


def test_against_zoneinfo():
    r = random.Random(7)
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata", "Europe/London"]
    walls = [datetime(2015, 1, 1) + timedelta(seconds=r.randrange(12 * 365 * 86400)) for _ in range(3000)]
    names = [r.choice(zones) for _ in walls]
    got = utc_micros(pd.Series([w.strftime("%Y-%m-%d %H:%M:%S") for w in walls], dtype=object), pd.Series(names, dtype=object))
    want = [int(w.replace(tzinfo=ZoneInfo(z)).timestamp()) * 1_000_000 for w, z in zip(walls, names, strict=True)]
    assert got.tolist() == want


def test_outer_blanks_of_any_length():
    blanks = " " * 600
    assert utc_micros(pd.Series([f"{blanks}2024-01-01T00:00:00Z", f"2024-01-01T00:00:00Z{blanks}", blanks, None]), pd.Series([None] * 4, dtype=object)).fillna(-1).tolist() == [1_704_067_200_000_000] * 2 + [-1] * 2


def test_a_shape_is_compiled_once():
    assert parser_for("9999-99-99A99:99:99A") is parser_for("9999-99-99A99:99:99A")
    assert zone_table("Europe/Berlin") is zone_table("Europe/Berlin")


def test_frame_with_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "2022-01-01T00:00:00Z", None, "x"), (1, "2022-01-01T00:00:00Z", None, "x"), (2, None, "UTC", "y")], "id long, text string, zone string, table_name string")
    got = [tuple(r) for r in normalised_instants(df, "id", "text", "zone", "t").collect()]
    assert got == [("t", 1, 1640995200000000)] * 2
    assert normalised_instants(df.where("1 = 0"), "id", "text", "zone", "t").count() == 0


def test_any_length_and_any_year():
    texts = pd.Series([" " * 3000 + "2024-05-01 12:00" + " " * 3000, "2024-05-01 12:00:00." + "1" * 700, "2150-07-01 12:00", "1850-01-01T00:00:00Z"])
    got = utc_micros(texts, pd.Series(["Europe/Paris", "UTC", "Europe/Paris", "UTC"])).tolist()
    want = [(2024, 5, 1, 10, 0), (2024, 5, 1, 12, 0), (2150, 7, 1, 10, 0), (1850, 1, 1, 0, 0)]
    at = lambda w: (datetime(*w) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert got == [at(want[0]), at(want[1]) + 111_111, at(want[2]), at(want[3])]
