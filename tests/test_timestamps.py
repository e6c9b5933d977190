import datetime as dt
import zoneinfo

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewrack.functions.zones import Zones, installed, local_to_utc
from tidewrack.operators.timestamps import epoch_ms, normalized_stamps, parser_of, stamp_shapes

UTC = dt.UTC


def ms(*parts, micro=0, off=0):
    return int((dt.datetime(*parts, tzinfo=UTC) - dt.timedelta(hours=off)).timestamp()) * 1000 + micro // 1000


CASES = [
    ("2026-03-01T04:05:06Z", None, None, ms(2026, 3, 1, 4, 5, 6)),
    ("  2026-03-01T04:05:06Z ", None, None, ms(2026, 3, 1, 4, 5, 6)),
    ("2026-03-01T04:05Z", None, None, ms(2026, 3, 1, 4, 5)),
    ("2026-03-01 04:05:06.7z", None, None, ms(2026, 3, 1, 4, 5, 6) + 700),
    ("2026-03-01T04:05:06,875+00:00", None, None, ms(2026, 3, 1, 4, 5, 6) + 875),
    ("2026-03-01T04:05:06.123999Z", None, None, ms(2026, 3, 1, 4, 5, 6) + 123),
    ("2026-03-01T04:05:06-0530", None, None, ms(2026, 3, 1, 9, 35, 6)),
    ("2026-03-01T04:05:06+05", None, None, ms(2026, 2, 28, 23, 5, 6)),
    ("20260301T040506Z", None, None, ms(2026, 3, 1, 4, 5, 6)),
    ("2026-03-01T04:05:06-08:00[America/Los_Angeles]", "Asia/Tokyo", None, ms(2026, 3, 1, 12, 5, 6)),
    ("2026-07-01 04:05:06 Europe/Berlin", None, None, ms(2026, 7, 1, 2, 5, 6)),
    ("Thu, 5 Mar 2026 10:29:25 +1100", None, None, ms(2026, 3, 4, 23, 29, 25)),
    ("Thu, 05 Mar 2026 10:29:25 -0800 (local)", None, None, ms(2026, 3, 5, 18, 29, 25)),
    ("5 Mar 2026 10:29:25 PDT", None, None, ms(2026, 3, 5, 17, 29, 25)),
    ("05 March 2026 10:29:25 UTC", "Asia/Tokyo", None, ms(2026, 3, 5, 10, 29, 25)),
    ("5. May 2026 12:12", None, None, ms(2026, 5, 5, 12, 12)),
    ("Mar 19, 2026, 3:56:29 PM", None, None, ms(2026, 3, 19, 15, 56, 29)),
    ("Mar 9, 2026, 12:06:29 AM", None, None, ms(2026, 3, 9, 0, 6, 29)),
    ("03/04/2026 10:00", None, "dmy", ms(2026, 4, 3, 10)),
    ("03/04/2026 1:00 PM", None, "mdy", ms(2026, 3, 4, 13)),
    ("03/04/2026 10:00", None, None, None),
    ("13/04/2026 10:00", None, "mdy", None),
    ("2026-01-15T12:00:00", "America/Chicago", None, ms(2026, 1, 15, 18)),
    ("2026-10-25 02:30:00", "Europe/Berlin", None, ms(2026, 10, 25, 0, 30)),  # twice: the earlier
    ("2026-03-29 02:30:00", "Europe/Berlin", None, ms(2026, 3, 29, 1, 30)),  # skipped: offset before the change
    ("1757271314", None, None, 1757271314000),
    ("1757271314.098600", None, None, 1757271314098),
    ("1757271314098", None, None, 1757271314098),
    ("1757271314098600", None, None, 1757271314098),
    ("1757271314098600123", None, None, 1757271314098),
    ("Wednesday, 04 March 2026 10:29:25.123456789 -0800 (time of the west coast in a winter without snow)", None, None, ms(2026, 3, 4, 18, 29, 25) + 123),
    ("0" * 30 + "1757271314098", None, None, 1757271314098), ("9" * 5000, None, None, None), ("-1757271314", None, None, None), ("2026-03-01T04:05:06." + "1" * 3000 + "Z", None, None, ms(2026, 3, 1, 4, 5, 6) + 111),
    ("12", None, None, None), ("0", None, None, None),
    ("2026-02-30T10:00:00Z", None, None, None), ("2026-13-04 08:15:00", None, None, None), ("0000-00-00 00:00:00", None, None, None),
    ("2026-05-14T25:61:00Z", None, None, None), ("soon", None, None, None), ("last Tuesday 3pm", None, None, None), ("", None, None, None), ("  ", None, None, None),
    (None, None, None, None), ("2026-03-01 04:05:06 Nowhere/Land", None, None, None), ("x" * 5000, None, None, None), ("2026-03-01", None, None, None), ("2026-03-01X04:05:06Z", None, None, None),
]


def test_every_form(spark):
    df = spark.createDataFrame([(i, a, z, o) for i, (a, z, o, _) in enumerate(CASES)], "i int, s string, z string, o string")
    got = dict(rows(df.select("i", epoch_ms(F.col("s"), F.col("z"), F.col("o")).alias("ms"))))
    wrong = [(CASES[i], v) for i, v in got.items() if v != CASES[i][3]]
    assert not wrong


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata"])
def test_transition_tables_agree_with_the_zone_rules(zone):
    tz = zoneinfo.ZoneInfo(zone)
    start = int(dt.datetime(2025, 9, 1, tzinfo=UTC).timestamp())
    local = np.arange(start, start + 330 * 86400, 1777)
    got = local_to_utc(local, installed().table(zone))
    for at, u in zip(local[::7], got[::7], strict=True):
        naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(at))
        assert u == int(naive.replace(tzinfo=tz, fold=0).timestamp())  # fold 0: the earlier; in a gap the offset before
    assert installed().table("No/Zone") is None and installed().table("est")[1].tolist() == [-18000]


def test_zone_data_are_of_a_version(spark):
    few = Zones.of("mine", {z: installed().data[z] for z in ("Europe/Berlin", "Asia/Tokyo")})
    again = Zones.from_frame(few.to_frame(spark))
    assert again.version == few.version and again.data == few.data and few.version.startswith("mine-")
    with pytest.raises(ValueError):
        Zones.from_frame(few.to_frame(spark).where("zone <> 'Asia/Tokyo'"))
    turned = Zones.of("turned", {"Europe/Berlin": installed().data["Asia/Tokyo"]})  # another release may say otherwise
    df = spark.createDataFrame([("2026-01-01 09:00:00",)], "s string")
    got = df.select(epoch_ms(F.col("s"), F.lit("Europe/Berlin"), zones=turned).alias("a"), epoch_ms(F.col("s"), F.lit("Europe/Berlin")).alias("b")).head()
    assert got.a == ms(2026, 1, 1) and got.b == ms(2026, 1, 1, 8)


def test_masks_map_to_parsers():
    assert parser_of("9999-99-99A99:99:99A")["Y"] == (0, 4)
    assert parser_of("AAAA") is None


def test_three_tables(spark):
    m = spark.createDataFrame([("a", "2026-01-01 00:00:00", "f1", 1), ("a", "2026-01-01 00:00:00", "f1", 2), ("b", "2026-01-01 00:00:00", None, 1), ("c", None, "f1", 1), (None, "1757271314", "gone", 1)], "id string, timestamp string, file_name string, stamp int")
    s = spark.createDataFrame([("f2", 3, "2026-01-01 00:00:00")], "file_name string, line_no int, ts string")
    g = spark.createDataFrame(
        [("g1", "soon", ([("DATE", "Thu, 1 Jan 2026 00:00:00 +0000")],)), ("g2", None, (None,)), ("g3", "1757271314000", ([],))], "id string, internalDate string, payload struct<headers:array<struct<name:string,value:string>>>"
    )
    f = spark.createDataFrame([("f1", "messages", "Asia/Tokyo", None), ("f2", "slack_01_clean", None, None)], "file_name string, feed string, zone string, date_order string")
    assert {r.zone_version for r in normalized_stamps(m, g, s, f).collect()} == {installed().version}
    got = rows(normalized_stamps(m, g, s, f), "src", "rec_id", "epoch_ms")
    assert got == sorted(
        [("messages", "a", ms(2025, 12, 31, 15)), ("messages", "b", ms(2026, 1, 1)), ("messages", None, 1757271314000), ("gmail_raw", "g1", ms(2026, 1, 1)), ("gmail_raw", "g3", 1757271314000), ("slack_01_clean", "f2:3", ms(2026, 1, 1))],
        key=lambda r: (r[0], r[1] is None, r[1] or "", r[2]),
    )
    assert normalized_stamps(m.limit(0), g.limit(0), s.limit(0), f.limit(0)).count() == 0
    assert rows(stamp_shapes(m, "timestamp")) == [("9999-99-99 99:99:99", 3), ("9999999999", 1), ("null", 1)]
