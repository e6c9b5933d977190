"""Stamps of many forms, precisions and zones to one instant in UTC.

A stamp becomes a shape mask (each digit ``9``, each ASCII letter ``A``, other characters themselves). Each
distinct mask is mapped once to a parser: where in the stamp its fields lie. All stamps of a mask are then
converted together, as arrays, and local times go through the zones' transition tables, all of one version.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.keys import trimmed
from tidewrack.functions.zones import Zones, installed, local_to_utc

# Month names and their short forms.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
WEEKDAYS = {d[:n] for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday") for n in (3, 9)}

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_OFFSET = r" ?(?:A{3})?(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?"
_NAME = r"(?P<zone>A+(?:[/_+-]A+)*)"
_AFTER = rf"(?:{_OFFSET}(?: ?\(A[A ]*\)| ?\[A[A/_+-]*\])?| ?{_NAME}| ?\[(?P<zone2>A[A/_+-]*)\])?"
#: The layouts that masks are matched with, tried in this order.
LAYOUTS = tuple(
    re.compile(p)
    for p in (
        r"(?P<num>-?9+)(?:\.(?P<f>9+))?",
        rf"(?P<Y>9999)-(?P<M>99)-(?P<D>99)(?:(?P<T>A)| +){_TIME}{_AFTER}",
        rf"(?P<Y>9999)/(?P<M>99)/(?P<D>99) +{_TIME}{_AFTER}",
        rf"(?P<Y>9999)(?P<M>99)(?P<D>99)(?P<T>A)(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,](?P<f>9+))?{_AFTER}",
        rf"(?:(?P<wd>A{{3,9}}),? +)?(?P<D>99?)\.? +(?P<mon>A{{3,9}})\.? +(?P<Y>9999),? +{_TIME}{_AFTER}",
        rf"(?:(?P<wd>A{{3,9}}),? +)?(?P<mon>A{{3,9}})\.? +(?P<D>99?),? +(?P<Y>9999),? +{_TIME} ?(?P<ampm>AA){_AFTER}",
        rf"(?:(?P<wd>A{{3,9}}),? +)?(?P<mon>A{{3,9}})\.? +(?P<D>99?),? +(?P<Y>9999),? +{_TIME}{_AFTER}",
        rf"(?P<a>99?)/(?P<b>99?)/(?P<Y>9999),? +{_TIME} ?(?P<ampm>AA){_AFTER}",
        rf"(?P<a>99?)/(?P<b>99?)/(?P<Y>9999),? +{_TIME}{_AFTER}",
    )
)
#: Bare numbers are taken in the unit (power of ten below a second) that puts them within these years.
NUMBER_YEARS, UNITS = (2001, 2100), (0, 3, 6, 9)


def shape_mask(c: Column) -> Column:
    """The mask of a stamp without surrounding blanks."""
    letters = string.ascii_letters
    return F.translate(trimmed(c), "012345678" + letters, "9" * 9 + "A" * len(letters))


def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field name to (start, end) in the stamps of this mask; None: no stamp of this shape denotes an instant."""
    for layout in LAYOUTS:
        if m := layout.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


_kept_parser_of = functools.lru_cache(maxsize=4096)(parser_of)
#: Parsers of masks up to this length are kept from batch to batch; those of longer ones, mostly texts that are no stamps, are made anew.
KEPT = 200


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), "int64")
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype("int64") - 48)
    return out


def _words(stamps: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the distinct lower-case words in a span."""
    codes, words = pd.factorize(np.array([s[span[0] : span[1]] for s in stamps], dtype=object))
    return codes, words


def _numbers(stamps: np.ndarray, fields: dict) -> np.ndarray:
    """Milliseconds, as float with NaN for none, of bare numbers."""
    lo, hi = (np.datetime64(f"{y}-01-01", "s").astype("int64") for y in NUMBER_YEARS)
    out = np.full(len(stamps), np.iinfo("int64").min, "int64")
    a, b = fields["num"]
    bare = [s[a:b].lstrip("0") for s in stamps]
    whole = np.array([int(s) if 0 < len(s) < 20 else -1 for s in bare], dtype=object)  # more digits are beyond every unit's range
    frac = np.array([int((s[slice(*fields["f"])] + "000")[:3]) for s in stamps], dtype=object) if "f" in fields else 0
    for unit in UNITS:
        scaled = whole // 10**unit
        ok = (scaled >= lo) & (scaled < hi) & (out == np.iinfo("int64").min)
        if unit == 0:
            ms = whole * 1000 + frac
        else:
            ms = whole // 10 ** (unit - 3)
        ok = ok.astype(bool)
        out[ok] = ms[ok].astype("int64")
    return out


def _convert(mask: str, stamps: np.ndarray, zones: np.ndarray, orders: np.ndarray, known: Zones) -> np.ndarray:
    """Epoch milliseconds of the stamps of one mask; the least int64 stands for no instant."""
    none = np.iinfo("int64").min
    fields = _kept_parser_of(mask) if len(mask) <= KEPT else parser_of(mask)
    if fields is None:
        return np.full(len(stamps), none, "int64")
    if "num" in fields:
        return _numbers(stamps, fields)
    chars = np.array(stamps, dtype=f"U{len(mask)}").view("uint32").reshape(len(stamps), len(mask))
    get = lambda k, default=0: _digits(chars, fields[k]) if k in fields else np.full(len(stamps), default, "int64")
    year, hour, minute, sec = get("Y"), get("h"), get("mi"), get("s")
    ok = np.ones(len(stamps), bool)
    if "a" in fields:
        a, b = get("a"), get("b")
        dmy = orders == "dmy"
        month, day = np.where(dmy, b, a), np.where(dmy, a, b)
        ok &= dmy | (orders == "mdy")
    else:
        day = get("D")
        if "mon" in fields:
            codes, words = _words(stamps, fields["mon"])
            month = np.array([MONTHS.get(w.lower(), 0) for w in words], "int64")[codes]
        else:
            month = get("M")
    if "T" in fields:
        ok &= np.isin(chars[:, fields["T"][0]], [ord("T"), ord("t")])
    if "wd" in fields:
        codes, words = _words(stamps, fields["wd"])
        ok &= np.array([w.lower() in WEEKDAYS for w in words], bool)[codes]
    if "ampm" in fields:
        codes, words = _words(stamps, fields["ampm"])
        half = np.array([{"am": 0, "pm": 12}.get(w.lower(), -1) for w in words], "int64")[codes]
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    ok &= (year >= 1) & (month >= 1) & (month <= 12) & (hour <= 23) & (minute <= 59) & (sec <= 59)
    m = np.clip(month, 1, 12)
    first = (np.clip(year, 1, 9999) - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype("int64")
    ok &= (day >= 1) & (day <= length)
    local = (first.astype("datetime64[D]").astype("int64") + day - 1) * 86400 + hour * 3600 + minute * 60 + sec
    milli = np.zeros(len(stamps), "int64")
    if "f" in fields:
        s, e = fields["f"]
        width = min(e - s, 3)
        milli = _digits(chars, (s, s + width)) * 10 ** (3 - width)
    if "sign" in fields:
        oh, om = get("oh"), get("om")
        sign = np.where(chars[:, fields["sign"][0]] == ord("-"), -1, 1)
        ok &= (oh <= 18) & (om <= 59)
        utc = local - sign * (oh * 3600 + om * 60)
    else:
        named = "zone" if "zone" in fields else "zone2" if "zone2" in fields else None
        codes, names = _words(stamps, fields[named]) if named else pd.factorize(zones)
        utc = local.copy()
        for i, name in enumerate(names):
            at = codes == i
            table = known.table(name)
            if table is None:
                ok &= ~at
            else:
                utc[at] = local_to_utc(local[at], table)
    return np.where(ok, utc * 1000 + milli, none)


def _converter(zones: Broadcast[Zones]) -> Callable[..., Column]:
    @F.pandas_udf(T.LongType())
    def convert(stamp: pd.Series, mask: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
        known = zones.value
        out = np.full(len(stamp), np.iinfo("int64").min, "int64")
        codes, masks = pd.factorize(mask.to_numpy(dtype=object))
        by_mask = np.argsort(codes, kind="stable")
        at = np.searchsorted(codes[by_mask], np.arange(len(masks) + 1))
        stamps, places, orders = stamp.to_numpy(dtype=object), zone.to_numpy(dtype=object), order.to_numpy(dtype=object)
        for i, m in enumerate(masks):
            rows = by_mask[at[i] : at[i + 1]]
            out[rows] = _convert(m, stamps[rows], places[rows], orders[rows], known)
        return pd.Series(out).where(out != np.iinfo("int64").min).astype("Int64")

    return convert


def shared_zones(zones: Zones | None = None) -> Broadcast[Zones]:
    """The zones, the installed ones if none are given, as sent to the tasks; once for each session's context and version."""
    sc, zones = SparkSession.active().sparkContext, zones or installed()
    if not hasattr(sc, "_tidewrack_zones"):
        sc._tidewrack_zones = {}
    if zones.version not in sc._tidewrack_zones:
        sc._tidewrack_zones[zones.version] = sc.broadcast(zones)
    return sc._tidewrack_zones[zones.version]


def epoch_ms(stamp: Column, zone: Column | None = None, date_order: Column | None = None, zones: Zones | None = None) -> Column:
    """Milliseconds since 1970 UTC (rounded down) of a stamp, or null where it denotes no instant.

    ``zone`` (null: UTC) holds for stamps without zone, ``date_order`` (``mdy``, ``dmy``) for all-number dates
    with slashes, which have no instant without it; ``zones`` are the tables to convert by. Null, empty and blank stamps
    and words give null; stamps may be of any length.
    """
    t = trimmed(stamp)
    return _converter(shared_zones(zones))(
        F.coalesce(t, F.lit("")), F.coalesce(shape_mask(t), F.lit("")),
        F.coalesce(zone if zone is not None else F.lit(None).cast("string"), F.lit("UTC")),
        F.coalesce(F.lower(date_order) if date_order is not None else F.lit(None).cast("string"), F.lit("")),
    )


def header_value(headers: Column, name: str) -> Column:
    """The first value of the mail header ``name``, whatever the case of its name; null where it is absent."""
    return F.get(F.filter(headers, lambda h: F.lower(trimmed(h["name"])) == name), F.lit(0))["value"]


def normalized_stamps(messages: DataFrame, gmail: DataFrame, slack: DataFrame, files: DataFrame, zones: Zones | None = None) -> DataFrame:
    """(src, rec_id, epoch_ms, zone_version): one distinct row for each stamp of the three tables that denotes an instant.

    All are converted by the same ``zones`` (the driver's, if none are given), whose version each row states.
    Rows without file, or of an unknown file, count as written in UTC. Extra columns are ignored. Ties and
    repeated rows come out once. A null id stays null. The file list is joined by name, without a hint: the
    optimizer broadcasts it while it is small and splits hot files where it is not.
    """
    by_file = files.groupBy("file_name", "feed").agg(F.min(F.struct("zone", "date_order")).alias("z"))

    def of_feed(feed: str) -> DataFrame:
        return by_file.where(F.col("feed") == feed).select("file_name", "z")

    m = messages.select(F.col("id").alias("rec_id"), F.col("timestamp").alias("stamp"), "file_name")
    s = slack.select(F.concat("file_name", F.lit(":"), F.col("line_no").cast("string")).alias("rec_id"), F.col("ts").alias("stamp"), "file_name")
    read = lambda df, feed, src: df.where(F.col("stamp").isNotNull()).join(of_feed(feed), "file_name", "left").select(F.lit(src).alias("src"), "rec_id", epoch_ms(F.col("stamp"), F.col("z.zone"), F.col("z.date_order"), zones).alias("epoch_ms"))
    g = gmail.select(F.col("id").alias("rec_id"), F.col("internalDate").alias("stamp"), header_value(F.col("payload.headers"), "date").alias("header"))
    g = g.select(F.lit("gmail_raw").alias("src"), "rec_id", F.coalesce(epoch_ms(F.col("stamp"), zones=zones), epoch_ms(F.col("header"), zones=zones)).alias("epoch_ms"))
    rows = read(m, "messages", "messages").unionByName(read(s, "slack_01_clean", "slack_01_clean")).unionByName(g)
    return rows.where(F.col("epoch_ms").isNotNull()).distinct().withColumn("zone_version", F.lit(shared_zones(zones).value.version))


def stamp_shapes(stamps: DataFrame, column: str) -> DataFrame:
    """(shape, n): how many stamps have each mask; nulls have the shape ``null``."""
    return stamps.groupBy(F.coalesce(shape_mask(F.col(column)), F.lit("null")).alias("shape")).agg(F.count("*").alias("n"))
