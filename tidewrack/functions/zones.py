"""Zone transition tables of one release of the time zone database.

The driver reads the zone data once and sends them, some 500 KB, to the tasks. Tables are made from these data, so every
executor converts by the same release whatever zone files its machine has. The data can be written down and read
back, to convert by a release later.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import importlib.resources
import io
import re
import zoneinfo
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Years a table covers; before and after, the first and last offsets hold.
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: Offsets in hours of the zone abbreviations of North America, and GMT and its names.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0,
    "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "HDT": -9,
}
#: Local seconds from which an offset holds, and the offsets in seconds: one more offset than boundaries.
Table = tuple[np.ndarray, np.ndarray]


def table_of(data: bytes) -> Table:
    """The transition table of a zone's data.

    A boundary is the later of the two readings of the change, so a local time that occurs twice gets the earlier
    instant, and one that was skipped keeps the offset in force before the change. Offsets are read every four days, and
    where they differ, the change is found by halving.
    """
    tz = zoneinfo.ZoneInfo.from_file(io.BytesIO(data))
    off = lambda s: dt.datetime.fromtimestamp(s, tz).utcoffset().seconds  # noqa: E731  (modulo a day, enough to compare)
    start, end = (int(np.datetime64(day, "s").astype("int64")) for day in (f"{FIRST_YEAR}-01-02", f"{LAST_YEAR}-12-30"))
    grid = range(start, end, 4 * 86400)
    at = [off(s) for s in grid]
    changes = []
    for i in range(len(grid) - 1):
        if at[i] != at[i + 1]:
            lo, hi = grid[i], grid[i + 1]
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == at[i] else (lo, mid)
            changes.append(hi)
    offsets = np.array([int(dt.datetime.fromtimestamp(s, tz).utcoffset().total_seconds()) for s in (start, *changes)], "int64")
    return np.array(changes, "int64") + np.maximum(offsets[:-1], offsets[1:]), offsets


@dataclass(frozen=True)
class Zones:
    """Zone data by name, and their version: the release and a digest of the contents."""

    version: str
    data: dict[str, bytes]
    _tables: dict[str, Table | None] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def of(release: str, data: dict[str, bytes]) -> Zones:
        digest = hashlib.sha256()
        for zone in sorted(data):
            digest.update(f"{zone} {len(data[zone])} ".encode() + data[zone])
        return Zones(f"{release}-{digest.hexdigest()[:12]}", data)

    def table(self, zone: str) -> Table | None:
        """The table of a zone or abbreviation, made when first asked for; None where there is none of this name."""
        if zone not in self._tables:
            hours = ABBREVIATIONS.get(zone.upper())
            if hours is not None:
                self._tables[zone] = np.array([], "int64"), np.array([int(hours * 3600)], "int64")
            else:
                self._tables[zone] = table_of(self.data[zone]) if zone in self.data else None
        return self._tables[zone]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """version, zone, data: one row for each zone."""
        return spark.createDataFrame([(self.version, z, bytearray(d)) for z, d in sorted(self.data.items())], "version string, zone string, data binary")

    @staticmethod
    def from_frame(frame: DataFrame) -> Zones:
        """What ``to_frame`` gave (one row for each zone there is); fails where the contents aren't those of the one version stated."""
        rows = frame.collect()
        stated = {r["version"] for r in rows}
        out = Zones.of(min(stated, default="").rpartition("-")[0], {r["zone"]: bytes(r["data"]) for r in rows})
        if stated != {out.version}:
            raise ValueError(f"zone data of version {out.version}, but {sorted(stated)} stated")
        return out


def _release() -> str:
    for folder in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            at = Path(folder, name)
            if at.is_file() and (m := re.match(pattern, at.open().readline())):
                return m[1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unnamed"


def _read(zone: str) -> bytes | None:
    for folder in zoneinfo.TZPATH:
        if Path(folder, zone).is_file():
            return Path(folder, zone).read_bytes()
    *above, name = zone.split("/")
    try:
        return importlib.resources.files(".".join(["tzdata.zoneinfo", *above])).joinpath(name).read_bytes()
    except (ModuleNotFoundError, FileNotFoundError):
        return None


@functools.lru_cache(maxsize=1)
def installed() -> Zones:
    """The zones of this machine's release."""
    found = {z: _read(z) for z in zoneinfo.available_timezones() if z not in ("localtime", "posixrules")}
    return Zones.of(_release(), {z: d for z, d in found.items() if d and d[:4] == b"TZif"})


def local_to_utc(local: np.ndarray, table: Table) -> np.ndarray:
    """UTC seconds of local seconds."""
    return local - table[1][np.searchsorted(table[0], local, side="right")]
