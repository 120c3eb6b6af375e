"""Timestamp texts of mixed form, precision and zone to UTC microseconds.

A text is reduced to its shape: digits become ``9``, capitals ``A``, small letters ``a``, all else stays. The few
distinct shapes are each compiled once per Python process to a parser that knows the character positions of every
field; a batch is split by shape, every part becomes a matrix of code points, and fields are read from its columns.
Zones are tables of transitions, built once per process and zone and tagged with the version of the zone data.
"""

from __future__ import annotations

import functools
import re
import string
import zoneinfo
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPE = str.maketrans(string.digits + string.ascii_uppercase + string.ascii_lowercase, "9" * 10 + "A" * 26 + "a" * 26)
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
#: Zone abbreviations, in minutes east of UTC, for rows whose own zone doesn't use the abbreviation.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "SAST": 120, "BRT": -180, "BRST": -120, "ART": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
EPOCH_DIGITS = {10: 1_000_000, 13: 1_000, 16: 1}
MINUTE = 60_000_000
MISSING = np.iinfo(np.int64).min


@dataclass(frozen=True)
class ZoneTable:
    """Transitions of a zone. ``until[i]`` is the first wall time, in microseconds, that no longer has ``offset[i]``:
    for an overlap the end of the first pass, for a gap its end. So a doubled time takes the first of its instants
    and a skipped one is carried on by the gap."""

    name: str
    version: str
    until: np.ndarray
    offset: np.ndarray
    abbreviations: dict[str, int]
    first: int
    last: int

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """Wall times beyond the table's years are looked up one by one in the zone's rules."""
        out = wall - self.offset[np.searchsorted(self.until, wall, side="right")]
        beyond = np.flatnonzero((wall < self.first) | (wall >= self.last))
        if len(beyond):
            zone, day = zoneinfo.ZoneInfo(self.name), timedelta(microseconds=1)
            out[beyond] = [w - int((datetime(1970, 1, 1) + w * day).replace(tzinfo=zone).utcoffset() / day) for w in wall[beyond].tolist()]
        return out


@functools.cache
def zone_data_version() -> str:
    """Version of the zone data in use."""
    for root in zoneinfo.TZPATH:
        try:
            with open(f"{root}/tzdata.zi") as f:
                return f.readline().rpartition(" ")[2].strip()
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@functools.lru_cache(maxsize=1024)
def zone_table(name: str, first_year: int = 1900, last_year: int = 2100) -> ZoneTable | None:
    """The transitions of a named zone, found by halving every 14-day span over which its offset differs; None for
    an unknown name."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    offset_at = lambda s: datetime.fromtimestamp(s, UTC).astimezone(zone).utcoffset()
    lo, hi = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (first_year, last_year))
    step, until, offsets, names = 14 * 86400, [], [offset_at(lo)], {}
    for a in range(lo, hi, step):
        x, y = a, min(a + step, hi)
        if (after := offset_at(y)) == (before := offset_at(x)):
            continue
        while y - x > 1:
            mid = (x + y) // 2
            x, y = (mid, y) if offset_at(mid) == before else (x, mid)
        until.append(y * 1_000_000 + int(max(before, after) / timedelta(microseconds=1)))
        offsets.append(after)
    for y in range(1970, 2038):
        for m in (1, 7):
            t = datetime(y, m, 1, tzinfo=UTC).astimezone(zone)
            names[t.tzname() or ""] = int(t.utcoffset() / timedelta(minutes=1))
    return ZoneTable(name, zone_data_version(), np.array(until, np.int64), np.array([int(o / timedelta(microseconds=1)) for o in offsets], np.int64), names, (lo + 2 * 86400) * 1_000_000, (hi - 2 * 86400) * 1_000_000)


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of proleptic Gregorian dates, and which of them exist (year 0 doesn't)."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
    y, m = np.where(ok, y, 1970), np.where(ok, m, 1)
    month = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1).astype("timedelta64[M]")
    first = month.astype("datetime64[D]").astype(np.int64)
    length = (month + np.timedelta64(1, "M")).astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, ok & (d <= length)


DATE = r"(?P<Y>9999)-(?P<M>99)-(?P<D>99)"
TIME = r"(?P<h>99):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
LAYOUTS = tuple(
    re.compile(x)
    for x in (
        rf"{DATE}(?:(?P<T>A)| +){TIME} ?(?P<zone>(?P<Z>A)|(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?)?(?:\[(?P<note>[^\]]+)\])?",
        rf"{DATE}(?:(?P<T>A)| +){TIME} +(?P<named>[Aa]+(?:/[Aa9_+\-]+)+|A+)",
        r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?P<T>A)(?P<h>99)(?P<m>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?(?P<zone>(?P<Z>A)|(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?)?",
        rf"(?P<D>99?)[/.](?P<M>99?)[/.](?P<Y>9999|99),? +{TIME}(?: ?(?P<zone>(?P<Z>A)|(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?))?",
        rf"(?:[Aa]{{3,9}}, +)?(?P<D>99?) +(?P<mon>[Aa]{{3,9}}) +(?P<Y>9999),? +{TIME}(?: +(?:(?P<zone>(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?)|(?P<named>A+)))?",
        r"(?P<mon>[Aa]{3,9}) +(?P<D>99?), +(?P<Y>9999),? +(?P<h>99?):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: *(?P<half>AA|aa))?(?: +(?:(?P<zone>(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?)|(?P<named>A+)))?",
    )
)
Parser = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _words(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(codes[:, span[0] : span[1]])
    return part.view(f"<U{span[1] - span[0]}").ravel()


def parser_for(shape: str) -> Parser | None:
    """:func:`compiled`, kept for shapes of usual length."""
    return _kept(shape) if len(shape) <= 64 else compiled(shape)


def compiled(shape: str) -> Parser | None:
    """The parser of a shape, or None where texts of this shape never name a date and time. It takes the code points,
    one row a text, and the row's zones, and gives microseconds, ``MISSING`` where a text names none."""
    if shape.strip("9") == "":
        unit = EPOCH_DIGITS.get(len(shape))
        return unit and (lambda codes, zones: (codes.astype(np.int64) - 48) @ (10 ** np.arange(codes.shape[1] - 1, -1, -1, dtype=np.int64)) * unit)
    for layout in LAYOUTS:
        if found := layout.fullmatch(shape):
            span = {k: found.span(k) for k, v in found.groupdict().items() if v is not None}
            return functools.partial(_parse, span)
    return None


_kept = functools.lru_cache(maxsize=65536)(compiled)


def _parse(span: dict[str, tuple[int, int]], codes: np.ndarray, zones: np.ndarray) -> np.ndarray:
    def number(field: str, default: int = 0) -> np.ndarray:
        if field not in span:
            return np.full(len(codes), default, np.int64)
        a, b = span[field]
        return (codes[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    ok = np.ones(len(codes), bool)
    year = number("Y")
    if span["Y"][1] - span["Y"][0] == 2:
        year = year + np.where(year < 69, 2000, 1900)
    if "mon" in span:
        names, at = np.unique(_words(codes, span["mon"]), return_inverse=True)
        month = np.array([MONTHS.get(str(n)[:3].lower(), 0) for n in names], np.int64)[at]
    else:
        month = number("M")
    hour = number("h")
    if "half" in span:
        half = codes[:, span["half"][0]] | 32
        ok &= ((half == ord("a")) | (half == ord("p"))) & ((codes[:, span["half"][1] - 1] | 32) == ord("m")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.where(half == ord("p"), 12, 0)
    if "T" in span:
        ok &= codes[:, span["T"][0]] == ord("T")
    minute, second, micros = number("m"), number("s"), np.zeros(len(codes), np.int64)
    if "f" in span:
        a, b = span["f"]
        digits = codes[:, a : min(b, a + 6)].astype(np.int64) - 48
        micros = digits @ (10 ** np.arange(5, 5 - digits.shape[1], -1, dtype=np.int64))
    day, real = days_from_civil(year, month, number("D"))
    ok &= real & (hour <= 23) & (minute <= 59) & (second <= 59)
    wall = ((day * 24 + hour) * 60 + minute) * MINUTE + second * 1_000_000 + micros
    if "Z" in span:
        ok &= codes[:, span["Z"][0]] == ord("Z")
        out = wall
    elif "sign" in span:
        oh, om = number("oh"), number("om")
        ok &= (oh <= 18) & (om <= 59)
        out = wall - np.where(codes[:, span["sign"][0]] == ord("-"), -1, 1) * (oh * 60 + om) * MINUTE
    elif "named" in span or "note" in span:
        out, known = _in_zones(wall, _words(codes, span.get("named") or span["note"]), zones)
        ok &= known
    else:
        out, known = _in_zones(wall, zones, zones)
        ok &= known
    return np.where(ok, out, MISSING)


def _in_zones(wall: np.ndarray, names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wall times to UTC by zone names; an abbreviation is first looked up among those of the row's own zone."""
    out, ok = wall.copy(), np.zeros(len(wall), bool)
    code, pairs = pd.MultiIndex.from_arrays([names, own]).factorize()
    for i, (name, row_zone) in enumerate(pairs):
        at = np.flatnonzero(code == i)
        if "/" not in name and name.isupper() and name != "UTC":
            mine = zone_table(row_zone)
            minutes = mine.abbreviations.get(name) if mine else None
            if minutes is None:
                minutes = ABBREVIATIONS.get(name)
            if minutes is not None:
                out[at], ok[at] = wall[at] - minutes * MINUTE, True
                continue
        if zone := zone_table(name):
            out[at], ok[at] = zone.to_utc(wall[at]), True
    return out, ok


def utc_micros(texts: pd.Series, zones: pd.Series) -> pd.Series:
    """Instants of a batch; null where a text is null or names no existing date and time. A text without a zone is
    local to ``zones``, UTC where that is null or blank; an unknown zone there makes the text unusable."""
    values = texts.to_numpy(dtype=object, na_value=None)
    cleaned = np.array([(t or "").strip() for t in values], object)
    zone = np.array([(z or "").strip() or "UTC" for z in zones.to_numpy(dtype=object, na_value=None)], object)
    out = np.full(len(cleaned), MISSING, np.int64)
    code, shapes = pd.factorize(np.array([t.translate(SHAPE) for t in cleaned], object))
    order, starts = np.argsort(code, kind="stable"), np.searchsorted(np.sort(code), np.arange(len(shapes) + 1))
    for i, shape in enumerate(shapes):
        if shape and shape.isascii() and (parse := parser_for(shape)):
            at = order[starts[i] : starts[i + 1]]
            codes = np.array(cleaned[at], f"<U{len(shape)}").view(np.uint32).reshape(len(at), len(shape))
            out[at] = parse(codes, zone[at])
    return pd.Series(out, dtype="Int64").mask(out == MISSING)


def _utc_micros_udf(version: str) -> Callable[..., Column]:
    @F.pandas_udf(T.LongType())
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if zone_data_version() != version:
            raise RuntimeError(f"zone data {zone_data_version()} here, {version} on the driver")
        for texts, zones in batches:
            yield utc_micros(texts, zones)

    return parsed


def to_utc_micros(text: Column | str, zone: Column | str) -> Column:
    """Microseconds since 1970 UTC of a timestamp text; see :func:`utc_micros`. Slashed and dotted dates are day
    first, two-digit years from 69 on are of the 1900s, digits beyond microseconds are cut, 10, 13 or 16 digits alone
    are seconds, milliseconds or microseconds. A written offset or zone overrules the row's zone, an offset overrules
    a zone noted beside it. A text may be of any length. A worker whose zone data is of another version than the
    driver's fails, rather than giving other instants than the rest."""
    return _utc_micros_udf(zone_data_version())(F.col(text) if isinstance(text, str) else text, F.col(zone) if isinstance(zone, str) else zone)


def normalised_instants(df: DataFrame, row_id: str, text: str, zone: str, table_name: str) -> DataFrame:
    """``table_name, row_id, utc_micros`` for every row with a usable text, repeated rows included. No shuffle: one
    scan of three columns and one Arrow step."""
    return (
        df.select(F.lit(table_name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), to_utc_micros(text, zone).alias("utc_micros"))
        .where(F.col("utc_micros").isNotNull())
    )
