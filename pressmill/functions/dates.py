"""Dates in free text.

A small grammar: a text's time of day, zone and date are found wherever they stand, by the first of
these forms that fits:

    date     2015-11-26 | 2015/11/26 | 20151126[1030[15]] | 26 November 2015 | 26th of Nov, 2015 | Nov 26, 2015 | November 2015
             | 11/26/2015 | 26/11/2015 | 11-26-15 | today | yesterday | 3 hours ago | Nov 26 (year of the anchor) | none (day of the anchor)
    time     10:27[:15[.250]] [am|pm] | 5 pm | noon | midnight
    zone     Z | +01:00 | +0100 | +01 | a listed name

Numeric dates are month first unless only the other order is a date. Two digits of a year
mean 1969 to 2068. A text without a time is midnight, one without a zone is UTC. Words around them do not
matter. Where a part is missing the anchor gives it (a timestamp column, such as the crawl time); without an
anchor those forms, like every text without a date or with an impossible one, give NULL.

As one Column expression the grammar outgrows the size of a compiled method, so it
runs as an Arrow function, over columns of short texts only.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: English month names and their usual short forms.
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
          "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
          "sept": 9, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
#: Fixed: zone names and their minutes east of Greenwich.
ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
         "msk": 180, "jst": 540, "aest": 600, "aedt": 660, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
         "mdt": -360, "pst": -480, "pdt": -420}
#: Seconds of the units that "... ago" counts.
UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}

_MONTH = "(?P<month>" + "|".join(MONTHS) + r")\b\.?"
_YEAR = r"'?(?P<year>\d{4}(?!\d)|\d{2}(?![\d:]))"
_CLOCK = (r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2})(?:[.,](?P<part>\d{1,9}))?)?(?:\s?(?P<half>[ap])\.?m\b\.?)?"
          r"(?:\s?\(?(?P<zone>" + "|".join(sorted(ZONES, key=len, reverse=True)) + r")\b"
          r"|\s?(?P<sign>[+-])(?P<zh>\d{2}):?(?P<zm>\d{2})?(?!\d))?")
_TIME = re.compile(r"(?:(?<=\dt)|(?<![\w:.+-])|(?<=[0-9]{4}:))" + _CLOCK)
_HOUR = re.compile(r"(?<![\w:.])(?P<hour>\d{1,2})\s?(?P<half>[ap])\.?m\b")
_COMPACT = re.compile(r"(?<!\d)(?P<year>(?:19|20)\d{2})(?P<month>[01]\d)(?P<day>[0-3]\d)"
                      r"(?:t?(?P<hour>\d{2})(?P<minute>\d{2})(?P<second>\d{2})?)?(?!\d)")
_DATES = [re.compile(p) for p in (
    r"(?<!\d)(?P<year>\d{4})[-/.](?P<month>\d{1,2})[-/.](?P<day>\d{1,2})(?!\d)",
    _COMPACT.pattern,
    r"(?<![\d:])(?P<day>\d{1,2})(?:st|nd|rd|th)?(?:\s+of)?[\s.,/-]*\b" + _MONTH + r"(?:[\s,./-]*" + _YEAR + ")?",
    r"\b" + _MONTH + r"[\s.-]*(?P<day>\d{1,2})(?:st|nd|rd|th)?(?![\d:])(?:[\s,./-]+" + _YEAR + ")?",
    r"(?<!\d[\s./-])\b" + _MONTH + r"[\s,./-]*(?P<year>\d{4})(?!\d)",  # without a day before it
    r"(?<![\d:])(?P<month>\d{1,2})(?P<mark>[/.-])(?P<day>\d{1,2})(?P=mark)" + _YEAR,
    r"(?<![\d:])(?P<day>\d{1,2})(?P<mark>[/.-])(?P<month>\d{1,2})(?P=mark)" + _YEAR)]
_AGO = re.compile(r"\b(\d{1,5}|an?)\s+(" + "|".join(UNITS) + r")s?\s+ago\b")
_DAY_WORD = re.compile(r"\b(?:(yesterday)|today)\b")


def _year(text: str) -> int:
    return int(text) if len(text) == 4 else int(text) + (2000 if int(text) < 69 else 1900)


def _day(s: str, anchor: datetime | None) -> datetime | None:
    """Midnight of the first date that a form finds."""
    for form in _DATES:
        for found in form.finditer(s):
            g = found.groupdict()
            year = _year(g["year"]) if g.get("year") else anchor.year if anchor else None
            month = MONTHS[g["month"]] if g["month"] in MONTHS else int(g["month"])
            try:
                return datetime(year, month, int(g.get("day") or 1))
            except (TypeError, ValueError):  # no year, or no such day
                continue
    if anchor is None:
        return None
    today = anchor.replace(hour=0, minute=0, second=0, microsecond=0)
    if word := _DAY_WORD.search(s):
        return today - timedelta(days=bool(word.group(1)))
    return today if _TIME.search(s) and not re.search(r"\d[/.-]\d", s) else None


def _time(s: str) -> timedelta | None:
    """What to add to midnight, the zone's offset included; None for an impossible time."""
    found = _TIME.search(s)
    compact = None if found else next((c for c in _COMPACT.finditer(s) if c["hour"]), None)
    g = (found or compact or _HOUR.search(s))
    g = g.groupdict() if g else {"hour": "12" if re.search(r"\bnoon\b", s) else "0"}
    hour, minute, second = (int(g.get(k) or 0) for k in ("hour", "minute", "second"))
    if g.get("half"):
        hour = hour % 12 + (12 if g["half"] == "p" else 0)
    east = ZONES[g["zone"]] if g.get("zone") else int(g.get("zh") or 0) * 60 + int(g.get("zm") or 0)
    east = -east if g.get("sign") == "-" else east
    if hour > 23 or minute > 59 or second > 59 or abs(east) > 14 * 60:
        return None
    return timedelta(hours=hour, minutes=minute - east, seconds=second, microseconds=int((g.get("part") or "0")[:6].ljust(6, "0")))


@lru_cache(maxsize=100_000)
def resolve(text: str | None, anchor: datetime | None = None) -> datetime | None:
    """The time (UTC, naive) that a text names."""
    s = " ".join((text or "").lower().split())
    if not s:
        return None
    if anchor is not None and (ago := _AGO.search(s)):
        return anchor - timedelta(seconds=(1 if ago.group(1)[0] == "a" else int(ago.group(1))) * UNITS[ago.group(2)])
    day, time = _day(s, anchor), _time(s)
    try:
        return None if day is None or time is None else day + time
    except OverflowError:
        return None


_EPOCH = datetime(1970, 1, 1)


def _micros(t: datetime | None) -> int | None:
    return None if t is None else (t - _EPOCH) // timedelta(microseconds=1)


def _from_micros(m) -> datetime | None:
    return None if m is None or m != m else _EPOCH + timedelta(microseconds=int(m))


@F.pandas_udf(T.LongType())
def _resolved(texts: pd.Series, anchors: pd.Series) -> pd.Series:
    return pd.Series([_micros(resolve(t, _from_micros(a))) for t, a in zip(texts, anchors)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _first_resolved(lists: pd.Series, anchors: pd.Series) -> pd.Series:
    out = []
    for texts, a in zip(lists, anchors):
        found = (resolve(t, _from_micros(a)) for t in (texts if texts is not None else ()))
        out.append(_micros(next((t for t in found if t is not None), None)))
    return pd.Series(out, dtype="Int64")


def _anchor(anchor: Column | None) -> Column:
    return F.lit(None).cast("long") if anchor is None else F.unix_micros(anchor)


def parse_date(x, anchor: Column | None = None) -> Column:
    """The timestamp (UTC) that a text names."""
    return F.timestamp_micros(_resolved(F.col(x) if isinstance(x, str) else x, _anchor(anchor)))


def first_date(x, anchor: Column | None = None) -> Column:
    """The first of an array of texts that names a time."""
    return F.timestamp_micros(_first_resolved(F.col(x) if isinstance(x, str) else x, _anchor(anchor)))
