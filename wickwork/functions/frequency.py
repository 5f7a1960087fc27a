"""Calendar frequencies by pandas alias, as column arithmetic.

A frequency and an anchor (the first timestamp of a series) define a grid. Instead of building
the grid somewhere and joining to it, the operators number its points: ``ordinal`` gives the
number of the last grid point at or before a time, ``point`` the time of a numbered point. Both
are built-in integer and date expressions, so gaps can be found and filled row by row.

Times are epoch microseconds (``bigint``) throughout; see :func:`to_micros`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
DAY = 86_400 * SECOND

# Pandas aliases of fixed length, old spellings included, in microseconds.
FIXED_STEPS = {
    "us": 1,
    "ms": 1_000,
    "s": SECOND,
    "S": SECOND,
    "min": 60 * SECOND,
    "T": 60 * SECOND,
    "h": 3_600 * SECOND,
    "H": 3_600 * SECOND,
    "D": DAY,
}
# Pandas aliases which follow the calendar, with the kind of grid they stand for.
CALENDAR_KINDS = {
    "B": "business",
    "W": "week",
    "MS": "month_start",
    "M": "month_end",
    "ME": "month_end",
    "QS": "quarter_start",
    "Q": "quarter_end",
    "QE": "quarter_end",
    "YS": "year_start",
    "AS": "year_start",
    "Y": "year_end",
    "A": "year_end",
    "YE": "year_end",
}
# Days between 1970-01-01 (a Thursday) and the first such weekday after it.
WEEKDAY_OFFSETS = {"THU": 0, "FRI": 1, "SAT": 2, "SUN": 3, "MON": 4, "TUE": 5, "WED": 6}
MONTHS_PER_KIND = {"month": 1, "quarter": 3, "year": 12}


def floor_div(a: Column, b: int | Column) -> Column:
    """Integer division rounding down, exact for 64-bit values of either sign."""
    divisor = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, divisor), divisor)


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(micros: Column, like: T.DataType) -> Column:
    """Back from microseconds to the type the caller's column had."""
    return F.timestamp_micros(micros).cast(like)


def _date_of(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def _month_index(days: Column) -> Column:
    date = _date_of(days)
    return (F.year(date) * 12 + F.month(date) - 1).cast("bigint")


def _month_start(index: Column) -> Column:
    first = F.make_date(floor_div(index, 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.unix_date(first).cast("bigint")


@dataclass(frozen=True)
class Frequency:
    """A grid of time points, ``count`` units apart."""

    count: int
    unit_micros: int
    kind: str = "fixed"
    weekday: int = 0

    @classmethod
    def of(cls, alias: str | Frequency) -> Frequency:
        if isinstance(alias, Frequency):
            return alias
        found = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", alias)
        if not found or found[1] == "0":
            raise ValueError(f"not a frequency: {alias!r}")
        count, name, day = int(found[1] or 1), found[2], found[3]
        if name in FIXED_STEPS and not day:
            return cls(count, FIXED_STEPS[name])
        kind = CALENDAR_KINDS.get(name)
        if kind == "week":
            if day and day not in WEEKDAY_OFFSETS:
                raise ValueError(f"not a weekday: {day!r}")
            return cls(count, 7 * DAY, kind, WEEKDAY_OFFSETS[day or "SUN"])
        if kind is None or day:
            raise ValueError(f"unsupported frequency: {alias!r}")
        return cls(count, DAY * (MONTHS_PER_KIND.get(kind.split("_")[0], 0) * 28 or 1), kind)

    @property
    def nominal_micros(self) -> int:
        """A lower bound of the time between two points; sizes blocks."""
        return self.count * self.unit_micros

    def _unit(self, days: Column) -> Column:
        """Number of the last unit point at or before a day."""
        if self.kind == "business":
            since_monday = days - WEEKDAY_OFFSETS["MON"]
            return floor_div(since_monday, 7) * 5 + F.least(F.pmod(since_monday, F.lit(7)), F.lit(4))
        if self.kind == "week":
            return floor_div(days - self.weekday, 7)
        period, side = self.kind.split("_")
        months = MONTHS_PER_KIND[period]
        if side == "start":
            return floor_div(_month_index(days), months)
        return floor_div(_month_index(days + 1), months) - 1

    def _day(self, unit: Column) -> Column:
        """The day of a unit point."""
        if self.kind == "business":
            return floor_div(unit, 5) * 7 + F.pmod(unit, F.lit(5)) + WEEKDAY_OFFSETS["MON"]
        if self.kind == "week":
            return unit * 7 + self.weekday
        period, side = self.kind.split("_")
        months = MONTHS_PER_KIND[period]
        if side == "start":
            return _month_start(unit * months)
        return _month_start((unit + 1) * months) - 1

    def _first_unit(self, anchor: Column) -> Column:
        day = floor_div(anchor, DAY)
        unit = self._unit(day)
        return F.when(self._day(unit) == day, unit).otherwise(unit + 1)

    def ordinal(self, micros: Column, anchor: Column) -> Column:
        """Number of the last grid point at or before ``micros``; the first grid point is 0."""
        if self.kind == "fixed":
            return floor_div(micros - anchor, self.nominal_micros)
        time_of_day = F.pmod(anchor, F.lit(DAY))
        unit = self._unit(floor_div(micros - time_of_day, DAY))
        return floor_div(unit - self._first_unit(anchor), self.count)

    def point(self, ordinal: Column, anchor: Column) -> Column:
        """Time of a numbered grid point."""
        if self.kind == "fixed":
            return anchor + ordinal * F.lit(self.nominal_micros)
        day = self._day(self._first_unit(anchor) + ordinal * self.count)
        return day * F.lit(DAY) + F.pmod(anchor, F.lit(DAY))
