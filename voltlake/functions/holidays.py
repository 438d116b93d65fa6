"""Bank holidays of England by their rules."""

from __future__ import annotations

from datetime import date, timedelta

#: Days of single years, and those that they were moved from.
EXTRA = ["1995-05-08", "1999-12-31", "2002-06-03", "2002-06-04", "2011-04-29", "2012-06-04", "2012-06-05", "2020-05-08", "2022-06-02", "2022-06-03", "2022-09-19", "2023-05-08"]
MOVED = ["1995-05-01", "2002-05-27", "2012-05-28", "2020-05-04", "2022-05-30"]


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar, by the moon's age and the Sunday after it."""
    century, golden = year // 100, year % 19
    moon = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon -= (moon // 28) * (1 - (29 // (moon + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    return date(year, 3, 28) + timedelta(days=moon - weekday)


def _monday(year: int, month: int, last: bool) -> date:
    day = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1) if last else date(year, month, 7)
    return day - timedelta(days=day.weekday())


def england(year: int) -> list[date]:
    """The bank holidays of a year from 1978 on; one on a weekend counts, and so does the working
    day that stands for it."""
    days = [easter(year) - timedelta(days=2), easter(year) + timedelta(days=1), _monday(year, 5, False), _monday(year, 5, True), _monday(year, 8, True)]
    taken = set(days)
    for fixed in (date(year, 1, 1), date(year, 12, 25), date(year, 12, 26)):
        days.append(fixed)
        taken.add(fixed)
    for fixed in (date(year, 1, 1), date(year, 12, 25), date(year, 12, 26)):
        if fixed.weekday() >= 5:
            while fixed.weekday() >= 5 or fixed in taken:
                fixed += timedelta(days=1)
            days.append(fixed)
            taken.add(fixed)
    days = [d for d in days if d.isoformat() not in MOVED] + [date.fromisoformat(d) for d in EXTRA if d.startswith(str(year))]
    return sorted(set(days))


def between(first: int, last: int) -> list[str]:
    return [d.isoformat() for y in range(first, last + 1) for d in england(y)]
