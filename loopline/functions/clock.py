"""Clocks, journey days, weekday masks and yearly windows as Columns.

Clocks are minutes 0..1439 or null, absolute times are minutes from 00:00 of day 1, weekday
sets are 7-bit masks with bit 0 for Monday; null always means unknown, never empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]


def parse_clock(text: Column) -> Column:
    """Minutes of ``H:MM``, ``HH:MM`` or ``HH:MM:SS``; null for anything else or out of range."""
    shape = r"^(\d{1,2}):(\d{2})(?::\d{2})?$"
    ok = F.trim(text).rlike(shape)
    h = F.regexp_extract(F.trim(text), shape, 1).try_cast("int")
    m = F.regexp_extract(F.trim(text), shape, 2).try_cast("int")
    return F.when(ok & (h < 24) & (m < 60), h * 60 + m)


def format_clock(minutes: Column) -> Column:
    """``HH:MM`` of minutes of any sign, modulo one day."""
    m = F.pmod(minutes, F.lit(DAY))
    return F.when(
        minutes.isNotNull(),
        F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0")),
    )


def absolute(day: Column, clock: Column) -> Column:
    """Minutes since 00:00 of day 1."""
    return (day - 1) * DAY + clock


def day_of(absolute_minutes: Column) -> Column:
    """Journey day, from 1, of absolute minutes."""
    return (F.floor(absolute_minutes / DAY) + 1).cast("int")


def crosses_midnight(dep: Column, arr: Column) -> Column:
    """Whether the arrival's day is later than the departure's, both in absolute minutes."""
    return F.floor(arr / DAY) > F.floor(dep / DAY)


def until_next(arrival: Column, departure: Column) -> Column:
    """Minutes from one clock to the next occurrence of another, 0..1439."""
    return F.pmod(departure - arrival, F.lit(DAY)).cast("int")


def in_clock_window(clock: Column, start: Column, end: Column) -> Column:
    """Whether a clock lies in an inclusive window that may wrap midnight; a missing bound is the day's."""
    a, b = F.coalesce(start, F.lit(0)), F.coalesce(end, F.lit(DAY - 1))
    return F.when(a <= b, (clock >= a) & (clock <= b)).otherwise((clock >= a) | (clock <= b))


def weekday_index(date: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(date)


def weekday_name(date: Column) -> Column:
    """MON to SUN of a date."""
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(date) + 1)


def days_mask(days: Column) -> Column:
    """7-bit mask of a list of weekday names; null stays null, the empty list is 0."""
    bits = [F.when(F.array_contains(days, d), 1 << i).otherwise(0) for i, d in enumerate(WEEKDAYS)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return F.when(days.isNotNull(), total.cast("int"))


def mask_days(mask: Column) -> Column:
    """Weekday names of a mask in order from Monday; null of a null mask."""
    names = F.filter(
        F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(d)) for i, d in enumerate(WEEKDAYS)]), lambda x: x.isNotNull()
    )
    return F.when(mask.isNotNull(), names)


def shift_mask(mask: Column, days: Column) -> Column:
    """Weekdays moved by a number of days of either sign."""
    k = F.pmod(days, F.lit(7)).cast("int")
    return F.call_function("shiftleft", mask, k).bitwiseOR(F.call_function("shiftright", mask, F.lit(7) - k)).bitwiseAND(127)


def runs_on(mask: Column, weekday: Column) -> Column:
    """Whether a train runs on a weekday index; an unknown mask passes."""
    return mask.isNull() | (F.call_function("shiftright", mask, weekday).bitwiseAND(1) == 1)


def mask_of_binary(text: Column) -> Column:
    """Mask of seven digits 0 or 1 from Monday; null if malformed."""
    ok = text.rlike("^[01]{7}$")
    total = F.lit(0)
    for i in range(7):
        total = total + F.when(F.substring(text, i + 1, 1) == "1", 1 << i).otherwise(0)
    return F.when(ok, total)


def in_yearly_window(month_day: Column, start: Column, end: Column) -> Column:
    """Whether an MM-DD lies in an inclusive yearly window that may wrap the year's end; no window is always."""
    inside = F.when(start <= end, (month_day >= start) & (month_day <= end)).otherwise((month_day >= start) | (month_day <= end))
    return F.when(start.isNull() | end.isNull(), F.lit(True)).otherwise(inside)


def window_complement(start: Column, end: Column) -> tuple[Column, Column]:
    """The yearly window of all other days, counted in a year without 29 February."""
    def at(c: Column, by: int) -> Column:
        return F.date_format(F.date_add(F.concat(F.lit("2001-"), c).try_cast("date"), by), "MM-dd")

    return at(end, 1), at(start, -1)


def window_days(start: Column, end: Column) -> Column:
    """All MM-DD of a yearly window, in a year without 29 February, in order of the window."""
    a, b = F.concat(F.lit("2001-"), start).try_cast("date"), F.concat(F.lit("2001-"), end).try_cast("date")
    first, last = F.lit("2001-01-01").cast("date"), F.lit("2001-12-31").cast("date")
    days = F.when(a <= b, F.sequence(a, b)).otherwise(F.concat(F.sequence(a, last), F.sequence(first, b)))
    return F.transform(days, lambda d: F.date_format(d, "MM-dd"))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def season_window(text: Column) -> tuple[Column, Column]:
    """MM-DD bounds of a phrase such as ``10th June to 31st October``; null if it is none."""
    shape = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3})[a-z]*\s+to\s+(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3})[a-z]*"

    def part(day: int, month: int) -> Column:
        m = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.regexp_extract(text, shape, month)))
        d = F.regexp_extract(text, shape, day).try_cast("int")
        return F.when((m > 0) & d.between(1, 31), F.format_string("%02d-%02d", m.cast("int"), d))

    return part(1, 2), part(3, 4)


def is_iso_date(text: Column) -> Column:
    """Whether a text is a real calendar date written YYYY-MM-DD."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), F.lit(False))


def local_date(instant: Column, zone: str = "Asia/Kolkata") -> Column:
    """Date of a UTC instant in a time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))


def leg_arrival(dep: Column, arr: Column, duration: Column, tolerance: int = 120) -> Column:
    """Absolute arrival of a leg given both clocks and the duration.

    Of the days at, before and after the one the duration suggests, takes the arrival nearest
    to departure plus duration; null when none lies within the tolerance or the leg would not
    move forward in time.
    """
    target = dep + duration
    base = F.floor(target / DAY) * DAY + arr
    best = F.array_min(
        F.transform(F.array(base - DAY, base, base + DAY), lambda c: F.struct(F.abs(c - target).alias("off"), c.alias("at")))
    )
    return F.when((best["off"] <= tolerance) & (best["at"] > dep), best["at"].cast("int"))


def dotted_minutes(text: Column) -> Column:
    """Minutes of ``HH.MM`` where hours may exceed 24; null if malformed."""
    shape = r"^(\d{1,3})\.(\d{2})$"
    m = F.regexp_extract(text, shape, 2).try_cast("int")
    return F.when(text.rlike(shape) & (m < 60), F.regexp_extract(text, shape, 1).try_cast("int") * 60 + m)


def printed_clock(text: Column) -> Column:
    """Clock of a printed timetable: ``HH.MM`` or ``HH:MM``, 24.00 being midnight."""
    m = dotted_minutes(F.regexp_replace(F.trim(text), ":", "."))
    return F.when(m <= DAY, F.pmod(m, F.lit(DAY)).cast("int"))


def signed_delay(text: Column) -> Column:
    """Minutes of ``h:mm`` to ``hhh:mm`` with an optional minus; ``On Time`` is 0, blank and ``-`` null, other text an error."""
    t = F.trim(text)
    shape = r"^(-?)(\d{1,3}):([0-5]\d)$"
    size = F.regexp_extract(t, shape, 2).try_cast("int") * 60 + F.regexp_extract(t, shape, 3).try_cast("int")
    bad = F.raise_error(F.concat(F.lit("unrecognised delay: "), t)).cast("int")
    return (
        F.when(t.isNull() | t.isin("", "-"), F.lit(None).cast("int")).when(F.lower(t) == "on time", 0)
        .when(t.rlike(shape), F.when(F.regexp_extract(t, shape, 1) == "-", -size).otherwise(size)).otherwise(bad)
    )


def halt(arr: Column, dep: Column, longest: int = 720) -> Column:
    """Minutes of a stop from both clocks; null when either is missing or the halt is implausibly long."""
    m = until_next(arr, dep)
    return F.when(m <= longest, m)


def round1(x: Column) -> Column:
    """One decimal, halves towards plus infinity, also for negative values."""
    return F.floor(x * 10 + 0.5) / 10
