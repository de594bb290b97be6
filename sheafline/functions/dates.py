"""Dates as yyyymmdd numbers, ages, decay, and the time scope of a question."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_int(day: Column) -> Column:
    """yyyymmdd; 0 for no date."""
    return F.coalesce(F.date_format(day.cast("date"), "yyyyMMdd").cast("int"), F.lit(0))


def age_days(day: Column, anchor: Column) -> Column:
    """Days between the two, without sign; 0 if one is missing."""
    return F.coalesce(F.abs(F.datediff(anchor.cast("date"), day.cast("date"))), F.lit(0))


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(max(1.0, float(half_life))))


@dataclass(frozen=True)
class Scope:
    start: dt.date
    end: dt.date
    kind: str


_SEASONS = {"spring": 3, "frühling": 3, "printemps": 3, "primavera": 3, "summer": 6, "sommer": 6, "été": 6, "verano": 6, "autumn": 9, "herbst": 9, "automne": 9, "otoño": 9, "winter": 12, "hiver": 12, "invierno": 12}
_NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}


def time_scope(question: str | None, anchor: dt.date) -> Scope | None:
    """The span of days a question speaks of, the latest at or before the anchor; None if of none."""
    q = (question or "").lower()

    def month(year: int, number: int) -> tuple[dt.date, dt.date]:
        return dt.date(year, number, 1), dt.date(year, number, calendar.monthrange(year, number)[1])

    if m := re.search(r"\b(20\d\d)\b", q):
        year = int(m[1])
        return Scope(dt.date(year, 1, 1), dt.date(year, 12, 31), "year")
    if "yesterday" in q or "gestern" in q or "hier " in q or "ayer" in q:
        day = anchor - dt.timedelta(days=1)
        return Scope(day, day, "yesterday")
    if m := re.search(r"\b(\d+|one|two|three|four|five|six) months? ago\b", q):
        back = _NUMBERS.get(m[1]) or int(m[1])
        middle = anchor - dt.timedelta(days=30 * back)
        return Scope(*month(middle.year, middle.month), "months ago")
    if "last week" in q or "letzte woche" in q or "semaine dernière" in q or "semana pasada" in q:
        return Scope(anchor - dt.timedelta(days=10), anchor, "last week")
    if "last month" in q or "letzten monat" in q or "mois dernier" in q or "mes pasado" in q:
        before = anchor.replace(day=1) - dt.timedelta(days=1)
        return Scope(*month(before.year, before.month), "last month")
    if "last year" in q or "letztes jahr" in q or "année dernière" in q or "año pasado" in q:
        return Scope(dt.date(anchor.year - 1, 1, 1), dt.date(anchor.year - 1, 12, 31), "last year")
    if "recently" in q or "kürzlich" in q or "récemment" in q or "recientemente" in q:
        return Scope(anchor - dt.timedelta(days=60), anchor, "recently")
    for name, first in _SEASONS.items():
        if re.search(rf"\b{name}\b", q):
            year = anchor.year
            while dt.date(year, first, 1) > anchor:
                year -= 1
            last_year, last_month = (year, first + 2) if first < 12 else (year + 1, 2)
            return Scope(dt.date(year, first, 1), month(last_year, last_month)[1], "season")
    for number in range(1, 13):
        if re.search(rf"\b{calendar.month_name[number].lower()}\b", q):
            year = anchor.year if dt.date(anchor.year, number, 1) <= anchor else anchor.year - 1
            return Scope(*month(year, number), "month")
    return None
