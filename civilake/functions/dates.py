"""Date parsing and date arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def multi_date(c: Column) -> Column:
    """The date of a text such as ``2024-01-31``, ``2024.01.31`` or ``20240131``, or null."""
    text = F.trim(c.cast("string"))
    iso = F.regexp_replace(text, r"^(\d{4})[-.]?(\d{2})[-.]?(\d{2})$", "$1-$2-$3")
    return F.when(text.rlike(r"^\d{4}([-.]?)\d{2}\1\d{2}$"), iso.try_cast("date"))


def first_date(*columns: Column) -> Column:
    """The first column that parses as a date."""
    return F.coalesce(*(multi_date(c) for c in columns))


def iso_dates(c: Column) -> Column:
    """All ISO dates written in a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))


def survey_range(c: Column) -> tuple[Column, Column]:
    """First and last ISO date in a text; the same if there is one, null if none."""
    found = iso_dates(c)
    return F.get(found, F.lit(0)).try_cast("date"), F.when(F.size(found) > 0, F.element_at(found, -1)).try_cast("date")


def days_left(target: Column, today: Column) -> Column:
    """``D-3`` before, ``D-Day`` on, ``D+3`` after the date."""
    n = F.datediff(target, today)
    return F.when(n > 0, F.concat(F.lit("D-"), n)).when(n == 0, F.lit("D-Day")).otherwise(F.concat(F.lit("D+"), -n))


def date_bucket(c: Column, today: Column) -> Column:
    """today / week (7 days) / month (30 days) / older."""
    n = F.datediff(today, c)
    return F.when(n <= 0, "today").when(n <= 7, "week").when(n <= 30, "month").otherwise("older")


def rfc_2822(c: Column) -> Column:
    """The moment of a mail-style date such as ``Mon, 01 Jan 2024 09:00:00 +0900``, or null."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))


def published(c: Column, now: Column) -> Column:
    """The moment of a mail-style date, or ``now`` where there is none that can be read."""
    return F.coalesce(rfc_2822(c), now)


def survey_times(c: Column) -> Column:
    """All ``2024-01-02 9 시 0 분 ~ 18 시 0 분`` spans of a text, each on one line."""
    spans = F.regexp_extract_all(c, F.lit(r"\d{4}-\d{2}-\d{2}\s*\d+\s*시\s*\d+\s*분\s*~\s*\d+\s*시\s*\d+\s*분"), F.lit(0))
    return F.transform(spans, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def relative_time(c: Column, now: Column) -> Column:
    """How long ago a moment was, in its largest whole unit."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(c)
    out = F
    for size, name in ((86400, "day"), (3600, "hour"), (60, "minute")):
        out = out.when(seconds >= size, F.concat_ws(" ", F.floor(seconds / size), F.lit(f"{name}(s) ago")))
    return out.otherwise("just now")


def weekday(c: Column) -> Column:
    """The Korean weekday of a date."""
    return F.get(F.array(*(F.lit(day) for day in "일월화수목금토")), F.dayofweek(c) - 1)
