"""Dates, months and windows of time as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR_S = 365.25 * 86400


def parse_date(c: Column) -> Column:
    """A timestamp of ISO text, year-month, year, or a year as a number from 1500 to 2200; else null."""
    text = F.trim(c.cast("string"))
    year = F.when(text.rlike(r"^\d{4}(\.0+)?$"), F.substring(text, 1, 4).cast("int"))
    year = F.when(year.between(1500, 2200), year)
    month = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01")))
    return F.coalesce(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.try_to_timestamp(month, F.lit("yyyy-M-d")), F.when(text.rlike(r"^\d{4}-\d"), F.try_to_timestamp(text)))


def years_between(later: Column, earlier: Column) -> Column:
    """Fractional years of 365.25 days: by days and times of day, so zones and clock changes don't matter."""
    seconds = lambda c: F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c).cast("double")
    return (F.datediff(later, earlier) * 86400.0 + seconds(later) - seconds(earlier)) / F.lit(YEAR_S)


def in_month_window(month: Column, first: int, last: int) -> Column:
    """Whether a month is in an inclusive window, which may go over the new year."""
    return month.between(first, last) if first <= last else (month >= first) | (month <= last)


def month_distance(month: Column, first: int, last: int) -> Column:
    """Months, around the year, from the middle of a window."""
    length = (last - first) % 12
    gap = F.pmod(month - F.lit((first + length / 2.0)), F.lit(12.0))
    return F.least(gap, 12 - gap)


def overlaps_year(start: Column, end: Column, year: int) -> Column:
    """Whether the half-open window [start, end) has a day of the year."""
    return (start < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))) & (end > F.make_date(F.lit(year), F.lit(1), F.lit(1)))


def query_window(start: Column, end: Column, missing: int = 2012, instead: int = 2013) -> tuple[Column, Column]:
    """Half-open window of inclusive days; one inside the missing year is moved to the other."""
    inside = (F.year(start) == missing) & (F.year(end) == missing)
    months = F.lit(12 * (instead - missing))
    return F.when(inside, F.add_months(start, months)).otherwise(start), F.date_add(F.when(inside, F.add_months(end, months)).otherwise(end), 1)


def wave_label(c: Column) -> Column:
    return F.year(c).cast("string")


def year_month(c: Column) -> Column:
    """(year, month) of text such as 2019-07; the month may be missing."""
    part = lambda i: F.regexp_extract(c, r"^(\d{4})(?:-(\d{1,2}))?$", i)
    return F.struct(F.when(part(1) != "", part(1)).cast("int").alias("year"), F.when(part(2) != "", part(2)).cast("int").alias("month"))


def format_year_month(year: Column, month: Column) -> Column:
    return F.when(month.isNull(), F.format_string("%04d", year)).otherwise(F.format_string("%04d-%02d", year, month))


def season_bounds(year: Column, first: int, last: int) -> tuple[Column, Column]:
    """First and last day of a season of months in a year (its end in the next one if it goes over)."""
    end = year if first <= last else year + 1
    return F.make_date(year, F.lit(first), F.lit(1)), F.last_day(F.make_date(end, F.lit(last), F.lit(1)))


def shift_day(day: Column, days: int) -> Column:
    return F.date_add(day, days)


def window_text(start: Column, end: Column) -> Column:
    """First to last day of a half-open window."""
    return F.concat_ws(" to ", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_sub(end, 1), "yyyy-MM-dd"))


def substitute_year(start: Column, end: Column, year: int = 2012, to: int = 2013) -> tuple[Column, Column, Column]:
    """A half-open window that lies wholly in one year, on the same days of another (29 February on the 28th), and whether it was moved."""
    last = F.date_sub(end, 1)
    moved = (F.year(start) == year) & (F.year(last) == year)
    move = lambda d: F.add_months(d, 12 * (to - year))
    return F.when(moved, move(start)).otherwise(start), F.when(moved, F.date_add(move(last), 1)).otherwise(end), moved


def window_miss(captures: Column, target_year: Column, max_gap: int | None) -> Column:
    """Which rule left a location without a capture: `year` when none is near the target year, else `month`. captures: array of structs with year."""
    if max_gap is None:
        return F.lit("month")
    near = F.exists(captures, lambda c: F.coalesce(F.abs(c["year"] - target_year) <= max_gap, F.lit(False)))
    return F.when(target_year.isNull() | near, "month").otherwise("year")


def with_year(df: DataFrame, date: str, name: str = "_year") -> DataFrame:
    """Rows whose date is told, with its year."""
    return df.withColumn(name, F.year(parse_date(F.col(date)))).where(F.col(name).isNotNull())


def years_of(frames: list[DataFrame], date: str) -> DataFrame:
    """(year), distinct and in order, over several tables."""
    out = None
    for df in frames:
        if date not in df.columns:
            raise ValueError(f"a table has no column {date}")
        part = with_year(df, date).select(F.col("_year").alias("year"))
        out = part if out is None else out.unionByName(part)
    return out.distinct().orderBy("year")


def year_windows(df: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """(year, rows, first day, last day) of the season months of each year that occurs."""
    years = with_year(df, date).groupBy(F.col("_year").alias("year")).agg(F.count("*").alias("n"))
    begin, end = season_bounds(F.col("year"), first, last)
    return years.select("year", "n", begin.alias("first_day"), end.alias("last_day"))
