"""Fiscal-year and calendar columns (UTC calendar dates, April to March)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.vectors import let


def fy_start_year(date: Column) -> Column:
    return F.year(F.add_months(date, 1 - fv.FISCAL_START_MONTH))


def fy_key_of_year(start_year: Column) -> Column:
    return F.concat(
        start_year.cast("string"), F.lit("-"), F.lpad(F.pmod(start_year + 1, F.lit(100)).cast("string"), 2, "0")
    )


def fy_key(date: Column) -> Column:
    return fy_key_of_year(fy_start_year(date))


def previous_fy(key: Column) -> Column:
    return fy_key_of_year(F.substring(key, 1, 4).cast("int") - 1)


def next_fy(key: Column) -> Column:
    return fy_key_of_year(F.substring(key, 1, 4).cast("int") + 1)


def fy_window(key: Column) -> Column:
    year = F.substring(key, 1, 4).cast("int")
    return F.struct(
        F.make_date(year, F.lit(4), F.lit(1)).alias("start"),
        F.make_date(year + 1, F.lit(3), F.lit(31)).alias("end"),
    )


def in_fy(date: Column, key: Column) -> Column:
    window = fy_window(key)
    return date.between(window["start"], window["end"])


def fiscal_month_number(date: Column) -> Column:
    """1 for April ... 12 for March."""
    return F.month(F.add_months(date, 1 - fv.FISCAL_START_MONTH))


def fiscal_month_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in fv.FISCAL_MONTHS]), number - 1)


def add_cadence(date: Column, cadence: Column) -> Column:
    """One cadence later, clamped to the month's last day."""
    months = F.create_map(*[F.lit(x) for pair in fv.CADENCE_MONTHS.items() for x in pair])[cadence]
    return F.add_months(date, months)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def statement_date(day: Column, month: Column, year: Column) -> Column:
    """Date from dd, mm, yy(yy) digits, null unless it is a real day in 2000-2099."""
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    made = F.try_to_date(F.concat_ws("-", full, month, day), "yyyy-MM-dd")
    return let(made, lambda m: F.when(F.year(m).between(2000, 2099), m))
