"""Money columns: signed integer minor units in, whole major units only on output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom import fixed_values as fv


def js_round(value: Column) -> Column:
    """Halves go up (towards +infinity), unlike Spark's round()."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def to_major(minor: Column) -> Column:
    """Minor to major units, halves up, in exact integer arithmetic."""
    shifted = F.coalesce(minor, F.lit(0)).cast("bigint") + F.lit(fv.MINOR_PER_MAJOR // 2)
    whole = shifted - F.pmod(shifted, F.lit(fv.MINOR_PER_MAJOR))
    return F.call_function("div", whole, F.lit(fv.MINOR_PER_MAJOR))


def to_minor(text: Column) -> Column:
    """'1,80,000.5' to 18000050; null when it is not a number or too large to hold."""
    number = F.regexp_replace(text, ",", "").try_cast("decimal(28,2)")
    return (number * F.lit(fv.MINOR_PER_MAJOR)).try_cast("bigint")


def near(a: Column, b: Column, tolerance: float) -> Column:
    gap = F.abs(F.abs(a) - F.abs(b))
    return F.when(b == 0, a == 0).otherwise(gap <= F.abs(b) * F.lit(tolerance))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 when the whole is not positive."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.when(whole > 0, js_round(ratio * 100)).otherwise(F.lit(0).cast("bigint"))


def savings_rate(income: Column, expense: Column) -> Column:
    return percent(income - expense, income)


def direction(amount: Column) -> Column:
    return F.when(amount >= 0, "credit").otherwise("debit")


def amount_bucket(amount: Column) -> Column:
    major = to_major(F.abs(amount))
    band = F.lit(fv.AMOUNT_BAND_TOP)
    for limit, name in reversed(fv.AMOUNT_BANDS):
        band = F.when(major < limit, F.lit(name)).otherwise(band)
    return F.concat(F.when(amount >= 0, "income").otherwise("expense"), F.lit(":"), band)


def flow_fits_sign(amount: Column, flow: Column, allow_transfer: bool) -> Column:
    return (
        F.when(flow == "transfer", F.lit(allow_transfer))
        .when(amount > 0, flow == "income")
        .otherwise(flow.isin("expense", "investment"))
    )


def human_bytes(count: Column) -> Column:
    """'512 B', '1.5 KB', '23 MB' ... one decimal only below ten units."""
    value = count.cast("double")
    shown = F.concat(F.format_string("%.0f", value), F.lit(" B"))
    for power, unit in enumerate(fv.BYTE_UNITS, start=1):
        scaled = value / F.lit(float(1024**power))
        text = F.when(scaled >= 10, F.format_string("%.0f", scaled)).otherwise(F.format_string("%.1f", scaled))
        shown = F.when(value >= F.lit(float(1024**power)), F.concat(text, F.lit(" " + unit))).otherwise(shown)
    return shown
