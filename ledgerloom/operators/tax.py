"""Income tax under two regimes from detected income and tagged evidence; whole major units.

Rate tables are a handful of fixed rows, so they become expressions instead of joins and every
step is one projection over (owner, period) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, text
from ledgerloom.operators import rollups


def slab_tax(taxable: Column, regime: str) -> Column:
    """Sum over slabs of the income inside the slab times its rate."""
    parts = []
    for lower, upper, rate in fv.TAX_SLABS[regime]:
        top = taxable if upper is None else F.least(taxable, F.lit(upper))
        parts.append(F.greatest(F.lit(0), top - F.lit(lower)).cast("double") * F.lit(rate))
    return reduce(lambda a, b: a + b, parts)


def rebate(taxable: Column, tax: Column, regime: str) -> Column:
    ceiling, largest, marginal = fv.TAX_REBATE[regime]
    excess = (taxable - F.lit(ceiling)).cast("double")
    above = F.when(F.lit(marginal) & (tax > excess), tax - excess).otherwise(F.lit(0.0))
    return F.when(taxable <= ceiling, F.least(tax, F.lit(float(largest)))).otherwise(above)


def surcharge_rate(taxable: Column, regime: str) -> Column:
    """Rate of the highest threshold strictly below the income."""
    rate = F.lit(0.0)
    for over, value in fv.TAX_SURCHARGE[regime]:
        rate = F.when(taxable > over, F.lit(value)).otherwise(rate)
    return rate


def regime_tax(df: DataFrame, taxable: Column, regime: str) -> DataFrame:
    """Adds <regime>_taxable, _tax, _rebate, _surcharge, _cess and _total; rounded at every step."""
    name = f"{regime}_".__add__
    df = df.withColumn(name("taxable"), F.greatest(F.lit(0), money.js_round(taxable.cast("double"))).cast("bigint"))
    income = F.col(name("taxable"))
    df = df.withColumn("_base", slab_tax(income, regime))
    df = df.withColumn(name("rebate"), rebate(income, F.col("_base"), regime))
    df = df.withColumn(name("tax"), money.js_round(F.col("_base") - F.col(name("rebate"))))
    df = df.withColumn(name("surcharge"), money.js_round(F.col(name("tax")) * surcharge_rate(income, regime)))
    levied = F.col(name("tax")) + F.col(name("surcharge"))
    df = df.withColumn(name("cess"), money.js_round(levied * F.lit(fv.CESS_RATE)))
    return df.withColumn(name("total"), levied + F.col(name("cess"))).drop("_base")


def canonical_section(tag: Column) -> Column:
    return text.literal_map(fv.SECTION_SPELLINGS)[F.lower(tag)]


def section_cap(section: Column) -> Column:
    caps = [x for name, cap in fv.DEDUCTION_CAPS.items() if cap is not None for x in (F.lit(name), F.lit(cap).cast("bigint"))]
    return F.create_map(*caps)[section]


def capped(detected: DataFrame) -> DataFrame:
    """Detected sections with cap and claimable amount; each input row gets the full cap."""
    cap = section_cap(F.col("section"))
    return detected.withColumns({"cap": cap, "amount": F.coalesce(F.least("raw_amount", cap), "raw_amount")})


def hra_exemption(rent_paid: Column, received: Column, basic: Column, city_tier: Column) -> Column:
    """Least of allowance received, rent over a tenth of basic pay, and the city share of basic."""
    share = F.when(city_tier == "metro", 0.5).otherwise(0.4)
    with_basic = F.least(received.cast("double"), rent_paid - basic * 0.1, share * basic)
    without = F.least(received.cast("double"), rent_paid.cast("double"))
    least = F.when(F.coalesce(basic, F.lit(0)) > 0, with_basic).otherwise(without)
    claim = F.greatest(F.lit(0).cast("bigint"), money.js_round(least))
    return F.when(F.coalesce(received, F.lit(0)) > 0, claim).otherwise(F.lit(0).cast("bigint"))


def compare_regimes(taxpayers: DataFrame) -> DataFrame:
    """Both regimes for rows with gross, itemised and employer_nps; a tie recommends the old one."""
    df = regime_tax(taxpayers, F.col("gross") - fv.STANDARD_DEDUCTION["old"] - F.col("itemised"), "old")
    nps = F.coalesce("employer_nps", F.lit(0))
    df = regime_tax(df, F.col("gross") - fv.STANDARD_DEDUCTION["new"] - nps, "new")
    return df.withColumns(
        {
            "recommended": F.when(F.col("old_total") <= F.col("new_total"), "old").otherwise("new"),
            "saving": F.abs(F.col("old_total") - F.col("new_total")),
        }
    )


def headroom(deductions: DataFrame) -> DataFrame:
    """What is left under each capped section."""
    limited = deductions.filter("cap is not null")
    left = F.col("cap") - F.col("amount")
    return limited.withColumns({"headroom": F.greatest(left, F.lit(0).cast("bigint")), "maxed": left <= 0})


def detected_sections(ledger: DataFrame, households: DataFrame, with_basic: bool = False) -> DataFrame:
    """Tagged sections per raw spelling, plus rent allowance where no row is tagged with it.

    `households`: owner_id, hra_received, basic_salary, city_tier. The allowance derived from rent rows
    knows no basic pay unless `with_basic` asks for it.
    """
    period = rollups.PERIOD
    tagged = rollups.tax_sections(ledger).withColumn("section", canonical_section(F.col("tax_section"))).filter("section is not null")
    tagged = tagged.select(*period, "section", money.to_major(F.col("minor")).alias("raw_amount"), "evidence")
    has_hra = tagged.filter("section = 'HRA'").select(*period)
    rent = rollups.rent_totals(ledger).filter("rent_minor > 0").join(has_hra, period, "left_anti").join(households, "owner_id", "left")
    basic = F.col("basic_salary") if with_basic else F.lit(None).cast("bigint")
    claim = hra_exemption(money.to_major(F.col("rent_minor")), F.col("hra_received"), basic, F.col("city_tier"))
    derived = rent.select(*period, F.lit("HRA").alias("section"), claim.alias("raw_amount"), F.col("rent_rows").alias("evidence"))
    return tagged.unionByName(derived)


def tax_rollup(ledger: DataFrame, households: DataFrame, supported: list[str] | None = None) -> DataFrame:
    """Regime comparison of every owner and supported year with income."""
    period = rollups.PERIOD
    years = fv.TAX_YEARS if supported is None else supported
    ledger = ledger.filter(F.col("fy_key").isin(years))
    deductions = capped(detected_sections(ledger, households)).groupBy(*period).agg(F.sum("amount").alias("itemised"))
    income = rollups.income_totals(ledger).filter("total > 0").select(*period, F.col("total").alias("gross"))
    taxpayers = income.join(deductions, period, "left").withColumns(
        {"itemised": F.coalesce("itemised", F.lit(0).cast("bigint")), "employer_nps": F.lit(0).cast("bigint")}
    )
    return compare_regimes(taxpayers)
